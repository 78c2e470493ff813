"""Patterns kept up to date: releases come in, the patterns of the packages that they touch are made anew.

What a package's early blocks mean may change with later releases, so a pattern is never appended to: a batch names
its packages, their whole histories go through the patterns again, and the result takes the place of theirs. History
and results lie in buckets of packages; a batch reads and replaces only the buckets of its packages (dynamic partition
overwrite), where the rows of other packages are taken over as they are. Files of other buckets are not touched.

A batch that is run again changes nothing in the history (rows that are there are passed over) and makes the same
results, so a job that was stopped halfway is mended by its next run. Results are checkpointed before they replace
what they were partly read from.

Defined cases: rows without a package are passed over; a row is known by package, version and position in the input; a
late release takes its place in the history; an empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pedigree.operators import provenance, publisher
from pedigree.operators.grid import Grid
from pedigree.params import Params
from pedigree.session import cut

ROW = ["package_id", "version", "input_idx"]


def relations(history: DataFrame, p: Params = Params()) -> dict[str, DataFrame]:
    """The relations that are kept: tenure and summary of owners, records and rollup of attestations."""
    owners, attested = publisher.extract(history, Grid(base=p)), provenance.extract(history, p)
    return {"tenure": owners["tenure"], "summary": owners["summary"], "per_version": attested["per_version"], "rollup": attested["rollup"]}


def only(name: str, history: DataFrame, p: Params = Params()) -> dict[str, DataFrame]:
    """One of these relations, for who keeps no other: nothing is shared, so nothing is checkpointed on the way."""
    if name in ("tenure", "summary"):
        return {name: publisher.extract(history, Grid(base=p), shared=False)[name]}
    return {name: provenance.extract(history, p, shared=False)[name]}


class PatternTables:
    """Releases and the patterns of their packages under one folder, in buckets of packages."""

    def __init__(self, spark: SparkSession, path: str, p: Params = Params(), buckets: int = 64, make: Callable[[DataFrame, Params], dict[str, DataFrame]] = relations):
        self.spark, self.path, self.p, self.buckets, self.make = spark, path.rstrip("/"), p, buckets, make

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod("package_id", F.lit(self.buckets)).cast("int"))

    def read(self, name: str) -> DataFrame | None:
        """A table with its column `bucket`; None before it is first written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        exists = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(f"{self.path}/{name}") if exists else None

    def table(self, name: str) -> DataFrame:
        """A relation as it is now."""
        return self.read(name).drop("bucket")

    def update(self, releases: DataFrame) -> None:
        """One batch of releases (a release history's columns)."""
        rows = cut(self._bucket(releases.where("package_id is not null").dropDuplicates(ROW)))
        touched = rows.select("package_id").distinct()
        numbers = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        if not numbers:
            return
        mine = F.col("bucket").isin(numbers)
        stored = self.read("history")
        new = self._unknown(rows, stored, mine)
        new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/history")
        whole = self.read("history").where(mine).join(touched, "package_id", "left_semi").drop("bucket").select(*releases.columns)
        for name, made in self.make(whole, self.p).items():
            made, old = self._bucket(made), self.read(name)
            if old is not None:
                made = made.unionByName(old.where(mine).join(touched, "package_id", "left_anti"))
            cut(made).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    @staticmethod
    def _unknown(rows: DataFrame, stored: DataFrame | None, mine) -> DataFrame:
        """Rows that the history does not hold; nulls are values like others."""
        if stored is None:
            return rows
        known = stored.where(mine).select(*ROW).alias("known")
        same = F.lit(True)
        for c in ROW:
            same = same & F.expr(f"new.{c} <=> known.{c}")
        return rows.alias("new").join(known, same, "left_anti")

    def attach(self, releases: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Follow a stream of releases."""
        return releases.writeStream.foreachBatch(lambda df, batch: self.update(df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
