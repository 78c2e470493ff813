"""Observation as a stream: registry documents come in, baselines and changed decisions go out.

Every micro-batch reads the store as it was at its start, judges the incoming releases against it,
appends the new baselines and the decisions that differ from the latest ones. What an attempt at a batch writes carries the
attempt's mark; the last thing written is its row in `finished`, and readers see rows of finished attempts only. So
releases, files, decisions, sightings and quarantine of a batch become visible in one step, an attempt that is stopped
in between leaves nothing visible, and a batch that is finished is not done again. There is no watermark: histories are judged whole, and
a late release simply takes its place in them.

Releases and decisions lie in buckets of packages; a batch reads the buckets of its own packages only.
Overrides let a release pass whatever the gates say. First publications of dependencies come in by a second
stream of looked-up documents; the gates use what is known when a batch starts, and `wanted` names what is
still to be looked up (errors again after a while). `admit` lets only so many names be asked at a time: it refuses those
that are being asked and counts those for which there is no room.

A release is kept with all fields of its document and its files, in one row; `last_seen` tells when it was observed.

Whatever can't be read fails open. A document that is no JSON object, or makes the projection fail, goes to
`quarantine`; an entry that is no object is no release. A release whose gates fail is let through without results, noted in
quarantine, and the others of its batch are judged as usual; a gate that gives no known result is skipped. Of two rows with one
version in a batch the one with the greatest digest counts.

`compact` puts the small files of buckets together, one file a bucket, by overwriting those partitions only; rows of attempts that were
never finished go. It must not run beside a batch or a reader of those buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from pedigree.operators import gates, projection
from pedigree.operators.store import look_up, publish_millis
from pedigree.params import Params
from pedigree.session import cut
from pedigree.streaming.isolation import isolate

DECISIONS = "package_id long, version string, disposition string, results array<struct<gate:string,result:string,detail:string>>, batch long, bucket int"
OVERRIDES = "package_name string, version string, reason string, removed boolean, created_ms long"
LOOKUPS = "dep string, status string, first_publish_ms long, fetched_at_ms long, batch long"
ASKED = "dep string, asked_ms long, batch long"
DROPPED = "batch long, dropped long"
SEEN = "package_id long, version string, seen_ms long, batch long"
QUARANTINE = "package_name string, version string, stage string, error string, batch long"
FINISHED = "batch long, attempt string"
#: Tables whose rows become visible with their batch; rows without an attempt (of a compacted bucket) are visible.
IN_ONE_STEP = ("versions", "decisions", "seen", "quarantine")
BUCKETS = 64
RELEASE, RELEASE_NAME = ["package_id", "version"], ["package_name", "version"]


def released(documents: DataFrame) -> DataFrame:
    """The releases of documents with all fields, their keys, `deps` and `has_script`."""
    rows = projection.project(documents)
    deps = F.coalesce(F.json_object_keys("dependencies"), F.array().cast("array<string>"))
    rows = rows.withColumns({"deps": deps, "has_script": F.col("has_install_scripts"), "version_id": F.xxhash64("package_name", "version"), "package_id": F.xxhash64("package_name")})
    return rows.withColumn("bucket", F.pmod("package_id", F.lit(BUCKETS)).cast("int"))


class WitnessStore:
    """Append-only tables of releases and decisions under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _read(self, name: str, schema: str | StructType, before: int | None) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        if name in IN_ONE_STEP:
            df = self._visible(name, schema)
        else:
            df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return df if before is None else df.where(F.col("batch") < before)

    def _visible(self, name: str, schema: str | StructType) -> DataFrame:
        """Rows of finished attempts. The list of these is read first, so that a reader sees a batch in all tables or in none."""
        empty = self.spark.createDataFrame([], schema)
        finished = self._read("finished", FINISHED, None).select("attempt")
        df = self.spark.read.schema(StructType([*empty.schema, StructField("attempt", StringType())])).parquet(f"{self.path}/{name}")
        told = df.where("attempt is not null").join(finished, "attempt", "left_semi")
        return told.unionByName(df.where("attempt is null")).select(*empty.columns)

    def finished(self) -> DataFrame:
        """The finished batches: batch, attempt."""
        return self._read("finished", FINISHED, None)

    def compact(self, least: int = 2) -> dict[str, int]:
        """Put the files of each bucket that has at least `least` of them into one, by overwriting that bucket; returns how many buckets of each table."""
        out = {}
        for name, read in (("versions", self.releases), ("decisions", self.decisions)):
            out[name] = 0
            if self._exists(name):
                files = self.spark.read.parquet(f"{self.path}/{name}").select("bucket", F.input_file_name().alias("f")).distinct().groupBy("bucket").count()
                buckets = [r["bucket"] for r in files.where(F.col("count") >= least).collect()]  # at most BUCKETS numbers
                if buckets:
                    rows = cut(read().where(F.col("bucket").isin(buckets)))
                    rows = rows.withColumn("attempt", F.lit(None).cast("string")).repartition(len(buckets), "bucket").sortWithinPartitions("bucket", *RELEASE)
                    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
                    out[name] = len(buckets)
        return out

    def _append(self, rows: DataFrame, name: str, schema: str) -> None:
        rows.select(*[c.split()[0] for c in schema.split(", ")], *(["attempt"] if name in IN_ONE_STEP else [])).write.mode("append").parquet(f"{self.path}/{name}")

    def releases(self, before: int | None = None) -> DataFrame:
        """Baselines: all fields of a release, `files`, deps, has_script, version_id, package_id, batch, bucket."""
        empty = released(self.spark.createDataFrame([], "document string")).withColumn("batch", F.lit(0).cast("long"))
        return self._read("versions", empty.schema, before).select(*empty.columns)

    def files(self) -> DataFrame:
        """File rows of the baselines."""
        return projection.version_files(self.releases())

    def last_seen(self) -> DataFrame:
        """When each release was last observed: package_id, version, seen_ms."""
        return self._read("seen", SEEN, None).groupBy(*RELEASE).agg(F.max("seen_ms").alias("seen_ms"))

    def quarantine(self) -> DataFrame:
        """What failed: package_name and version (null for a document), stage, error, batch."""
        return self._read("quarantine", QUARANTINE, None)

    def decisions(self, before: int | None = None) -> DataFrame:
        return self._read("decisions", DECISIONS, before)

    def overrides(self) -> DataFrame:
        """The overrides in force: package_id, package_name, version, reason, created_ms, the newest first."""
        log = self._read("overrides", OVERRIDES, None)
        last = log.groupBy("package_name", "version").agg(F.max(F.struct("created_ms", "removed", "reason")).alias("x")).where("not x.removed")
        return last.select(F.xxhash64("package_name").alias("package_id"), "package_name", "version", "x.reason", "x.created_ms").orderBy(F.desc("created_ms"), "package_name", "version")

    def override(self, rows: DataFrame, now_ms: int, removed: bool = False) -> None:
        """Let releases (package_name, version, reason) pass, or take that back."""
        rows.select("package_name", "version", F.col("reason").cast("string"), F.lit(removed).alias("removed"), F.lit(now_ms).cast("long").alias("created_ms")).write.mode("append").parquet(f"{self.path}/overrides")

    def lookups(self) -> DataFrame:
        """What is known of dependencies: dep, status, first_publish_ms, fetched_at_ms, attempts."""
        log = self._read("lookups", LOOKUPS, None)
        return log.groupBy("dep").agg(F.max(F.struct("fetched_at_ms", "batch", "status", "first_publish_ms")).alias("x"), F.count("*").alias("attempts")).select("dep", "x.status", "x.first_publish_ms", "x.fetched_at_ms", "attempts")

    def wanted(self, now_ms: int, p: Params = Params()) -> DataFrame:
        """Dependencies of the newest baselines without a lookup that still holds."""
        deps = self.releases().select(F.explode("deps").alias("dep")).distinct()
        return look_up(deps, self.lookups(), now_ms, p).where("not hit").select("dep")

    def admit(self, names: DataFrame, batch: int, now_ms: int, bound: int = 100, patience_ms: int = 60_000, p: Params = Params()) -> DataFrame:
        """The names (column `dep`) that are to be asked now, noted as being asked; at most `bound` are without an answer at a time.

        Refused are names that are being asked or whose lookup still holds; those for which there is no room are counted
        (`dropped`) and come again when they are wanted again. A question without an answer is given up after `patience_ms`.
        """
        told = self.lookups().select("dep", F.col("fetched_at_ms").alias("_told"))
        log = self._read("asked", ASKED, None)
        waiting = cut(log.where(F.lit(now_ms) - F.col("asked_ms") < patience_ms).join(told, "dep", "left").where("_told is null or _told < asked_ms").select("dep").distinct())  # at most `bound` rows
        again = log.where(F.col("batch") == batch).select("dep").distinct()
        fresh = look_up(names.where("dep <> ''").select("dep").distinct(), self.lookups(), now_ms, p).where("not hit").select("dep").join(waiting, "dep", "left_anti")
        room = max(0, bound - waiting.count())
        fresh = cut(fresh)
        taken = cut(fresh.orderBy("dep").limit(room))
        self._append(self.spark.createDataFrame([(batch, fresh.count() - taken.count())], DROPPED), "dropped", DROPPED)
        self._append(taken.select("dep", F.lit(now_ms).cast("long").alias("asked_ms"), F.lit(batch).cast("long").alias("batch")), "asked", ASKED)
        return taken.unionAll(again).distinct()  # a batch that is run again asks the same names

    def dropped(self) -> DataFrame:
        """Names for which there was no room, by batch."""
        return self._read("dropped", DROPPED, None).groupBy("batch").agg(F.max("dropped").alias("dropped"))

    def enrich(self, answers: DataFrame, batch: int, now_ms: int) -> None:
        """One micro-batch of answers (dep, code, document): found, gone (404), or an error; a replayed batch changes nothing."""
        told = answers.withColumn("first_publish_ms", publish_millis("document"))
        found = (F.col("code") == 200) & F.col("first_publish_ms").isNotNull()
        status = F.when(F.col("code") == 404, "vanished").when(found, "ok").otherwise("error")
        rows = told.select("dep", status.alias("status"), F.when(found, F.col("first_publish_ms")).alias("first_publish_ms"), F.lit(now_ms).cast("long").alias("fetched_at_ms"), F.lit(batch).cast("long").alias("batch")).dropDuplicates(["dep"])
        done = self._read("lookups", LOOKUPS, None).where(F.col("batch") == batch).select("dep")
        rows.join(done, "dep", "left_anti").write.mode("append").parquet(f"{self.path}/lookups")

    def observe(self, documents: DataFrame, batch: int, now_ms: int, p: Params = Params(), known: dict[str, gates.Gate] | None = None, can_look_up: bool = True) -> None:
        """One micro-batch of documents (column `document`)."""
        if not self.finished().where(F.col("batch") == batch).isEmpty():
            return
        attempt = F.lit(uuid.uuid4().hex).alias("attempt")
        documents = documents.select("document", F.xxhash64("document").alias("_digest"))
        rows, broken = isolate(documents, ["_digest"], released)
        unread = documents.where(~F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("document")), F.lit("OBJECT")), F.lit(False)))
        self._append(unread.select(*[F.lit(None).cast("string").alias(c) for c in RELEASE_NAME], F.lit("document").alias("stage"), F.lit("no JSON object").alias("error"), F.lit(batch).cast("long").alias("batch"), attempt), "quarantine", QUARANTINE)
        bad = [(None, None, "document", error, batch) for _, error in broken]
        if rows is not None:
            bad += self._judge(rows, batch, now_ms, p, known, can_look_up, attempt)
        if bad:
            self._append(self.spark.createDataFrame(bad, QUARANTINE).withColumn("attempt", attempt), "quarantine", QUARANTINE)
        self._append(self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"), attempt), "finished", FINISHED)

    def _judge(self, rows: DataFrame, batch: int, now_ms: int, p: Params, given: dict[str, gates.Gate] | None, can_look_up: bool, attempt: Column) -> list[tuple]:
        """Write baselines and decisions of a batch's releases; returns quarantine rows."""
        whole = F.struct(*[c for c in rows.columns if c not in RELEASE])
        incoming = rows.groupBy(*RELEASE).agg(F.max_by(whole, F.xxhash64(*rows.columns)).alias("_x")).select(*RELEASE, "_x.*")
        incoming = cut(incoming.withColumn("batch", F.lit(batch).cast("long")))
        mine = F.col("bucket").isin([r["bucket"] for r in incoming.select("bucket").distinct().collect()])  # at most BUCKETS numbers
        stored = self.releases(batch).where(mine).join(incoming.select("package_id").distinct(), "package_id", "left_semi")
        deps = lambda df: df.select("version_id", F.explode("deps").alias("dep"))
        cache, overrides = self.lookups() if can_look_up else None, self.overrides()

        def judge(some: DataFrame) -> DataFrame:
            prepared = gates.facts(some.drop("has_script"), stored, deps(some), deps(stored), some.select("version_id", "has_script"), cache, now_ms, p)
            return gates.run_gates(prepared, overrides, p, given)

        judged, failed = isolate(incoming, [*RELEASE, "package_name"], judge)
        first = F.array(F.struct(F.lit("first-seen").alias("gate"), F.lit("SKIP").alias("result"), F.lit("first observation: baseline recorded").alias("detail")))
        kept = stored.select(*RELEASE, F.lit(True).alias("_known"))
        latest = self.decisions(batch).where(mine).groupBy(*RELEASE).agg(F.max_by("disposition", "batch").alias("_latest"))
        passed = self.spark.createDataFrame([(i, v, "ALLOW", []) for i, v, _, _ in failed], "package_id long, version string, disposition string, results array<struct<gate:string,result:string,detail:string>>").withColumn("_failed", F.lit(True))
        told = passed if judged is None else judged.withColumn("_failed", F.lit(False)).unionByName(passed)
        told = told.join(kept, RELEASE, "left").join(latest, RELEASE, "left")
        told = told.where("_latest is null or _latest <> disposition").withColumn("results", F.when(F.col("_known") | F.col("_failed"), F.col("results")).otherwise(F.concat(first, F.col("results"))))
        told = told.select(*RELEASE, "disposition", "results", F.lit(batch).cast("long").alias("batch"))
        told = told.select(*[c.split()[0] for c in DECISIONS.split(", ")[:3]], "results", "batch", F.pmod("package_id", F.lit(BUCKETS)).cast("int").alias("bucket"), attempt)
        new = incoming.join(self.releases().where(mine).select(*RELEASE), RELEASE, "left_anti").select(*self.releases().columns, attempt)
        new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/versions")
        self._append(incoming.select(*RELEASE, F.lit(now_ms).cast("long").alias("seen_ms"), "batch", attempt), "seen", SEEN)
        told.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/decisions")
        return [(name, v, "gates", error, batch) for _, v, name, error in failed]

    def attach(self, documents: DataFrame, checkpoint: str, now_ms: int, p: Params = Params(), **trigger) -> StreamingQuery:
        """Observe a stream of documents."""
        return documents.writeStream.foreachBatch(lambda df, batch: self.observe(df, batch, now_ms, p)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def attach_lookups(self, answers: DataFrame, checkpoint: str, now_ms: int, **trigger) -> StreamingQuery:
        """Note a stream of answers (dep, code, document)."""
        return answers.writeStream.foreachBatch(lambda df, batch: self.enrich(df, batch, now_ms)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
