"""Point queries over the store, as a user of the command line would ask them; all answers are DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.functions.names import target
from pedigree.operators import store

KEY = ["package_name", "version"]


def check(targets: DataFrame, log: DataFrame, overrides: DataFrame) -> DataFrame:
    """For `name@version` texts (column `target`): the effective disposition and an exit code (0 allow, 2 warn, 3 block, 4 not seen)."""
    asked = targets.withColumn("_t", target(F.col("target"))).select("target", F.col("_t.name").alias("package_name"), F.col("_t.version").alias("version"))
    latest = store.effective(store.latest_decisions(log, KEY), overrides, KEY)
    out = asked.join(latest, KEY, "left")
    code = F.when(F.col("disposition") == "ALLOW", 0).when(F.col("disposition") == "WARN", 2).when(F.col("disposition") == "BLOCK", 3).otherwise(4)
    return out.select("target", F.coalesce("disposition", F.lit("UNKNOWN")).alias("disposition"), F.coalesce("overridden", F.lit(False)).alias("overridden"), code.alias("exit_code"))


def why(name: str, version: str, log: DataFrame) -> DataFrame:
    """The gates' results behind the newest decision on one release."""
    one = log.where((F.col("package_name") == name) & (F.col("version") == version)).groupBy(*KEY).agg(F.max_by(F.struct("disposition", "results"), "obs").alias("d"))
    return one.select("package_name", "version", "d.disposition", F.explode("d.results").alias("r")).select("package_name", "version", "disposition", "r.gate", "r.result", "r.detail")


def status(releases: DataFrame, log: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row of totals."""
    counts = store.decision_counts(log).withColumnRenamed("total", "decisions")
    sizes = releases.agg(F.countDistinct("package_id").alias("packages"), F.count("*").alias("versions"))
    # Three rows of totals side by side.
    return counts.withColumn("_k", F.lit(1)).join(sizes.withColumn("_k", F.lit(1)), "_k").join(overrides.agg(F.count("*").alias("overrides")).withColumn("_k", F.lit(1)), "_k").drop("_k")
