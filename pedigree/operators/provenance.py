"""Attestation patterns: streaks of attested releases per major version, regressions, carriers, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedigree.functions.columns import domain, major, param, semver_key, tied, trim_all
from pedigree.operators.grid import Relations
from pedigree.params import MACHINE_EMAIL, Params
from pedigree.session import cut


def skipped_rows(history: DataFrame) -> DataFrame:
    """Rows that the pattern passes over, with the reason."""
    usable = (F.length("version") > 0) & F.col("published_at_ms").isNotNull()
    first = F.row_number().over(Window.partitionBy("package_id", "version", usable).orderBy("input_idx"))
    reason = F.when(F.coalesce(F.length("version"), F.lit(0)) == 0, "missing or empty version").when(F.col("published_at_ms").isNull(), "missing or non-integer published_at_ms").when(first > 1, "duplicate_version")
    return history.withColumn("reason", reason).where("reason is not null").select("package_id", "input_idx", "reason")


def valid_rows(history: DataFrame) -> DataFrame:
    """Rows with a version and a time, the first of each version in input order, numbered by time and version; `mrn` numbers within a major."""
    rows = history.where((F.length("version") > 0) & F.col("published_at_ms").isNotNull())
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("package_id", "version").orderBy("input_idx"))).where("_k = 1").drop("_k")
    address = F.when(F.length("publisher_email") > 0, F.lower(trim_all(F.col("publisher_email"))))
    rows = rows.withColumns({"email": address, "name": F.nullif("publisher_name", F.lit("")), "major": major(F.col("version"))})
    order = ["published_at_ms", F.when(F.col("_tied"), semver_key(F.col("version"))), "input_idx"]
    rows = rows.withColumn("_tied", tied("package_id", "published_at_ms"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("package_id").orderBy(*order)).cast("long") - 1).drop("_tied")
    return rows.withColumn("mrn", F.row_number().over(Window.partitionBy("package_id", "major").orderBy("rn")).cast("long") - 1)


def streaks(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """Attested releases in a row before and after each one; an unknown attestation leaves the streak as it is."""
    by = Window.partitionBy("package_id", "major").orderBy("rn")
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    yes = F.when(F.col("provenance_present"), 1).otherwise(0)
    rows = rows.withColumns({"_c": F.coalesce(F.sum(yes).over(before), F.lit(0)), "_n": F.sum(yes).over(upto)})
    rows = rows.withColumn("_reset", F.when(~F.col("provenance_present"), F.col("_n")))
    rows = rows.withColumn("prior_streak", F.col("_c") - F.coalesce(F.max("_reset").over(before), F.lit(0)))
    after = F.when(F.col("provenance_present"), F.col("prior_streak") + 1).when(~F.col("provenance_present"), 0).otherwise(F.col("prior_streak"))
    need = param(p.min_baseline_streak)
    rows = rows.withColumn("streak_after", after).withColumn("_reached", (F.max("streak_after").over(upto) >= need))
    enough = F.count("*").over(Window.partitionBy("package_id")) >= param(p.min_history)
    baseline = F.col("prior_streak") >= need
    return rows.withColumns({
        "baseline_established": enough & baseline,
        "provenance_regression": enough & baseline & F.coalesce(~F.col("provenance_present"), F.lit(False)),
        "in_scope": enough & F.col("_reached"),
    }).drop("_c", "_n", "_reset", "_reached")


def carried_by(rows: DataFrame) -> DataFrame:
    """Whether a machine, or anyone else with an address, published one of a row's baseline: the last rows of its major, as many as the streak is long."""
    before = Window.partitionBy("package_id", "major").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda cond: F.coalesce(F.max(F.when(cond, F.col("mrn"))).over(before) >= F.col("mrn") - F.col("prior_streak"), F.lit(False))
    return rows.withColumns({"any_machine": latest(F.col("email") == MACHINE_EMAIL), "any_human": latest(F.col("email") != MACHINE_EMAIL)})


def carriers(records: DataFrame, where: str = "baseline_established") -> DataFrame:
    """Names and addresses that published the rows which carry the baseline of each record.

    The slices of a major start later and later, so a row lies in those of a run of records. It hands its name to
    the records from the next one to the last of that run or, if the name comes again before, to there: each name
    of a record is made once, and nothing else is.
    """
    rows = records.withColumns({"_m": F.coalesce("major", F.lit(-1).cast("decimal(38,0)")), "_start": F.col("mrn") - F.col("prior_streak")})
    starts = rows.groupBy("package_id", "_m", F.col("_start").alias("mrn")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("package_id", "_m").orderBy("mrn").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.select("package_id", "_m", "mrn", "name", "email").join(starts, ["package_id", "_m", "mrn"], "left").withColumn("_last", F.coalesce(F.sum("_n").over(upto), F.lit(0)) - 1)
    held = held.select("package_id", "_m", "mrn", "_last", F.explode(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("who")), F.struct(F.lit("email").alias("kind"), F.col("email").alias("who")))).alias("_x")).select("package_id", "_m", "mrn", "_last", "_x.*").where("who is not null")
    again = F.lead("mrn").over(Window.partitionBy("package_id", "_m", "kind", "who").orderBy("mrn"))
    runs = held.withColumn("_until", F.least("_last", again)).where("_until > mrn")
    each = runs.select("package_id", "_m", "kind", "who", F.explode(F.sequence(F.col("mrn") + 1, F.col("_until"))).alias("mrn"))
    named = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("who"))))
    found = each.groupBy("package_id", "_m", "mrn").agg(named("name").alias("identities"), named("email").alias("emails"))
    none = F.array().cast("array<string>")
    out = rows.where(where).where("prior_streak > 0").join(found, ["package_id", "_m", "mrn"], "left")
    return out.select("package_id", "version", "rn", F.coalesce("identities", none).alias("identities"), F.coalesce("emails", none).alias("emails"), "any_machine", "any_human")


def per_major(records: DataFrame, p: Params = Params()) -> DataFrame:
    """Totals, longest streak, first version to reach the baseline and regressions of every major."""
    reached = F.col("streak_after") >= param(p.min_baseline_streak)
    return records.groupBy("package_id", "major").agg(
        F.count("*").alias("total_versions"), F.count_if("provenance_present").alias("attested_versions"), F.max("streak_after").alias("max_consecutive_attested"),
        F.min_by(F.when(reached, F.col("version")), F.when(reached, F.col("rn"))).alias("baseline_reached_at"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("provenance_regression"), F.struct("rn", "version")))), lambda x: x["version"]).alias("regression_versions"),
    )


def rollup(records: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per package with rows."""
    need = param(p.min_baseline_streak)
    attested, reached = F.col("provenance_present"), F.col("streak_after") >= need
    return records.groupBy("package_id").agg(
        F.count("*").alias("total_versions"), F.count_if(attested).alias("attested_versions"), F.max("streak_after").alias("max_consecutive_attested"),
        (F.max_by("streak_after", "rn") >= F.first(need)).alias("has_baseline_at_head"), F.count_if("provenance_regression").alias("regression_count"),
        F.count_if(attested & (F.col("email") == MACHINE_EMAIL)).alias("machine_attested_versions"), F.count_if(attested & (F.col("email") != MACHINE_EMAIL)).alias("human_attested_versions"),
        F.min_by(F.when(attested, F.col("version")), F.when(attested, F.col("rn"))).alias("first_attested_version"),
        F.min_by(F.when(reached, F.col("version")), F.when(reached, F.col("rn"))).alias("first_baseline_reached_at"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("provenance_regression"), F.struct("rn", "version")))), lambda x: x["version"]).alias("regression_versions"),
    )


def records_of(history: DataFrame, p: Params = Params()) -> DataFrame:
    """Every valid row with its streak, its domain's releases and first time in the package, and who carries its baseline."""
    rows = carried_by(streaks(valid_rows(history), p)).withColumn("domain", domain(F.col("email")))
    of_domain = Window.partitionBy("package_id", "domain")
    return rows.withColumns({"domain_versions": F.count("*").over(of_domain), "domain_first_ms": F.min("published_at_ms").over(of_domain)})


def extract(history: DataFrame, p: Params = Params(), shared: bool = True) -> Relations:
    """All relations of the pattern, made on demand: per_version (checkpointed if `shared`), carriers, rollup, per_major, skipped."""
    keep = cut if shared else (lambda df: df)
    found = Relations(
        per_version=lambda: keep(records_of(history, p)), carriers=lambda: carriers(found["per_version"]), rollup=lambda: rollup(found["per_version"], p),
        per_major=lambda: per_major(found["per_version"], p), skipped=lambda: skipped_rows(history),
    )
    return found
