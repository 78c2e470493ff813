"""Keeping a store: overrides, settings, what is carried into a new store, checks of the store and of its release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pedigree.operators.store import upsert

#: Exit classes of a set of checks.
EXITS = {"ok": 0, "error": 1, "tamper": 5, "unverifiable": 6}


def list_overrides(overrides: DataFrame, created: str = "created_at") -> DataFrame:
    """Overrides, the newest first."""
    return overrides.orderBy(F.desc(created), "package_name", "version")


def remove_overrides(overrides: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    return overrides.join(removed.select(*key).distinct(), key, "left_anti")


def set_values(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """A key/value table (key, value, seq) after changes; the last change of a key counts."""
    return upsert(settings, changes, ["key"])


def seen_packages(packages: DataFrame, observed: DataFrame, at: Column) -> DataFrame:
    """(package_id, package_name, first_seen_at, last_seen_at) after packages were observed again or for the first time.

    An id follows from the name, so that writers need no common counter.
    """
    new = observed.select("package_name").distinct().withColumn("_at", at)
    both = packages.join(new, "package_name", "full_outer")
    return both.select(F.coalesce("package_id", F.xxhash64("package_name")).alias("package_id"), "package_name", F.coalesce("first_seen_at", "_at").alias("first_seen_at"), F.coalesce("_at", "last_seen_at").alias("last_seen_at"))


def carry_decisions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Decisions of a new store with those of the old one; they have no key, so all stay."""
    return new.unionByName(old.select(*new.columns))


def carry_overrides(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Overrides of a new store with those of the old one in their place."""
    return old.unionByName(new.select(*old.columns).join(old.select(*key), key, "left_anti"))


def swap(spark: SparkSession, staged: str, live: str) -> None:
    """Put a staged folder in the place of the live one by renames; if the second rename fails the old one comes back."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    staged_, live_, kept = path(staged), path(live), path(live.rstrip("/") + ".bak")
    system = live_.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(staged_):
        raise FileNotFoundError(staged)
    had = system.exists(live_)
    if had and not system.rename(live_, kept):
        raise OSError(f"{live} can't be set aside")
    if not system.rename(staged_, live_):
        if had:
            system.rename(kept, live_)
        raise OSError(f"{staged} can't take the place of {live}")
    if had:
        system.delete(kept, True)


def import_store(spark: SparkSession, tables: dict[str, DataFrame], live: str) -> None:
    """Write a new store beside the live one, with the live one's decisions and overrides, and swap."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    staged = live.rstrip("/") + ".new"
    system = path(live).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, rows in tables.items():
        old = f"{live.rstrip('/')}/{name}"
        if name in ("decisions", "overrides") and system.exists(path(old)):
            kept = spark.read.parquet(old)
            rows = carry_decisions(rows, kept) if name == "decisions" else carry_overrides(rows, kept, ["package_id", "version"])
        rows.write.mode("overwrite").parquet(f"{staged}/{name}")
    swap(spark, staged, live)


def migrated(spark: SparkSession, tables: dict[str, DataFrame], schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The tables with all that the schemas name: a missing table is empty, a missing column null; others stay as they are."""
    out = dict(tables)
    for name, schema in schemas.items():
        rows = out[name] if name in out else spark.createDataFrame([], schema)
        out[name] = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in rows.columns])
    return out


def store_version(settings: DataFrame, key: str = "seed_version") -> str | None:
    """The version that a store's settings (key, value) name, null if they name none."""
    row = settings.where(F.col("key") == key).agg(F.max("value").alias("v")).first()
    return row["v"] if row else None


def update_store(spark: SparkSession, tables: dict[str, DataFrame], live: str, verdict: str, schemas: dict[str, StructType] | None = None, force: bool = False) -> str:
    """Put a downloaded store in the place of the live one: `updated`, `current` (same version, nothing is done), or
    `refused: ...` if the bundle's verdict (`bundle.verify`) is not ok.

    Versions are the `seed_version` of the `settings` tables; without one in either store they count as different. The
    live store's decisions and overrides are kept, its tables and columns that the bundle is too old to know come into being.
    """
    if verdict != "ok":
        return f"refused: {verdict}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{live.rstrip('/')}/settings")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    now = store_version(spark.read.parquet(str(path))) if there else None
    new = store_version(tables["settings"]) if "settings" in tables else None
    if now is not None and now == new and not force:
        return "current"
    import_store(spark, migrated(spark, tables, schemas or {}), live)
    return "updated"


def newest_release(releases: DataFrame, pattern: str) -> DataFrame:
    """Of (tag, published_at, ...) the newest with a matching tag; a missing date counts as the oldest."""
    return releases.where(F.col("tag").rlike(pattern)).orderBy(F.coalesce(F.unix_millis(F.col("published_at").try_cast("timestamp")), F.lit(0)).desc(), "tag").limit(1)


def self_check(installed: DataFrame, stored: DataFrame, stored_names: DataFrame) -> DataFrame:
    """(package_name, version, status, reason, severity): installed packages (package_name, version, integrity) held against the store."""
    base = stored.select("package_name", "version", F.col("integrity_hash").alias("_base"))
    known = stored_names.select("package_name").distinct().withColumn("_known", F.lit(True))
    out = installed.join(base, ["package_name", "version"], "left").join(known, "package_name", "left")
    reason = F.when(F.col("integrity").isNull(), "lockfile_missing").when(F.col("_base").isNull(), "not_in_witness").when(F.col("_base") != F.col("integrity"), "integrity_mismatch").otherwise("integrity_match")
    status = F.when(reason == "integrity_match", "verified").when(reason == "integrity_mismatch", "tamper").otherwise("unverifiable")
    skipped = (reason == "lockfile_missing") | ((reason == "not_in_witness") & F.col("_known").isNull())
    severity = F.when(status == "tamper", "tamper").when(skipped, "skipped").when(status == "unverifiable", "unverifiable")
    return out.select("package_name", "version", status.alias("status"), reason.alias("reason"), severity.alias("severity"))


def exit_class(checks: DataFrame) -> DataFrame:
    """The exit class of (passed, severity) checks: tampering, then plain failures, then what can't be verified, else ok."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    name = F.when(some(F.col("severity") == "tamper"), "tamper").when(some(~F.col("passed") & F.col("severity").isNull()), "error").when(some(F.col("severity") == "unverifiable"), "unverifiable").otherwise("ok")
    return checks.agg(F.count("*").alias("checks"), name.alias("exit")).withColumn("exit_code", F.element_at(F.create_map(*[x for k, v in EXITS.items() for x in (F.lit(k), F.lit(v))]), F.col("exit")))


def sql_time(millis: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` in UTC."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss")


def parse_sql_time(text: Column) -> Column:
    """Milliseconds of such a text, null of anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.unix_millis(text.try_cast("timestamp")))
