"""The witness store: append-only baselines, a decision log that keeps changes only, overrides and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedigree.functions.columns import is_prerelease, is_semver, iso_millis, param, semver_key
from pedigree.params import Params
from pedigree.session import cut

KEY = ["package_id", "version_id"]


def append_new(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, the first of each key: what an insert-or-ignore would add."""
    return incoming.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def upsert(stored: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with the changes in their place; of several changes the one with the greatest `seq` counts."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc("seq")))
    return both.withColumn("_r", last).where("_r = 1").drop("_r", "_new")


def changed_decisions(observed: DataFrame, key: list[str] = KEY, order: str = "obs") -> DataFrame:
    """Of repeated decisions on a release the first and each one that differs from its predecessor."""
    before = F.lag("disposition").over(Window.partitionBy(*key).orderBy(order))
    return observed.withColumn("_before", before).where("_before is null or _before <> disposition").drop("_before")


def latest_decisions(log: DataFrame, key: list[str] = KEY, order: str = "obs") -> DataFrame:
    """The newest decision of every release.

    The newest of each kind are kept as numbers, which aggregates by hash; a maximum by text would sort the whole log.
    """
    kinds = ("ALLOW", "WARN", "BLOCK")
    newest = log.groupBy(*key).agg(F.max(order).alias(order), *(F.max(F.when(F.col("disposition") == d, F.col(order))).alias(f"_{d}") for d in kinds))
    return newest.select(*key, F.coalesce(*(F.when(F.col(f"_{d}") == F.col(order), d) for d in kinds)).alias("disposition"), order)


def recent(log: DataFrame, n: int, *order: str) -> DataFrame:
    """The n newest decisions."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)


def decision_counts(log: DataFrame) -> DataFrame:
    """Decisions in all and of each kind, zeros included."""
    return log.agg(F.count("*").alias("total"), *(F.count_if(F.col("disposition") == d).alias(d.lower()) for d in ("ALLOW", "WARN", "BLOCK")))


def denials(latest: DataFrame, overrides: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Releases whose newest decision is BLOCK and that no override lets pass."""
    return latest.where(F.col("disposition") == "BLOCK").join(overrides.select(*key), key, "left_anti")


def effective(latest: DataFrame, overrides: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Newest decisions with the override's say: disposition, overridden."""
    over = overrides.select(*key, F.lit(True).alias("_over"))
    return latest.join(over, key, "left").select(*key, F.when(F.col("_over"), "ALLOW").otherwise(F.col("disposition")).alias("disposition"), F.coalesce("_over", F.lit(False)).alias("overridden"))


def history(stored: DataFrame, latest: DataFrame, per_package: int = 20) -> DataFrame:
    """The newest releases of every package with their newest decision."""
    newest = Window.partitionBy("package_id").orderBy(F.desc_nulls_last("published_at"), F.desc("version_id"))
    return stored.withColumn("place", F.row_number().over(newest).cast("long")).where(F.col("place") <= per_package).join(latest.select(*KEY, "disposition"), KEY, "left")


def look_up(deps: DataFrame, cache: DataFrame, now_ms: int, p: Params = Params()) -> DataFrame:
    """Dependencies with the cached first publication: a hit for ok and vanished, for errors only while they are recent."""
    live = F.col("status").isin("ok", "vanished") | ((F.col("status") == "error") & (F.lit(now_ms) - F.col("fetched_at_ms") < param(p.error_ttl_ms)))
    return deps.join(cache, "dep", "left").select(*deps.columns, F.coalesce(live, F.lit(False)).alias("hit"), F.when(live, F.col("status")).alias("status"), F.when(live & (F.col("status") == "ok"), F.col("first_publish_ms")).alias("first_publish_ms"))


def note_lookups(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache after new lookups (dep, status, first_publish_ms, fetched_at_ms); attempts count up."""
    old = cache.select("dep", *[F.col(c).alias(f"_{c}") for c in ("status", "first_publish_ms", "fetched_at_ms", "attempts")])
    new = fetched.withColumn("_got", F.lit(True)).join(old, "dep", "full_outer")
    pick = lambda c: F.when(F.col("_got"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return new.select("dep", pick("status"), pick("first_publish_ms"), pick("fetched_at_ms"), (F.coalesce("_attempts", F.lit(0)) + F.coalesce("_got", F.lit(False)).cast("int")).alias("attempts"))


def flatten_packuments(documents: DataFrame, column: str = "document") -> DataFrame:
    """(package_name, version, ...) rows of registry documents; entries that are no objects are passed over."""
    release = "struct<name:string,dist:struct<integrity:string,shasum:string,tarball:string,attestations:variant>,dependencies:map<string,string>,scripts:map<string,string>,_npmUser:struct<name:string,email:string>>"
    doc = F.from_json(F.col(column), f"struct<name:string,`dist-tags`:map<string,string>,time:map<string,string>,versions:map<string,string>>")
    rows = documents.withColumn("_doc", doc).select(F.col("_doc.name").alias("package_name"), F.col("_doc.time").alias("_time"), F.explode("_doc.versions").alias("version", "_text"))
    rows = rows.where(F.col("_text").rlike(r"^\s*\{")).withColumn("_r", F.from_json("_text", release))
    script = lambda k: F.coalesce(F.length(F.try_element_at("_r.scripts", F.lit(k))) > 0, F.lit(False))
    attested = F.coalesce(F.startswith(F.schema_of_variant("_r.dist.attestations"), F.lit("OBJECT")), F.lit(False))
    return rows.select(
        "package_name", "version", F.try_element_at("_time", F.col("version")).alias("published_at"), F.col("_r.dist.integrity").alias("integrity_hash"), F.col("_r.dist.shasum").alias("content_hash"),
        F.col("_r._npmUser.name").alias("publisher_name"), F.col("_r._npmUser.email").alias("publisher_email"),
        attested.alias("provenance_present"), F.when(attested, "oidc").otherwise("unknown").alias("publish_method"),
        F.coalesce(F.map_keys("_r.dependencies"), F.array().cast("array<string>")).alias("deps"), (script("preinstall") | script("install") | script("postinstall")).alias("has_script"),
        F.substring_index("_r.dist.tarball", "/", -1).alias("filename"),
    )


def publish_millis(column: str = "document"):
    """When the package of a registry document was first published: its creation time, else its earliest release; null without either."""
    times = F.from_json(F.col(column), "struct<time:map<string,string>>")["time"]
    earliest = F.array_min(F.map_values(F.map_filter(times, lambda k, v: ~k.isin("created", "modified"))))
    return iso_millis(F.coalesce(F.try_element_at(times, F.lit("created")), earliest))


def first_publish(documents: DataFrame, column: str = "document") -> DataFrame:
    """(dep, first_publish_ms) of registry documents."""
    return documents.select(F.get_json_object(column, "$.name").alias("dep"), publish_millis(column).alias("first_publish_ms"))


def rewrite_versions(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """(package_id, version, kept, disposition, reason): blocked releases go; the reason is the first detail that says anything."""
    said = F.filter(F.transform("results", lambda r: r["detail"]), lambda d: F.coalesce(F.length(d) > 0, F.lit(False)))
    told = decisions.select("package_id", "version", "disposition", F.coalesce(F.try_element_at(said, F.lit(1)), F.lit("")).alias("reason"))
    out = versions.join(told, ["package_id", "version"], "left")
    flagged = F.coalesce(F.col("disposition").isin("WARN", "BLOCK"), F.lit(False))
    return out.select("package_id", "version", (F.coalesce("disposition", F.lit("ALLOW")) != "BLOCK").alias("kept"), F.coalesce("disposition", F.lit("ALLOW")).alias("disposition"), F.when(flagged, F.col("reason")).alias("reason"))


def rewrite_tags(tags: DataFrame, rewritten: DataFrame) -> DataFrame:
    """(package_id, tag, target, new_target): tags of blocked releases move to the highest release left, `latest` to no prerelease; null if none is left."""
    rewritten = cut(rewritten.select("package_id", "version", "kept"))  # read twice: what is left and what is gone
    left = rewritten.where(F.col("kept") & is_semver(F.col("version"))).withColumn("_k", semver_key(F.col("version")))
    best = left.groupBy("package_id").agg(F.max_by("version", "_k").alias("_any"), F.max_by(F.when(~is_prerelease(F.col("version")), F.col("version")), F.when(~is_prerelease(F.col("version")), F.col("_k"))).alias("_release"))
    gone = rewritten.where("not kept").select("package_id", F.col("version").alias("target"), F.lit(True).alias("_gone"))
    out = tags.join(gone, ["package_id", "target"], "left").join(best, "package_id", "left")
    moved = F.when(F.col("tag") == "latest", F.col("_release")).otherwise(F.col("_any"))
    return out.select("package_id", "tag", "target", F.when(F.col("_gone"), moved).otherwise(F.col("target")).alias("new_target"))
