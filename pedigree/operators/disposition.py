"""ALLOW, WARN or BLOCK for every package, from the ownership and attestation patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedigree.functions.columns import is_machine, param, provider
from pedigree.operators.publisher import Pattern
from pedigree.params import Params

KEYS = ("package_id",)
ORDER = ("ALLOW", "WARN", "BLOCK")


def severity(c):
    """0, 1, 2 of ALLOW, WARN, BLOCK."""
    return F.when(F.col(c) == "BLOCK", 2).when(F.col(c) == "WARN", 1).otherwise(0)


def verdict_of(level):
    return F.when(level == 2, "BLOCK").when(level == 1, "WARN").otherwise("ALLOW")


def _said(*parts):
    return F.array_join(F.array_compact(F.array(*parts)), " | ")


def judge_transitions(moves: DataFrame, summaries: DataFrame, records: DataFrame | None, keys: tuple[str, ...] = KEYS, p: Params = Params()) -> DataFrame:
    """Every transition with its verdict, co-signals and reason; `records` (attestation) are optional."""
    t = moves.join(summaries.select(*keys, "has_sufficient_history", "shape", "has_unverified_domain", "domain_stability"), list(keys))
    if records is not None:
        fell = records.where("provenance_regression").select("package_id", F.col("version").alias("at_version"), F.lit(True).alias("_fell"))
        t = t.join(fell, ["package_id", "at_version"], "left")
    else:
        t = t.withColumn("_fell", F.lit(None).cast("boolean"))
    risky = F.col("new_domain") & F.col("provider").isin("privacy", "unverified")
    broke = F.coalesce(F.col("prior_last_provenance"), F.lit(False)) & ~F.coalesce(F.col("first_provenance_present"), F.lit(False))
    text = lambda *x: F.concat(*[F.lit(s) if isinstance(s, str) else s.cast("string") for s in x])
    signs = F.array_compact(F.array(
        F.when(risky, text("co-signal: new ", F.col("provider"), " domain ", F.col("domain"))),
        F.when(F.coalesce("_fell", F.lit(False)), text("co-signal: provenance regression @ ", F.col("at_version"))).when(broke, "co-signal: provenance break"),
        F.when(F.col("gap_ms") < param(p.short_gap_ms), text("co-signal: gap_ms=", F.col("gap_ms"), " (<", param(p.short_gap_ms), ")")),
    ))
    t = t.withColumn("co_signals", signs)
    solo, long_ = F.col("shape").isin("solo", "unknown"), F.col("prior_tenure_versions") >= param(p.exceptional_prior_tenure)
    judged = (F.col("cell") == "cold_handoff") & (F.col("prior_tenure_versions") >= param(p.high_prior_tenure))
    t = t.withColumn("_d0", F.when(~judged, "ALLOW").when(solo, "BLOCK").when(long_ & (F.size("co_signals") > 0), "BLOCK").otherwise("WARN"))
    combo = judged & F.col("new_domain") & (F.col("provider") == "privacy") & F.col("has_unverified_domain") & (F.col("_d0") == "WARN")
    t = t.withColumn("_combo", combo).withColumn("_d1", F.when(combo, "BLOCK").otherwise(F.col("_d0")))
    calm = judged & F.col("new_domain") & ~solo & (F.col("domain_stability") == "churning") & (F.col("_d1") == "BLOCK")
    t = t.withColumn("_calm", calm).withColumn("disposition", F.when(calm, "WARN").otherwise(F.col("_d1")))
    at, tenure = text(F.col("cell"), " @ ", F.col("at_version")), F.col("prior_tenure_versions")
    reason = F.when(F.col("cell") != "cold_handoff", at).when(~judged, text(at, " (rotation churn, prior_tenure=", tenure, ")")).otherwise(_said(
        at, text("shape=", F.col("shape")), text("prior_tenure=", tenure),
        F.when(~solo & long_ & (F.size("co_signals") > 0), F.array_join("co_signals", " | ")).when(~solo & long_, "no co-signal (committee tenure alone does not BLOCK)"),
        F.when(risky, text("new_domain=", F.col("domain"), " (", F.col("provider"), ")")),
        F.when(F.col("_combo"), "privacy+unverified combo"), F.when(F.col("_calm"), "stability=churning (de-escalated)"),
    ))
    return t.withColumn("reason", reason)


def escalators(fell: DataFrame, p: Params = Params()) -> DataFrame:
    """Regressions with the signs that make them worse: new domain, privacy, unverified, machine to human."""
    kind = provider(F.col("domain"), F.col("domain_versions"), p.min_verified_versions)
    return fell.withColumn("escalators", F.array_compact(F.array(
        F.when(F.col("domain").isNotNull() & (F.col("domain_first_ms") >= F.col("published_at_ms")), "new_domain"),
        F.when(kind == "privacy", "privacy"), F.when(kind == "unverified", "unverified"),
        F.when(F.col("any_machine") & ~is_machine(F.col("email")), "machine_to_human"),
    )))


def regressions(records: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Every regression in scope; with blocks also `since` when the package knew the identity whose block it falls in, null outside of blocks.

    The first block that ends at or after the regression is the one seen last in descending order, so one
    window over both finds it.
    """
    fell = records.where("in_scope and provenance_regression")
    if blocks is None:
        return fell
    spans = blocks.select("package_id", F.col("last_published_at_ms").alias("_at"), F.lit(1).alias("_kind"), F.col("block_idx").alias("_b"), F.struct("first_published_at_ms", "since").alias("_span"))
    both = fell.withColumns({"_at": F.col("published_at_ms"), "_kind": F.lit(0)}).unionByName(spans, allowMissingColumns=True)
    ahead = Window.partitionBy("package_id").orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_next", F.last("_span", ignorenulls=True).over(ahead)).where("_kind = 0")
    return both.select(*fell.columns, F.when(F.col("_next.first_published_at_ms") <= F.col("published_at_ms"), F.col("_next.since")).alias("since"))


def judge_regressions(worsened: DataFrame) -> DataFrame:
    """Verdicts on regressions by identities that the package has seen earlier."""
    worse = F.size("escalators") > 0
    reason = _said(F.concat(F.lit("provenance_regression @ "), F.col("version")), F.when(worse, F.concat(F.lit("escalators=["), F.array_join("escalators", ","), F.lit("]"))).otherwise("regression without escalators"))
    return worsened.where("since < published_at_ms").withColumn("disposition", F.when(worse, "BLOCK").otherwise("WARN")).withColumn("reason", reason)


def worsened(pattern: Pattern, records: DataFrame) -> DataFrame:
    """All regressions with their escalators and `since`, at every point of the pattern's grid."""
    return escalators(pattern.grid.spread(regressions(records, pattern["blocks"])), pattern.grid.params)


def verdicts(pattern: Pattern, records: DataFrame | None = None) -> DataFrame:
    """All verdicts on single versions of packages with enough history: pass, place, version, disposition, reason.

    Without attestation records every transition is judged. With them, only those by identities
    never seen earlier, and in a second pass the regressions by identities that were.
    """
    keys = pattern.grid.keys
    moves = pattern["transitions"] if records is None else pattern["transitions"].where("not seen_before")
    first = judge_transitions(moves, pattern["summary"], records, keys, pattern.grid.params).where("has_sufficient_history")
    out = first.select(*keys, F.lit(1).alias("pass"), F.col("from_index").alias("place"), F.col("at_version").alias("version"), "disposition", "reason")
    if records is not None:
        second = judge_regressions(worsened(pattern, records)).join(pattern["summary"].where("has_sufficient_history").select(*keys), list(keys), "left_semi")
        out = out.unionByName(second.select(*keys, F.lit(2).alias("pass"), F.col("rn").alias("place"), "version", "disposition", "reason"))
    return out


def dispositions(pattern: Pattern, judged: DataFrame) -> DataFrame:
    """One row per package: its verdict (the most severe) and all reasons in order."""
    keys = pattern.grid.keys
    each = judged.groupBy(*keys).agg(
        F.max(severity("disposition")).alias("_level"),
        F.transform(F.sort_array(F.collect_list(F.struct("pass", "place", "disposition", "reason"))), lambda x: F.concat(x["disposition"], F.lit(": "), x["reason"])).alias("_reasons"),
    )
    s = pattern["signals"].join(each, list(keys), "left")
    quiet = F.when(F.col("transition_count") == 0, "no transitions observed").otherwise("no escalating signals")
    reasons = F.when(~F.col("has_sufficient_history"), F.array(F.concat(F.lit("insufficient history (observed_versions_count="), F.col("observed_versions_count").cast("string"), F.lit(")")))).when(F.col("_reasons").isNull(), F.array(quiet)).otherwise(F.col("_reasons"))
    return s.select(*keys, verdict_of(F.coalesce("_level", F.lit(0))).alias("disposition"), reasons.alias("reasons"))
