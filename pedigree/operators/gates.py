"""Six checks of an incoming release against its package's stored history, and their runner.

A gate is a function from the prepared facts (`facts`) to a (result, detail) pair of columns; the
registry keeps their order, and other gates can be registered. "Prior" means every other stored version,
whenever it was published.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedigree.functions.columns import iso_millis, param, shorten, trim_all
from pedigree.params import Params

KEY = ["package_id", "version"]
Gate = Callable[[Params], tuple[Column, Column]]


def _case(*branches: tuple[Column | None, str, Column]) -> tuple[Column, Column]:
    """The first branch that holds; one without a condition is the rest."""
    result = detail = None
    for when, kind, said in branches:
        if when is None:
            result, detail = result.otherwise(kind), detail.otherwise(said)
        elif result is None:
            result, detail = F.when(when, kind), F.when(when, said)
        else:
            result, detail = result.when(when, kind), detail.when(when, said)
    return result, detail


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def new_deps(incoming: DataFrame, stored: DataFrame, incoming_deps: DataFrame, stored_deps: DataFrame, young: DataFrame | None = None) -> DataFrame:
    """Per incoming release its dependencies and those that no other stored version has, and of these the ones in `young` (dep, age_hours).

    One table of dependencies for both sides is read once. All go through one exchange by package and dependency, which
    serves the removal of repeats and the count.
    """
    of = lambda releases, held: releases.select(*KEY, "version_id", F.lit(held).alias("_own"), F.lit(1 - held).alias("_wanted"))
    if incoming_deps is stored_deps:
        both = of(stored, 1).unionByName(of(incoming, 0)).groupBy(*KEY, "version_id").agg(F.max("_own").alias("_own"), F.max("_wanted").alias("_wanted")).join(stored_deps, "version_id")
    else:
        both = of(stored, 1).join(stored_deps, "version_id").unionByName(of(incoming, 0).join(incoming_deps, "version_id"))
    each = both.repartition("package_id", "dep").groupBy(*KEY, "dep").agg(F.max("_own").alias("_own"), (F.max("_wanted") == 1).alias("_wanted"))
    fresh = F.sum("_own").over(Window.partitionBy("package_id", "dep")) - F.col("_own") == 0
    seen = each.withColumn("_fresh", fresh).where("_wanted")
    found = [F.count("*").alias("n_deps"), F.sort_array(F.collect_list(F.when(F.col("_fresh"), F.col("dep")))).alias("new_deps")]
    if young is not None:
        seen = seen.join(young.groupBy("dep").agg(F.min("age_hours").alias("_age")), "dep", "left")
        found.append(F.collect_list(F.when(F.col("_fresh") & F.col("_age").isNotNull(), F.struct("dep", F.col("_age").alias("age_hours")))).alias("_young"))
    return seen.groupBy(*KEY).agg(*found)


def newest(stored: DataFrame) -> DataFrame:
    """One row per package: its stored versions, attested ones, and the two newest of each kind.

    The newest version other than a given one is the package's newest or, for that one itself, its second.
    """
    attested = F.coalesce("provenance_present", F.lit(False))
    order = [F.desc_nulls_last("published_at"), F.desc("version_id")]
    by = Window.partitionBy("package_id").orderBy(*order)
    ranked = stored.withColumns({"_r": F.row_number().over(by), "_a": F.count_if(attested).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    pick = lambda rank, n, cond=F.lit(True): F.max(F.when((F.col(rank) == n) & cond, F.struct("version", "publisher_email")))
    return ranked.groupBy("package_id").agg(F.count("*").alias("_n"), F.count_if(attested).alias("_attested"), pick("_r", 1).alias("_p1"), pick("_r", 2).alias("_p2"), pick("_a", 1, attested).alias("_a1"), pick("_a", 2, attested).alias("_a2"))


def priors(out: DataFrame) -> DataFrame:
    """Facts about the other stored versions, from the release's own row and its package's: how many, how many attested, and the newest of each kind."""
    other = lambda first, second: F.when(F.col(f"{first}.version") == F.col("version"), F.col(second)).otherwise(F.col(first))
    return out.withColumns({
        "n_prior": F.coalesce("_n", F.lit(0)) - F.coalesce(F.col("has_baseline").cast("int"), F.lit(0)), "n_prior_attested": F.coalesce("_attested", F.lit(0)) - F.coalesce("_self_attested", F.lit(0)),
        "latest_prior": other("_p1", "_p2"), "latest_attested": other("_a1", "_a2")["version"],
    }).drop("_n", "_attested", "_self_attested", "_p1", "_p2", "_a1", "_a2")


def facts(incoming: DataFrame, stored: DataFrame, incoming_deps: DataFrame, stored_deps: DataFrame, scripts: DataFrame, cache: DataFrame | None, now_ms: int, p: Params = Params()) -> DataFrame:
    """All that the gates look at, one row per incoming release."""
    base = stored.select(*KEY, F.lit(True).alias("has_baseline"), F.col("integrity_hash").alias("base_integrity"), F.col("content_hash").alias("base_content"), F.coalesce("provenance_present", F.lit(False)).cast("int").alias("_self_attested"))
    young = None
    if cache is not None:
        age = F.floor((F.lit(now_ms) - F.col("first_publish_ms")) / 3_600_000)
        young = cache.where(F.col("status") == "ok").select("dep", age.alias("age_hours")).where(F.col("age_hours") < param(p.fresh_dep_hours))
    deps = new_deps(incoming, stored, incoming_deps, stored_deps, young)
    out = priors(incoming.join(base, KEY, "left").join(newest(stored), "package_id", "left")).join(deps, KEY, "left").join(scripts, "version_id", "left")
    out = out.withColumns({"n_deps": F.coalesce("n_deps", F.lit(0)), "new_deps": F.coalesce("new_deps", F.array().cast("array<string>")), "has_script": F.coalesce("has_script", F.lit(False)), "now_ms": F.lit(now_ms)})
    if cache is None:
        return out.withColumns({"fresh_dep": F.lit(None).cast("struct<dep:string,age_hours:bigint>"), "can_look_up": F.lit(False)})
    other = F.filter("_young", lambda y: y["dep"] != F.col("package_name"))
    return out.withColumns({"fresh_dep": F.array_min(other), "can_look_up": F.lit(True)}).drop("_young")


def content_hash(p: Params) -> tuple[Column, Column]:
    a, b, c, d = (F.col(x) for x in ("base_integrity", "integrity_hash", "base_content", "content_hash"))
    cut = lambda x: shorten(x, 16, "(none)")
    both, same, plain = a.isNotNull() & b.isNotNull(), a == b, c.isNotNull() & d.isNotNull()
    return _case(
        (F.col("has_baseline").isNull(), "SKIP", F.lit("first-seen: no baseline to compare")),
        (a.isNull() & c.isNull(), "SKIP", F.lit("baseline has no hash fields — cannot verify")),
        (b.isNull() & d.isNull(), "SKIP", F.lit("incoming packument missing hash fields")),
        (both & same & plain & (c != d), "ALLOW", _text("integrity matches baseline (sha1 re-shasum: ", cut(c), " → ", cut(d), ")")),
        (both & same, "ALLOW", F.lit("integrity hash matches baseline")),
        (both, "BLOCK", _text("integrity hash differs from baseline: ", cut(a), " → ", cut(b))),
        (plain & (c == d), "ALLOW", F.lit("shasum matches baseline")),
        (plain, "BLOCK", _text("shasum differs from baseline: ", cut(c), " → ", cut(d))),
        (None, "SKIP", F.lit("cannot compare: differing hash algorithms between baseline and incoming")),
    )


def dep_structure(p: Params) -> tuple[Column, Column]:
    n, new = F.col("n_prior"), F.col("new_deps")
    shown = F.array_join(F.transform(F.slice(new, 1, 5), lambda x: shorten(x, 80, "(invalid)")), ", ")
    more = F.when(F.size(new) > 5, _text(", … (+", F.size(new) - 5, " more)")).otherwise("")
    return _case(
        (n == 0, "SKIP", F.lit("no prior versions to compare dependencies against")),
        (F.col("n_deps") == 0, "ALLOW", F.lit("incoming version declares no runtime dependencies")),
        (F.size(new) == 0, "ALLOW", _text("all ", F.col("n_deps"), " runtime dep(s) present in prior ", n, " version(s)")),
        (None, "WARN", _text("new runtime dep(s): ", shown, more, " (not in prior ", n, " version(s))")),
    )


def publisher_identity(p: Params) -> tuple[Column, Column]:
    old, new = F.col("latest_prior.publisher_email"), F.col("publisher_email")
    norm = lambda c: F.nullif(F.lower(trim_all(c)), F.lit(""))
    cut = lambda c: shorten(c, 80, "(unknown)")
    return _case(
        (F.col("n_prior") == 0, "SKIP", F.lit("no prior versions to compare publisher against")),
        (norm(old).isNull(), "SKIP", F.lit("prior version has no publisher email — cannot verify")),
        (norm(new).isNull(), "SKIP", F.lit("incoming version has no publisher email — cannot verify")),
        (norm(old) == norm(new), "ALLOW", _text("publisher unchanged: ", cut(old))),
        (None, "WARN", _text("publisher changed: ", cut(old), " → ", cut(new), " (prior version: ", F.col("latest_prior.version"), ")")),
    )


def provenance_continuity(p: Params) -> tuple[Column, Column]:
    n, k = F.col("n_prior"), F.col("n_prior_attested")
    return _case(
        (n == 0, "SKIP", F.lit("no prior versions to compare provenance against")),
        (k == 0, "SKIP", F.lit("package has never used OIDC provenance — nothing to regress from")),
        (F.coalesce("provenance_present", F.lit(False)), "ALLOW", _text("OIDC provenance present (continuous with ", k, "/", n, " prior versions)")),
        (None, "WARN", _text("OIDC provenance missing (", k, " of last ", n, " versions had it, latest: ", F.col("latest_attested"), ")")),
    )


def release_age(p: Params) -> tuple[Column, Column]:
    hours, limit = F.floor(F.greatest(F.lit(0), F.col("now_ms") - iso_millis(F.col("published_at"))) / 3_600_000), param(p.release_age_hours)
    return _case(
        (F.split("version", r"\+")[0].rlike("-[A-Za-z0-9]"), "ALLOW", _text("prerelease exempt from release-age cooldown (", F.col("version"), ")")),
        (iso_millis(F.col("published_at")).isNull(), "SKIP", F.lit("published_at missing or unparseable — cannot compute age")),
        (hours >= limit, "ALLOW", _text("release age ", hours, "h ≥ threshold ", limit, "h")),
        (None, "WARN", _text("release age ", hours, "h < threshold ", limit, "h (published ", F.col("published_at"), ")")),
    )


def scope_boundary(p: Params) -> tuple[Column, Column]:
    new = F.array_join("new_deps", ", ")
    return _case(
        (F.col("n_prior") == 0, "SKIP", F.lit("no prior versions to compare scope against")),
        (F.size("new_deps") == 0, "ALLOW", F.lit("no new runtime dependencies introduced")),
        (~F.col("has_script"), "ALLOW", _text(F.size("new_deps"), " new dep(s) but no install scripts — low risk")),
        (~F.col("can_look_up"), "WARN", _text("new dep(s) [", new, "] + install scripts (dep-age check unavailable)")),
        (F.col("fresh_dep").isNotNull(), "WARN", _text("new dep '", F.col("fresh_dep.dep"), "' published ", F.col("fresh_dep.age_hours"), "h ago + install scripts in ", F.col("package_name"), "@", F.col("version"))),
        (None, "WARN", _text("new dep(s) [", new, "] + install scripts (none freshly published within ", param(p.fresh_dep_hours), "h)")),
    )


#: Gates in the order of their results.
GATES: dict[str, Gate] = {
    "content-hash": content_hash, "dep-structure": dep_structure, "publisher-identity": publisher_identity,
    "provenance-continuity": provenance_continuity, "release-age": release_age, "scope-boundary": scope_boundary,
}
#: Gates that need no history.
INDEPENDENT = {"content-hash"}


def register(name: str, gate: Gate) -> None:
    """Add a gate behind the others."""
    if not name or name in GATES or not callable(gate):
        raise ValueError(f"no new gate: {name!r}")
    GATES[name] = gate


def evaluate(prepared: DataFrame, gate: str, p: Params = Params()) -> DataFrame:
    """One gate alone: package_id, version, result, detail."""
    result, detail = GATES[gate](p)
    return prepared.select(*KEY, result.alias("result"), detail.alias("detail"))


def run_gates(prepared: DataFrame, overrides: DataFrame | None = None, p: Params = Params(), gates: dict[str, Gate] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """package_id, version, disposition, results: all gates in order, an override instead of them, skips without history; columns of `keep` follow."""
    short = F.col("n_prior") < param(p.min_history)
    why = _text("insufficient history (", F.col("n_prior"), " prior version(s), need ", param(p.min_history), ") — first-seen poisoning protection")
    made, results = {}, []
    for k, (name, gate) in enumerate((gates or GATES).items()):
        result, detail = gate(p)
        if name not in INDEPENDENT:
            result, detail = F.when(short, "SKIP").otherwise(result), F.when(short, why).otherwise(detail)
        made |= {f"_result_{k}": result, f"_detail_{k}": detail}  # columns of their own, so that each is computed once
        known = F.col(f"_result_{k}").isin("ALLOW", "WARN", "BLOCK", "SKIP")
        results.append(F.struct(F.lit(name).alias("gate"), F.when(known, F.col(f"_result_{k}")).otherwise("SKIP").alias("result"), F.when(known, F.coalesce(f"_detail_{k}", F.lit(""))).otherwise("malformed gate output").alias("detail")))
    out = prepared.withColumns(made).withColumn("results", F.array(*results))
    # From the gates' own columns: functions over `results` are interpreted, and a filter on them made all gates once more.
    any_of = lambda kind: reduce(Column.__or__, (F.col(f"_result_{k}") == kind for k in range(len(results))), F.lit(False))
    worst = F.when(any_of("BLOCK"), "BLOCK").when(any_of("WARN"), "WARN").otherwise("ALLOW")
    if overrides is not None:
        out = out.join(overrides.select(*KEY, F.coalesce("reason", F.lit("(no reason)")).alias("_why")), KEY, "left")
        one = F.array(F.struct(F.lit("override").alias("gate"), F.lit("ALLOW").alias("result"), _text("override: ", F.col("_why")).alias("detail")))
        out = out.withColumn("results", F.when(F.col("_why").isNotNull(), one).otherwise(F.col("results")))
        worst = F.when(F.col("_why").isNotNull(), "ALLOW").otherwise(worst)
    return out.select(*KEY, worst.alias("disposition"), "results", *keep)
