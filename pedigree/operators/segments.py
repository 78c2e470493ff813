"""The patterns for packages of any size: windows over ranges of a package, with a carry from range to range.

A group that holds more than a set share of all rows is cut into ranges of its order, of about equal size. Windows
then run within a range; each range is reduced to a few numbers (first and last identity, counts, state of the
streak), a small window over these gives what a range takes over from the ones before, and that is stitched to its
rows. No task holds a whole package.

Only groups above the share are cut, so there are at most `share` of them with `pieces` ranges each: the table of
bounds and that of carries are bounded whatever the data, and are sent to all tasks. Rows of one instant stay in one
range. Per-domain numbers are aggregates joined back, not windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedigree.functions.columns import domain, major, param, semver_key, trim_all
from pedigree.operators import provenance, publisher
from pedigree.operators.grid import Grid, Relations
from pedigree.params import MACHINE_EMAIL, Params
from pedigree.session import cut


@dataclass(frozen=True)
class Ranges:
    """A group is cut into `pieces` if it has more than `least` rows and more than one `share`-th of all."""

    least: int = 100_000
    share: int = 400
    pieces: int = 128


def _same(left: str, right: str, on: list[str]) -> Column:
    condition = F.lit(True)
    for c in on:
        condition = condition & F.expr(f"{left}.`{c}` <=> {right}.`{c}`")
    return condition


def _told(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """`rows` with the columns of a table that is bounded by share and pieces; nulls are keys like others."""
    more = [F.col(f"_s.{c}").alias(c) for c in small.columns if c not in on]
    return rows.alias("_l").join(F.broadcast(small).alias("_s"), _same("_l", "_s", on), "left").select("_l.*", *more)


def ranged(rows: DataFrame, by: list[str], at: str, how: Ranges) -> DataFrame:
    """`rows` with `_range` (0 in groups that are not cut) and `_cut`; ranges follow the number column `at`."""
    counts = cut(rows.groupBy(*by).agg(F.count("*").alias("_n")))
    limit = max(how.least, (counts.agg(F.sum("_n")).first()[0] or 0) // how.share)
    large = counts.where(F.col("_n") > limit)
    shares = [k / how.pieces for k in range(1, how.pieces)]
    some = rows.alias("_l").join(F.broadcast(large).alias("_s"), _same("_l", "_s", by), "left_semi")
    bounds = cut(some.groupBy(*by).agg(F.array_distinct(F.percentile_approx(at, shares, 20 * how.pieces)).alias("_bounds")))
    found = _told(rows, bounds, by)
    return found.select(*rows.columns, F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(at))), F.lit(0)).alias("_range"), F.col("_bounds").isNotNull().alias("_cut"))


def carried(rows: DataFrame, by: list[str], reduced: dict[str, Column]) -> DataFrame:
    """One row for each range of the groups that are cut."""
    return rows.where("_cut").groupBy(*by, "_range").agg(*[c.alias(n) for n, c in reduced.items()])


def _before(by: list[str]):
    return Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _of_domain(rows: DataFrame, time: str, **more: Column) -> DataFrame:
    """`rows` with the releases of their domain in the package and when it was first seen there; rows without a domain have one in common."""
    rows = rows.withColumn("_domain", F.coalesce("domain", F.lit("")))
    known = rows.groupBy("package_id", "_domain").agg(F.count("*").alias("_versions"), F.min(time).alias("_first_ms"), *[c.alias(n) for n, c in more.items()])
    return rows.join(known, ["package_id", "_domain"], "left").drop("_domain")


def blocks(history: DataFrame, how: Ranges = Ranges()) -> DataFrame:
    """The tenure blocks that `publisher.bare_blocks` makes of the valid rows."""
    rows = ranged(publisher.usable_rows(history).withColumn("_k", semver_key(F.col("version"))), ["package_id"], "published_at_ms", how)
    here = Window.partitionBy("package_id", "_range").orderBy("published_at_ms", "_k", "identity", "input_idx")
    rows = rows.withColumns({"_rn": F.row_number().over(here).cast("long") - 1, "_turn": F.when(F.lag("identity").over(here) != F.col("identity"), 1).otherwise(0)})
    rows = cut(rows.withColumn("_turns", F.sum("_turn").over(here.rowsBetween(Window.unboundedPreceding, 0))))
    whole = carried(rows, ["package_id"], {"_size": F.count("*"), "_first": F.min_by("identity", "_rn"), "_last": F.max_by("identity", "_rn"), "_inner": F.sum("_turn")})
    order = Window.partitionBy("package_id").orderBy("_range")
    whole = whole.withColumn("_enters", F.coalesce((F.lag("_last").over(order) != F.col("_first")).cast("long"), F.lit(0)))
    whole = whole.withColumns({"_offset": F.sum("_size").over(_before(["package_id"])), "_block": _zero(F.sum(F.col("_inner") + F.col("_enters")).over(_before(["package_id"]))) + F.col("_enters")})
    rows = _told(rows, whole.select("package_id", "_range", "_offset", "_block"), ["package_id", "_range"])
    rows = rows.withColumns({"rn": _zero(F.col("_offset")) + F.col("_rn"), "block_idx": _zero(F.col("_block")) + F.col("_turns")})
    rows, known = _of_domain(rows, "published_at_ms", _first_rn=F.min("rn")), F.col("domain").isNotNull()
    rows = rows.withColumns({"domain_versions": F.when(known, F.col("_versions")), "first_seen_in_package_ms": F.when(known, F.col("_first_ms")), "_first_rn": F.when(known, F.col("_first_rn"))})
    return neighbours(cut(publisher.gathered(rows)), how)


def neighbours(found: DataFrame, how: Ranges = Ranges()) -> DataFrame:
    """Blocks with what they ask of the block before and of their identity's blocks before."""
    taken = F.struct("identity", "version_count", "duration_ms", "last_published_at_ms", "last_provenance_present")
    rows = ranged(found, ["package_id"], "block_idx", how)
    rows = cut(rows.withColumn("_prior", F.lag(taken).over(Window.partitionBy("package_id", "_range").orderBy("block_idx"))))
    ends = carried(rows, ["package_id"], {"_end": F.max_by(taken, "block_idx")}).withColumn("_end", F.lag("_end").over(Window.partitionBy("package_id").orderBy("_range")))
    rows = _told(rows, ends, ["package_id", "_range"]).withColumn("_prior", F.coalesce("_prior", "_end"))
    rows = rows.withColumns({
        "from_identity": F.col("_prior.identity"), "prior_tenure_versions": F.col("_prior.version_count"), "prior_tenure_duration_ms": F.col("_prior.duration_ms"),
        "gap_ms": F.col("first_published_at_ms") - F.col("_prior.last_published_at_ms"), "prior_last_provenance": F.col("_prior.last_provenance_present"),
    }).drop("_prior", "_end", "_range", "_cut")
    by = ["package_id", "identity"]
    rows = ranged(cut(rows), by, "block_idx", how)
    here = Window.partitionBy(*by, "_range")
    earlier = here.orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    whole = carried(rows, by, {"_turn": F.max("block_idx"), "_count": F.sum("version_count"), "_since": F.min("first_published_at_ms")})
    whole = whole.withColumns({
        "_last_turn": F.max("_turn").over(_before(by)), "_earlier": F.sum("_count").over(_before(by)), "_since": F.min("_since").over(Window.partitionBy(*by)), "_all": F.sum("_count").over(Window.partitionBy(*by)),
    }).drop("_turn", "_count")
    rows = _told(rows, whole, [*by, "_range"]).withColumns({
        "last_turn": F.coalesce(F.max("block_idx").over(earlier), "_last_turn"), "prior_contribution_count": _zero(F.sum("version_count").over(earlier)) + _zero(F.col("_earlier")),
        "since": F.coalesce("_since", F.min("first_published_at_ms").over(here)), "identity_versions": F.coalesce("_all", F.sum("version_count").over(here)),
    })
    return rows.drop("_range", "_cut", "_last_turn", "_earlier", "_since", "_all")


def publisher_pattern(history: DataFrame, grid: Grid = Grid(), shared: bool = True, how: Ranges = Ranges()) -> publisher.Pattern:
    """All relations of the ownership pattern; `rows` is not made."""
    found = publisher.extract(history, grid, shared)
    found.makers["blocks"] = lambda: cut(blocks(history, how)) if shared else blocks(history, how)
    return found


def numbered(history: DataFrame, how: Ranges) -> DataFrame:
    """The rows of `provenance.valid_rows` but for `mrn`, with `_total`, the package's rows."""
    usable = history.where((F.length("version") > 0) & F.col("published_at_ms").isNotNull())
    first = usable.groupBy("package_id", "version").agg(F.min_by(F.struct(*[c for c in history.columns if c not in ("package_id", "version")]), "input_idx").alias("_x"))
    address = F.when(F.length("publisher_email") > 0, F.lower(trim_all(F.col("publisher_email"))))
    rows = first.select("package_id", "version", "_x.*").select(*history.columns)
    rows = rows.withColumns({"email": address, "name": F.nullif("publisher_name", F.lit("")), "major": major(F.col("version")), "_k": semver_key(F.col("version"))})
    rows = ranged(cut(rows), ["package_id"], "published_at_ms", how)
    here = Window.partitionBy("package_id", "_range")
    rows = rows.withColumns({"_rn": F.row_number().over(here.orderBy("published_at_ms", "_k", "input_idx")).cast("long") - 1, "_here": F.count("*").over(here)})
    whole = carried(rows, ["package_id"], {"_size": F.count("*")})
    whole = whole.select("package_id", "_range", F.sum("_size").over(_before(["package_id"])).alias("_offset"), F.sum("_size").over(Window.partitionBy("package_id")).alias("_all"))
    rows = _told(rows, whole, ["package_id", "_range"]).withColumns({"rn": _zero(F.col("_offset")) + F.col("_rn"), "_total": F.coalesce("_all", "_here")})
    return rows.drop("_k", "_rn", "_here", "_offset", "_all", "_range", "_cut")


def records(history: DataFrame, p: Params = Params(), how: Ranges = Ranges()) -> DataFrame:
    """The records that `provenance.records_of` makes.

    A range's streaks depend on what it takes over only up to its first release without attestation (`_head`); behind
    the last one stands what it hands on (`_tail`).
    """
    by, need = ["package_id", "major"], param(p.min_baseline_streak)
    rows = ranged(cut(numbered(history, how)), by, "rn", how)
    here = Window.partitionBy(*by, "_range").orderBy("rn")
    before, upto = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    yes = F.when(F.col("provenance_present"), 1).otherwise(0)
    rows = rows.withColumns({"_m": F.row_number().over(here).cast("long") - 1, "_yes": yes, "_c": _zero(F.sum(yes).over(before)), "_n": F.sum(yes).over(upto)})
    rows = rows.withColumn("_reset", F.when(~F.col("provenance_present"), F.col("_n")))
    rows = rows.withColumn("_since", F.max("_reset").over(before))
    latest = lambda cond: F.max(F.when(cond, F.col("_m"))).over(before)
    machine, human = F.col("email") == MACHINE_EMAIL, F.col("email") != MACHINE_EMAIL
    rows = cut(rows.withColumns({"_machine": latest(machine), "_human": latest(human)}))
    # One row a range: its size, attested releases, those before the first and behind the last reset, longest streak between, last carriers.
    whole = carried(rows, by, {
        "_size": F.count("*"), "_all": F.sum("_yes"), "_head": F.min("_reset"), "_last": F.max("_reset"),
        "_inner": F.max(F.when(F.col("_since").isNotNull() & ~F.col("provenance_present").eqNullSafe(False), F.col("_c") - F.col("_since") + F.col("_yes"))), "_lm": F.max(F.when(machine, F.col("_m"))), "_lh": F.max(F.when(human, F.col("_m"))),
    })
    first = _before(by)
    whole = whole.withColumns({"_offset": _zero(F.sum("_size").over(first)), "_sum": _zero(F.sum("_all").over(first))})
    whole = whole.withColumn("_streak", F.col("_sum") - _zero(F.max(F.col("_sum") + F.col("_last")).over(first)))
    longest = F.greatest(F.col("_streak") + F.coalesce("_head", "_all"), _zero(F.col("_inner")))
    whole = whole.withColumn("_longest", longest)
    whole = whole.select(
        *by, "_range", "_offset", "_streak", F.max("_longest").over(first).alias("_most"),
        F.max(F.col("_offset") + F.col("_lm")).over(first).alias("_lm"), F.max(F.col("_offset") + F.col("_lh")).over(first).alias("_lh"),
    )
    rows = _told(rows, whole, [*by, "_range"])
    rows = rows.withColumn("prior_streak", F.when(F.col("_since").isNull(), F.col("_c") + _zero(F.col("_streak"))).otherwise(F.col("_c") - F.col("_since")))
    after = F.when(F.col("provenance_present"), F.col("prior_streak") + 1).when(~F.col("provenance_present"), 0).otherwise(F.col("prior_streak"))
    enough, baseline = F.col("_total") >= param(p.min_history), F.col("prior_streak") >= need
    rows = rows.withColumns({"streak_after": after, "mrn": _zero(F.col("_offset")) + F.col("_m")})
    carrier = lambda own, old: F.coalesce(F.coalesce(_zero(F.col("_offset")) + F.col(own), F.col(old)) >= F.col("mrn") - F.col("prior_streak"), F.lit(False))
    rows = rows.withColumns({
        "_reached": F.greatest(F.max("streak_after").over(upto), _zero(F.col("_most"))) >= need, "any_machine": carrier("_machine", "_lm"), "any_human": carrier("_human", "_lh"),
    })
    rows = rows.withColumns({
        "baseline_established": enough & baseline, "provenance_regression": enough & baseline & F.coalesce(~F.col("provenance_present"), F.lit(False)), "in_scope": enough & F.col("_reached"), "domain": domain(F.col("email")),
    })
    rows = _of_domain(rows, "published_at_ms").withColumnsRenamed({"_versions": "domain_versions", "_first_ms": "domain_first_ms"})
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def provenance_pattern(history: DataFrame, p: Params = Params(), shared: bool = True, how: Ranges = Ranges()) -> Relations:
    """All relations of the attestation pattern."""
    found = provenance.extract(history, p, shared)
    found.makers["per_version"] = lambda: cut(records(history, p, how)) if shared else records(history, p, how)
    return found
