"""Ownership patterns: tenure blocks, transitions, signals, identity profile and shape of every package.

Rows and blocks depend on no swept parameter and are windows and one aggregate over a single hash exchange by
package. What does depend on parameters is an expression over the blocks, or one aggregate of them by package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedigree.functions.columns import domain, identity, param, provider, semver_key, tied
from pedigree.operators.grid import Grid, Relations
from pedigree.params import Params
from pedigree.session import cut

CELLS = {"cold_handoff_count": "cold_handoff", "new_committee_member_count": "new_committee_member", "returning_dormant_count": "returning_dormant", "recurring_member_count": "recurring_member"}


def usable_rows(history: DataFrame) -> DataFrame:
    """Rows with an identity, a time and a version."""
    rows = history.withColumn("identity", identity(F.col("publisher_name"), F.col("publisher_email"))).withColumn("domain", domain(F.col("publisher_email")))
    return rows.where(F.col("identity").isNotNull() & F.col("published_at_ms").isNotNull() & (F.length("version") > 0))


def valid_rows(history: DataFrame) -> DataFrame:
    """Usable rows, numbered (rn from 0) by time, version and identity."""
    rows = usable_rows(history).withColumn("_tied", tied("package_id", "published_at_ms"))
    order = Window.partitionBy("package_id").orderBy("published_at_ms", F.when(F.col("_tied"), semver_key(F.col("version"))), "identity", "input_idx")
    return rows.withColumn("rn", F.row_number().over(order).cast("long") - 1).drop("_tied")


def blocks_of_rows(rows: DataFrame) -> DataFrame:
    """Each valid row with the number of its tenure block."""
    order = Window.partitionBy("package_id").orderBy("rn")
    rows = rows.withColumn("_new", F.when(F.lag("identity").over(order) == F.col("identity"), 0).otherwise(1))
    return rows.withColumn("block_idx", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def bare_blocks(rows: DataFrame) -> DataFrame:
    """Maximal runs of one identity, with all that later steps ask of a block and its neighbours but no parameter.

    The block's address is its first row's; `since` is when the package first saw its identity, `last_turn` the
    identity's block before, `newest_domain_rn` and `new_domains` tell of domains that first occur in the block.
    """
    of_domain, known = Window.partitionBy("package_id", "domain"), F.col("domain").isNotNull()
    rows = blocks_of_rows(rows).withColumns({
        "domain_versions": F.when(known, F.count("*").over(of_domain)), "first_seen_in_package_ms": F.when(known, F.min("published_at_ms").over(of_domain)), "_first_rn": F.when(known, F.min("rn").over(of_domain)),
    })
    blocks = gathered(rows)
    order, same = Window.partitionBy("package_id").orderBy("block_idx"), Window.partitionBy("package_id", "identity").orderBy("block_idx")
    earlier = same.rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({
        "from_identity": F.lag("identity").over(order), "prior_tenure_versions": F.lag("version_count").over(order), "prior_tenure_duration_ms": F.lag("duration_ms").over(order),
        "gap_ms": F.col("first_published_at_ms") - F.lag("last_published_at_ms").over(order), "prior_last_provenance": F.lag("last_provenance_present").over(order),
        "last_turn": F.max("block_idx").over(earlier), "prior_contribution_count": F.coalesce(F.sum("version_count").over(earlier), F.lit(0)),
        "since": F.min("first_published_at_ms").over(Window.partitionBy("package_id", "identity")), "identity_versions": F.sum("version_count").over(Window.partitionBy("package_id", "identity")),
    })


def gathered(rows: DataFrame) -> DataFrame:
    """One row for each tenure block of numbered rows that know their domain's releases, first time and first row in the package."""
    blocks = rows.groupBy("package_id", "block_idx", "identity").agg(
        F.min_by(F.struct("publisher_email", "domain", "domain_versions", "first_seen_in_package_ms", "version", "provenance_present"), "rn").alias("_a"), F.max_by(F.struct("version", "provenance_present"), "rn").alias("_z"),
        F.count("*").alias("version_count"), F.min("published_at_ms").alias("first_published_at_ms"), F.max("published_at_ms").alias("last_published_at_ms"),
        F.max("_first_rn").alias("newest_domain_rn"), F.count_if(F.col("_first_rn") == F.col("rn")).alias("new_domains"),
    )
    return blocks.select(
        "package_id", "block_idx", "identity", F.col("_a.publisher_email").alias("email"), "_a.domain", "_a.domain_versions", "_a.first_seen_in_package_ms", "version_count",
        F.col("_a.version").alias("first_version"), F.col("_z.version").alias("last_version"), F.col("_a.provenance_present").alias("first_provenance_present"), F.col("_z.provenance_present").alias("last_provenance_present"),
        "first_published_at_ms", "last_published_at_ms", (F.col("last_published_at_ms") - F.col("first_published_at_ms")).alias("duration_ms"), "newest_domain_rn", "new_domains",
    )


def classify(blocks: DataFrame, p: Params = Params()) -> DataFrame:
    """Blocks with their provider and, but for the first of a package, what they took over; expressions only."""
    blocks = blocks.withColumns({
        "provider": provider(F.col("domain"), F.col("domain_versions"), p.min_verified_versions),
        "is_overlap": F.coalesce(F.col("last_turn") >= F.col("block_idx") - param(p.overlap_window), F.lit(False)), "is_known": F.col("prior_contribution_count") >= param(p.known_count),
    })
    cell = F.when(F.col("is_overlap") & F.col("is_known"), "recurring_member").when(F.col("is_overlap"), "new_committee_member").when(F.col("is_known"), "returning_dormant").otherwise("cold_handoff")
    return blocks.withColumn("cell", F.when(F.col("block_idx") > 0, cell))


def transitions(classified: DataFrame) -> DataFrame:
    """One row for each block after the first: what it took over, and whether its identity is recent or known."""
    new = F.coalesce(F.col("domain").isNotNull() & (F.col("first_seen_in_package_ms") == F.col("first_published_at_ms")), F.lit(False))
    return classified.where("block_idx > 0").withColumns({
        "from_index": F.col("block_idx") - 1, "to_identity": F.col("identity"), "at_version": F.col("first_version"), "at_published_at_ms": F.col("first_published_at_ms"), "seen_before": F.col("since") < F.col("first_published_at_ms"), "new_domain": new,
    })


def summary(releases: DataFrame, classified: DataFrame, keys: tuple[str, ...] = ("package_id",), p: Params = Params()) -> DataFrame:
    """One row per package, also for packages without a valid row: signals, shape and profile from one aggregate of its blocks.

    `releases` has the number of a package's rows. A package is churning if a domain occurs in its last rows
    only, else mixed from three domains on, else stable.
    """
    of_blocks = classified.groupBy(*keys).agg(
        F.sum("version_count").alias("_seen"), (F.max("last_published_at_ms") - F.min("first_published_at_ms")).alias("total_history_duration_ms"), F.count_if(F.col("last_turn").isNull()).alias("unique_identity_count"),
        F.max("version_count").alias("longest_tenure_versions"), F.max("duration_ms").alias("longest_tenure_duration_ms"), F.max("identity_versions").alias("_most"),
        F.max("newest_domain_rn").alias("_newest"), F.sum("new_domains").alias("_domains"), F.collect_set("provider").alias("_providers"),
        F.count("cell").alias("transition_count"), F.max("prior_tenure_versions").alias("max_prior_tenure_versions"), F.max(F.when(F.col("cell") == "cold_handoff", F.col("prior_tenure_versions"))).alias("max_cold_handoff_prior_tenure"),
        *(F.count_if(F.col("cell") == cell).alias(name) for name, cell in CELLS.items()), F.bool_or(F.col("is_overlap") & (F.col("block_idx") > 0)).alias("_overlap"),
    )  # at most five providers
    out = releases.join(of_blocks, list(keys), "left")
    seen, alone = F.coalesce("_seen", F.lit(0)).cast("long"), (F.col("unique_identity_count") == 1) | (F.col("_most") / F.col("_seen") >= param(p.solo_dominance))
    enough = seen >= param(p.min_history)
    kind = F.when(~enough, "unknown").when(alone, "solo").when(F.col("unique_identity_count") == 2, "alternating").otherwise("committee")
    held = F.coalesce("_providers", F.array().cast("array<string>"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        *keys, seen.alias("observed_versions_count"), zero("unique_identity_count"), enough.alias("has_sufficient_history"), zero("max_prior_tenure_versions"), zero("max_cold_handoff_prior_tenure"), *map(zero, CELLS),
        zero("total_history_duration_ms"), zero("longest_tenure_versions"), zero("longest_tenure_duration_ms"), zero("transition_count"), (F.col("_all") - seen).alias("skipped_versions_count"),
        F.coalesce("_overlap", F.lit(False)).alias("has_overlap_transition"), kind.alias("shape"), F.sort_array(held).alias("providers_seen"),
        F.array_contains(held, "privacy").alias("has_privacy_provider"), F.array_contains(held, "unverified").alias("has_unverified_domain"),
        F.when(F.col("_newest") >= F.col("_seen") - param(p.churning_window), "churning").when(F.col("_domains") >= 3, "mixed").otherwise("stable").alias("domain_stability"),
    )


PROFILE = ("providers_seen", "has_privacy_provider", "has_unverified_domain", "domain_stability")


class Pattern(Relations):
    """The pattern's relations, made on demand: rows, blocks, tenure, transitions, summary, signals, identity_profile, shape.

    `shared`: several of them are asked for, so blocks and summary are checkpointed.
    """

    def __init__(self, history: DataFrame, grid: Grid = Grid(), shared: bool = True):
        keep = cut if shared else (lambda df: df)
        keys, p = grid.keys, grid.params
        releases = lambda: history.groupBy("package_id").agg(F.count("*").alias("_all"))
        super().__init__(
            rows=lambda: valid_rows(history),
            blocks=lambda: keep(bare_blocks(self["rows"])),
            tenure=lambda: classify(grid.spread(self["blocks"]), p),
            transitions=lambda: transitions(self["tenure"]),
            summary=lambda: keep(summary(grid.spread(releases()), self["tenure"], keys, p)),
            signals=lambda: self["summary"].drop("shape", *PROFILE),
            identity_profile=lambda: self["summary"].select(*keys, *PROFILE),
            shape=lambda: self["summary"].select(*keys, "shape"),
        )
        self.grid = grid


def extract(history: DataFrame, grid: Grid = Grid(), shared: bool = True) -> Pattern:
    """All relations of the pattern."""
    return Pattern(history, grid, shared)
