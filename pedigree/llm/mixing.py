"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are put in a pseudo-random order and cut into blocks. With integer weights
c and P = the sum of the active weights, block k of a source is released at slot floor(k*P/c) and
due at slot ceil((k+1)*P/c); in each slot the released block with the earliest deadline is taken.
As the weights add up to one slot per slot, every deadline is met, so after t slots each source has
been given t*c/P blocks with a deviation of less than one block.

The schedule repeats after P slots (a cycle), in which each source gets exactly c blocks, so only
one cycle is scheduled and the rest is arithmetic. A source that runs out leaves at the end of its
last cycle and the others' weights are scaled up: one schedule for each of the nested active sets,
at most (number of weights + 1) * P rows in all, whatever the corpus holds. Sources without a
weight share one. Everything is DataFrame expressions.

No key is gathered in one task: a source is ranked in 256 parts by the digest of its document
ids, and the parts' offsets come from counts that are summed before the shuffle.

Defined cases: a null or unlisted source belongs to the shared class `(other)`; a null id counts as
the empty text; rows with equal ids follow each other in any order; all rows are kept; an empty
table gives no rows; columns of the input that are named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "(other)"
ADDED = ("mix_source", "mix_block", "mix_slot", "mix_pos", "mix_release", "mix_deadline")
#: Hex digits of the id's digest that split a source: 16**2 parts.
PART_DIGITS = 2


def class_column(source: str, weights: dict[str, int]):
    """The weight class of a source: itself if it has a weight, the shared class otherwise."""
    return F.when(F.col(source).cast("string").isin(sorted(weights)), F.col(source).cast("string")).otherwise(F.lit(OTHER))


def schedule(counts: DataFrame, weights: dict[str, int], other_weight: int, block_rows: int) -> DataFrame:
    """(cls, k, since, until, slots, base, slot, release, deadline) per active set and block of its cycle, from (cls, n) rows.

    `since` and `until` delimit the cycles of the active set, `slots` is its P and `base` its first slot.
    """
    known = F.create_map(*[F.lit(x) for kv in sorted((weights | {OTHER: other_weight}).items()) for x in kv])
    sized = counts.select("cls", F.element_at(known, F.col("cls")).cast("long").alias("c"), F.ceil(F.col("n") / block_rows).alias("blocks"))
    sized = sized.withColumn("cycles", F.ceil(F.col("blocks") / F.col("c")))
    ends = sized.select(F.col("cycles").alias("until")).distinct()
    active = ends.join(sized, F.col("cycles") >= F.col("until")).groupBy("until").agg(F.array_sort(F.collect_list(F.struct("cls", "c"))).alias("active"), F.sum("c").alias("slots"))
    by_end = Window.orderBy("until")  # one row per active set: at most the number of weights
    active = active.withColumn("since", F.coalesce(F.lag("until").over(by_end), F.lit(0)))
    length = (F.col("until") - F.col("since")) * F.col("slots")
    active = active.withColumn("base", F.coalesce(F.sum(length).over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Earliest deadline first over the slots of one cycle; the state is the number of blocks given so far.
    picks = F.expr("""
        aggregate(
          sequence(0L, slots - 1),
          named_struct('given', transform(active, a -> 0L), 'picks', cast(array() as array<int>)),
          (s, t) -> transform(
            array(array_min(transform(active, (a, i) ->
              if(s.given[i] < a.c and s.given[i] * slots div a.c <= t,
                 named_struct('deadline', -(-(s.given[i] + 1) * slots div a.c) + if((s.given[i] + 1) * slots % a.c = 0, 0, 1), 'i', i), null))).i),
            p -> named_struct('given', transform(s.given, (g, i) -> if(i = p, g + 1, g)), 'picks', array_append(s.picks, p)))[0],
          s -> s.picks)
    """)
    slots = active.select("since", "until", "slots", "base", "active", F.posexplode(picks).alias("slot", "i")).select("since", "until", "slots", "base", "slot", F.col("active")[F.col("i")]["cls"].alias("cls"), F.col("active")[F.col("i")]["c"].alias("c"))
    k = F.row_number().over(Window.partitionBy("until", "cls").orderBy("slot")) - 1
    slots = slots.withColumn("k", k.cast("long"))
    return slots.select(
        "cls", "k", "c", "since", "until", "slots", "base", F.col("slot").cast("long").alias("slot"),
        F.floor(F.col("k") * F.col("slots") / F.col("c")).alias("release"), F.ceil((F.col("k") + 1) * F.col("slots") / F.col("c")).alias("deadline"),
    )


def mix_sources(docs: DataFrame, weights: dict[str, int], other_weight: int = 1, block_rows: int = 32, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows with their place in the mix; reading by (mix_slot, mix_pos) gives the interleaved corpus.

    mix_source: weight class. mix_block: block within the class. mix_slot: the block's slot.
    mix_pos: place within the block. mix_release, mix_deadline: the slots between which the block is due.
    """
    if other_weight < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    docs = docs.drop(*[c for c in docs.columns if c in ADDED])
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = docs.withColumn("mix_source", class_column(source_col, weights)).withColumn("mix_digest_", digest).withColumn("mix_part_", F.substring("mix_digest_", 1, PART_DIGITS))
    parts = docs.select(class_column(source_col, weights).alias("cls"), F.substring(digest, 1, PART_DIGITS).alias("part")).groupBy("cls", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(F.col("cls").alias("mix_source"), F.col("part").alias("mix_part_"), F.coalesce(before, F.lit(0)).alias("mix_before_"))
    plan = schedule(parts.groupBy("cls").agg(F.sum("n").alias("n")), weights, other_weight, block_rows)

    within = Window.partitionBy("mix_source", "mix_part_").orderBy("mix_digest_", id_col)
    ranked = keyed.withColumn("mix_rank_", F.row_number().over(within).cast("long") - 1)
    # At most (weights + 1) * 256 rows: a fixed bound.
    ranked = ranked.join(F.broadcast(offsets), ["mix_source", "mix_part_"])
    rank = F.col("mix_before_") + F.col("mix_rank_")
    ranked = ranked.withColumn("mix_block", F.expr(f"(mix_before_ + mix_rank_) div {int(block_rows)}")).withColumn("mix_pos", rank % block_rows)
    # At most (weights + 1) * P rows: a fixed bound.
    plan = F.broadcast(plan.select([F.col(c).alias(f"plan_{c}_") for c in plan.columns]))
    cycle = F.expr("mix_block div plan_c_")
    placed = ranked.join(plan, (F.col("mix_source") == F.col("plan_cls_")) & (F.col("mix_block") % F.col("plan_c_") == F.col("plan_k_")) & (cycle >= F.col("plan_since_")) & (cycle < F.col("plan_until_")))
    start = F.col("plan_base_") + (cycle - F.col("plan_since_")) * F.col("plan_slots_")
    return placed.select(
        *docs.columns, "mix_source", "mix_block", (start + F.col("plan_slot_")).alias("mix_slot"), "mix_pos",
        (start + F.col("plan_release_")).alias("mix_release"), (start + F.col("plan_deadline_")).alias("mix_deadline"),
    )


def oracle(weights: dict[str, int], other_weight: int, block_rows: int, relation: str = "documents", columns: str = "doc_id") -> str:
    """The same mix as DuckDB SQL (the schedule by recursion over slots)."""
    values = ", ".join(f"('{k}', {v})" for k, v in sorted((weights | {OTHER: other_weight}).items()))
    return f"""
WITH RECURSIVE w(cls, c) AS (VALUES {values}),
d AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '')) AS dg, CASE WHEN source IN (SELECT cls FROM w WHERE cls <> '{OTHER}') THEN source ELSE '{OTHER}' END AS cls FROM {relation}),
r AS (SELECT *, (row_number() OVER (PARTITION BY cls ORDER BY dg, doc_id) - 1) AS rk FROM d),
b AS (SELECT *, rk // {block_rows} AS block, rk % {block_rows} AS pos FROM r),
s AS (SELECT w.cls, w.c, ceil((max(block) + 1) / w.c)::BIGINT AS cycles FROM b JOIN w ON b.cls = w.cls GROUP BY w.cls, w.c),
e AS (SELECT DISTINCT cycles AS til FROM s),
a AS (SELECT til, list(s.cls ORDER BY s.cls) AS cl, list(s.c::BIGINT ORDER BY s.cls) AS cs, sum(s.c)::BIGINT AS p FROM e JOIN s ON s.cycles >= e.til GROUP BY til),
a2 AS (SELECT *, coalesce(lag(til) OVER (ORDER BY til), 0) AS since FROM a),
a3 AS (SELECT *, coalesce(sum((til - since) * p) OVER (ORDER BY til ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM a2),
g(til, t, given, pick) AS (
  SELECT til, -1::BIGINT, list_transform(cs, lambda x: 0::BIGINT), 0::BIGINT FROM a3
  UNION ALL
  SELECT n.til, n.t, list_transform(n.given, lambda x, i: CASE WHEN i = n.pick THEN x + 1 ELSE x END), n.pick
  FROM (SELECT g.til, g.t + 1 AS t, g.given,
          list_min(list_filter(list_transform(range(1, len(a3.cs) + 1), lambda i: CASE WHEN g.given[i] < a3.cs[i] AND (g.given[i] * a3.p) // a3.cs[i] <= g.t + 1
            THEN ((((g.given[i] + 1) * a3.p + a3.cs[i] - 1) // a3.cs[i]) * 100000 + i) ELSE NULL END), lambda x: x IS NOT NULL)) % 100000 AS pick
        FROM g JOIN a3 USING (til) WHERE g.t + 1 < a3.p) n),
q AS (SELECT g.til, g.t, a3.cl[g.pick] AS cls, a3.cs[g.pick] AS c, row_number() OVER (PARTITION BY g.til, g.pick ORDER BY g.t) - 1 AS k, a3.since, a3.base, a3.p
      FROM g JOIN a3 USING (til) WHERE g.t >= 0)
SELECT {columns}, b.cls AS mix_source, b.block::BIGINT AS mix_block, (q.base + (b.block // q.c - q.since) * q.p + q.t)::BIGINT AS mix_slot, b.pos::BIGINT AS mix_pos,
  (q.base + (b.block // q.c - q.since) * q.p + (q.k * q.p) // q.c)::BIGINT AS mix_release,
  (q.base + (b.block // q.c - q.since) * q.p + ((q.k + 1) * q.p + q.c - 1) // q.c)::BIGINT AS mix_deadline
FROM b JOIN q ON b.cls = q.cls AND b.block % q.c = q.k AND b.block // q.c >= q.since AND b.block // q.c < q.til
"""
