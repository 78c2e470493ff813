"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller (small star) neighbours to its least neighbour.

    The minimum has map-side partial sums; the join back has one row per node on one side, so a node
    with very many links is split by adaptive execution.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the least node of each node's component, for the nodes that (a, b) links mention.

    Edges point from the larger to the smaller node; the rounds end when every component is a star
    around its least node, after about log(n) of them; if they don't end
    within `rounds` of them it is an error. Null ends and self-links are left out; an
    empty table gives no rows.
    """
    edges = cut(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b"))
    for _ in range(rounds):
        edges = cut(_star(_star(edges, True), False))
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"the components of the links did not settle in {rounds} rounds")
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("x")).select("x.*").distinct()
