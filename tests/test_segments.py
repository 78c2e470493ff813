"""Patterns by ranges of a package against those by whole packages."""

import random

import pytest
from pyspark.sql import functions as F

from pedigree.operators import provenance, publisher, segments
from pedigree.operators.segments import Ranges

HISTORY = "package_id long, package_name string, input_idx long, version string, published_at string, published_at_ms long, publisher_name string, publisher_email string, publisher_tool string, provenance_present boolean"
#: Ranges of about three rows.
SMALL = Ranges(least=3, share=10**9, pieces=40)
BLOCKS = ("package_id", "block_idx")


def history(rng, packages=6, releases=120):
    rows = []
    for p in range(packages):
        who = rng.choice([["a@x.io"], ["a@x.io", "b@y.io"], ["a@x.io", "b@y.io", "c@pm.me", None, "npm-oidc-no-reply@github.com"]])
        ms, email, attested = 1_700_000_000_000, who[0], True
        for k in range(releases if p else 4):
            ms += rng.choice([0, 0, 1000, 86_400_000])
            email = rng.choice(who) if rng.random() < 0.3 else email
            attested = rng.choice([True, True, True, False, None]) if rng.random() < 0.3 else attested
            version = rng.choice([f"{k // 40}.{k % 40}.0", f"{k // 40}.{k % 40}.0", f"0.{k // 2}.0", "odd", None, ""])
            rows.append((p, f"p{p}", k, version, None, rng.choice([ms] * 9 + [None]), "dev" if email else None, email, None, attested))
    return rows


def rows_of(df, keys):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_give_the_same_rows(spark, seed):
    df = spark.createDataFrame(history(random.Random(seed)), HISTORY)
    plain, cut = publisher.extract(df), segments.publisher_pattern(df, how=SMALL)
    for name in ("blocks", "tenure", "transitions", "summary"):
        assert rows_of(cut[name], BLOCKS) == rows_of(plain[name], BLOCKS)
    plain, cut = provenance.extract(df), segments.provenance_pattern(df, how=SMALL)
    for name in ("per_version", "carriers", "rollup", "per_major"):
        assert rows_of(cut[name], BLOCKS) == rows_of(plain[name], BLOCKS)


def test_large_groups_are_cut_and_small_ones_are_not(spark):
    df = spark.range(10_000).select((F.col("id") % 10 == 0).cast("long").alias("g"), F.col("id").alias("at"))
    out = segments.ranged(df, ["g"], "at", Ranges(least=2000, share=4, pieces=16)).groupBy("g").agg(F.countDistinct("_range").alias("ranges"), F.max("_cut").alias("cut")).collect()
    assert {r.g: (r.ranges, r.cut) for r in out} == {0: (16, True), 1: (1, False)}
    most = segments.ranged(df, ["g"], "at", Ranges(least=2000, share=4, pieces=16)).where("_cut").groupBy("_range").count().agg(F.max("count")).first()[0]
    assert most < 9000 / 16 * 1.2
    assert segments.ranged(df.limit(0), ["g"], "at", Ranges()).count() == 0


def test_no_task_holds_a_whole_package(spark):
    """All windows over rows are dealt by range as well."""
    df = spark.createDataFrame(history(random.Random(3)), HISTORY)
    plan = segments.ranged(publisher.usable_rows(df), ["package_id"], "published_at_ms", SMALL)
    sizes = plan.groupBy("package_id", "_range").count().agg(F.max("count"), F.count("*")).first()
    whole = plan.groupBy("package_id").count().agg(F.max("count")).first()[0]
    assert sizes[0] * 4 < whole and sizes[1] > 50
