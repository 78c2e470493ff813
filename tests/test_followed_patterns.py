"""Patterns that follow their releases against patterns of the whole history."""

import random

from pyspark.sql import functions as F

from pedigree.streaming.patterns import PatternTables, relations
from test_segments import HISTORY, history, rows_of

KEYS = ("package_id",)


def files(folder):
    return {f.relative_to(folder) for f in folder.rglob("part-*.parquet")}


def test_batches_with_late_releases_equal_a_full_run(spark, tmp_path):
    rng = random.Random(7)
    rows = history(rng, packages=8, releases=40)
    rng.shuffle(rows)
    # The last batch holds two packages only, one of them in a bucket with others.
    last = [r for r in rows if r[0] in (1, 2)][:25]
    rest = [r for r in rows if r not in last]
    tables = PatternTables(spark, str(tmp_path / "t"), buckets=4)
    frame = lambda some: spark.createDataFrame(some, HISTORY)
    tables.update(frame(rest[:150]))
    tables.update(frame(rest[150:]))
    before = files(tmp_path / "t" / "tenure")
    tables.update(frame(last))
    after = files(tmp_path / "t" / "tenure")
    assert {f for f in before if f.parts[0] in ("bucket=0", "bucket=3")} == {f for f in after if f.parts[0] in ("bucket=0", "bucket=3")}
    assert before != after
    whole = relations(frame(rows))
    for name in whole:
        assert rows_of(tables.table(name), KEYS) == rows_of(whole[name], KEYS), name
    tables.update(frame(last))  # a batch that is run again
    tables.update(frame([]))
    assert tables.table("history").count() == len(rows)
    assert rows_of(tables.table("tenure"), KEYS) == rows_of(whole["tenure"], KEYS)


def test_stream_of_releases(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([r for r in history(random.Random(8), packages=2, releases=30)], HISTORY)
    tables = PatternTables(spark, str(tmp_path / "t"), buckets=2, make=lambda h, p: {"rollup": relations(h, p)["rollup"]})
    for k in (1, 0):
        df.where(F.col("input_idx") % 2 == k).write.mode("append").parquet(source)
        tables.attach(spark.readStream.schema(HISTORY).parquet(source), str(tmp_path / "checkpoint")).awaitTermination()
    assert rows_of(tables.table("rollup"), KEYS) == rows_of(relations(df)["rollup"], KEYS)


def test_one_relation_alone_is_the_same(spark, sf_dir, tmp_path):
    """Who keeps one relation pays for no other, and gets the same rows."""
    from pedigree.sources import adapters
    from pedigree.streaming import patterns

    history = adapters.release_history(spark, sf_dir)
    whole = patterns.relations(history)
    for name in ("tenure", "per_version"):
        tables = patterns.PatternTables(spark, f"{tmp_path}/{name}", buckets=2, make=lambda h, p, name=name: patterns.only(name, h, p))
        for k in range(2):
            tables.update(history.where(f"input_idx % 2 = {k}"))
        got = tables.table(name).select(*whole[name].columns)
        assert got.exceptAll(whole[name]).count() == whole[name].exceptAll(got).count() == 0 < got.count()
        assert {x.name for x in (tmp_path / name).iterdir()} == {"history", name}
