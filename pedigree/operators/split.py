"""Train and test parts of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.operators.evaluation import split_violations


def draw(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """n packages in the order of a seeded digest: the same ones for the same seed, whatever the partitioning."""
    return pool.select("package_id").orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("package_id").cast("string"))), "package_id").limit(n)


def build(corpus: DataFrame, held_out: DataFrame, locked: DataFrame, attack_sample: int = 0, clean_sample: int = 4, seed: int = 20260422) -> DataFrame:
    """(package_id, attack, part) of every package of (package_id, attack) rows.

    Held-out packages and samples of the other attacked and of the clean ones make the test part; the
    rest, with the locked packages, is for training.
    """
    free = corpus.where("attack").join(held_out.select("package_id").unionByName(locked.select("package_id")), "package_id", "left_anti")
    test = held_out.select("package_id").unionByName(draw(free, attack_sample, seed)).unionByName(draw(corpus.where("not attack"), clean_sample, seed)).distinct()
    return corpus.join(test.withColumn("_t", F.lit(True)), "package_id", "left").select("package_id", "attack", F.when(F.col("_t"), "test").otherwise("train").alias("part"))


def problems(split: DataFrame, corpus: DataFrame, held_out: DataFrame) -> DataFrame:
    """Leaks between the parts, see `split_violations`."""
    part = lambda p: split.where(F.col("part") == p).select("package_id")
    return split_violations(part("train"), part("test"), corpus.select("package_id"), held_out.select("package_id"))
