"""Splits and result documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(part, package, attack) rows of a split document."""
    doc = spark.read.json(path, multiLine=True, schema="test_set struct<packages:array<string>,attack_labeled:array<string>>, train_set struct<packages:array<string>,attack_labeled:array<string>>")
    parts = [doc.select(F.lit(p).alias("part"), F.explode(f"{p}_set.packages").alias("package"), F.col(f"{p}_set.attack_labeled").alias("_a")) for p in ("train", "test")]
    return parts[0].unionByName(parts[1]).select("part", "package", F.coalesce(F.array_contains("_a", F.col("package")), F.lit(False)).alias("attack"))


def write_document(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """Rows as JSON lines, sorted over all files if an order is given; the committer makes them appear at once or not at all."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ("section", "package_id", "label_id")) -> None:
    """Ready lines (column `line`) as text, sorted over all files: the same bytes, file after file, for the same rows."""
    lines.orderBy(*order, "line").select("line").write.mode("overwrite").text(path)
