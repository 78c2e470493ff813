"""The result document asks for rows of labelled packages only; rows of one time are in version order."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pedigree.functions.columns import major, semver_key
from pedigree.operators import evaluation, provenance, publisher
from pedigree.plans import store_queries


def test_attribution_takes_rows_of_labelled_packages_only(spark, sf_dir, monkeypatch):
    seen, attribute = [], evaluation.attribute
    monkeypatch.setattr(evaluation, "attribute", lambda labels, targets, last, rows: seen.append((labels, rows)) or attribute(labels, targets, last, rows))
    store_queries.QUERIES["result_document"](spark, sf_dir)
    ((labels, rows),) = seen
    of = lambda df: {r.package_id for r in df.select("package_id").distinct().collect()}
    assert of(rows) and of(rows) <= of(labels)


def test_rows_of_one_time_are_in_version_order(spark):
    rows = [(p, k, f"{k * 7 % 5}.{k * 3 % 11}.0" + ("-rc.1" if k % 4 == 0 else ""), 1000 + k // 3 % 4 if p else k, f"n{k % 3}", None, True) for p in range(3) for k in range(60)]
    history = spark.createDataFrame(rows, "package_id long, input_idx long, version string, published_at_ms long, publisher_name string, publisher_email string, provenance_present boolean")
    full = semver_key(F.col("version"))
    for made, order in ((publisher.valid_rows(history), (full, "identity", "input_idx")), (provenance.valid_rows(history), (full, "input_idx"))):
        told = made.withColumn("want", F.row_number().over(Window.partitionBy("package_id").orderBy("published_at_ms", *order)) - 1)
        assert told.count() and told.where("rn <> want").count() == 0


def test_major_of_odd_versions(spark):
    found = {"1.2.3": 1, " 4.0.0 ": 4, "05.x": 5, " 6.x": None, "v1": None, "": None, "7": None, "8.": 8, "9" * 39 + ".0.0": None, None: None}
    df = spark.createDataFrame([(v,) for v in found], "v string").select("v", major(F.col("v")).alias("m"))
    assert {r.v: r.m if r.m is None else int(r.m) for r in df.collect()} == found
