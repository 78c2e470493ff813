"""Names, paths, targets, registry, splits and result files."""

import json

import pytest
from pyspark.sql import functions as F

from pedigree.functions import names
from pedigree.operators import split
from pedigree.operators.registry import PATTERNS, PatternModule, check
from pedigree.plans import verbs
from pedigree.sources import results


def one(spark, column, *values):
    schema = ", ".join(f"c{k} string" for k in range(len(values)))
    return spark.createDataFrame([values], schema).select(column(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "path, expected",
    [("/lodash", ("packument", "lodash", None)), ("/@a/b", ("packument", "@a/b", None)), ("/@a%2Fb", ("packument", "@a%2Fb", None)), ("/x/-/x-1.0.0.tgz", ("tarball", "x", "x-1.0.0.tgz")), ("/@a/b/-/b-1.tgz", ("tarball", "@a/b", "b-1.tgz")), ("/", ("unknown", None, None)), ("/-/ping", ("unknown", None, None)), ("/a/b/c", ("unknown", None, None)), (None, ("unknown", None, None))],
)
def test_paths(spark, path, expected):
    assert tuple(one(spark, names.request_kind, path)) == expected


def test_names(spark):
    assert one(spark, names.tarball_version, "@a/b", "b-1.2.3-rc.1.tgz") == "1.2.3-rc.1"
    assert one(spark, names.tarball_version, "b", "c-1.2.3.tgz") is None
    assert one(spark, names.encoded_name, "@a/b") == "@a%2Fb"
    assert tuple(one(spark, names.target, "@a/b@1.0.0")) == ("@a/b", "1.0.0")
    assert one(spark, names.target, "@ab") is None and one(spark, names.target, "ab") is None


def test_registry():
    assert set(PATTERNS) == {"publisher", "provenance"}
    for bad in (PatternModule("", 1, print), PatternModule("x", 0, print), PatternModule("x", 1, None), PatternModule("x", 1, print, "history")):
        with pytest.raises(ValueError):
            check(bad)


def test_split_is_seeded_and_without_leaks(spark):
    corpus = spark.range(60).select(F.col("id").alias("package_id"), (F.col("id") % 10 == 0).alias("attack"))
    held, locked = corpus.where("package_id = 0"), corpus.where("package_id in (10, 20)")
    parts = [sorted(map(tuple, split.build(c, held, locked, 1, 4).collect())) for c in (corpus, corpus.repartition(7))]
    assert parts[0] == parts[1]
    test = [p for p, _, part in parts[0] if part == "test"]
    assert len(test) == 6 and 0 in test and not {10, 20} & set(test)
    assert split.problems(split.build(corpus, held, locked, 1, 4), corpus, held).count() == 0


def test_files(spark, tmp_path):
    doc = {"test_set": {"packages": ["a", "b"], "attack_labeled": ["a"]}, "train_set": {"packages": ["c"], "attack_labeled": []}}
    (tmp_path / "split.json").write_text(json.dumps(doc, indent=1))
    rows = sorted(map(tuple, results.read_split(spark, str(tmp_path / "split.json")).collect()))
    assert rows == [("test", "a", True), ("test", "b", False), ("train", "c", False)]
    results.write_document(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).strip() == '{"a":1,"b":null}'


def test_why(spark):
    log = spark.createDataFrame([("p", "1", 0, "ALLOW", []), ("p", "1", 1, "WARN", [("g", "WARN", "d")])], "package_name string, version string, obs long, disposition string, results array<struct<gate:string,result:string,detail:string>>")
    assert [tuple(r) for r in verbs.why("p", "1", log).collect()] == [("p", "1", "WARN", "g", "WARN", "d")]
