"""Failing releases, foreign gates, bounded lookups, whole fields in the stream's store."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pedigree.operators import foreign, gates, store
from pedigree.params import Params
from pedigree.streaming.isolation import isolate
from pedigree.streaming.observe import WitnessStore
from test_store_and_streams import NOW, document, release


def docs(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "document string")


def test_failing_keys_are_told_apart(spark):
    rows = spark.range(300).select("id", F.col("id").cast("string").alias("text")).withColumn("text", F.when(F.col("id").isin(7, 200), "x").otherwise(F.col("text")))
    done, failed = isolate(rows, ["id"], lambda df: df.select("id", F.col("text").cast("int").alias("n")))
    assert sorted(r.id for r in done.collect()) == [k for k in range(300) if k not in (7, 200)]
    assert sorted(f[0] for f in failed) == [7, 200] and all("x" in f[1] for f in failed)
    with pytest.raises(PySparkException):
        isolate(rows, ["id"], lambda df: df.select("nothing"))  # a wrong plan is no matter of rows
    with pytest.raises(PySparkException):
        isolate(rows.where("id in (7, 200)"), ["id"], lambda df: df.select(F.col("text").cast("int")), most=1)


def test_a_failing_release_lets_the_others_go_on(spark, tmp_path):
    witness = WitnessStore(spark, str(tmp_path / "store"))
    broken = dict(gates.GATES) | {"broken": lambda p: (F.when(F.col("version") == "1.0.1", F.raise_error(F.lit("boom"))).otherwise("WARN"), F.lit("said"))}
    versions = {f"1.0.{k}": release(k) for k in range(9)}
    text = document("p", versions, {})
    judged = Params(min_history=0)  # without it, gates skip a release without history and none fails
    witness.observe(docs(spark, text, "no json", "[1]", None), 0, NOW, judged, known=broken)
    witness.observe(docs(spark, text), 1, NOW + 5, judged, known=broken)
    decided = {r.version: r for r in witness.decisions().where("batch = 0").collect()}
    assert {v for v, r in decided.items() if r.disposition == "WARN"} == set(versions) - {"1.0.1"}
    only = witness.decisions().where("version = '1.0.1'").collect()
    assert [(r.batch, r.disposition, r.results) for r in only] == [(0, "ALLOW", [])]
    bad = [(r.package_name, r.version, r.stage) for r in witness.quarantine().collect()]
    assert bad.count(("p", "1.0.1", "gates")) >= 1 and bad.count((None, None, "document")) == 3
    assert any("boom" in r.error for r in witness.quarantine().where("stage = 'gates'").collect())
    assert witness.releases().count() == 9 and {r.seen_ms for r in witness.last_seen().collect()} == {NOW + 5}


def test_python_gates_skip_what_they_raise_on(spark):
    prepared = spark.createDataFrame([(1, f"1.0.{k}", 9) for k in range(9)], "package_id long, version string, n_prior long")

    def judge(facts):
        n = int(facts["version"].split(".")[-1])
        if n % 3 == 0:
            raise ValueError(f"no {n}")
        return ("WARN", "third") if n % 3 == 1 else "not a pair"

    custom = {"mine": foreign.python_gate(["version", "n_prior"], judge), "plain": lambda p: (F.lit("ALLOW"), F.lit(""))}
    for row in gates.run_gates(prepared, gates=custom).collect():
        n = int(row.version[-1])
        mine, plain = row.results
        assert plain.result == "ALLOW"
        assert (mine.result, mine.detail) == [("SKIP", f"gate_error: no {n}"), ("WARN", "third"), ("SKIP", "malformed gate output")][n % 3]
        assert row.disposition == ("WARN" if n % 3 == 1 else "ALLOW")


@pytest.mark.parametrize("told, attested", [('{"url":"u"}', True), ("{}", True), ('"text"', False), ('"{x"', False), ("false", False), ("[]", False), ("null", False), ("7", False)])
def test_attestations_must_be_objects(spark, tmp_path, told, attested):
    text = '{"name":"p","versions":{"1.0.0":{"dist":{"shasum":"s","tarball":"https://r/p.tgz","attestations":%s},"_npmUser":{"name":"%s"}}}}' % (told, "n" * 300)
    row = store.flatten_packuments(docs(spark, text)).first()
    assert row.provenance_present is attested and len(row.publisher_name) == 300
    if told in ('"text"', '{"url":"u"}'):
        witness = WitnessStore(spark, str(tmp_path / "store"))
        witness.observe(docs(spark, text), 0, NOW)
        kept = witness.releases().first()
        assert kept.provenance_present is attested and len(kept.publisher_name) == 300 and [f.filename for f in kept.files] == ["p.tgz"]
        assert witness.files().first().content_hash == "s"


def test_lookups_are_bounded_and_followed(spark, tmp_path):
    witness = WitnessStore(spark, str(tmp_path / "store"))
    names = lambda *some: spark.createDataFrame([(n,) for n in some], "dep string")
    asked = sorted(r.dep for r in witness.admit(names(*[f"d{k:03}" for k in range(130)], "d000", ""), 0, NOW).collect())
    assert asked == [f"d{k:03}" for k in range(100)]
    assert [tuple(r) for r in witness.dropped().collect()] == [(0, 30)]
    assert witness.admit(names("d001", "d120"), 1, NOW + 1).count() == 0  # one is being asked, there is no room for the other
    assert sorted(r.dep for r in witness.admit(names(*asked), 0, NOW).collect()) == asked  # the same batch again
    source = tmp_path / "answers"
    source.mkdir()
    lines = [{"dep": "d001", "code": 404, "document": None}, {"dep": "d002", "code": 200, "document": '{"time":{"created":"2001-07-03T23:00:00Z"}}'}, {"dep": "d003", "code": 500, "document": None}]
    (source / "a.json").write_text("\n".join(map(json.dumps, lines)))
    answers = spark.readStream.schema("dep string, code int, document string").json(str(source))
    witness.attach_lookups(answers, str(tmp_path / "checkpoint"), NOW + 2).awaitTermination()
    assert {r.dep: r.status for r in witness.lookups().collect()} == {"d001": "vanished", "d002": "ok", "d003": "error"}
    more = sorted(r.dep for r in witness.admit(names("d001", "d002", "d003", *[f"e{k}" for k in range(9)]), 2, NOW + 3).collect())
    assert more == ["e0", "e1", "e2"]
    assert witness.admit(names("x"), 3, NOW + 60_000).count() == 1  # old questions are given up
