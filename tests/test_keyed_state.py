"""Observation with keyed state against observation over tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from pedigree.params import Params
from pedigree.streaming import keyed
from pedigree.streaming.observe import WitnessStore
from test_store_and_streams import NOW, document, release


@pytest.fixture
def stateful(spark):
    yield keyed.use_state_store(spark)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def rounds():
    """Documents of four micro-batches: an attack, a replay, a changed hash, a late release and one of another package."""
    versions = {f"1.0.{k}": release(k, attested=True) for k in range(9)}
    times = {f"1.0.{k}": f"2025-0{min(k + 1, 9)}-01T00:00:00Z" for k in range(9)}
    versions["1.0.9"] = release(9, "evil@pm.me", {"base": "^1", "dropper": "1"}, scripts={"postinstall": "node x"})
    times["1.0.9"] = "2026-04-11T12:00:00Z"
    first = document("p", versions, times)
    other = document("q", {"0.1.0": release(1), "0.2.0": 5}, {"0.1.0": "2025-01-01T00:00:00Z"})
    yield [first, other, "no json"]
    yield [first]
    versions = versions | {"1.0.3": release(3, sha="sha512-other", attested=True)}
    yield [document("p", versions, times), other]
    versions, times = versions | {"0.9.9": release(0, "old@x.io")}, times | {"0.9.9": "2024-01-01T00:00:00Z"}
    yield [document("p", versions, times)]


def told(rows):
    return sorted((r.version, r.disposition, tuple(map(tuple, r.results))) for r in rows)


def test_keyed_state_decides_like_the_store(stateful, tmp_path):
    """Each round is a new start of the query: it goes on from its checkpoint."""
    spark, source, out = stateful, tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    spark.createDataFrame([], keyed.DECIDED).write.parquet(out)
    witness, seen = WitnessStore(spark, str(tmp_path / "store")), set()
    for batch, texts in enumerate(rounds()):
        for k, text in enumerate(texts):
            (source / f"{batch}-{k}.txt").write_text(text)
        docs = spark.readStream.format("text").option("wholetext", True).load(str(source)).select(F.col("value").alias("document"))
        keyed.decisions(docs, NOW).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(out).awaitTermination()
        rows = told(spark.read.schema(keyed.DECIDED).parquet(out).collect())
        new = [r for r in rows if r not in seen]
        seen |= set(rows)
        incoming = spark.createDataFrame([(t,) for t in texts], "document string")
        witness.observe(incoming, batch, NOW, can_look_up=False)
        assert new == told(witness.decisions().where(F.col("batch") == batch).collect()), batch
        assert len(rows) == len(seen)
    assert any(r[1] == "BLOCK" for r in seen) and any(r[1] == "WARN" for r in seen)


def test_lookups_are_asked_once_and_failures_expire(stateful, tmp_path):
    spark, source = stateful, tmp_path / "in"
    source.mkdir()
    got = []
    rows = spark.readStream.schema(keyed.WANTED).json(str(source))
    query = keyed.lookups(rows, Params(error_ttl_ms=4000), 600_000).writeStream.foreachBatch(lambda df, b: got.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).start()

    def feed(name, *records):
        """What a file of records brings out; its mark, a new name, tells when the batch is done."""
        (source / name).write_text("\n".join(json.dumps(dict(zip(("dep", "code", "first_publish_ms"), r))) for r in [*records, (f"mark{name}",)]))
        until = time.time() + 60
        while not any(r[0] == f"mark{name}" for r in got):
            assert time.time() < until and query.isActive
            time.sleep(0.1)
        told, got[:] = sorted((r for r in got if not r[0].startswith("mark")), key=repr), []
        return told

    try:
        assert feed("0", ("a",), ("a",), ("b",), ("",)) == [("a", "fetch", None, None), ("b", "fetch", None, None)]
        assert feed("1", ("a",)) == []  # being asked
        assert feed("2", ("a", 500), ("b", 200, 7), ("c", 404)) == [("a", "known", "error", None), ("b", "known", "ok", 7), ("c", "known", "vanished", None)]
        time.sleep(5)
        assert feed("3", ("a",), ("b",), ("c",)) == [("a", "fetch", None, None)]  # the failure has expired
    finally:
        query.stop()
