"""A batch becomes visible in all tables or in none; compaction keeps the rows and touches its buckets only."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from pedigree.streaming import observe
from pedigree.streaming.observe import WitnessStore

NOW = 1_776_254_400_000


def docs(spark, *packages):
    def one(name, n, sha="s"):
        entry = {f"1.0.{k}": {"dist": {"integrity": f"{sha}{k}", "tarball": f"https://r/{name}-{k}.tgz"}, "dependencies": {"d": "1"}, "_npmUser": {"name": "a", "email": "a@x.io"}} for k in range(n)}
        return json.dumps({"name": name, "versions": entry, "time": {f"1.0.{k}": f"2025-0{k + 1}-01T00:00:00Z" for k in range(n)}})

    return spark.createDataFrame([(one(*p) if isinstance(p, tuple) else p,) for p in packages], "document string")


def state(store):
    tables = {
        "releases": store.releases().drop("files", "maintainers"),
        "files": store.files(),
        "decisions": store.decisions().withColumn("results", F.to_json("results")),
        "seen": store.last_seen(),
        "quarantine": store.quarantine(),
    }
    return {name: sorted(map(tuple, df.collect()), key=repr) for name, df in tables.items()}


BATCHES = [(("p", 3), ("q", 2), "no json"), (("p", 4), ("q", 2, "other"), "[1]"), (("p", 5, "other"), ("new", 1))]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    store = WitnessStore(spark, str(tmp_path_factory.mktemp("whole")))
    states = [state(store)]
    for k, packages in enumerate(BATCHES):
        store.observe(docs(spark, *packages), k, NOW)
        states.append(state(store))
    return store, states


@pytest.mark.parametrize("stop", ["seen", "finished"])
def test_a_stopped_writer_leaves_nothing_visible(spark, tmp_path, monkeypatch, whole, stop):
    store, (_, before, after, _) = WitnessStore(spark, str(tmp_path)), whole[1]
    store.observe(docs(spark, *BATCHES[0]), 0, NOW)
    assert state(store) == before
    with monkeypatch.context() as m:
        kept = observe.WitnessStore._append

        def append(self, rows, name, schema):
            if name == stop:
                raise OSError("stopped")
            kept(self, rows, name, schema)

        m.setattr(observe.WitnessStore, "_append", append)
        with pytest.raises(OSError, match="stopped"):
            store.observe(docs(spark, *BATCHES[1]), 1, NOW)
    assert glob.glob(f"{tmp_path}/versions/bucket=*/*") and state(store) == before
    store.observe(docs(spark, *BATCHES[1]), 1, NOW)
    assert state(store) == after
    store.observe(docs(spark, *BATCHES[2]), 1, NOW + 9)  # finished: not done again
    assert state(store) == after and store.finished().count() == 2


def test_compaction(spark, whole):
    store, states = whole
    files = lambda t: {f: os.path.getmtime(f) for f in glob.glob(f"{store.path}/{t}/bucket=*/*.parquet")}
    by_bucket = lambda found: {b: [f for f in found if os.path.dirname(f) == b] for b in map(os.path.dirname, found)}
    before = {t: by_bucket(files(t)) for t in ("versions", "decisions")}
    assert store.compact() == {t: sum(len(f) > 1 for f in before[t].values()) for t in before} and any(len(f) > 1 for f in before["versions"].values())
    after = {t: by_bucket(files(t)) for t in before}
    for t in before:
        assert before[t].keys() == after[t].keys() and all(len(f) == 1 for f in after[t].values())
        assert all(after[t][b] == f for b, f in before[t].items() if len(f) == 1)  # others keep their files
    assert state(store) == states[-1] and store.compact() == {"versions": 0, "decisions": 0}
    store.observe(docs(spark, ("p", 6)), 3, NOW)
    assert store.releases().where("package_name = 'p'").count() == 6


def test_an_empty_store(spark, tmp_path):
    store = WitnessStore(spark, str(tmp_path))
    assert store.compact() == {"versions": 0, "decisions": 0} and not any(state(store).values())
    store.observe(docs(spark, "x").limit(0), 0, NOW)
    assert not any(state(store).values()) and store.finished().count() == 1
