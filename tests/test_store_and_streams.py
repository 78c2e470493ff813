"""Gates, store, streaming observation, seed bundles."""

import base64
import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from pedigree.operators import evaluation, gates, store, upkeep
from pedigree.plans import queries
from pedigree.sources import bundle
from pedigree.sources.results import write_lines
from pedigree.streaming import observe
from pedigree.streaming.observe import WitnessStore

NOW = 1_776_254_400_000


def document(name, versions, times):
    return json.dumps({"name": name, "dist-tags": {"latest": list(versions)[-1]}, "versions": versions, "time": times})


def release(k, email="a@x.io", deps=None, sha=None, attested=False, scripts=None):
    dist = {"integrity": sha or f"sha512-{k}", "shasum": f"s{k}", "tarball": f"https://r/p/-/p-1.0.{k}.tgz"} | ({"attestations": {"url": "u"}} if attested else {})
    return {"name": "p", "dist": dist, "dependencies": deps or {"base": "^1"}, "scripts": scripts or {}, "_npmUser": {"name": "dev", "email": email}}


def write(path, k, text):
    (path / f"{k}.txt").write_text(text)


def test_stream_replays_an_attack(spark, tmp_path):
    source, where = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    versions = {f"1.0.{k}": release(k, attested=True) for k in range(9)}
    times = {f"1.0.{k}": f"2026-0{k + 1 if k < 9 else 9}-01T00:00:00Z".replace("2026", "2025") for k in range(9)}
    versions["1.0.9"] = release(9, "evil@pm.me", {"base": "^1", "dropper": "1"}, scripts={"postinstall": "node x"})
    times["1.0.9"] = "2026-04-11T12:00:00Z"
    witness = WitnessStore(spark, str(where))

    def feed(k, text):
        write(source, k, text)
        docs = spark.readStream.format("text").option("wholetext", True).load(str(source)).select(F.col("value").alias("document"))
        witness.attach(docs, str(tmp_path / "checkpoint"), NOW).awaitTermination()

    feed(0, document("p", versions, times))
    assert witness.releases().count() == 10
    assert {r.disposition for r in witness.decisions().collect()} == {"ALLOW"}  # nothing to compare with yet
    feed(1, document("p", versions, times) + " ")
    warned = lambda r: {x.gate for x in r.results if x.result == "WARN"}
    changed = {r.version: r for r in witness.decisions().where("batch = 1").collect()}
    assert warned(changed["1.0.9"]) == {"dep-structure", "publisher-identity", "provenance-continuity", "scope-boundary"}
    assert all(warned(r) == {"publisher-identity"} for v, r in changed.items() if v != "1.0.9")  # prior means every other version
    feed(2, document("p", versions, times) + "  ")
    assert witness.decisions().where("batch = 2").count() == 0 and witness.releases().count() == 10
    versions["1.0.3"] = release(3, sha="sha512-other", attested=True)
    feed(3, document("p", versions, times))
    drifted = witness.decisions().where("batch = 3").collect()
    assert [(r.version, r.disposition) for r in drifted] == [("1.0.3", "BLOCK")]
    assert witness.releases().where("version = '1.0.3'").first().integrity_hash == "sha512-3"  # the baseline stays


def test_overrides_and_lookups_reach_the_stream(spark, tmp_path):
    witness = observe.WitnessStore(spark, str(tmp_path / "store"))
    versions = {f"1.0.{k}": release(k, attested=True) for k in range(10)}
    times = {v: f"2001-0{1 + k % 6}-01T00:00:00Z" for k, v in enumerate(versions)}
    docs = lambda *texts: spark.createDataFrame([(t,) for t in texts], "document string")
    witness.observe(docs(document("p", versions, times), "no json", '{"versions":{"1.0.0":5}}', None), 0, NOW)
    assert witness.releases().count() == 10
    versions["1.0.3"] = release(3, sha="sha512-other", attested=True)
    one = spark.createDataFrame([("p", "1.0.3", "known good")], "package_name string, version string, reason string")
    witness.override(one, NOW)
    witness.observe(docs(document("p", versions, times)), 1, NOW)
    assert witness.decisions().where("batch = 1 and version = '1.0.3'").count() == 0  # still allowed
    assert [(r.version, r.reason) for r in witness.overrides().collect()] == [("1.0.3", "known good")]
    witness.override(one, NOW + 1, removed=True)
    witness.observe(docs(document("p", versions, times)), 2, NOW)
    assert witness.overrides().count() == 0 and witness.decisions().where("batch = 2 and version = '1.0.3'").first().disposition == "BLOCK"
    deps = {r.dep for r in witness.wanted(NOW).collect()}
    assert deps
    answers = spark.createDataFrame([(d, 200, '{"name":"%s","time":{"created":"2001-07-03T23:00:00Z"}}' % d) for d in deps] + [("gone", 404, None), ("odd", 200, "{}")], "dep string, code int, document string")
    witness.enrich(answers, 0, NOW)
    witness.enrich(answers, 0, NOW)
    known = {r.dep: (r.status, r.attempts) for r in witness.lookups().collect()}
    assert known == {d: ("ok", 1) for d in deps} | {"gone": ("vanished", 1), "odd": ("error", 1)}
    assert witness.wanted(NOW).count() == 0


def test_import_swaps_the_store(spark, tmp_path):
    live = str(tmp_path / "live")
    rows = lambda *r: spark.createDataFrame(r, "package_id long, version string, reason string")
    upkeep.import_store(spark, {"overrides": rows((1, "1.0.0", "a"), (2, "1.0.0", "b")), "decisions": rows((1, "x", "d"))}, live)
    upkeep.import_store(spark, {"overrides": rows((2, "1.0.0", "new"), (3, "1.0.0", "new")), "decisions": rows((1, "x", "d"))}, live)
    read = lambda t: sorted(map(tuple, spark.read.parquet(f"{live}/{t}").collect()))
    assert read("overrides") == [(1, "1.0.0", "a"), (2, "1.0.0", "b"), (3, "1.0.0", "new")] and len(read("decisions")) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["live"]
    with pytest.raises(FileNotFoundError):
        upkeep.swap(spark, str(tmp_path / "none"), live)


def test_result_lines_are_the_same_bytes(spark, tmp_path):
    results = spark.range(50).select(F.col("id").alias("package_id"), F.when(F.col("id") % 2 == 0, "ALLOW").alias("disposition"))
    labels = spark.range(20).select(F.col("id").alias("label_id"), (F.col("id") % 7).alias("package_id"))
    texts = []
    for k in (1, 5):
        lines = evaluation.result_lines(results.repartition(k), labels.repartition(k))
        write_lines(lines, str(tmp_path / str(k)))
        texts.append("".join(p.read_text() for p in sorted((tmp_path / str(k)).glob("part-*"))))
    assert texts[0] == texts[1] and texts[0].splitlines()[0] == '{"label_id":0,"package_id":0}' and texts[0].splitlines()[-1] == '{"disposition":null,"package_id":49}'


def test_runner_overrides_and_foreign_gates(spark):
    prepared = spark.createDataFrame([(1, "1.0.0", 9), (1, "1.0.1", 3)], "package_id long, version string, n_prior long")
    custom = {"odd": lambda p: (F.lit("WARN"), F.lit("odd")), "broken": lambda p: (F.lit("MAYBE"), F.lit("x"))}
    overrides = spark.createDataFrame([(1, "1.0.1", None)], "package_id long, version string, reason string")
    out = {r.version: r for r in gates.run_gates(prepared, overrides, gates=custom).collect()}
    assert out["1.0.0"].disposition == "WARN" and [x.result for x in out["1.0.0"].results] == ["WARN", "SKIP"]
    assert out["1.0.1"].disposition == "ALLOW" and out["1.0.1"].results[0].detail == "override: (no reason)"
    with pytest.raises(ValueError):
        gates.register("content-hash", custom["odd"])


def test_rewriter_moves_tags(spark):
    versions = spark.createDataFrame([(1, v) for v in ("1.0.0", "1.1.0", "1.2.0-rc.1", "2.0.0")], "package_id long, version string")
    results = "array<struct<gate:string,result:string,detail:string>>"
    decided = spark.createDataFrame([(1, "2.0.0", "BLOCK", [("a", "SKIP", ""), ("b", "BLOCK", "why")])], f"package_id long, version string, disposition string, results {results}")
    kept = store.rewrite_versions(versions, decided)
    assert kept.where("not kept").first().reason == "why"
    tags = spark.createDataFrame([(1, "latest", "2.0.0"), (1, "next", "2.0.0"), (1, "old", "1.0.0")], "package_id long, tag string, target string")
    assert {r.tag: r.new_target for r in store.rewrite_tags(tags, kept).collect()} == {"latest": "1.1.0", "next": "1.2.0-rc.1", "old": "1.0.0"}


def test_sqlite_bundle_and_signature(spark, tmp_path):
    path = tmp_path / "seed.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE packages (id INTEGER PRIMARY KEY, package_name TEXT)")
        db.executemany("INSERT INTO packages VALUES (?, ?)", [(k, f"p{k}") for k in range(1, 101)])
        db.execute("CREATE TABLE blank (id INTEGER, x TEXT)")
    df = bundle.read_table(spark, str(path), "packages")
    assert df.count() == 100 and df.where("id = 7").first().package_name == "p7" and dict(df.dtypes)["id"] == "bigint"
    assert bundle.read_table(spark, str(path), "blank").count() == 0
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    pair = spark._jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    signer = spark._jvm.java.security.Signature.getInstance("Ed25519")
    signer.initSign(pair.getPrivate())
    signer.update(digest.encode())
    signature, key = base64.b64encode(bytes(signer.sign())).decode(), bytes(spark._jvm.java.security.KeyFactory.getInstance("Ed25519").getKeySpec(pair.getPublic(), spark._jvm.java.lang.Class.forName("java.security.spec.X509EncodedKeySpec")).getEncoded())
    assert bundle.verify(spark, str(path), f"{digest}  seed.db", signature, key) == "ok"
    assert bundle.verify(spark, str(path), None, signature, key) == "digest missing"
    assert bundle.verify(spark, str(path), "xyz", signature, key) == "digest malformed"
    assert bundle.verify(spark, str(path), "0" * 64, signature, key) == "digest mismatch"
    assert bundle.verify(spark, str(path), digest, None, key) == "signature missing"
    assert bundle.verify(spark, str(path), digest, "!!", key) == "signature malformed"
    assert bundle.verify(spark, str(path), digest, base64.b64encode(b"\1" * 64).decode(), key) in ("signature invalid", "signature malformed")


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_gate_facts_are_made_once(spark, sf_dir):
    """Releases, dependencies and lookups are not made a second time for the dependencies' ages (14 scans before)."""
    plan = queries.QUERIES["gate_runner"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 8


def test_youngest_new_dependency_is_not_the_package_itself(spark):
    row = "package_id bigint, package_name string, version_id bigint, version string, published_at string, publisher_email string, provenance_present boolean, integrity_hash string, content_hash string"
    one = lambda i: (1, "p", i, f"1.0.{i}", "2001-01-01T00:00:00Z", "a@b.c", True, "i", "c")
    stored, incoming = spark.createDataFrame([one(1)], row), spark.createDataFrame([one(2)], row)
    deps = spark.createDataFrame([(1, "old"), (2, "old"), (2, "p"), (2, "z"), (2, "y"), (2, "gone")], "version_id bigint, dep string")
    cache = spark.createDataFrame([("p", "ok", 0), ("z", "ok", 0), ("y", "ok", 0), ("y", "ok", 3_600_000), ("old", "ok", 0), ("gone", "vanished", None)], "dep string, status string, first_publish_ms bigint")
    scripts = spark.createDataFrame([(2, True)], "version_id bigint, has_script boolean")
    for other in (deps, deps.select("*")):  # one table for both sides, and two
        got = gates.facts(incoming, stored, deps, other, scripts, cache, 7_200_000).first()
        assert (got["n_deps"], got["new_deps"], tuple(got["fresh_dep"])) == (5, ["gone", "p", "y", "z"], ("y", 1))
