"""SQL functions, lockfiles and listings of releases: equal to the column functions, odd documents are defined."""

import json

import pytest
from pyspark.sql import functions as F

from pedigree.functions import columns, sql
from pedigree.operators import evaluation, projection
from pedigree.params import Params
from pedigree.plans import store_queries
from pedigree.sources import adapters, lockfile

VERSIONS = ["1.2.3", " 1.2.3-rc.1 ", "01.2.3", "1.2.3-alpha.10+b", "0.0.0", "v1", "7.x", "", None, "99999999999999999999.0.1", "1.2.3-A.b"]
PEOPLE = [(" A ", "x@Y.z"), ("", "X@y "), (" ", None), (None, "a@b@ProtonMail.com"), (None, " "), ("b", "no-at"), (None, "@"), ("c", "q@gmail.com")]


def test_sql_functions_equal_columns(spark):
    sql.register(sql.register(spark))
    v = spark.createDataFrame([(x,) for x in VERSIONS], "version string")
    got = spark.sql("SELECT version, version_key(version) AS k, version_major(version) AS m FROM {v}", v=v).collect()
    assert sorted(got, key=repr) == sorted(v.select("version", columns.semver_key(F.col("version")).alias("k"), columns.major(F.col("version")).alias("m")).collect(), key=repr)
    p = spark.createDataFrame([(*x, n) for x in PEOPLE for n in (None, 1, 2)], "name string, email string, n bigint")
    got = spark.sql("SELECT name, email, n, release_identity(name, email) AS i, mail_domain(email) AS d, mail_provider(mail_domain(email), n, 2) AS p FROM {p}", p=p).collect()
    d = columns.domain(F.col("email"))
    assert sorted(got, key=repr) == sorted(p.select("name", "email", "n", columns.identity(F.col("name"), F.col("email")).alias("i"), d.alias("d"), columns.provider(d, F.col("n"), 2).alias("p")).collect(), key=repr)


def test_sql_functions_equal_columns_on_a_history(spark, sf_dir):
    h = adapters.release_history(spark, sf_dir)
    a = sql.register(spark).sql("SELECT version_key(version) AS k, release_identity(publisher_name, publisher_email) AS i FROM {h}", h=h)
    b = h.select(columns.semver_key(F.col("version")).alias("k"), columns.identity(F.col("publisher_name"), F.col("publisher_email")).alias("i"))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < a.count()
    assert "Python" not in a._jdf.queryExecution().executedPlan().toString()


LOCK = {
    "packages": {
        "": {"name": "root", "integrity": "r"},
        "node_modules/a": {"version": "1", "integrity": "s", "extra": [1]},
        "node_modules/a/node_modules/@s/b": {"version": "2", "link": True, "integrity": ""},
        "node_modules/alias": {"name": "real", "version": 3, "integrity": 7},
        "node_modules/z": 3,
        "lib/q": {},
    }
}
INSTALLED = [("lib/q", "lib/q", None, None, False), ("node_modules/a", "a", "1", "s", False), ("node_modules/a/node_modules/@s/b", "@s/b", "2", None, True), ("node_modules/alias", "real", None, None, False)]


@pytest.mark.parametrize("bad", [None, "", "no json", "[1]", '{"packages":[1]}', '{"packages":null}', "{}"])
def test_lockfiles(spark, bad):
    docs = spark.createDataFrame([(1, "p", json.dumps(LOCK)), (2, "p", bad), (1, "p", json.dumps(LOCK))], "id int, path string, document string")
    rows = lockfile.installed(docs)
    assert rows.columns == ["id", "path", "package_name", "version", "integrity", "link"]
    assert sorted(map(tuple, rows.drop("id").collect()), key=repr) == sorted(INSTALLED * 2, key=repr)
    by_sql = sql.register(spark).sql("SELECT d.id, r.* FROM {d} d, LATERAL lockfile_packages(d.document) r", d=docs.drop("path"))
    assert sorted(map(tuple, by_sql.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert [r["integrity"] for r in lockfile.of_package(rows.where("id = 1"), "a").collect()] == ["s", "s"]
    assert lockfile.installed(docs.limit(0)).count() == 0


def test_listings(spark):
    listing = [{"tag_name": "v1", "published_at": "t", "assets": [{"name": "a", "browser_download_url": "1"}, {"name": "a", "browser_download_url": "2"}, {"name": "b"}, 5]}, {"tag_name": "v2", "assets": {}}, 7, {}]
    docs = spark.createDataFrame([(json.dumps(listing),), ("{}",), (None,), ("x",)], "document string")
    rows = lockfile.listed_releases(docs)
    assert sorted(map(tuple, rows.collect()), key=repr) == [("v1", "t", {"a": "2"}), ("v2", None, {}), (None, None, {})]
    told = {r["tag"]: (r["urls"], r["missing"], r["available"]) for r in lockfile.assets_of(rows, ["a"]).collect()}
    assert told == {"v1": ({"a": "2"}, [], ["a"]), "v2": (None, ["a"], []), None: (None, ["a"], [])}


@pytest.mark.parametrize("text", ["0", "-1", "many", "1.5", "inf", "nan"])
def test_settings_are_positive(monkeypatch, text):
    monkeypatch.setenv("PEDIGREE_KNOWN_COUNT", text)
    with pytest.raises(ValueError, match="PEDIGREE_KNOWN_COUNT must be a positive integer"):
        Params.from_env()


def test_repeated_decisions_of_a_release(spark):
    doc = json.dumps({"name": "p", "versions": {"1.0.0": {}, "1.0.1": {}, "2.0.0": {}}, "dist-tags": {"latest": "2.0.0"}})
    one = lambda v, d, *details: ("p", v, d, [(x,) for x in details])
    told = [one("2.0.0", "WARN", "w"), one("2.0.0", "BLOCK", None, "b"), one("2.0.0", "BLOCK", "c"), one("1.0.1", "WARN", "y"), one("1.0.1", "WARN", "x"), one("1.0.1", "ALLOW", "a"), one(None, "BLOCK", "n")]
    decisions = spark.createDataFrame(told, "package_name string, version string, disposition string, results array<struct<detail:string>>")
    r = projection.rewrite_documents(spark.createDataFrame([("p", doc)], "package_name string, document string"), decisions).first()
    assert ([tuple(x) for x in r["blocked"]], [tuple(x) for x in r["warned"]], r["kept"]) == ([("2.0.0", "b")], [("1.0.1", "x")], 2)
    assert json.loads(r["document"])["dist-tags"] == {"latest": "1.0.1"}


def test_head_of_nothing(spark, sf_dir):
    history = adapters.release_history(spark, sf_dir).limit(0)
    labels = adapters.attack_labels(history)
    results, parts = evaluation.package_results(history, labels.select("package_id").distinct())
    attributed = evaluation.attribute(labels, evaluation.label_targets(labels, history), parts["last"], spark.createDataFrame([], "package_id bigint, version string, block_idx bigint, input_idx bigint"))
    head = json.loads(evaluation.result_head(results, attributed).first()["line"])
    assert head["corpus"] == {"packages": 0, "attacked": 0, "clean": 0} and head["parameters"]["min_history"] == 8
    assert head["aggregates"]["labels"] == {"total": 0, "detected": 0, "attributable": 0, "recall": None, "recall_attributable": None}


@pytest.mark.parametrize("name", ["lockfile_packages", "sql_document_releases"])
def test_tables_of_documents_need_no_join_by_their_text(spark, sf_dir, name):
    found = store_queries.QUERIES[name](spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and plan.count("Relation [") == (1 if name == "lockfile_packages" else 2)  # no second making of the documents
    assert found.count() == adapters.stored_releases(spark, sf_dir).count()


ODD = ['{"name":7,"time":7,"versions":{"1.0.0":{"dist":7,"_npmUser":[1]},"x":3}}', '{"time":{"1.0.0":4,"9":"t"},"versions":{"1.0.0":{"dist":{"shasum":1,"attestations":[]},"scripts":"s"}}}', '{"versions":[1]}', "[1]", "no json", None]


def test_releases_of_odd_documents(spark):
    docs = spark.createDataFrame([(x,) for x in ODD], "document string")
    by_sql = sql.register(spark).sql("SELECT r.* FROM {d} d, LATERAL document_releases(d.document) r", d=docs).collect()
    assert [tuple(r) for r in by_sql] == [(None, "1.0.0", None, None, None, None, None, False)] * 2
    rows = projection.project(docs).select("package_name", "version", "published_at", "content_hash", "publisher_name", "has_install_scripts", F.size("files")).collect()
    assert [tuple(r) for r in rows] == [(None, "1.0.0", None, None, None, False, 0)] * 2


def test_large_documents_in_rows_of_their_own_size(spark):
    """Thousands of entries: a row that held its document's names would be a hundred kilobytes."""
    packages = {f"node_modules/package-number-{i}": {"version": f"1.0.{i}", "integrity": str(i)} for i in range(4000)}
    rows = lockfile.installed(spark.createDataFrame([(json.dumps({"packages": packages}),)], "document string"))
    assert "variant" not in str(rows.schema) and rows.count() == 4000
    releases = projection.project(spark.createDataFrame([(json.dumps({"name": "p", "versions": {f"1.0.{i}": {} for i in range(4000)}, "time": {f"1.0.{i}": "t" for i in range(4000)}}),)], "document string"))
    assert releases.where("published_at = 't' and package_name = 'p'").count() == 4000


def test_rewriting_makes_gates_once(spark, sf_dir):
    """A filter on the verdict was pushed below the gates, which made all of them once more for it."""
    plan = store_queries.QUERIES["rewritten_documents"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "integrity hash differs from baseline" in plan
    assert not [line for line in plan.splitlines() if "Filter CASE WHEN" in line and "has_baseline" in line]


def test_only_changed_documents_move_tags(spark):
    """Documents that are odd, whole, or lose a release, a prerelease, everything; a decision without a version counts for nothing."""
    text = '{"name":"n","k":[1],"versions":{"1.0.0":{},"2.0.0":{"x":1},"3.0.0-rc.1":{},"x":{}},"time":{"1.0.0":"a","2.0.0":"b","m":"c"},"dist-tags":{"latest":"2.0.0","beta":"2.0.0","odd":7}}'
    documents = spark.createDataFrame([(1, text), (2, text), (3, "[]"), (4, None), (5, '{"versions":7,"dist-tags":{"a":"1.0.0"}}'), (6, text)], "package_id bigint, document string")
    said = [(1, "2.0.0", "BLOCK", "late"), (1, "2.0.0", "WARN", "w"), (1, "x", "WARN", "odd"), (1, "1.0.0", "ALLOW", "a"), (2, "1.0.0", "ALLOW", "a"), (5, "1.0.0", "BLOCK", "b"), (6, "1.0.0", "BLOCK", ""), (6, "2.0.0", "BLOCK", ""), (6, None, "BLOCK", "n")]
    decisions = spark.createDataFrame([(p, v, d, [{"detail": ""}, {"detail": r}]) for p, v, d, r in said], "package_id bigint, version string, disposition string, results array<struct<detail:string>>")
    got = {r["package_id"]: r for r in projection.rewrite_documents(documents, decisions, "package_id").collect()}
    assert [got[k]["changed"] for k in range(1, 7)] == [True, False, False, False, False, True]
    assert [got[k]["document"] for k in (2, 3, 4, 5)] == [text, "[]", None, '{"versions":7,"dist-tags":{"a":"1.0.0"}}']
    assert json.loads(got[1]["document"]) == {"name": "n", "k": [1], "versions": {"1.0.0": {}, "3.0.0-rc.1": {}, "x": {}}, "time": {"1.0.0": "a", "m": "c"}, "dist-tags": {"latest": "1.0.0", "beta": "3.0.0-rc.1", "odd": 7}}
    assert json.loads(got[6]["document"])["dist-tags"] == {"beta": "3.0.0-rc.1", "odd": 7} and got[6]["kept"] == 2
    assert [tuple(x) for x in got[1]["blocked"]] == [("2.0.0", "late")] and [tuple(x) for x in got[1]["warned"]] == [("x", "odd")]
    assert sorted(tuple(x) for x in got[6]["downgrades"]) == [("beta", "2.0.0", "3.0.0-rc.1"), ("latest", "2.0.0", None)]
    assert [got[k]["downgrades"] for k in (2, 3, 4, 5)] == [[]] * 4


def test_files_of_releases_are_read_in_their_documents(spark, sf_dir):
    """A join of releases and files made the documents twice, and sent a file a release through the driver."""
    found = store_queries.QUERIES["files_of_releases"](spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and plan.count("Relation [") == 2 and "LeftOuter" not in plan
    assert found.count() == adapters.stored_releases(spark, sf_dir).count()


def test_files_of_a_table_of_files(spark):
    """A file of no release, a release of no files, two files, a name that is null; small as they look, files are not broadcast."""
    releases = spark.createDataFrame([("p", "1", 7), ("p", "2", 8), ("q", "1", 9), ("q", "2", 9)], "package_name string, version string, n int")
    files = spark.createDataFrame([("p", "1", "b"), ("p", "1", "a"), ("q", "1", None), ("z", "1", "c")], "package_name string, version string, filename string")
    found = projection.files_of(releases, files, ["package_name", "version"])
    assert sorted(map(tuple, found.collect())) == [("p", "1", 7, ["a", "b"]), ("p", "2", 8, None), ("q", "1", 9, []), ("q", "2", 9, None)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_own_files(spark):
    dist = '{"versions":{"1.0.0":{"dist":{"tarball":"https://r/-/a.tgz"}},"2.0.0":{"dist":{"tarball":7}},"3.0.0":{}}}'
    rows = projection.own_files(projection.project(spark.createDataFrame([(dist,)], "document string")))
    two = rows.limit(1).selectExpr("array(named_struct('filename', 'b'), named_struct('filename', 'a')) AS files")
    assert sorted(map(tuple, rows.select("version", "filenames").collect())) == [("1.0.0", ["a.tgz"]), ("2.0.0", None), ("3.0.0", None)]
    assert projection.own_files(two).first()["filenames"] == ["a", "b"]
