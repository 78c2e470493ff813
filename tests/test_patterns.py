"""Hand-built histories with known outcomes."""

import pytest
from pyspark.sql import functions as F

from pedigree.functions.columns import domain, identity, major, matches_range, provider, semver_key, wilson
from pedigree.operators import disposition, provenance, publisher
from pedigree.params import Params

START, DAY = 1_700_000_000_000, 86_400_000
SCHEMA = "package_id long, package_name string, input_idx long, version string, published_at_ms long, publisher_name string, publisher_email string, publisher_tool string, provenance_present boolean"


def history(spark, *packages, step=DAY):
    """Packages of (name@domain, n) entries, releases one day apart."""
    rows = []
    for k, entries in enumerate(packages):
        i = 0
        for who, n in entries:
            for _ in range(n):
                rows.append((k, f"p{k}", i, f"1.0.{i}", START + i * step, who.split("@")[0] or None, who if "@" in who else None, None, None))
                i += 1
    return spark.createDataFrame(rows, SCHEMA)


def attested(spark, *marks, versions=None):
    rows = [(k, f"p{k}", i, versions[i] if versions else f"1.0.{i}", START + i * 1000, "dev", "dev@acme.com", None, {"A": True, "U": False, "N": None}[m]) for k, text in enumerate(marks) for i, m in enumerate(text)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, *columns, by=None):
    return [tuple(r) for r in df.select(*columns).orderBy(*(by or columns)).collect()]


def test_takeover_singletons_and_solo(spark):
    found = publisher.extract(history(spark, [("a@example.com", 27), ("b@example.com", 3)], [(f"d{k}@x.io", 1) for k in range(40)], [("solo@x.io", 100)]))
    assert rows(found["tenure"].groupBy("package_id").count(), "package_id", "count") == [(0, 2), (1, 40), (2, 1)]
    moves = rows(found["transitions"].where("package_id = 0"), "prior_tenure_versions", "cell", "prior_contribution_count", "gap_ms")
    assert moves == [(27, "cold_handoff", 0, DAY)]
    assert rows(found["shape"], "package_id", "shape") == [(0, "solo"), (1, "committee"), (2, "solo")]
    assert found["transitions"].where("package_id = 1 and cell <> 'cold_handoff'").count() == 0


@pytest.mark.parametrize("entries, overlap", [(["A", "B", "C", "D", "A"], False), (["A", "B", "C", "A"], True), (["A", "B", "A"], True)])
def test_overlap_window_boundary(spark, entries, overlap):
    found = publisher.extract(history(spark, [(f"{e}@x.io", 1) for e in entries]))
    assert rows(found["transitions"], "from_index", "is_overlap")[-1][1] is overlap


@pytest.mark.parametrize("n, known", [(10, True), (9, False)])
def test_known_contributor_boundary(spark, n, known):
    found = publisher.extract(history(spark, [("a@x.io", n), ("b@y.io", 1), ("a@x.io", 1)]))
    assert rows(found["transitions"], "from_index", "is_known")[-1][1] is known


@pytest.mark.parametrize("counts, shape", [((8, 1), "solo"), ((7, 2), "alternating"), ((8, 2), "solo"), ((5, 2, 2), "committee"), ((3, 2), "unknown")])
def test_shape(spark, counts, shape):
    found = publisher.extract(history(spark, [(f"d{k}@acme.com", n) for k, n in enumerate(counts)]))
    assert rows(found["shape"], "shape") == [(shape,)]


def test_invalid_rows_are_counted_and_packages_stay(spark):
    bad = spark.createDataFrame([(7, "p", 0, "1.0.0", None, "a", None, None, None), (7, "p", 1, "", START, "a", None, None, None), (7, "p", 2, "1.0.1", START, " ", "", None, None)], SCHEMA)
    signals = publisher.extract(bad)["signals"].first()
    assert (signals.observed_versions_count, signals.skipped_versions_count, signals.has_sufficient_history, signals.transition_count) == (0, 3, False, 0)
    assert publisher.extract(bad)["identity_profile"].first().domain_stability == "stable"


@pytest.mark.parametrize(
    "marks, regressions",
    [("AAAU" + "A" * 4, [3]), ("AAUAAAAA"[:3] + "AAA" + "AA", []), ("AU" * 7, []), ("A" * 10, []), ("AAANAAAA", []), ("AAAU" + "U" * 19, [3]), ("AAAU", []), ("AANAUAAA", [4])],
)
def test_streaks(spark, marks, regressions):
    records = provenance.extract(attested(spark, marks))["per_version"]
    assert [r.rn for r in records.where("provenance_regression").orderBy("rn").collect()] == regressions


def test_streaks_are_kept_per_major(spark):
    versions = ["1.0.0", "2.0.0", "1.0.1", "2.0.1", "1.0.2", "2.0.2", "1.0.3", "2.0.3"]
    records = provenance.extract(attested(spark, "AAAAAAUA", versions=versions))["per_version"]
    assert rows(records.where("provenance_regression"), "version", "prior_streak") == [("1.0.3", 3)]


def test_carriers_are_the_last_rows_not_the_last_attested(spark):
    df = attested(spark, "AAANUAAA").withColumn("publisher_name", F.concat(F.lit("d"), F.col("input_idx").cast("string")))
    found = provenance.extract(df)["carriers"].where("version = '1.0.4'").first()
    assert found.identities == ["d1", "d2", "d3"]


def verdict(spark, entries, step=DAY):
    found = publisher.extract(history(spark, entries, step=step))
    return disposition.dispositions(found, disposition.verdicts(found)).first()


@pytest.mark.parametrize(
    "entries, expected",
    [
        ([("dev1@acme.com", 5), ("dev2@acme.com", 4)], "WARN"),
        ([("j@gmail.com", 8), ("i@protonmail.me", 1)], "BLOCK"),
        ([("d@example.com", 27), ("r@example.com", 3)], "BLOCK"),
        ([("A@a.com", 20), ("B@b.com", 5), ("C@b.com", 5)], "WARN"),
        ([("A@a.com", 5), ("B@b.com", 5), ("C@c.com", 5)], "WARN"),
        ([("B@random.xyz", 1), ("A@a.com", 8), ("D@protonmail.me", 1), ("C@a.com", 5)], "BLOCK"),
        ([("A@a.com", 20), ("B@protonmail.me", 5), ("C@random.xyz", 5)], "WARN"),
        ([("A@a.com", 150), ("B@b.com", 20), ("C@c.com", 20)], "WARN"),
        ([("A@a.com", 50), ("B@protonmail.me", 15), ("C@c.com", 15)], "BLOCK"),
        ([(f"d{k % 3}@x.com", 1) for k in range(9)], "ALLOW"),
        ([("a@x.com", 5)], "ALLOW"),
    ],
)
def test_dispositions(spark, entries, expected):
    assert verdict(spark, entries).disposition == expected


def test_full_disposition_judges_regressions_of_known_identities(spark):
    df = history(spark, [("alice@acme.com", 10), ("bob@acme.com", 5), ("alice@acme.com", 1)]).withColumn("provenance_present", F.col("input_idx") < 15)
    found, records = publisher.extract(df), provenance.extract(df)["per_version"]
    out = disposition.dispositions(found, disposition.verdicts(found, records)).first()
    assert any("regression without escalators" in r for r in out.reasons)


def test_versions_sort_by_precedence(spark):
    chain = ["0.9.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.10", "1.2.0", "10.0.0", "100000000000000000000000.0.0", "not a version"]
    df = spark.createDataFrame([(v,) for v in reversed(chain)], "v string")
    assert [r.v for r in df.orderBy(semver_key(F.col("v"))).collect()] == chain
    assert [r[0] for r in spark.createDataFrame([("1.0.0+a",), ("1.0.0+b",)], "v string").select(semver_key(F.col("v"))).distinct().collect()] == ["a" + "00011" + "00010" * 2 + "~"]


def test_columns(spark):
    df = spark.createDataFrame([("  Ann ", "X@Y.com"), (" ", " B@c.org"), (None, None), (None, "nodomain"), (None, "a@b@C.net ")], "n string, e string")
    assert [r[0] for r in df.select(identity(F.col("n"), F.col("e"))).collect()] == ["Ann", "<b@c.org>", None, "<nodomain>", "<a@b@c.net>"]
    assert [r[0] for r in df.select(domain(F.col("e"))).collect()] == ["y.com", "c.org", None, None, "c.net"]
    kinds = spark.createDataFrame([("pm.me", 5), ("gmail.com", 1), ("acme.com", 2), ("acme.com", 1), (None, 0)], "d string, n int")
    assert [r[0] for r in kinds.select(provider(F.col("d"), F.col("n"), 2)).collect()] == ["privacy", "free-webmail", "verified-corporate", "unverified", "unknown"]
    assert [r[0] for r in spark.createDataFrame([("12.3.4",), ("7.x",), ("main",)], "v string").select(major(F.col("v")).cast("long")).collect()] == [12, 7, None]
    assert spark.range(1).select(wilson(F.lit(2), F.lit(2), -1)).first()[0] == 0.3424
    hit = spark.createDataFrame([("1.5.0", ">=1.0.0 <2.0.0"), ("2.0.0", ">=1.0.0 <2.0.0"), ("1.0.0", ""), ("1.0.0", None)], "v string, r string")
    assert [r[0] for r in hit.select(matches_range(F.col("v"), F.col("r"))).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="unparseable range comparator"):
        spark.createDataFrame([("2.0.0", ">1.0.0 || <0.5.0")], "v string, r string").select(matches_range(F.col("v"), F.col("r"))).collect()


def test_params_from_env(monkeypatch):
    monkeypatch.setenv("PEDIGREE_KNOWN_COUNT", "12")
    monkeypatch.setenv("PEDIGREE_SOLO_DOMINANCE", "0.7")
    assert Params.from_env() == Params(known_count=12, solo_dominance=0.7)
    monkeypatch.setenv("PEDIGREE_SOLO_DOMINANCE", "bad")
    with pytest.raises(ValueError, match="must be a positive number"):
        Params.from_env()


def test_permutation_changes_nothing(spark):
    df = history(spark, [("a@x.io", 4), ("b@y.io", 3), ("a@x.io", 3)])
    one, two = (rows(publisher.extract(d)["tenure"], "block_idx", "identity", "version_count", "first_version") for d in (df, df.orderBy(F.rand(3))))
    assert one == two
