"""Every query with an oracle, against DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import pytest

duckdb = pytest.importorskip("duckdb")

from pedigree.plans import queries, store_queries  # noqa: E402

QUERIES, ORACLES = queries.QUERIES | store_queries.QUERIES, queries.ORACLES | store_queries.ORACLES
HEAVY = {"sensitivity_grid", "sensitivity_deltas", "calibration_best", "lag_quartiles", "confusion_matrix"}


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return db


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - HEAVY))
def test_matches_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    r = duck.sql(ORACLES[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert found == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert found or name in ("tarball_denials", "label_targets")
