"""The newest decision of every release is kept without sorting the log (F15)."""

import random

from pedigree.operators import store


def test_newest_decisions_aggregate_by_hash(spark):
    rng = random.Random(15)
    rows = [(k % 7, k % 11, obs, rng.choice(["ALLOW", "WARN", "BLOCK"])) for obs, k in enumerate(rng.randrange(200) for _ in range(900))] + [(99, 1, 5, "BLOCK"), (99, 1, 6, None)]
    out = store.latest_decisions(spark.createDataFrame(rows, "package_id long, version_id long, obs long, disposition string"))
    want = {}
    for p, v, obs, d in rows:
        want[p, v] = max(want.get((p, v), (-1, "")), (obs, d), key=lambda x: x[0])
    assert {(r.package_id, r.version_id): (r.obs, r.disposition) for r in out.collect()} == want
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
