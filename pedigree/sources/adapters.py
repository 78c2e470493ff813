"""Release histories and gate inputs derived from the star-schema tables.

Each derivation is one SQL text that Spark and DuckDB read alike, up to a few functions that differ;
so queries and oracles start from the same relation, and everything behind it is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pedigree.params import MACHINE_EMAIL

_DIALECTS = {
    "spark": {"ms": "unix_millis(cast({} as timestamp))", "iso": "date_format(cast({} as timestamp), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"},
    "duckdb": {"ms": "(epoch_us({}::TIMESTAMP) // 1000)", "iso": "strftime({}::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ')"},
}

#: Instant at which the gates are evaluated: 2001-07-04T00:00:00Z.
GATE_NOW_MS = 994_204_800_000
_BASE_MS = 1_700_000_000_000


def history_sql(dialect: str, events: str = "events") -> str:
    """Releases per package, from `events`: one package a user, classes of publishers by modulus, and some broken rows."""
    d = _DIALECTS[dialect]
    ms = d["ms"].format("ts")
    return f"""
SELECT cast(user_id as bigint) AS package_id, 'pkg-' || user_id AS package_name, seq AS input_idx,
  CASE WHEN event_id % 53 = 0 THEN '0.0.' || cast(floor(seq / 20) as bigint) WHEN event_id % 61 = 0 THEN 'v' || seq WHEN event_id % 101 = 0 THEN ''
       ELSE (CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 + cast(floor(seq / 30) as bigint) END) || '.' || seq || '.' || (event_id % 10) || (CASE WHEN event_id % 11 = 0 THEN '-rc.' || (event_id % 3) ELSE '' END) END AS version,
  CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 13 = 0 THEN cast(floor(ms / 864000000) as bigint) * 864000000 ELSE ms END AS published_at_ms,
  CASE WHEN event_id % 97 = 0 THEN ' ' WHEN user_id % 7 = 3 THEN NULL ELSE ' ' || person || ' ' END AS publisher_name,
  CASE WHEN event_id % 97 = 0 THEN NULL
       WHEN user_id % 10 = 5 AND event_id % 2 = 0 THEN '{MACHINE_EMAIL}'
       WHEN c IN (1, 3) AND user_id % 4 = 1 AND seq >= n - 3 THEN person || '@late' || user_id || '.net'
       ELSE CASE k WHEN 0 THEN upper(person) || '@gmail.com' WHEN 1 THEN person || '@Proton.me' WHEN 2 THEN person || '@acme' || (user_id % 5) || '.com' WHEN 3 THEN person || '@corp.example'
                   WHEN 4 THEN NULL WHEN 5 THEN person || '@x.solo' || seq || '.io' WHEN 6 THEN person || '@tutanota.com' ELSE person || '@outlook.com' END END AS publisher_email,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'tool@' || (event_id % 4) END AS publisher_tool,
  CASE WHEN event_type = 'purchase' AND event_id % 9 = 0 THEN NULL WHEN user_id % 9 = 4 AND seq < 12 THEN false WHEN event_type = 'error' AND event_id % 3 = 0 THEN false
       WHEN seq = n - 2 AND user_id % 2 = 0 THEN false ELSE true END AS provenance_present
FROM (
  SELECT *, 'dev' || who || 'u' || user_id AS person, (user_id + 3 * who) % 8 AS k
  FROM (
    SELECT *, CASE c WHEN 0 THEN CASE WHEN seq * 100 < 85 * n THEN 0 ELSE 1 END WHEN 1 THEN cast(floor(seq / (4 + user_id % 7)) as bigint) % 3 WHEN 2 THEN cast(floor(seq / (22 + user_id % 5)) as bigint)
                     WHEN 3 THEN cast(floor(seq / 3) as bigint) % 5 WHEN 4 THEN 0 ELSE cast(floor(seq / 6) as bigint) % 2 END AS who
    FROM (
      SELECT user_id, event_id, event_type, user_id % 6 AS c, {_BASE_MS} + 6 * ({ms} - {_BASE_MS}) AS ms, count(*) OVER (PARTITION BY user_id) AS n,
        cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 as bigint) AS seq
      FROM {events} WHERE user_id IS NOT NULL) a
    WHERE user_id % 17 <> 0 OR seq < 6) b) f
"""


def labels_sql(history: str) -> str:
    """Attack labels of every thirteenth package: pinned to a version, by range, or unspecified; the pinned ones with a sibling by range."""
    return f"""
SELECT package_id * 10 + kind AS label_id, package_id, 'ADV-' || package_id AS advisory_id, CASE WHEN kind = 0 THEN pinned END AS version_id, true AS is_malicious,
  CASE kind WHEN 1 THEN '>=1.0.0 <2.0.0' WHEN 2 THEN '>1.40.0' END AS affected_range, CASE WHEN kind < 3 THEN (package_id * 7 + kind * 3) % 40 END AS detection_lag_days
FROM (SELECT package_id, max(input_idx) - 1 AS pinned FROM {history} GROUP BY package_id) p
CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k
WHERE package_id % 13 = 0 AND (kind = package_id % 4 OR (kind = 1 AND package_id % 4 = 0) OR (kind = 2 AND package_id % 4 = 3))
"""


def releases_sql(dialect: str) -> str:
    """Stored releases, one package a customer, from `orders`."""
    d = _DIALECTS[dialect]
    return f"""
SELECT cast(o_custkey as bigint) AS package_id, 'cust-' || o_custkey AS package_name, cast(o_orderkey as bigint) AS version_id,
  '1.' || rank || '.0' || (CASE WHEN o_orderkey % 23 = 0 THEN '-rc.1' ELSE '' END) AS version,
  {d["iso"].format("o_orderdate")} AS published_at,
  'user' || (CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END) || '@' || (CASE WHEN o_orderkey % 5 = 0 THEN 'proton.me' WHEN o_custkey % 2 = 0 THEN 'gmail.com' ELSE 'acme.com' END) AS publisher_email,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_custkey % 4 = 0 OR o_orderkey % 6 = 0 THEN false ELSE true END AS provenance_present,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'sha512-' || o_orderkey || '-' || o_custkey || '-stored' END AS integrity_hash, 'sha1-' || o_orderkey || '-0000000000' AS content_hash
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders) o
"""


def incoming_sql(releases: str) -> str:
    """The same releases as observed again: some hashes differ or are missing, some addresses change."""
    return f"""
SELECT package_id, package_name, version_id, version, published_at,
  CASE WHEN version_id % 31 = 0 THEN NULL WHEN version_id % 29 = 0 THEN upper(publisher_email) ELSE publisher_email END AS publisher_email, provenance_present,
  CASE WHEN version_id % 50 = 0 THEN NULL WHEN version_id % 37 = 0 THEN 'sha512-tampered-' || version_id ELSE integrity_hash END AS integrity_hash,
  CASE WHEN version_id % 100 = 0 THEN NULL WHEN version_id % 43 = 0 THEN 'sha1-again-' || version_id ELSE content_hash END AS content_hash
FROM {releases}
"""


def deps_sql() -> str:
    """(version_id, dep) of every release, from `lineitem`."""
    return "SELECT DISTINCT cast(l_orderkey as bigint) AS version_id, 'supp-' || (l_suppkey % 10) AS dep FROM lineitem"


def scripts_sql() -> str:
    """Releases with an install script, from `lineitem`."""
    return "SELECT cast(l_orderkey as bigint) AS version_id, max(CASE WHEN l_returnflag = 'R' AND l_orderkey % 2 = 0 THEN 1 ELSE 0 END) = 1 AS has_script FROM lineitem GROUP BY l_orderkey"


def dep_cache_sql(dialect: str) -> str:
    """First publication of every dependency with the state of its lookup."""
    d = _DIALECTS[dialect]
    return f"""
SELECT dep, CASE WHEN dep IN ('supp-3', 'supp-7') THEN 'vanished' WHEN dep = 'supp-5' THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN dep IN ('supp-1', 'supp-2') THEN {GATE_NOW_MS} - 6 * 3600000 ELSE first_ms END AS first_publish_ms, {GATE_NOW_MS} - (CASE WHEN dep = 'supp-5' THEN 100000 ELSE 900000 END) AS fetched_at_ms
FROM (SELECT 'supp-' || (l_suppkey % 10) AS dep, min({d["ms"].format("l_shipdate")}) AS first_ms FROM lineitem GROUP BY 1) x
"""


def observations_sql(dialect: str) -> str:
    """Repeated decisions of releases, five observations each, from `orders`."""
    return """
SELECT cast(o_custkey as bigint) AS package_id, cast(o_orderkey as bigint) AS version_id, cast(obs as bigint) AS obs,
  CASE (o_orderkey + cast(floor(obs / (1 + o_orderkey % 3)) as bigint)) % 4 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'WARN' ELSE 'ALLOW' END AS disposition
FROM orders CROSS JOIN (SELECT 0 AS obs UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) x
"""


def _view(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def release_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, history_sql("spark", "{events}"), "events")


def attack_labels(history: DataFrame) -> DataFrame:
    return history.sparkSession.sql(labels_sql("{history}"), history=history)


def stored_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, releases_sql("spark").replace("FROM orders", "FROM {orders}"), "orders")


def incoming_releases(releases: DataFrame) -> DataFrame:
    return releases.sparkSession.sql(incoming_sql("{releases}"), releases=releases)


def release_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, deps_sql().replace("FROM lineitem", "FROM {lineitem}"), "lineitem")


def release_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, scripts_sql().replace("FROM lineitem", "FROM {lineitem}"), "lineitem")


def dep_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, dep_cache_sql("spark").replace("FROM lineitem", "FROM {lineitem}"), "lineitem")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, observations_sql("spark").replace("FROM orders", "FROM {orders}"), "orders")
