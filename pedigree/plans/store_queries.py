"""Queries of the store's upkeep and of whole documents: full projection, rewriting, overrides, settings, checks; with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedigree.functions import sql
from pedigree.operators import evaluation, gates, projection, upkeep
from pedigree.params import Params
from pedigree.plans import oracles, queries
from pedigree.session import cut
from pedigree.sources import adapters, lockfile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


#: JSON texts of odd and plain fields of a release, by its number.
_FIELDS = {
    "gitHead": "element_at(array('\"  abc' || version_id || ' \"', '7', '\"   \"', 'null'), cast(version_id % 4 as int) + 1)",
    "_npmVersion": "element_at(array('\" 9.' || version_id || '\"', '5', 'null'), cast(version_id % 3 as int) + 1)",
    "maintainers": "element_at(array('[{\"name\":\"a' || version_id || '\",\"email\":\"\"},{\"name\":7},\"x\",{\"email\":\"e@x\"}]', '[]', '{}'), cast(version_id % 3 as int) + 1)",
    "devDependencies": "element_at(array('{\"d1\":\"^1\",\"d2\":2}', '{}', '[1]'), cast(version_id % 3 as int) + 1)",
    "bundledDependencies": "element_at(array('[\"x\",\"y\"]', '{\"k\":true}', '[]', 'null'), cast(version_id % 4 as int) + 1)",
    "bundleDependencies": "'[\"z\"]'",
    "repository": "element_at(array('\"git://r/' || version_id || '\"', '{\"url\":\"https://r/' || version_id || '\"}', '{\"type\":\"git\"}', '3'), cast(version_id % 4 as int) + 1)",
    "dependencies": "'{\"a\":\"1\",\"b\":\"2\"}'",
    "scripts": "element_at(array('{\"install\":\"\"}', '{\"postinstall\":\"x\"}', '7'), cast(version_id % 3 as int) + 1)",
    "_npmUser": "'{\"name\":\" dev \",\"email\":\"' || publisher_email || '\"}'",
    "dist": "'{\"shasum\":' || element_at(array('\"' || content_hash || '\"', '1'), cast(version_id % 2 as int) + 1) || ',\"integrity\":\"i' || version_id || '\",\"unpackedSize\":' || element_at(array(cast(version_id as string), '\"12\"'), cast(version_id % 2 as int) + 1)"
    " || element_at(array(',\"tarball\":\"https://r/p/-/f' || version_id || '.tgz\"', ',\"attestations\":{\"url\":\"u\"},\"tarball\":\"plain' || version_id || '.tgz\"', ''), cast(version_id % 3 as int) + 1) || '}'",
}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry documents with tags, times and odd fields, one a package; `bad` is no release."""
    releases = adapters.stored_releases(spark, sf_dir)
    entry = "'{' || " + " || ',' || ".join(f"'\"{name}\":' || {text}" for name, text in _FIELDS.items()) + " || '}'"
    rows = releases.selectExpr("package_id", "package_name", "version", "published_at", f"{entry} as entry")
    pair = lambda text: F.concat(F.lit('"'), F.col("version"), F.lit('":'), text)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    of = rows.groupBy("package_id", "package_name").agg(F.array_join(F.collect_list(pair(F.col("entry"))), ",").alias("v"), F.array_join(F.collect_list(pair(quoted(F.col("published_at")))), ",").alias("t"))
    key = queries.semver_key(F.col("version"))
    best = rows.groupBy("package_id").agg(F.max_by("version", key).alias("latest"), F.min_by("version", key).alias("old"))
    text = F.concat(
        F.lit('{"name":"'), F.col("package_name"), F.lit('","extra":[1,{"k":null}],"versions":{'), F.col("v"), F.lit(',"bad":7},"time":{"created":"c","modified":"m",'), F.col("t"),
        F.lit('},"dist-tags":{"latest":"'), F.col("latest"), F.lit('","beta":"'), F.col("latest"), F.lit('","old":"'), F.col("old"), F.lit('","odd":7}}'),
    )
    return of.join(best, "package_id").select("package_id", "package_name", text.alias("document"))


_NAMED = "package_name, version, published_at"


@query(
    oracles._gates(f"""SELECT {_NAMED}, CASE WHEN version_id % 2 = 0 THEN content_hash END AS content_hash, CASE WHEN version_id % 2 = 0 THEN 'sha1' END AS content_hash_algo, 'i' || version_id AS integrity_hash, CASE WHEN version_id % 4 = 0 THEN 'abc' || version_id END AS git_head,
  CASE WHEN version_id % 2 = 0 THEN version_id::DOUBLE END AS package_size_bytes, 2::BIGINT AS dependency_count, CASE WHEN version_id % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS dev_dependency_count, 0::BIGINT AS peer_dependency_count, 0::BIGINT AS optional_dependency_count,
  CASE version_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 1 END::BIGINT AS bundled_dependency_count, '{{"a":"1","b":"2"}}' AS dependencies, CASE WHEN version_id % 3 = 0 THEN '{{"d1":"^1","d2":2}}' END AS dev_dependencies, NULL::VARCHAR AS peer_dependencies, NULL::VARCHAR AS optional_dependencies,
  CASE version_id % 4 WHEN 0 THEN '["x","y"]' WHEN 1 THEN '{{"k":true}}' WHEN 3 THEN '["z"]' END AS bundled_dependencies, ' dev ' AS publisher_name, publisher_email, CASE WHEN version_id % 3 = 0 THEN 'npm@9.' || version_id END AS publisher_tool,
  CASE WHEN version_id % 3 = 0 THEN 'a' || version_id || '/,/e@x' END AS maintainers, CASE WHEN version_id % 3 = 1 THEN 'oidc' ELSE 'unknown' END AS publish_method, version_id % 3 = 1 AS provenance_present, CASE WHEN version_id % 3 = 1 THEN '{{"url":"u"}}' END AS provenance_details,
  version_id % 3 = 1 AS has_install_scripts, CASE version_id % 4 WHEN 0 THEN 'git://r/' || version_id WHEN 1 THEN 'https://r/' || version_id END AS source_repo_url, NULL::VARCHAR AS license, CASE WHEN version_id % 3 = 2 THEN 0 ELSE 1 END::BIGINT AS files FROM rel""")
)
def release_projection(spark, sf_dir):
    """All fields of a release, as scalars."""
    people = F.array_join(F.transform("maintainers", lambda m: F.concat(F.coalesce(m["name"], F.lit("")), F.lit("/"), F.coalesce(m["email"], F.lit("")))), ",")
    return projection.project(_documents(spark, sf_dir)).withColumns({"maintainers": people, "files": F.size("files").cast("long")})


@query(oracles._gates("""SELECT package_name, version, CASE version_id % 3 WHEN 0 THEN 'f' ELSE 'plain' END || version_id || '.tgz' AS filename, 'tarball' AS packagetype, CASE WHEN version_id % 2 = 0 THEN content_hash END AS content_hash, CASE WHEN version_id % 2 = 0 THEN 'sha1' END AS content_hash_algo,
  CASE WHEN version_id % 2 = 0 THEN version_id::DOUBLE END AS size_bytes, published_at AS uploaded_at, CASE version_id % 3 WHEN 0 THEN 'https://r/p/-/f' ELSE 'plain' END || version_id || '.tgz' AS url FROM rel WHERE version_id % 3 <> 2"""))
def version_files(spark, sf_dir):
    return projection.version_files(projection.project(_documents(spark, sf_dir)))


@query(oracles._gates("SELECT package_name, version, CASE version_id % 3 WHEN 0 THEN 'f' || version_id || '.tgz' WHEN 1 THEN 'plain' || version_id || '.tgz' END AS filenames FROM rel"))
def files_of_releases(spark, sf_dir):
    return projection.own_files(projection.project(_documents(spark, sf_dir))).select("package_name", "version", F.array_join("filenames", ",").alias("filenames"))


_REASONS = "coalesce(string_agg(version || '=' || reason, '; ' ORDER BY version) FILTER (disposition = '{}'), '')"


@query(
    oracles._gates(
        f"""SELECT s.package_id, s.changed, s.kept, s.blocked, s.warned, CASE WHEN s.changed THEN coalesce(d.downgrades, '') ELSE '' END AS downgrades, s.versions, s.times, s.extra, t.tags
FROM (SELECT package_id, bool_or(NOT kept) AS changed, count(*) FILTER (kept) + 1 AS kept, {_REASONS.format("BLOCK")} AS blocked, {_REASONS.format("WARN")} AS warned, string_agg(version, ',' ORDER BY version) FILTER (kept) AS vs,
  array_to_string(list_sort(list_append(coalesce(list(version) FILTER (kept), []), 'bad')), ',') AS versions, array_to_string(list_sort(list_concat(coalesce(list(version) FILTER (kept), []), ['created', 'modified'])), ',') AS times, '[1,{{"k":null}}]' AS extra FROM rw GROUP BY package_id) s
LEFT JOIN (SELECT package_id, string_agg(tag || ':' || target || '>' || coalesce(goal, ''), '; ' ORDER BY tag) AS downgrades FROM moved WHERE gone GROUP BY package_id) d ON s.package_id = d.package_id
LEFT JOIN (SELECT package_id, array_to_string(list_sort(list_append(coalesce(list(tag || ':' || goal) FILTER (goal IS NOT NULL), []), 'odd:7')), '; ') AS tags FROM moved GROUP BY package_id) t ON s.package_id = t.package_id""",
        oracles._runner()
        | oracles._TAGS
        | {"moved": "SELECT t.package_id, t.tag, t.target, NOT rw.kept AS gone, CASE WHEN rw.kept THEN t.target WHEN t.tag = 'latest' THEN best.r ELSE best.a END AS goal FROM tags t JOIN rw ON t.package_id = rw.package_id AND t.target = rw.version LEFT JOIN best ON t.package_id = best.package_id"},
    )
)
def rewritten_documents(spark, sf_dir):
    """What a rewritten document holds, read back from its text, and what was done to it."""
    decisions = gates.run_gates(queries._facts(spark, sf_dir))
    out = projection.rewrite_documents(_documents(spark, sf_dir).select("package_id", "document"), decisions, "package_id")
    top = out.withColumn("_read", F.from_json("document", "struct<versions:map<string,string>,time:map<string,string>,extra:string,`dist-tags`:map<string,string>>"))
    sorted_ = lambda a, sep: F.array_join(F.array_sort(a), sep)
    reasons = lambda c: sorted_(F.transform(c, lambda x: F.concat(x["version"], F.lit("="), x["reason"])), "; ").alias(c)
    names = lambda m: F.map_keys(f"_read.{m}")
    tags = F.transform(F.map_entries("_read.dist-tags"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return top.select(
        "package_id", "changed", "kept", reasons("blocked"), reasons("warned"), sorted_(F.transform("downgrades", lambda d: F.concat(d["tag"], F.lit(":"), d["from"], F.lit(">"), F.coalesce(d["to"], F.lit("")))), "; ").alias("downgrades"),
        sorted_(names("versions"), ",").alias("versions"), sorted_(names("time"), ",").alias("times"), F.col("_read.extra").alias("extra"), sorted_(tags, "; ").alias("tags"),
    )


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.stored_releases(spark, sf_dir).where("version_id % 19 = 0").select("package_id", "package_name", "version_id", "version", F.col("published_at").alias("created_at"))


@query(oracles._store("SELECT package_id, package_name, version_id, version, published_at AS created_at FROM rel WHERE version_id % 19 = 0 AND version_id % 2 = 1 ORDER BY created_at DESC"))
def override_list_after_removal(spark, sf_dir):
    overrides = _overrides(spark, sf_dir)
    return upkeep.list_overrides(upkeep.remove_overrides(overrides, overrides.where("version_id % 2 = 0"), ["package_id", "version"]))


@query(oracles._store("SELECT package_id, version_id, version, CASE WHEN version_id % 19 = 0 THEN 'old' ELSE 'new' END AS reason FROM rel WHERE version_id % 19 = 0 OR version_id % 23 = 0"))
def overrides_carried_over(spark, sf_dir):
    rows = adapters.stored_releases(spark, sf_dir).select("package_id", "version_id", "version")
    new, old = (rows.where(f"version_id % {m} = 0").withColumn("reason", F.lit(r)) for m, r in ((23, "new"), (19, "old")))
    return upkeep.carry_overrides(new, old, ["package_id", "version"])


@query(oracles._store("SELECT disposition, count(*) * 2 AS n FROM log GROUP BY disposition"))
def decisions_carried_over(spark, sf_dir):
    log = queries.store.changed_decisions(adapters.observations(spark, sf_dir))
    return upkeep.carry_decisions(log, log).groupBy("disposition").agg(F.count("*").alias("n"))


@query(oracles._store("SELECT package_name AS key, CASE WHEN package_id % 3 = 0 THEN 'second' WHEN package_id % 2 = 0 THEN 'first' ELSE 'start' END AS value FROM (SELECT DISTINCT package_id, package_name FROM rel)"))
def settings_set(spark, sf_dir):
    start = adapters.stored_releases(spark, sf_dir).select("package_id", F.col("package_name").alias("key")).distinct().select("key", "package_id", F.lit("start").alias("value"), F.lit(0).alias("seq"))
    changes = start.where("package_id % 2 = 0").withColumns({"value": F.lit("first"), "seq": F.lit(1)}).unionByName(start.where("package_id % 3 = 0").withColumns({"value": F.lit("second"), "seq": F.lit(2)}))
    return upkeep.set_values(start, changes).select("key", "value")


@query(oracles._store("SELECT package_name, CASE WHEN package_id % 3 = 0 THEN 'new' ELSE 'old' END AS first_seen_at, CASE WHEN package_id % 2 = 0 THEN 'new' WHEN package_id % 3 = 0 THEN 'new' ELSE 'old' END AS last_seen_at FROM (SELECT DISTINCT package_id, package_name FROM rel)"))
def packages_seen(spark, sf_dir):
    names = adapters.stored_releases(spark, sf_dir).select("package_id", "package_name").distinct()
    known = names.where("package_id % 3 <> 0").select("package_id", "package_name", F.lit("old").alias("first_seen_at"), F.lit("old").alias("last_seen_at"))
    return upkeep.seen_packages(known, names.where("package_id % 3 = 0 or package_id % 2 = 0"), F.lit("new")).drop("package_id")


@query(oracles._store("SELECT 'seed-v' || version_id AS tag, published_at FROM rel WHERE version_id % 5 = 0 ORDER BY published_at DESC, tag LIMIT 1"))
def newest_tagged_release(spark, sf_dir):
    tag = F.concat(F.when(F.col("version_id") % 5 == 0, "seed-v").otherwise("v"), F.col("version_id").cast("string"))
    return upkeep.newest_release(adapters.stored_releases(spark, sf_dir).select(tag.alias("tag"), "published_at"), r"^seed-v\d+$")


_CHECKED = """SELECT package_name, version, CASE WHEN version_id % 7 = 0 OR NOT known OR integrity_hash IS NULL THEN 'unverifiable' WHEN version_id % 11 = 0 THEN 'tamper' ELSE 'verified' END AS status,
  CASE WHEN version_id % 7 = 0 THEN 'lockfile_missing' WHEN NOT known OR integrity_hash IS NULL THEN 'not_in_witness' WHEN version_id % 11 = 0 THEN 'integrity_mismatch' ELSE 'integrity_match' END AS reason,
  CASE WHEN version_id % 7 = 0 OR package_id % 6 = 0 THEN 'skipped' WHEN NOT known OR integrity_hash IS NULL THEN 'unverifiable' WHEN version_id % 11 = 0 THEN 'tamper' END AS severity FROM (SELECT *, version_id % 5 <> 0 AND package_id % 6 <> 0 AS known FROM rel)"""


@query(oracles._store(_CHECKED))
def installed_checks(spark, sf_dir):
    """Installed releases against the store: some are not stored, some differ, some have no lockfile."""
    rows = adapters.stored_releases(spark, sf_dir)
    integrity = F.when(F.col("version_id") % 7 == 0, None).when(F.col("version_id") % 11 == 0, "other").otherwise(F.coalesce("integrity_hash", F.lit("?")))
    stored = rows.where("version_id % 5 <> 0 and package_id % 6 <> 0")
    return upkeep.self_check(rows.select("package_name", "version", integrity.alias("integrity")), stored, rows.where("package_id % 6 <> 0"))


@query(oracles._store(f"SELECT count(*) AS checks, CASE WHEN bool_or(severity = 'tamper') THEN 'tamper' WHEN bool_or(severity = 'unverifiable') THEN 'unverifiable' ELSE 'ok' END AS exit, CASE WHEN bool_or(severity = 'tamper') THEN 5 WHEN bool_or(severity = 'unverifiable') THEN 6 ELSE 0 END AS exit_code FROM ({_CHECKED}) x"))
def installed_exit(spark, sf_dir):
    return upkeep.exit_class(installed_checks(spark, sf_dir).withColumn("passed", F.col("status") == "verified"))


@query(oracles._store("SELECT version_id, strftime(published_at::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS at, epoch_ms(published_at::TIMESTAMP) AS millis FROM rel"))
def store_times(spark, sf_dir):
    at = upkeep.sql_time(F.unix_millis(F.col("published_at").cast("timestamp")))
    return adapters.stored_releases(spark, sf_dir).select("version_id", at.alias("at"), upkeep.parse_sql_time(at).alias("millis"))


@query(oracles._versions("SELECT package_id, count(*) AS n_labels, count(*) FILTER (is_malicious) AS n_malicious FROM (" + adapters.labels_sql("h0") + ") l GROUP BY package_id"))
def labels_per_package(spark, sf_dir):
    return evaluation.labels_per_package(adapters.attack_labels(adapters.release_history(spark, sf_dir)))


def _deltas() -> str:
    names = ", ".join(f"'{c}'" for c in evaluation.SWEPT)
    return f"""SELECT constant, delta_fp, delta_recall, delta_recall >= 0.02 OR delta_fp >= 0.005 AS retained, CASE WHEN NOT (delta_recall >= 0.02 OR delta_fp >= 0.005) THEN printf('below thresholds: |Δrecall|=%.4f < 0.02 AND |ΔFP|=%.4f < 0.005', delta_recall, delta_fp) END AS drop_reason FROM (
  SELECT [{names}][((m.grid_id - 1) // 2 + 1)::INT] AS constant, round(max(abs(m.false_positive_rate - b.false_positive_rate)), 4) AS delta_fp, coalesce(round(max(abs(m.recall - b.recall)), 4), 0) AS delta_recall FROM ({oracles.ORACLES["sensitivity_grid"]}) m, ({oracles.ORACLES["sensitivity_grid"]}) b WHERE m.grid_id > 0 AND b.grid_id = 0 GROUP BY 1)"""


@query(_deltas())
def sensitivity_deltas(spark, sf_dir):
    return evaluation.drop_rule(queries.sensitivity_grid(spark, sf_dir))


_PACKAGE = sorted("package_id attack disposition shape observed_versions_count has_sufficient_history transition_count block_transitions warn_transitions provenance_regression_count provenance_escalator_fires fires_new_domain fires_privacy fires_unverified fires_machine_to_human publisher_block".split())
_LABEL = sorted("label_id package_id advisory_id n_candidates detected detected_version detected_disposition detection_lag_days".split())


def _json(source: str, names: list[str]) -> str:
    return f"to_json({{{', '.join(f'{n}: {source}.{n}' for n in names)}}})"


def _head() -> str:
    counts = oracles._confusion("(SELECT *, 0 AS one FROM res)", "one")
    lags = "SELECT count(*) AS n, min(detection_lag_days)::BIGINT AS lowest, quantile_disc(detection_lag_days, 0.25)::BIGINT AS q1, quantile_disc(detection_lag_days, 0.5)::BIGINT AS median, quantile_disc(detection_lag_days, 0.75)::BIGINT AS q3, max(detection_lag_days)::BIGINT AS highest FROM att WHERE detected AND detection_lag_days IS NOT NULL"
    labels = f"SELECT *, {oracles._rate('detected', 'total')} AS recall, {oracles._rate('detected', 'attributable')} AS recall_attributable FROM (SELECT count(*) AS total, count(*) FILTER (detected) AS detected, count(*) FILTER (n_candidates > 0) AS attributable FROM att)"
    fixed = "{" + ", ".join(f"{k}: {v!r}" + ("::DOUBLE" if isinstance(v, float) else "") for k, v in vars(Params()).items()) + "}"
    same = lambda source, names: "{" + ", ".join(f"{n}: {source}.{n}" for n in names.split()) + "}"
    attested = f"{{provenance_attack_detected: c.provenance_attack_detected, provenance_clean_blocked: c.provenance_clean_blocked, recall: {oracles._rate('c.provenance_attack_detected', 'c.tp + c.fn')}, false_positive_rate: {oracles._rate('c.provenance_clean_blocked', 'c.fp + c.tn')}}}"
    aggregates = f"""{{packages: {same("c", "tp fn fp tn warn_clean recall recall_low recall_high false_positive_rate fpr_low fpr_high precision")}, layers: {same("c", "publisher_only provenance_only both_layers")}, provenance: {attested},
  labels: {same("l", "total detected attributable recall recall_attributable")}, escalators: {same("c", "fires_new_domain fires_privacy fires_unverified fires_machine_to_human")}, detection_lag_days: {same("q", "n lowest q1 median q3 highest")}}}"""
    return f"SELECT 'head' AS section, -1::BIGINT AS package_id, -1::BIGINT AS label_id, to_json({{corpus: {{packages: tp + fn + fp + tn, attacked: tp + fn, clean: fp + tn}}, parameters: {fixed}, aggregates: {aggregates}}})::VARCHAR AS line FROM ({counts}) c, ({labels}) l, ({lags}) q"


@query(
    oracles._C.sql(
        f"{_head()} UNION ALL SELECT 'package', package_id, -1::BIGINT, {_json('res', _PACKAGE)}::VARCHAR FROM res UNION ALL SELECT 'label', package_id, label_id::BIGINT, {_json('att', _LABEL)}::VARCHAR FROM att",
        full=True,
        results=True,
        more=oracles._ATTRIBUTION,
    )
)
def result_document(spark, sf_dir):
    """The whole result document, line by line: its head with corpus, parameters and aggregates, its labels, its packages."""
    results, parts, labels, history = queries._results(spark, sf_dir)
    results = cut(results)
    # All labels; they ask for no row of a package that has none, as patterns never look beyond a package.
    theirs = history.join(labels.select("package_id").distinct(), "package_id", "left_semi")
    attributed = cut(evaluation.attribute(labels, evaluation.label_targets(labels, theirs), parts["last"], queries.publisher.blocks_of_rows(queries.publisher.valid_rows(theirs))))
    return evaluation.result_document(results, attributed)


@query(oracles.ORACLES["semver_order"])
def sql_version_keys(spark, sf_dir):
    """`semver_order`, in SQL text."""
    rows = adapters.release_history(spark, sf_dir)
    return sql.register(spark).sql("SELECT DISTINCT version, version_key(version) AS sort_key, CAST(version_major(version) AS BIGINT) AS major FROM {rows} WHERE length(version) > 0", rows=rows)


@query(oracles._gates("SELECT package_name, version, published_at, 'i' || version_id AS integrity_hash, CASE WHEN version_id % 2 = 0 THEN content_hash END AS content_hash, '<' || lower(publisher_email) || '>' AS identity, split_part(lower(publisher_email), '@', 2) AS host, version_id % 3 = 1 AS provenance_present FROM rel"))
def sql_document_releases(spark, sf_dir):
    """The releases of whole documents, by a table function in SQL text."""
    text = """SELECT r.package_name, r.version, r.published_at, r.integrity_hash, r.content_hash, release_identity(nullif(trim(r.publisher_name), 'dev'), r.publisher_email) AS identity,
      mail_domain(r.publisher_email) AS host, r.provenance_present FROM {documents} d, LATERAL document_releases(d.document) r"""
    return sql.register(spark).sql(text, documents=_documents(spark, sf_dir))


def _lockfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lockfiles of installed releases: nested folders, entries that say their name, packages that no store knows, odd integrities."""
    path = "CASE version_id % 3 WHEN 0 THEN 'node_modules/h' || version_id || '/node_modules/' || package_name WHEN 1 THEN 'lib/' || version_id ELSE 'node_modules/n' || version_id END"
    integrity = "CASE WHEN version_id % 7 = 0 THEN '7' WHEN version_id % 11 = 0 THEN '\"other\"' ELSE '\"' || coalesce(integrity_hash, '?') || '\"' END"
    entry = f"""'"' || {path} || '":{{' || CASE WHEN version_id % 3 = 1 THEN '"name":"' || package_name || '",' ELSE '' END || '"version":"' || version || '","integrity":' || {integrity} || '}}'"""
    of = adapters.stored_releases(spark, sf_dir).selectExpr("package_id % 97 AS lock_id", f"{entry} AS entry").groupBy("lock_id").agg(F.array_join(F.collect_list("entry"), ",").alias("e"))
    return of.select("lock_id", F.concat(F.lit('{"name":"root","packages":{"":{"name":"root","version":"1"},"node_modules/odd":3,'), "e", F.lit("}}")).alias("document"))


_INSTALLED = """SELECT package_id % 97 AS lock_id, CASE WHEN version_id % 3 = 2 THEN 'n' || version_id ELSE package_name END AS package_name, version,
  CASE WHEN version_id % 7 = 0 THEN NULL WHEN version_id % 11 = 0 THEN 'other' ELSE coalesce(integrity_hash, '?') END AS integrity, CASE WHEN version_id % 3 <> 2 THEN integrity_hash END AS base, version_id % 3 <> 2 AS known FROM rel"""


@query(oracles._store(f"SELECT lock_id, package_name, version, integrity FROM ({_INSTALLED}) x"))
def lockfile_packages(spark, sf_dir):
    """Installed packages of whole lockfiles, in SQL text; the same rows as `lockfile.installed`."""
    text = "SELECT d.lock_id, r.package_name, r.version, r.integrity FROM {lockfiles} d, LATERAL lockfile_packages(d.document) r"
    return sql.register(spark).sql(text, lockfiles=_lockfiles(spark, sf_dir))


@query(
    oracles._store(f"""SELECT package_name, version, CASE reason WHEN 'integrity_match' THEN 'verified' WHEN 'integrity_mismatch' THEN 'tamper' ELSE 'unverifiable' END AS status, reason,
  CASE WHEN reason = 'integrity_mismatch' THEN 'tamper' WHEN reason = 'lockfile_missing' OR (reason = 'not_in_witness' AND NOT known) THEN 'skipped' WHEN reason = 'not_in_witness' THEN 'unverifiable' END AS severity
FROM (SELECT *, CASE WHEN integrity IS NULL THEN 'lockfile_missing' WHEN base IS NULL THEN 'not_in_witness' WHEN base <> integrity THEN 'integrity_mismatch' ELSE 'integrity_match' END AS reason FROM ({_INSTALLED}) x) y""")
)
def lockfile_checks(spark, sf_dir):
    """The packages of lockfiles held against the store."""
    stored = adapters.stored_releases(spark, sf_dir)
    return upkeep.self_check(lockfile.installed(_lockfiles(spark, sf_dir)), stored, stored)


@query(
    oracles._store("""SELECT 'seed-v' || version_id AS tag, CASE WHEN version_id % 2 = 1 THEN 'db=u/' || version_id || ',sig=s/' || version_id END AS urls, CASE WHEN version_id % 2 = 1 THEN '' ELSE 'sig' END AS missing,
  CASE WHEN version_id % 2 = 1 THEN 'db,notes,sig' ELSE 'db,notes' END AS available FROM rel""")
)
def release_assets(spark, sf_dir):
    """The files of remote releases, one listing a package; every second one lacks its signature."""
    entry = """'{"tag_name":"seed-v' || version_id || '","published_at":"' || published_at || '","assets":[{"name":"db","browser_download_url":"old"},{"name":"db","browser_download_url":"u/' || version_id || '"},{"name":7},"x",{"name":"notes","browser_download_url":"n"},{"name":"sig","browser_download_url":"' || CASE WHEN version_id % 2 = 1 THEN 's/' || version_id ELSE '' END || '"}]}'"""
    listings = adapters.stored_releases(spark, sf_dir).selectExpr("package_id", f"{entry} AS e").groupBy("package_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("e"), ","), F.lit(",5]")).alias("document"))
    told = lockfile.assets_of(lockfile.listed_releases(listings), ["db", "sig"])
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("urls"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return told.select("tag", pairs.alias("urls"), F.array_join("missing", ",").alias("missing"), F.array_join("available", ",").alias("available"))
