"""DuckDB SQL for the catalogue: the same relations written a second time, as chains of common table expressions."""

from __future__ import annotations

from pedigree.functions.columns import SEMVER
from pedigree.params import FREE_WEBMAIL, MACHINE_EMAIL, PRIVACY_PROVIDERS
from pedigree.sources import adapters

NOW = adapters.GATE_NOW_MS


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _num(x: str) -> str:
    short = f"coalesce(nullif(ltrim({x}, '0'), ''), '0')"
    return f"(lpad(length({short})::VARCHAR, 4, '0') || {short})"


def _part(v: str, k: int) -> str:
    return f"nullif(regexp_extract(trim({v}), '{SEMVER}', {k}), '')"


def key(v: str) -> str:
    """Sort key of a version."""
    ids = f"array_to_string(list_transform(string_split({_part(v, 4)}, '.'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '0' || {_num('x')} ELSE '1' || x END), '!')"
    core = " || ".join(_num(_part(v, k)) for k in (1, 2, 3))
    return f"(CASE WHEN regexp_matches(trim({v}), '{SEMVER}') THEN 'a' || {core} || coalesce('-' || {ids}, '~') ELSE 'z' || {v} END)"


def major(v: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches(trim({v}), '{SEMVER}') THEN {_part(v, 1)} END, nullif(regexp_extract({v}, '^([0-9]+)\\.', 1), ''))::BIGINT"


def _domain(e: str) -> str:
    return f"CASE WHEN contains({e}, '@') THEN nullif(lower(trim(regexp_extract({e}, '@([^@]*)$', 1))), '') END"


def _provider(d: str, n: str, least: str = "2") -> str:
    return f"CASE WHEN {d} IS NULL THEN 'unknown' WHEN {d} IN ({_list(PRIVACY_PROVIDERS)}) THEN 'privacy' WHEN {d} IN ({_list(FREE_WEBMAIL)}) THEN 'free-webmail' WHEN coalesce({n}, 0) >= {least} THEN 'verified-corporate' ELSE 'unverified' END"


class Chain:
    """Common table expressions up to a point; with a grid, `k` are the key columns and parameters are columns."""

    def __init__(self, grid: str | None = None):
        self.grid = grid
        self.k = "package_id" if grid is None else "grid_id, w, kc, mvv, cw, sd, package_id"
        self.w, self.kc, self.mvv, self.cw, self.sd = ("3", "10", "2", "5", "0.8") if grid is None else ("w", "kc", "mvv", "cw", "sd")

    def on(self, a: str, b: str) -> str:
        """Equality of the keys, without the parameters that follow from the grid point."""
        return " AND ".join(f"{a}.{c} = {b}.{c}" for c in (["package_id"] if self.grid is None else ["grid_id", "package_id"]))

    def keys(self, a: str) -> str:
        return ", ".join(f"{a}.{c.strip()}" for c in self.k.split(","))

    def parts(self) -> dict[str, str]:
        k, on, ks = self.k, self.on, self.keys
        return {
            "h0": adapters.history_sql("duckdb"),
            "h": "SELECT * FROM h0" if self.grid is None else f"SELECT h0.*, g.* FROM h0 CROSS JOIN ({self.grid}) g",
            "labels": adapters.labels_sql("h0"),
            "v": f"SELECT * FROM (SELECT *, coalesce(nullif(trim(publisher_name), ''), '<' || nullif(lower(trim(publisher_email)), '') || '>') AS identity, {_domain('publisher_email')} AS domain FROM h) WHERE identity IS NOT NULL AND published_at_ms IS NOT NULL AND length(version) > 0",
            "pr": f"SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY published_at_ms, {key('version')}, identity, input_idx) - 1 AS rn FROM v",
            "prb": f"SELECT *, (sum(chg) OVER (PARTITION BY {k} ORDER BY rn ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS block_idx FROM (SELECT *, CASE WHEN lag(identity) OVER (PARTITION BY {k} ORDER BY rn) = identity THEN 0 ELSE 1 END AS chg FROM pr)",
            "seen": f"SELECT {k}, domain, count(*) AS dn, min(published_at_ms) AS dfirst FROM pr WHERE domain IS NOT NULL GROUP BY {k}, domain",
            "b0": f"""SELECT {k}, block_idx, any_value(identity) AS identity, list(publisher_email ORDER BY rn)[1] AS email, count(*) AS version_count, list(version ORDER BY rn)[1] AS first_version, list(version ORDER BY rn DESC)[1] AS last_version,
  list(provenance_present ORDER BY rn)[1] AS first_provenance_present, list(provenance_present ORDER BY rn DESC)[1] AS last_provenance_present, min(published_at_ms) AS first_published_at_ms, max(published_at_ms) AS last_published_at_ms FROM prb GROUP BY {k}, block_idx""",
            "bl": f"SELECT b.*, b.last_published_at_ms - b.first_published_at_ms AS duration_ms, s.dfirst AS first_seen_in_package_ms, {_provider('b.domain', 's.dn', self.mvv if self.grid is None else 'b.mvv')} AS provider FROM (SELECT *, {_domain('email')} AS domain FROM b0) b LEFT JOIN seen s ON {on('b', 's')} AND b.domain = s.domain",
            "tr": f"""SELECT *, CASE WHEN is_overlap AND is_known THEN 'recurring_member' WHEN is_overlap THEN 'new_committee_member' WHEN is_known THEN 'returning_dormant' ELSE 'cold_handoff' END AS cell FROM (
  SELECT {k}, block_idx - 1 AS from_index, lag(identity) OVER o AS from_identity, identity AS to_identity, first_version AS at_version, first_published_at_ms AS at_published_at_ms, lag(version_count) OVER o AS prior_tenure_versions, lag(duration_ms) OVER o AS prior_tenure_duration_ms,
    first_published_at_ms - lag(last_published_at_ms) OVER o AS gap_ms, coalesce(max(block_idx) OVER e >= block_idx - {self.w}, false) AS is_overlap, coalesce(sum(version_count) OVER e, 0)::BIGINT AS prior_contribution_count,
    coalesce(sum(version_count) OVER e, 0) >= {self.kc} AS is_known, min(first_published_at_ms) OVER (PARTITION BY {k}, identity) < first_published_at_ms AS seen_before, lag(last_provenance_present) OVER o AS prior_last, first_provenance_present, domain, provider,
    coalesce(first_seen_in_package_ms = first_published_at_ms, false) AS new_domain
  FROM bl WINDOW o AS (PARTITION BY {k} ORDER BY block_idx), e AS (PARTITION BY {k}, identity ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE from_index >= 0""",
            "pk": f"SELECT {k}, count(*) AS n_all FROM h GROUP BY {k}",
            "sg": f"""SELECT {ks('pk')}, coalesce(r.n, 0) AS observed_versions_count, coalesce(x.u, 0) AS unique_identity_count, coalesce(r.n, 0) >= 8 AS has_sufficient_history, coalesce(t.mp, 0) AS max_prior_tenure_versions, coalesce(t.mc, 0) AS max_cold_handoff_prior_tenure,
  coalesce(t.c1, 0) AS cold_handoff_count, coalesce(t.c2, 0) AS new_committee_member_count, coalesce(t.c3, 0) AS returning_dormant_count, coalesce(t.c4, 0) AS recurring_member_count, coalesce(r.dur, 0) AS total_history_duration_ms, coalesce(x.lv, 0) AS longest_tenure_versions,
  coalesce(x.ld, 0) AS longest_tenure_duration_ms, coalesce(t.n, 0) AS transition_count, pk.n_all - coalesce(r.n, 0) AS skipped_versions_count, coalesce(t.ov, false) AS has_overlap_transition
FROM pk LEFT JOIN (SELECT {k}, count(*) AS n, max(published_at_ms) - min(published_at_ms) AS dur FROM pr GROUP BY {k}) r ON {on('pk', 'r')}
LEFT JOIN (SELECT {k}, count(DISTINCT identity) AS u, max(version_count) AS lv, max(duration_ms) AS ld FROM bl GROUP BY {k}) x ON {on('pk', 'x')}
LEFT JOIN (SELECT {k}, count(*) AS n, max(prior_tenure_versions) AS mp, max(CASE WHEN cell = 'cold_handoff' THEN prior_tenure_versions END) AS mc, count(*) FILTER (cell = 'cold_handoff') AS c1, count(*) FILTER (cell = 'new_committee_member') AS c2,
  count(*) FILTER (cell = 'returning_dormant') AS c3, count(*) FILTER (cell = 'recurring_member') AS c4, bool_or(is_overlap) AS ov FROM tr GROUP BY {k}) t ON {on('pk', 't')}""",
            "st": f"SELECT {k}, CASE WHEN max(CASE WHEN f >= n - {self.cw} THEN 1 ELSE 0 END) = 1 THEN 'churning' WHEN count(*) >= 3 THEN 'mixed' ELSE 'stable' END AS domain_stability FROM (SELECT {k}, domain, min(rn) AS f, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY {k}) AS n FROM pr) WHERE domain IS NOT NULL GROUP BY {k}, domain) GROUP BY {k}",
            "sh": f"SELECT {ks('sg')}, CASE WHEN NOT sg.has_sufficient_history THEN 'unknown' WHEN z.u = 1 OR z.m / z.t >= {self.sd if self.grid is None else 'sg.sd'} THEN 'solo' WHEN z.u = 2 THEN 'alternating' ELSE 'committee' END AS shape FROM sg LEFT JOIN (SELECT {k}, count(*) AS u, max(n)::DOUBLE AS m, sum(n)::DOUBLE AS t FROM (SELECT {k}, identity, sum(version_count) AS n FROM bl GROUP BY {k}, identity) GROUP BY {k}) z ON {on('sg', 'z')}",
            "ip": f"SELECT {ks('sg')}, coalesce(q.p, '') AS providers_seen, coalesce(q.hp, false) AS has_privacy_provider, coalesce(q.hu, false) AS has_unverified_domain, coalesce(st.domain_stability, 'stable') AS domain_stability FROM sg LEFT JOIN (SELECT {k}, string_agg(DISTINCT provider, ',' ORDER BY provider) AS p, bool_or(provider = 'privacy') AS hp, bool_or(provider = 'unverified') AS hu FROM bl GROUP BY {k}) q ON {on('sg', 'q')} LEFT JOIN st ON {on('sg', 'st')}",
            "pv0": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k}, version ORDER BY input_idx) AS dup FROM h WHERE length(version) > 0 AND published_at_ms IS NOT NULL) WHERE dup = 1",
            "pv1": f"SELECT *, row_number() OVER (PARTITION BY {k}, major ORDER BY rn) - 1 AS mrn FROM (SELECT *, CASE WHEN length(publisher_email) > 0 THEN lower(trim(publisher_email)) END AS email, nullif(publisher_name, '') AS name, {major('version')} AS major, row_number() OVER (PARTITION BY {k} ORDER BY published_at_ms, {key('version')}, input_idx) - 1 AS rn FROM pv0)",
            "pv2": f"SELECT *, coalesce(c, 0) - coalesce(max(CASE WHEN provenance_present = false THEN cn END) OVER (PARTITION BY {k}, major ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_streak FROM (SELECT *, sum(CASE WHEN provenance_present THEN 1 ELSE 0 END) OVER (PARTITION BY {k}, major ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c, sum(CASE WHEN provenance_present THEN 1 ELSE 0 END) OVER (PARTITION BY {k}, major ORDER BY rn) AS cn FROM pv1)",
            "pv3": "SELECT *, CASE WHEN provenance_present THEN prior_streak + 1 WHEN provenance_present = false THEN 0 ELSE prior_streak END AS streak_after FROM pv2",
            "pv": f"SELECT *, enough AND prior_streak >= 3 AS baseline_established, enough AND prior_streak >= 3 AND coalesce(NOT provenance_present, false) AS provenance_regression, enough AND reached AS in_scope, {_domain('email')} AS domain FROM (SELECT *, max(streak_after) OVER (PARTITION BY {k}, major ORDER BY rn) >= 3 AS reached, count(*) OVER (PARTITION BY {k}) >= 8 AS enough FROM pv3)",
            "ca": f"SELECT {ks('t')}, t.version, t.rn, coalesce(string_agg(DISTINCT r.name, ',' ORDER BY r.name), '') AS identities, coalesce(string_agg(DISTINCT r.email, ',' ORDER BY r.email), '') AS emails, coalesce(bool_or(r.email = '{MACHINE_EMAIL}'), false) AS any_machine, coalesce(bool_or(r.email <> '{MACHINE_EMAIL}'), false) AS any_human FROM pv t JOIN pv r ON {on('t', 'r')} AND t.major IS NOT DISTINCT FROM r.major AND r.mrn < t.mrn AND r.mrn >= t.mrn - t.prior_streak WHERE t.baseline_established GROUP BY {ks('t')}, t.version, t.rn",
            "dk": f"SELECT {k}, domain, count(*) AS n, min(published_at_ms) AS f FROM pv WHERE domain IS NOT NULL GROUP BY {k}, domain",
            "es": f"""SELECT *, list_filter([CASE WHEN domain IS NOT NULL AND df >= published_at_ms THEN 'new_domain' END, CASE WHEN kind = 'privacy' THEN 'privacy' END, CASE WHEN kind = 'unverified' THEN 'unverified' END,
  CASE WHEN any_machine AND NOT coalesce(email = '{MACHINE_EMAIL}', false) THEN 'machine_to_human' END], lambda x: x IS NOT NULL) AS escalators FROM (
  SELECT pv.*, dk.f AS df, {_provider('pv.domain', 'dk.n', self.mvv if self.grid is None else 'pv.mvv')} AS kind, coalesce(ca.any_machine, false) AS any_machine FROM pv LEFT JOIN dk ON {on('pv', 'dk')} AND pv.domain = dk.domain LEFT JOIN ca ON {on('pv', 'ca')} AND pv.version = ca.version WHERE pv.in_scope AND pv.provenance_regression)""",
        }

    def judged(self, full: bool) -> dict[str, str]:
        """Verdicts on transitions, with the attestation records or without."""
        on, ks = self.on, self.keys
        fell = f"LEFT JOIN pv ON {on('t', 'pv')} AND pv.version = t.at_version AND pv.provenance_regression" if full else ""
        fell_flag = "pv.version IS NOT NULL" if full else "false"
        return {
            "j0": f"""SELECT t.*, sh.shape, ip.has_unverified_domain AS hud, ip.domain_stability AS stab, t.new_domain AND t.provider IN ('privacy', 'unverified') AS risky, {fell_flag} AS fell,
  coalesce(t.prior_last, false) AND NOT coalesce(t.first_provenance_present, false) AS broke, t.cell = 'cold_handoff' AND t.prior_tenure_versions >= 5 AS judged, sh.shape IN ('solo', 'unknown') AS solo, t.prior_tenure_versions >= 20 AS lng
FROM tr t JOIN sh ON {on('t', 'sh')} JOIN ip ON {on('t', 'ip')} {fell}""",
            "j1": "SELECT *, list_filter([CASE WHEN risky THEN 'co-signal: new ' || provider || ' domain ' || domain END, CASE WHEN fell THEN 'co-signal: provenance regression @ ' || at_version WHEN broke THEN 'co-signal: provenance break' END, CASE WHEN gap_ms < 86400000 THEN 'co-signal: gap_ms=' || gap_ms || ' (<86400000)' END], lambda x: x IS NOT NULL) AS cs FROM j0",
            "j2": "SELECT *, CASE WHEN NOT judged THEN 'ALLOW' WHEN solo THEN 'BLOCK' WHEN lng AND len(cs) > 0 THEN 'BLOCK' ELSE 'WARN' END AS d0 FROM j1",
            "j3": "SELECT *, judged AND new_domain AND provider = 'privacy' AND hud AND d0 = 'WARN' AS combo FROM j2",
            "j4": "SELECT *, judged AND new_domain AND NOT solo AND stab = 'churning' AND (combo OR d0 = 'BLOCK') AS calm FROM j3",
            "j": """SELECT *, CASE WHEN calm THEN 'WARN' WHEN combo THEN 'BLOCK' ELSE d0 END AS disposition, CASE WHEN cell <> 'cold_handoff' THEN cell || ' @ ' || at_version WHEN NOT judged THEN cell || ' @ ' || at_version || ' (rotation churn, prior_tenure=' || prior_tenure_versions || ')'
  ELSE array_to_string(list_filter([cell || ' @ ' || at_version, 'shape=' || shape, 'prior_tenure=' || prior_tenure_versions, CASE WHEN NOT solo AND lng AND len(cs) > 0 THEN array_to_string(cs, ' | ') WHEN NOT solo AND lng THEN 'no co-signal (committee tenure alone does not BLOCK)' END,
    CASE WHEN risky THEN 'new_domain=' || domain || ' (' || provider || ')' END, CASE WHEN combo THEN 'privacy+unverified combo' END, CASE WHEN calm THEN 'stability=churning (de-escalated)' END], lambda x: x IS NOT NULL), ' | ') END AS reason FROM j4""",
            "j5": f"SELECT {ks('j')}, 1 AS pass, j.from_index AS place, j.at_version AS version, j.disposition, j.reason FROM j" + (" WHERE NOT j.seen_before" if full else ""),
            "r0": f"SELECT *, min(first_published_at_ms) OVER (PARTITION BY {self.k}, identity) AS since FROM bl",
            "r1": f"SELECT {ks('es')}, es.rn, es.version, es.published_at_ms AS ms, es.escalators AS e, arg_min(r0.since, r0.block_idx) AS since FROM es JOIN r0 ON {on('es', 'r0')} AND es.published_at_ms BETWEEN r0.first_published_at_ms AND r0.last_published_at_ms GROUP BY {ks('es')}, es.rn, es.version, es.published_at_ms, es.escalators",
            "r2": f"SELECT {self.k}, 2 AS pass, rn AS place, version, CASE WHEN len(e) > 0 THEN 'BLOCK' ELSE 'WARN' END AS disposition, 'provenance_regression @ ' || version || ' | ' || CASE WHEN len(e) > 0 THEN 'escalators=[' || array_to_string(e, ',') || ']' ELSE 'regression without escalators' END AS reason FROM r1 WHERE since < ms",
            "vd": f"SELECT x.* FROM ({'SELECT * FROM j5 UNION ALL SELECT * FROM r2' if full else 'SELECT * FROM j5'}) x JOIN sg ON {on('x', 'sg')} WHERE sg.has_sufficient_history",
            "dp": f"""SELECT {ks('sg')}, CASE coalesce(y.l, 0) WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'WARN' ELSE 'ALLOW' END AS disposition, CASE WHEN NOT sg.has_sufficient_history THEN 'insufficient history (observed_versions_count=' || sg.observed_versions_count || ')' WHEN y.r IS NULL THEN CASE WHEN sg.transition_count = 0 THEN 'no transitions observed' ELSE 'no escalating signals' END ELSE y.r END AS reasons
FROM sg LEFT JOIN (SELECT {self.k}, max(CASE disposition WHEN 'BLOCK' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) AS l, string_agg(disposition || ': ' || reason, chr(10) ORDER BY pass, place) AS r FROM vd GROUP BY {self.k}) y ON {on('sg', 'y')}""",
        }

    def results(self) -> dict[str, str]:
        on, ks, k = self.on, self.keys, self.k
        return {
            "lv": f"SELECT {k}, version, arg_max(disposition, pass * 1000000000 + place) AS disposition FROM vd GROUP BY {k}, version",
            "lw": f"SELECT {ks('lv')}, count(*) FILTER (lv.disposition = 'BLOCK') AS nb, count(*) FILTER (lv.disposition = 'WARN') AS nw, coalesce(bool_or(lv.disposition = 'BLOCK' AND es.version IS NULL), false) AS own FROM lv LEFT JOIN es ON {on('lv', 'es')} AND lv.version = es.version AND len(es.escalators) > 0 GROUP BY {ks('lv')}",
            "le": f"SELECT {k}, count(*) AS n, count(*) FILTER (len(escalators) > 0) AS f, " + ", ".join(f"count(*) FILTER (list_contains(escalators, '{e}')) AS fires_{e}" for e in _FIRES) + f" FROM es GROUP BY {k}",
            "res": f"""SELECT {ks('sg')}, sg.package_id IN (SELECT package_id FROM labels) AS attack, dp.disposition, sh.shape, sg.observed_versions_count, sg.has_sufficient_history, sg.transition_count, coalesce(lw.nb, 0) AS block_transitions, coalesce(lw.nw, 0) AS warn_transitions,
  coalesce(le.n, 0) AS provenance_regression_count, coalesce(le.f, 0) AS provenance_escalator_fires, {", ".join(f"coalesce(le.fires_{e}, 0) AS fires_{e}" for e in _FIRES)}, coalesce(lw.own, false) AS publisher_block
FROM sg JOIN dp ON {on('sg', 'dp')} JOIN sh ON {on('sg', 'sh')} LEFT JOIN lw ON {on('sg', 'lw')} LEFT JOIN le ON {on('sg', 'le')}""",
        }

    def sql(self, final: str, full: bool | None = None, results: bool = False, more: dict[str, str] | None = None) -> str:
        parts = self.parts() | (self.judged(full) if full is not None else {}) | (self.results() if results else {}) | (more or {})
        return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in parts.items()) + "\n" + final


_FIRES = ("new_domain", "privacy", "unverified", "machine_to_human")
_R4 = "floor({} * 10000 + 0.5) / 10000"


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {_R4.format(f'(({a})::DOUBLE / ({b}))')} END"


def _wilson(a: str, n: str, side: str) -> str:
    z = "1.959964::DOUBLE"
    p = f"(({a})::DOUBLE / ({n}))"
    end = f"(({p} + {z} * {z} / (2 * ({n})) {side} {z} * sqrt({p} * (1 - {p}) / ({n}) + {z} * {z} / (4 * ({n}) * ({n})))) / (1 + {z} * {z} / ({n})))"
    return f"CASE WHEN ({n}) > 0 THEN {_R4.format(f'least(1.0, greatest(0.0, {end}))')} END"


def _confusion(source: str, by: str) -> str:
    attack, block, att = "attack", "disposition = 'BLOCK'", "provenance_escalator_fires > 0"
    counts = {
        "tp": f"{attack} AND {block}", "fn": f"{attack} AND NOT ({block})", "fp": f"NOT {attack} AND {block}", "tn": f"NOT {attack} AND NOT ({block})", "warn_clean": f"NOT {attack} AND disposition = 'WARN'",
        "publisher_only": f"{attack} AND {block} AND publisher_block AND NOT ({att})", "provenance_only": f"{attack} AND {block} AND NOT publisher_block AND {att}", "both_layers": f"{attack} AND {block} AND publisher_block AND {att}",
        "provenance_attack_detected": f"{attack} AND {att}", "provenance_clean_blocked": f"NOT {attack} AND {att}",
    }
    inner = f"SELECT {by}, " + ", ".join(f"count(*) FILTER ({w}) AS {n}" for n, w in counts.items()) + ", " + ", ".join(f"sum(fires_{e})::BIGINT AS fires_{e}" for e in _FIRES) + f" FROM {source} GROUP BY {by}"
    rates = f"{_rate('tp', 'tp + fn')} AS recall, {_wilson('tp', 'tp + fn', '-')} AS recall_low, {_wilson('tp', 'tp + fn', '+')} AS recall_high, {_rate('fp', 'fp + tn')} AS false_positive_rate, {_wilson('fp', 'fp + tn', '-')} AS fpr_low, {_wilson('fp', 'fp + tn', '+')} AS fpr_high, {_rate('tp', 'tp + fp')} AS precision"
    return f"SELECT *, {rates} FROM ({inner})"


def _grid(points: list[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, {w}, {kc}, {m}, {c}, {s}::DOUBLE)" for k, (w, kc, m, c, s) in enumerate(points)) + ") AS t(grid_id, w, kc, mvv, cw, sd)"


_SENSITIVE = [(3, 10, 2, 5, 0.8), (2, 10, 2, 5, 0.8), (4, 10, 2, 5, 0.8), (3, 9, 2, 5, 0.8), (3, 11, 2, 5, 0.8), (3, 10, 1, 5, 0.8), (3, 10, 3, 5, 0.8), (3, 10, 2, 4, 0.8), (3, 10, 2, 6, 0.8), (3, 10, 2, 5, 0.75), (3, 10, 2, 5, 0.8500000000000001)]
_CALIBRATE = [(3, 10, m, 5, s) for m in (1, 2, 3, 4) for s in (0.75, 0.8, 0.85)]
_GRID_COLUMNS = "grid_id, w AS p_overlap_window, kc AS p_known_count, mvv AS p_min_verified_versions, cw AS p_churning_window, sd AS p_solo_dominance"
_TARGETS = {
    "pinned": "SELECT DISTINCT package_id, advisory_id FROM labels WHERE version_id IS NOT NULL",
    "lab": "SELECT * FROM labels l WHERE is_malicious AND (version_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM pinned p WHERE p.package_id = l.package_id AND p.advisory_id = l.advisory_id))",
    "tg0": f"""SELECT l.label_id, l.package_id, h0.version, 'version_pinned' AS kind FROM lab l JOIN h0 ON l.package_id = h0.package_id AND l.version_id = h0.input_idx WHERE l.version_id IS NOT NULL
UNION SELECT l.label_id, l.package_id, h0.version, 'range_based' FROM lab l JOIN h0 ON l.package_id = h0.package_id WHERE l.version_id IS NULL AND length(h0.version) > 0 AND CASE l.affected_range
  WHEN '>=1.0.0 <2.0.0' THEN CASE WHEN regexp_matches(trim(h0.version), '{SEMVER}') THEN {key('h0.version')} >= {key("'1.0.0'")} AND {key('h0.version')} < {key("'2.0.0'")} ELSE h0.version >= '1.0.0' AND h0.version < '2.0.0' END
  WHEN '>1.40.0' THEN CASE WHEN regexp_matches(trim(h0.version), '{SEMVER}') THEN {key('h0.version')} > {key("'1.40.0'")} ELSE h0.version > '1.40.0' END ELSE false END""",
    "tg": f"SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY {key('version')}, version) AS place FROM tg0",
}
_ATTRIBUTION = _TARGETS | {
    "wh": "SELECT package_id, version, arg_max(block_idx, input_idx) AS block_idx FROM prb GROUP BY package_id, version",
    "bk": f"SELECT lv.package_id, lv.version AS anchor, wh.block_idx AS b, {key('lv.version')} AS k FROM lv LEFT JOIN wh ON lv.package_id = wh.package_id AND lv.version = wh.version WHERE lv.disposition = 'BLOCK'",
    "ta": f"SELECT tg.*, wh.block_idx, {key('tg.version')} AS vk FROM tg LEFT JOIN wh ON tg.package_id = wh.package_id AND tg.version = wh.version",
    "fd": "SELECT ta.label_id, bk.anchor, row_number() OVER (PARTITION BY ta.label_id ORDER BY ta.place, CASE WHEN bk.anchor = ta.version THEN 0 ELSE 1 END, bk.k, bk.anchor) AS r FROM ta JOIN bk ON ta.package_id = bk.package_id AND (ta.version = bk.anchor OR (ta.block_idx = bk.b AND bk.k <= ta.vk))",
    "ot": "SELECT tg.label_id, lv.version, lv.disposition, row_number() OVER (PARTITION BY tg.label_id ORDER BY tg.place) AS r FROM tg JOIN lv ON tg.package_id = lv.package_id AND tg.version = lv.version",
    "att": """SELECT lab.label_id, lab.package_id, lab.advisory_id, coalesce(n.n, 0) AS n_candidates, fd.anchor IS NOT NULL AS detected, coalesce(fd.anchor, ot.version) AS detected_version, CASE WHEN fd.anchor IS NOT NULL THEN 'BLOCK' ELSE ot.disposition END AS detected_disposition, lab.detection_lag_days
FROM lab LEFT JOIN (SELECT * FROM fd WHERE r = 1) fd ON lab.label_id = fd.label_id LEFT JOIN (SELECT * FROM ot WHERE r = 1) ot ON lab.label_id = ot.label_id LEFT JOIN (SELECT label_id, count(*) AS n FROM tg GROUP BY label_id) n ON lab.label_id = n.label_id""",
}

_C = Chain()

# Gates: the prior versions of a release are found by joining the history with itself.
_GATE_PARTS = {
    "rel": adapters.releases_sql("duckdb"),
    "inc": adapters.incoming_sql("rel"),
    "deps": adapters.deps_sql(),
    "scr": adapters.scripts_sql(),
    "cache": adapters.dep_cache_sql("duckdb"),
    "pri": """SELECT i.package_id, i.version, count(*) AS n_prior, count(*) FILTER (s.provenance_present) AS n_att, list(s.version ORDER BY s.published_at DESC, s.version_id DESC)[1] AS lv, list(s.publisher_email ORDER BY s.published_at DESC, s.version_id DESC)[1] AS le,
  (list(s.version ORDER BY s.published_at DESC, s.version_id DESC) FILTER (s.provenance_present))[1] AS la FROM inc i JOIN rel s ON i.package_id = s.package_id AND i.version <> s.version GROUP BY i.package_id, i.version""",
    "idep": "SELECT i.package_id, i.version, d.dep FROM inc i JOIN deps d ON i.version_id = d.version_id",
    "ndep": "SELECT x.package_id, x.version, count(*) AS n_deps, coalesce(list(x.dep ORDER BY x.dep) FILTER (NOT EXISTS (SELECT 1 FROM rel s JOIN deps d ON s.version_id = d.version_id WHERE s.package_id = x.package_id AND s.version <> x.version AND d.dep = x.dep)), []) AS nd FROM idep x GROUP BY x.package_id, x.version",
    "fr": f"SELECT n.package_id, n.version, arg_min(c.dep, c.dep) AS fdep, arg_min(floor(({NOW} - c.first_publish_ms) / 3600000)::BIGINT, c.dep) AS fage FROM (SELECT package_id, version, unnest(nd) AS dep FROM ndep) n JOIN cache c ON n.dep = c.dep WHERE c.status = 'ok' AND floor(({NOW} - c.first_publish_ms) / 3600000) < 24 GROUP BY n.package_id, n.version",
    "f": f"""SELECT i.*, s.integrity_hash AS bi, s.content_hash AS bc, coalesce(p.n_prior, 0) AS n_prior, coalesce(p.n_att, 0) AS n_att, p.lv, p.le, p.la, coalesce(n.n_deps, 0) AS n_deps, coalesce(n.nd, []) AS nd, coalesce(scr.has_script, false) AS has_script, fr.fdep, fr.fage,
  floor(greatest(0, {NOW} - epoch_ms(i.published_at::TIMESTAMP)) / 3600000)::BIGINT AS hours FROM inc i JOIN rel s ON i.version_id = s.version_id LEFT JOIN pri p ON i.package_id = p.package_id AND i.version = p.version LEFT JOIN ndep n ON i.package_id = n.package_id AND i.version = n.version LEFT JOIN scr ON i.version_id = scr.version_id LEFT JOIN fr ON i.package_id = fr.package_id AND i.version = fr.version""",
}


def _cut(x: str, n: int, absent: str) -> str:
    return f"coalesce(CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '…' ELSE {x} END, '{absent}')"


def _gate(branches: list[tuple[str, str, str]]) -> tuple[str, str]:
    head = " ".join(f"WHEN {w} THEN '{r}'" for w, r, _ in branches[:-1])
    said = " ".join(f"WHEN {w} THEN {d}" for w, _, d in branches[:-1])
    return f"CASE {head} ELSE '{branches[-1][1]}' END", f"CASE {said} ELSE {branches[-1][2]} END"


_bi, _ii, _bc, _ic = (_cut(x, 16, "(none)") for x in ("bi", "integrity_hash", "bc", "content_hash"))
_GATES = {
    "content-hash": _gate([
        ("bi IS NULL AND bc IS NULL", "SKIP", "'baseline has no hash fields — cannot verify'"), ("integrity_hash IS NULL AND content_hash IS NULL", "SKIP", "'incoming packument missing hash fields'"),
        ("bi = integrity_hash AND bc <> content_hash", "ALLOW", f"'integrity matches baseline (sha1 re-shasum: ' || {_bc} || ' → ' || {_ic} || ')'"), ("bi = integrity_hash", "ALLOW", "'integrity hash matches baseline'"),
        ("bi <> integrity_hash", "BLOCK", f"'integrity hash differs from baseline: ' || {_bi} || ' → ' || {_ii}"), ("bc = content_hash", "ALLOW", "'shasum matches baseline'"), ("bc <> content_hash", "BLOCK", f"'shasum differs from baseline: ' || {_bc} || ' → ' || {_ic}"),
        ("", "SKIP", "'cannot compare: differing hash algorithms between baseline and incoming'"),
    ]),
    "dep-structure": _gate([
        ("n_prior = 0", "SKIP", "'no prior versions to compare dependencies against'"), ("n_deps = 0", "ALLOW", "'incoming version declares no runtime dependencies'"), ("len(nd) = 0", "ALLOW", "'all ' || n_deps || ' runtime dep(s) present in prior ' || n_prior || ' version(s)'"),
        ("", "WARN", "'new runtime dep(s): ' || array_to_string(nd[1:5], ', ') || CASE WHEN len(nd) > 5 THEN ', … (+' || (len(nd) - 5) || ' more)' ELSE '' END || ' (not in prior ' || n_prior || ' version(s))'"),
    ]),
    "publisher-identity": _gate([
        ("n_prior = 0", "SKIP", "'no prior versions to compare publisher against'"), ("nullif(trim(le), '') IS NULL", "SKIP", "'prior version has no publisher email — cannot verify'"), ("nullif(trim(publisher_email), '') IS NULL", "SKIP", "'incoming version has no publisher email — cannot verify'"),
        ("lower(trim(le)) = lower(trim(publisher_email))", "ALLOW", f"'publisher unchanged: ' || {_cut('le', 80, '(unknown)')}"),
        ("", "WARN", f"'publisher changed: ' || {_cut('le', 80, '(unknown)')} || ' → ' || {_cut('publisher_email', 80, '(unknown)')} || ' (prior version: ' || lv || ')'"),
    ]),
    "provenance-continuity": _gate([
        ("n_prior = 0", "SKIP", "'no prior versions to compare provenance against'"), ("n_att = 0", "SKIP", "'package has never used OIDC provenance — nothing to regress from'"),
        ("coalesce(provenance_present, false)", "ALLOW", "'OIDC provenance present (continuous with ' || n_att || '/' || n_prior || ' prior versions)'"),
        ("", "WARN", "'OIDC provenance missing (' || n_att || ' of last ' || n_prior || ' versions had it, latest: ' || la || ')'"),
    ]),
    "release-age": _gate([
        ("regexp_matches(string_split(version, '+')[1], '-[A-Za-z0-9]')", "ALLOW", "'prerelease exempt from release-age cooldown (' || version || ')'"), ("published_at IS NULL", "SKIP", "'published_at missing or unparseable — cannot compute age'"),
        ("hours >= 72", "ALLOW", "'release age ' || hours || 'h ≥ threshold 72h'"), ("", "WARN", "'release age ' || hours || 'h < threshold 72h (published ' || published_at || ')'"),
    ]),
    "scope-boundary": _gate([
        ("n_prior = 0", "SKIP", "'no prior versions to compare scope against'"), ("len(nd) = 0", "ALLOW", "'no new runtime dependencies introduced'"), ("NOT has_script", "ALLOW", "len(nd) || ' new dep(s) but no install scripts — low risk'"),
        ("fdep IS NOT NULL", "WARN", "'new dep ''' || fdep || ''' published ' || fage || 'h ago + install scripts in ' || package_name || '@' || version"),
        ("", "WARN", "'new dep(s) [' || array_to_string(nd, ', ') || '] + install scripts (none freshly published within 24h)'"),
    ]),
}


def _gates(final: str, more: dict[str, str] | None = None) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in (_GATE_PARTS | (more or {})).items()) + "\n" + final


def _runner() -> dict[str, str]:
    rows = []
    for place, (name, (result, detail)) in enumerate(_GATES.items()):
        if name != "content-hash":
            why = "'insufficient history (' || n_prior || ' prior version(s), need 8) — first-seen poisoning protection'"
            result, detail = f"CASE WHEN n_prior < 8 THEN 'SKIP' ELSE {result} END", f"CASE WHEN n_prior < 8 THEN {why} ELSE {detail} END"
        rows.append(f"SELECT package_id, version, version_id, {place}::BIGINT AS place, '{name}' AS gate, {result} AS result, {detail} AS detail FROM f")
    return {
        "g": " UNION ALL ".join(rows),
        "run": "SELECT *, CASE WHEN bool_or(result = 'BLOCK') OVER w THEN 'BLOCK' WHEN bool_or(result = 'WARN') OVER w THEN 'WARN' ELSE 'ALLOW' END AS disposition FROM g WINDOW w AS (PARTITION BY package_id, version)",
        "rv": "SELECT package_id, version, any_value(disposition) AS disposition, list(detail ORDER BY place)[1] AS reason FROM run GROUP BY package_id, version",
        "rw": "SELECT package_id, version, disposition <> 'BLOCK' AS kept, disposition, CASE WHEN disposition <> 'ALLOW' THEN reason END AS reason FROM rv",
    }


_OBS = {"rel": adapters.releases_sql("duckdb"), "ob": adapters.observations_sql("duckdb"), "log": "SELECT package_id, version_id, obs, disposition FROM (SELECT *, lag(disposition) OVER (PARTITION BY package_id, version_id ORDER BY obs) AS b FROM ob) WHERE b IS NULL OR b <> disposition",
        "lt": "SELECT package_id, version_id, arg_max(disposition, obs) AS disposition, max(obs) AS obs FROM ob GROUP BY package_id, version_id"}


def _store(final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in _OBS.items()) + "\n" + final


_TAGS = {
    "bt": f"SELECT package_id, arg_max(version, {key('version')}) AS latest, arg_min(version, {key('version')}) AS old FROM rel GROUP BY package_id",
    "tags": "SELECT package_id, 'latest' AS tag, latest AS target FROM bt UNION ALL SELECT package_id, 'beta', latest FROM bt UNION ALL SELECT package_id, 'old', old FROM bt",
    "best": f"SELECT package_id, arg_max(version, {key('version')}) AS a, arg_max(version, {key('version')}) FILTER (NOT contains(version, '-')) AS r FROM rw WHERE kept GROUP BY package_id",
}
_VERSIONS = {"h0": adapters.history_sql("duckdb"), "vs": "SELECT DISTINCT version FROM h0 WHERE length(version) > 0"}


def _versions(final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in _VERSIONS.items()) + "\n" + final


def _in_range(tests: list[tuple[str, str]]) -> str:
    parsed = " AND ".join(f"{key('version')} {op} {key(repr(b))}" for op, b in tests)
    return f"CASE WHEN regexp_matches(trim(version), '{SEMVER}') THEN {parsed} ELSE {' AND '.join(f'version {op} {b!r}' for op, b in tests)} END"


_RANGES = {">=1.2.0 <2.0.0": [(">=", "1.2.0"), ("<", "2.0.0")], ">1.10.0-rc.1": [(">", "1.10.0-rc.1")], "=0.0.1": [("=", "0.0.1")], "<=1.5.3 >0.5.0": [("<=", "1.5.3"), (">", "0.5.0")]}

ORACLES: dict[str, str] = {
    "tenure_blocks": _C.sql("SELECT package_id, block_idx, identity, email, domain, provider, first_seen_in_package_ms, first_provenance_present, last_provenance_present, version_count, first_version, last_version, first_published_at_ms, last_published_at_ms, duration_ms FROM bl"),
    "transitions": _C.sql("SELECT package_id, from_index, from_identity, to_identity, at_version, at_published_at_ms, prior_tenure_versions, prior_tenure_duration_ms, gap_ms, is_overlap, prior_contribution_count, is_known, seen_before, new_domain, cell FROM tr"),
    "cell_histogram": _C.sql("SELECT cell, count(*) AS n, count(DISTINCT package_id) AS packages FROM tr GROUP BY cell"),
    "publisher_signals": _C.sql("SELECT * FROM sg"),
    "package_shape": _C.sql("SELECT * FROM sh"),
    "identity_profile": _C.sql("SELECT * FROM ip"),
    "provenance_streaks": _C.sql("SELECT package_id, rn, version, published_at_ms, email, major, prior_streak::BIGINT AS prior_streak, streak_after::BIGINT AS streak_after, baseline_established, provenance_regression, in_scope FROM pv"),
    "provenance_skipped": _C.sql("SELECT package_id, input_idx, CASE WHEN coalesce(length(version), 0) = 0 THEN 'missing or empty version' WHEN published_at_ms IS NULL THEN 'missing or non-integer published_at_ms' ELSE 'duplicate_version' END AS reason FROM h WHERE NOT EXISTS (SELECT 1 FROM pv0 WHERE pv0.package_id = h.package_id AND pv0.input_idx = h.input_idx)"),
    "baseline_carriers": _C.sql("SELECT package_id, version, identities, emails, any_machine, any_human FROM ca"),
    "provenance_rollup": _C.sql(f"""SELECT package_id, count(*) AS total_versions, count(*) FILTER (provenance_present) AS attested_versions, max(streak_after)::BIGINT AS max_consecutive_attested, arg_max(streak_after, rn) >= 3 AS has_baseline_at_head, count(*) FILTER (provenance_regression) AS regression_count,
  count(*) FILTER (provenance_present AND email = '{MACHINE_EMAIL}') AS machine_attested_versions, count(*) FILTER (provenance_present AND email <> '{MACHINE_EMAIL}') AS human_attested_versions, arg_min(version, rn) FILTER (provenance_present) AS first_attested_version,
  arg_min(version, rn) FILTER (streak_after >= 3) AS first_baseline_reached_at, coalesce(string_agg(version, ',' ORDER BY rn) FILTER (provenance_regression), '') AS regression_versions FROM pv GROUP BY package_id"""),
    "provenance_per_major": _C.sql("SELECT package_id, major, count(*) AS total_versions, count(*) FILTER (provenance_present) AS attested_versions, max(streak_after)::BIGINT AS max_consecutive_attested, arg_min(version, rn) FILTER (streak_after >= 3) AS baseline_reached_at, coalesce(string_agg(version, ',' ORDER BY rn) FILTER (provenance_regression), '') AS regression_versions FROM pv GROUP BY package_id, major"),
    "transition_verdicts": _C.sql("SELECT package_id, from_index, at_version, array_to_string(cs, '; ') AS co_signals, disposition, reason FROM j", full=False),
    "disposition_single": _C.sql("SELECT * FROM dp", full=False),
    "regression_escalators": _C.sql("SELECT package_id, version, array_to_string(escalators, ',') AS escalators FROM es"),
    "verdicts_full": _C.sql("SELECT * FROM vd", full=True),
    "disposition_full": _C.sql("SELECT * FROM dp", full=True),
    **{"gate_" + n.replace("-", "_"): _gates(f"SELECT package_id, version, {r} AS result, {d} AS detail FROM f") for n, (r, d) in _GATES.items()},
    "gate_runner": _gates("SELECT package_id, version, disposition, place, gate, result, detail FROM run", _runner()),
    "gate_runner_with_overrides": _gates("SELECT package_id, version, disposition, place, gate, result, detail FROM run WHERE version_id % 19 <> 0 UNION ALL SELECT package_id, version, 'ALLOW', 0, 'override', 'ALLOW', 'override: ' || CASE WHEN version_id % 2 = 0 THEN 'ticket ' || version_id ELSE '(no reason)' END FROM rel WHERE version_id % 19 = 0", _runner()),
    "gate_runner_without_cache": _gates("SELECT disposition, count(*) AS n FROM rv GROUP BY disposition", _runner()),
    "decision_log_changes": _store("SELECT * FROM log"),
    "latest_decision": _store("SELECT package_id, version_id, arg_max(disposition, obs) AS disposition, max(obs) AS obs FROM log GROUP BY package_id, version_id"),
    "decision_stats": _store("SELECT count(*) AS total, count(*) FILTER (disposition = 'ALLOW') AS allow, count(*) FILTER (disposition = 'WARN') AS warn, count(*) FILTER (disposition = 'BLOCK') AS block FROM log"),
    "recent_decisions": _store("SELECT * FROM log ORDER BY obs DESC, version_id DESC LIMIT 5"),
    "effective_decisions": _store("SELECT package_id, version_id, CASE WHEN version_id % 19 = 0 THEN 'ALLOW' ELSE disposition END AS disposition, version_id % 19 = 0 AS overridden FROM lt"),
    "tarball_denials": _store("SELECT * FROM lt WHERE disposition = 'BLOCK' AND version_id % 19 <> 0"),
    "package_history": _store("SELECT r.package_id, r.version_id, r.version, r.published_at, r.place, lt.disposition FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY published_at DESC NULLS LAST, version_id DESC) AS place FROM rel) r LEFT JOIN lt ON r.package_id = lt.package_id AND r.version_id = lt.version_id WHERE r.place <= 20"),
    "store_counts": _store("SELECT count(DISTINCT package_id) AS packages, count(*) AS versions, count(integrity_hash) AS hashed FROM rel"),
    "store_append_new": _store("SELECT package_id, version_id, version FROM rel WHERE version_id % 2 = 0 AND version_id % 3 = 0"),
    "override_upsert": _store("SELECT package_id, version_id, version, CASE WHEN version_id % 38 = 0 OR version_id % 57 = 0 THEN 'changed' WHEN version_id % 2 = 0 THEN 'ticket ' || version_id END AS reason FROM rel WHERE version_id % 19 = 0"),
    "dep_lookup": f"WITH deps AS ({adapters.deps_sql()}), cache AS ({adapters.dep_cache_sql('duckdb')}) SELECT d.version_id, d.dep, c.status <> 'error' OR {NOW} - c.fetched_at_ms < 300000 AS hit, c.status, CASE WHEN c.status = 'ok' THEN c.first_publish_ms END AS first_publish_ms FROM deps d JOIN cache c ON d.dep = c.dep",
    "dep_cache_update": f"WITH cache AS ({adapters.dep_cache_sql('duckdb')}) SELECT dep, CASE WHEN dep IN ('supp-1', 'supp-5') THEN 'ok' ELSE status END AS status, first_publish_ms, CASE WHEN dep IN ('supp-1', 'supp-5') THEN {NOW} ELSE fetched_at_ms END AS fetched_at_ms, CASE dep WHEN 'supp-1' THEN 1 WHEN 'supp-5' THEN 3 ELSE 2 END AS attempts FROM cache",
    "packument_flatten": _gates("""SELECT r.package_name, r.version, r.published_at, r.integrity_hash, r.content_hash, '  dev ' AS publisher_name, r.publisher_email, coalesce(r.provenance_present, false) AS provenance_present, CASE WHEN r.provenance_present THEN 'oidc' ELSE 'unknown' END AS publish_method,
  coalesce(d.deps, '') AS deps, coalesce(scr.has_script, false) AS has_script, r.package_name || '-' || r.version || '.tgz' AS filename FROM rel r LEFT JOIN (SELECT version_id, string_agg(dep, ',' ORDER BY dep) AS deps FROM deps GROUP BY version_id) d ON r.version_id = d.version_id LEFT JOIN scr ON r.version_id = scr.version_id"""),
    "packument_first_publish": _gates("SELECT package_name AS dep, min(epoch_ms(published_at::TIMESTAMP)) AS first_publish_ms FROM rel GROUP BY package_name"),
    "rewrite_versions": _gates("SELECT * FROM rw", _runner()),
    "rewrite_dist_tags": _gates("SELECT t.package_id, t.tag, t.target, CASE WHEN rw.kept THEN t.target WHEN t.tag = 'latest' THEN best.r ELSE best.a END AS new_target FROM tags t JOIN rw ON t.package_id = rw.package_id AND t.target = rw.version LEFT JOIN best ON t.package_id = best.package_id", _runner() | _TAGS),
    "label_filter": _C.sql("SELECT label_id, package_id, version_id, affected_range FROM lab", more=_TARGETS),
    "label_targets": _C.sql("SELECT label_id, package_id, version, kind, place FROM tg", more=_TARGETS),
    "label_attribution": _C.sql("SELECT * FROM att", full=True, results=True, more=_ATTRIBUTION),
    "package_results": _C.sql("SELECT * FROM res", full=True, results=True),
    "confusion_matrix": _C.sql(_confusion("(SELECT *, CASE WHEN package_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM res)", "split"), full=True, results=True),
    "lag_quartiles": _C.sql("SELECT count(*) AS n, min(detection_lag_days)::BIGINT AS lowest, quantile_disc(detection_lag_days, 0.25)::BIGINT AS q1, quantile_disc(detection_lag_days, 0.5)::BIGINT AS median, quantile_disc(detection_lag_days, 0.75)::BIGINT AS q3, max(detection_lag_days)::BIGINT AS highest FROM att WHERE detected AND detection_lag_days IS NOT NULL", full=True, results=True, more=_ATTRIBUTION),
    "sensitivity_grid": Chain(_grid(_SENSITIVE)).sql(_confusion("res", "grid_id, w, kc, mvv, cw, sd").replace("SELECT *,", f"SELECT * EXCLUDE (grid_id, w, kc, mvv, cw, sd), {_GRID_COLUMNS},", 1), full=True, results=True),
    "calibration_best": Chain(_grid(_CALIBRATE)).sql("SELECT * FROM (" + _confusion("res", "grid_id, w, kc, mvv, cw, sd").replace("SELECT *,", f"SELECT * EXCLUDE (grid_id, w, kc, mvv, cw, sd), {_GRID_COLUMNS},", 1) + ") ORDER BY (false_positive_rate <= 0.05) DESC, CASE WHEN false_positive_rate <= 0.05 THEN -recall ELSE false_positive_rate END, false_positive_rate, recall DESC, p_min_verified_versions, p_solo_dominance LIMIT 1", full=True, results=True),
    "split_checks": _versions("""SELECT problem, package_id FROM (SELECT DISTINCT package_id FROM h0) p, LATERAL (SELECT unnest(['in both', 'train not in corpus', 'test not in corpus', 'held out but in train', 'held out but not in test']) AS problem) q
WHERE CASE problem WHEN 'in both' THEN (package_id % 5 <> 0 OR package_id % 35 = 0) AND package_id % 5 = 0 WHEN 'train not in corpus' THEN (package_id % 5 <> 0 OR package_id % 35 = 0) AND package_id % 11 = 3 WHEN 'test not in corpus' THEN package_id % 5 = 0 AND package_id % 11 = 3
  WHEN 'held out but in train' THEN package_id % 14 = 0 AND (package_id % 5 <> 0 OR package_id % 35 = 0) ELSE package_id % 14 = 0 AND package_id % 5 <> 0 END"""),
    "semver_order": _versions(f"SELECT version, {key('version')} AS sort_key, {major('version')} AS major FROM vs"),
    "range_match": _versions(" UNION ALL ".join(f"SELECT version, '{r}' AS range FROM vs WHERE {_in_range(t)}" for r, t in _RANGES.items())),
}

_FULL_NAME = "CASE WHEN version_id % 3 = 2 THEN package_name ELSE '@acme/' || package_name END"
ORACLES |= {
    "request_routes": _store(f"""SELECT version_id, CASE WHEN version_id % 5 IN (0, 2) THEN 'unknown' WHEN version_id % 5 = 1 THEN 'packument' ELSE 'tarball' END AS kind, CASE WHEN version_id % 5 NOT IN (0, 2) THEN {_FULL_NAME} END AS name,
  CASE WHEN version_id % 5 > 2 THEN package_name || '-' || version || '.tgz' END AS filename, CASE WHEN version_id % 5 > 2 THEN version END AS version FROM rel"""),
    "check_targets": _store("""SELECT target, CASE WHEN NOT seen THEN 'UNKNOWN' ELSE disposition END AS disposition, seen AND overridden AS overridden, CASE WHEN NOT seen THEN 4 WHEN disposition = 'ALLOW' THEN 0 WHEN disposition = 'WARN' THEN 2 ELSE 3 END AS exit_code FROM (
  SELECT r.package_name || '@' || CASE WHEN r.version_id % 4 = 1 THEN '9.9.9' ELSE r.version END AS target, r.version_id % 4 = 0 AS seen, r.version_id % 19 = 0 AS overridden, CASE WHEN r.version_id % 19 = 0 THEN 'ALLOW' ELSE lt.disposition END AS disposition
  FROM rel r JOIN lt ON r.package_id = lt.package_id AND r.version_id = lt.version_id WHERE r.version_id % 4 < 2)"""),
    "store_status": _store("SELECT count(*) AS decisions, count(*) FILTER (disposition = 'ALLOW') AS allow, count(*) FILTER (disposition = 'WARN') AS warn, count(*) FILTER (disposition = 'BLOCK') AS block, (SELECT count(DISTINCT package_id) FROM rel) AS packages, (SELECT count(*) FROM rel) AS versions, (SELECT count(*) FROM rel WHERE version_id % 19 = 0) AS overrides FROM log"),
    "split_parts": _versions("""SELECT package_id, package_id % 13 = 0 AS attack, CASE WHEN package_id % 26 = 0 OR r <= CASE WHEN package_id % 13 = 0 THEN 1 ELSE 4 END THEN 'test' ELSE 'train' END AS part FROM (
  SELECT package_id, CASE WHEN package_id % 26 = 0 OR package_id = 13 THEN 1000000 ELSE row_number() OVER (PARTITION BY package_id % 13 = 0, package_id % 26 = 0 OR package_id = 13 ORDER BY md5('20260422-' || package_id), package_id) END AS r FROM (SELECT DISTINCT package_id FROM h0))"""),
}
