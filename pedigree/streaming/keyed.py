"""Observation with keyed state: histories, last decisions and lookups live in the engine's state store.

`observe` reads the store's tables in every micro-batch; here each package's baselines are state of its key, so a
batch costs what comes in, and a restart goes on from the checkpoint. Three processors:

* `Histories`, by package: releases by version, dependencies with the number of releases that have them, and the two
  newest releases (of all and of the attested ones). It emits what the gates look at, as the store was before the batch.
* `Decisions`, by package: the last disposition of every version. It emits a first decision and changes.
* `Lookups`, by dependency: what is known, names that are being asked, and failures, which expire after a while
  (time to live of the state), as does a question without an answer. It emits names to fetch and answers.

The gates themselves are the expressions of `operators.gates`, between the first two. There is no watermark; a late
release takes its place in the history. State needs a provider with map state and time to live (`use_state_store`).
Rows of one package in a batch are those of its document, which is what a task holds of it at a time; of two rows with one version the
one with the greatest digest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pedigree.operators import gates, projection
from pedigree.params import Params

_RELEASE = "published_at string, version_id long, publisher_email string, attested boolean, integrity_hash string, content_hash string, deps array<string>"
_HEAD = "n long, n_attested long, newest array<struct<published_at:string,version_id:long,version:string,publisher_email:string>>, attested array<struct<published_at:string,version_id:long,version:string,publisher_email:string>>"
INCOMING = "package_id long, package_name string, version string, version_id long, published_at string, publisher_email string, provenance_present boolean, integrity_hash string, content_hash string, deps array<string>, has_script boolean"
FACTS = INCOMING + ", has_baseline boolean, base_integrity string, base_content string, n_prior long, n_prior_attested long, latest_prior struct<version:string,publisher_email:string>, latest_attested string, n_deps long, new_deps array<string>"
DECIDED = "package_id long, version string, disposition string, results array<struct<gate:string,result:string,detail:string>>"


def _named(schema: str) -> Row:
    return Row(*[c.split()[0] for c in schema.split(", ")])


_FACT, _DECISION, _PRIOR, _GATE = _named(FACTS), _named(DECIDED), Row("version", "publisher_email"), Row("gate", "result", "detail")
FIRST_SEEN = _GATE("first-seen", "SKIP", "first observation: baseline recorded")


def use_state_store(spark: SparkSession) -> SparkSession:
    """Let streaming queries of the session keep map state and time to live."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def incoming(documents: DataFrame, column: str = "document") -> DataFrame:
    """The releases of registry documents, as far as the gates ask."""
    rows = projection.project(documents, column)
    deps = F.coalesce(F.json_object_keys("dependencies"), F.array().cast("array<string>"))
    return rows.select(
        F.xxhash64("package_name").alias("package_id"), "package_name", "version", F.xxhash64("package_name", "version").alias("version_id"), "published_at", "publisher_email",
        "provenance_present", "integrity_hash", "content_hash", deps.alias("deps"), F.col("has_install_scripts").alias("has_script"),
    )


def _rank(head: tuple) -> tuple:
    return head[0] is not None, head[0] or "", head[1]


def _values(struct, *names: str) -> tuple:
    """The fields of a struct, which is a Row in state and a dict in rows."""
    return tuple(struct[n] for n in names)


class Histories(StatefulProcessor):
    """Facts about incoming releases; the first row of a version becomes its baseline."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.releases = handle.getMapState("releases", "version string", _RELEASE)
        self.deps = handle.getMapState("deps", "dep string", "n long")
        self.head = handle.getValueState("head", _HEAD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        versions: dict[str, Row] = {}
        for row in rows:
            held = versions.get(row.version)
            if held is None or repr(row) > repr(held):
                versions[row.version] = row
        n, n_attested, newest, attested = self.head.get() if self.head.exists() else (0, 0, [], [])
        newest, attested = ([_values(x, "published_at", "version_id", "version", "publisher_email") for x in heads or []] for heads in (newest, attested))
        fresh = []
        for row in versions.values():
            stored = self.releases.getValue((row.version,)) if self.releases.containsKey((row.version,)) else None
            deps = sorted(set(row.deps or []))
            own = set(stored[6] or []) if stored else set()
            new = [d for d in deps if self._held(d) - (d in own) == 0]
            prior = next((x for x in newest if x[2] != row.version), None)
            proven = next((x for x in attested if x[2] != row.version), None)
            yield _FACT(
                *row, stored is not None or None, stored[4] if stored else None, stored[5] if stored else None, n - (stored is not None), n_attested - bool(stored and stored[3]),
                _PRIOR(prior[2], prior[3]) if prior else None, proven[2] if proven else None, len(deps), new,
            )
            if stored is None:
                fresh.append(row)
        for row in fresh:
            held = bool(row.provenance_present)
            self.releases.updateValue((row.version,), (row.published_at, row.version_id, row.publisher_email, held, row.integrity_hash, row.content_hash, list(row.deps or [])))
            for dep in set(row.deps or []):
                self.deps.updateValue((dep,), (self._held(dep) + 1,))
            told = (row.published_at, row.version_id, row.version, row.publisher_email)
            n, newest = n + 1, sorted([*newest, told], key=_rank, reverse=True)[:2]
            if held:
                n_attested, attested = n_attested + 1, sorted([*attested, told], key=_rank, reverse=True)[:2]
        if fresh:
            self.head.update((n, n_attested, newest, attested))

    def _held(self, dep: str) -> int:
        return self.deps.getValue((dep,))[0] if self.deps.containsKey((dep,)) else 0

    def close(self) -> None:
        pass


class Decisions(StatefulProcessor):
    """First decisions and those that differ from the last one of their version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "version string", "disposition string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            before = self.last.getValue((row.version,))[0] if self.last.containsKey((row.version,)) else None
            if before != row.disposition:
                self.last.updateValue((row.version,), (row.disposition,))
                results = [_GATE(*_values(x, "gate", "result", "detail")) for x in row.results]
                yield _DECISION(row.package_id, row.version, row.disposition, results if row.known else [FIRST_SEEN, *results])

    def close(self) -> None:
        pass


def _by(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    return df.groupBy(key).transformWithState(processor, StructType.fromDDL(schema), "Append", time)


def decisions(documents: DataFrame, now_ms: int, overrides: DataFrame | None = None, p: Params = Params(), known: dict[str, gates.Gate] | None = None) -> DataFrame:
    """The decisions to be logged of a stream of documents: package_id, version, disposition, results.

    `overrides` (package_id, version, reason) is read once, when the query starts. Dependencies are not looked up
    here: `scope-boundary` says so, as it does without a cache.
    """
    facts = _by(incoming(documents), "package_id", Histories(), FACTS)
    prepared = facts.withColumns({"now_ms": F.lit(now_ms), "fresh_dep": F.lit(None).cast("struct<dep:string,age_hours:bigint>"), "can_look_up": F.lit(False)})
    judged = gates.run_gates(prepared, overrides, p, known, keep=("has_baseline",)).withColumn("known", F.coalesce("has_baseline", F.lit(False)))
    return _by(judged.select("package_id", "version", "disposition", "results", "known"), "package_id", Decisions(), DECIDED)


WANTED = "dep string, code int, first_publish_ms long"
TOLD = "dep string, kind string, status string, first_publish_ms long"
_TOLD = _named(TOLD)


class Lookups(StatefulProcessor):
    """Questions (code null) and answers about dependencies; times to live in milliseconds."""

    def __init__(self, error_ttl_ms: int, patience_ms: int):
        self.error_ttl_ms, self.patience_ms = error_ttl_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.found = handle.getValueState("found", "status string, first_publish_ms long")
        self.failed = handle.getValueState("failed", "n int", self.error_ttl_ms)
        self.asked = handle.getValueState("asked", "n int", self.patience_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r.code is None, r.code != 200, r.code != 404))  # answers first, the best of them counts
        answered = False
        for row in rows:
            if row.code is not None:
                if answered:
                    continue
                answered = True
                status = "vanished" if row.code == 404 else "ok" if row.code == 200 and row.first_publish_ms is not None else "error"
                self.asked.clear()
                if status == "error":
                    self.failed.update((1,))
                else:
                    self.failed.clear()
                    self.found.update((status, row.first_publish_ms if status == "ok" else None))
                yield _TOLD(key[0], "known", status, row.first_publish_ms if status == "ok" else None)
            elif not (self.found.exists() or self.failed.exists() or self.asked.exists()):
                self.asked.update((1,))
                yield _TOLD(key[0], "fetch", None, None)

    def close(self) -> None:
        pass


def lookups(rows: DataFrame, p: Params = Params(), patience_ms: int = 60_000) -> DataFrame:
    """(dep, kind, status, first_publish_ms) from a stream of questions and answers (`WANTED`): `fetch` what is to be asked, `known` what was answered.

    A name is asked once, again when its failure or an unanswered question has expired.
    """
    return _by(rows.where("dep <> ''"), "dep", Lookups(int(p.error_ttl_ms), patience_ms), TOLD, "ProcessingTime")
