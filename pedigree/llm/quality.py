"""Quality classification by co-training two views.

The content view sees hashed character trigrams of the text, the metadata view only what a page says
about itself: source, language, length and layout (lines and their lengths). Each view is a logistic
model, fitted on a bounded sample of labelled documents. Over several rounds each scores all other
documents of the training part, and the ones of which it is most sure, in the classes' proportions, are
given to the other view as training rows; of equal texts one is given. The views are then calibrated
on labelled rows that neither was trained on, and the calibrated log-odds are combined by a third
logistic model, fitted on the same rows.

A round is one pass over the documents where they are read: each task keeps its few surest rows (ids
and scores), the surest of all are found by partial top-n, and only the given documents' features, which
have a fixed size, reach the training task. Texts are used whole and never leave their task.

Defined cases: null text is empty; null source, language or length are values of their own; rows with
a null id or label take no part in fitting, nor do ids with both labels; of several rows with one id
the one with the least hash is trained on; without labels of both classes the score is the share of
good labels, or 0.5 without labels; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import cut, mix, slices, text_bytes

TRIGRAMS, FACTS = 1 << 11, 256


@dataclass(frozen=True)
class Limits:
    """Bounds: labelled documents of each class that are trained on, documents that a view gives to the other in a round (a share of these); and the rounds."""

    per_class: int = 1500
    share: float = 0.05
    rounds: int = 3


def content(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed trigrams."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(column), TRIGRAMS), np.float32)
    if len(data) < 3:
        return out
    wide = data.astype(np.uint64)
    key = (mix(wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) >> np.uint64(64 - 11)).astype(np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    inside = row[:-2] == row[2:]
    counts = np.bincount(row[:-2][inside] * TRIGRAMS + key[inside], minlength=out.size).reshape(out.shape)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def facts(source: pa.Array, lang: pa.Array, chars: pa.Array, text: pa.Array) -> np.ndarray:
    """Hashed indicators of source, language, length, number of lines and their mean length."""
    data, offsets = text_bytes(text)
    lines = np.concatenate([[0], np.cumsum(data == 10)])[offsets]
    lines = np.diff(lines) + 1
    size = np.diff(offsets)
    out = np.zeros((len(source), FACTS), np.float32)
    for r, (s, g, n) in enumerate(zip(source.to_pylist(), lang.to_pylist(), chars.to_pylist())):
        length = -1 if n is None else int(2 * np.log2(max(n, 0) + 1))
        said = (f"s{s}", f"g{g}", f"n{length}", f"l{int(2 * np.log2(lines[r]))}", f"m{int(2 * np.log2(size[r] / lines[r] + 1))}", f"c{g}{length}")
        for fact in said:
            out[r, int(mix(np.array([zlib.crc32(fact.encode())], np.uint64))[0] % np.uint64(FACTS))] = 1
    return out


class Logistic:
    """Ridge logistic regression by accelerated gradient steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 300):
        weight = np.ones(len(y)) if weight is None else weight
        weight = (weight / weight.sum()).astype(np.float32)
        self.centre = x.mean(0)
        self.scale = 1 / (x.std(0) + 0.02)
        a = ((x - self.centre) * self.scale).astype(np.float32)
        rate = 4 / (np.linalg.norm(a, axis=1) ** 2 @ weight + 1)
        self.w, self.b = np.zeros(x.shape[1], np.float32), 0.0
        u, c, v, d = self.w, self.b, self.w, self.b
        for k in range(steps):
            error = (1 / (1 + np.exp(-np.clip(a @ v + d, -30, 30))) - y) * weight
            w, b = v - rate * (error @ a + ridge * v), d - rate * error.sum()
            v, d = w + k / (k + 3) * (w - u), b + k / (k + 3) * (b - c)
            u, c = w, b
        self.w, self.b = u * self.scale, float(c - (u * self.scale) @ self.centre)
        self.centre = self.scale = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w + self.b, -20, 20)


class Model:
    def __init__(self, views: tuple[Logistic, Logistic] | None, calibrated: list[tuple[float, float]], joint: tuple[float, ...], prior: float):
        self.views, self.calibrated, self.joint, self.prior = views, calibrated, joint, prior

    def scores(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: both views together, content, metadata."""
        if self.views is None:
            return (np.full(len(x), self.prior),) * 3
        each = [a * v.logits(f) + b for v, f, (a, b) in zip(self.views, (x, z), self.calibrated)]
        both = self.joint[0] * each[0] + self.joint[1] * each[1] + self.joint[2]
        return tuple(1 / (1 + np.exp(-np.clip(s, -30, 30))) for s in (both, *each))


def _small(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's logistic regression of a few columns; the last coefficient is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + 0.5 * np.eye(len(b)), a.T @ (weight * (y - p)) - 0.5 * b)
        b += np.clip(step, -3, 3)
    return b


def _parts(known: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labelled rows that the views are trained on, and those that calibrate them."""
    third = mix(ids[known].view(np.uint64)) % np.uint64(3) == 0
    train, check = known[~third], known[third]
    return (train, check) if len(set(y[check])) == 2 == len(set(y[train])) else (known, known)


def _train(rows: pa.Table, prior: float) -> Model:
    """The model from rows (id, y, view, x, z): labelled ones have no view, given ones the view that gets them."""
    rows = rows.sort_by([("view", "ascending"), ("id", "ascending")]).combine_chunks()
    ids, y, view = (rows[c].to_numpy().astype(np.int64) for c in ("id", "y", "view"))
    features = [np.frombuffer(b"".join(rows[c].to_pylist()), np.float16).reshape(len(rows), -1).astype(np.float32) for c in ("x", "z")]
    known = np.flatnonzero(view < 0)
    if len(known) < 4 or len(set(y[known])) < 2:
        return Model(None, [], (), prior)
    train, check = _parts(known, ids, y)
    views = []
    for k, f in enumerate(features):
        extra = np.flatnonzero(view == k)
        some = np.concatenate([train, extra])
        # Labels weigh more than what the other view says.
        views.append(Logistic(f[some], y[some], np.concatenate([np.ones(len(train)), np.full(len(extra), 0.3)])))
    weight = np.where(y[check] == 1, prior / max(1e-9, (y[check] == 1).mean()), (1 - prior) / max(1e-9, (y[check] == 0).mean()))
    calibrated = [tuple(_small(v.logits(f[check])[:, None], y[check], weight)) for v, f in zip(views, features)]
    each = np.column_stack([a * v.logits(f[check]) + b for v, f, (a, b) in zip(views, features, calibrated)])
    return Model((views[0], views[1]), calibrated, tuple(_small(each, y[check], weight)), prior)


def held_out_column(id_col: str, folds: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _source(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(chars_col).cast("long").alias("n_chars"))


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows (id, text, source, lang, n_chars, ...) some at a time, with their features in both views."""
    for batch in batches:
        for part in slices(batch, 1, 1 << 20):
            for k in range(0, part.num_rows, 500):
                p = part.slice(k, 500)
                yield p, content(p.column(1)), facts(p.column(2), p.column(3), p.column(4), p.column(1))


def _featured(source: DataFrame, picked: DataFrame) -> DataFrame:
    """(id, y, view, x, z) for the ids of `picked` (id, y, view), a bounded table: one row for each of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, x, z in _views(batches):
            packed = [pa.array([r.tobytes() for r in f.astype(np.float16)], pa.binary()) for f in (x, z)]
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(5), p.column(6), *packed], names=["id", "y", "view", "x", "z"])

    rows = source.join(F.broadcast(picked), "id")
    hashed = F.xxhash64("text", "source", "lang", "n_chars")
    one = rows.groupBy("id", "y", "view").agg(F.min_by(F.struct("text", "source", "lang", "n_chars"), hashed).alias("r"))
    return cut(one.select("id", "r.text", "r.source", "r.lang", "r.n_chars", "y", "view").mapInArrow(run, "id long, y int, view int, x binary, z binary"))


def _fitted(rows: DataFrame, prior: float) -> Model:
    """The model, trained in one task on the bounded rows."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)  # bounded by `Limits`, each row of a fixed size
        model = _train(pa.Table.from_batches(rows), prior) if rows else Model(None, [], (), prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(train, "model binary").first()
    return pickle.loads(found["model"]) if found else Model(None, [], (), prior)


def _surest(others: DataFrame, model: Model, given: list[dict[int, int]], n: tuple[int, int]) -> list[dict[int, int]]:
    """Per view the documents of the whole table that it is given next, with their labels: the other one's surest n[label] of each label."""
    shared = others.sparkSession.sparkContext.broadcast((model, given))  # a fixed size; the sample's numbers and a few more a round

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, given = shared.value
        best: dict[tuple[int, int], list[tuple[float, int, int]]] = {(k, y): [] for k in (0, 1) for y in (0, 1)}
        for p, x, z in _views(batches):
            ids, texts = p.column(0).to_pylist(), p.column(5).to_pylist()
            for k, f in enumerate((x, z)):
                s = model.views[k].logits(f)
                for y in (0, 1):
                    found = best[k, y]
                    sure = s if y else -s
                    floor = max(1.0, found[-1][0] if len(found) == n[y] else 1.0)
                    more = [(float(sure[r]), ids[r], texts[r]) for r in np.flatnonzero(sure >= floor).tolist() if ids[r] not in given[1 - k]]
                    if more:
                        found.extend(more)
                        found.sort(key=lambda t: (-t[0], t[1]))
                        seen: set[int] = set()
                        best[k, y] = [t for t in found if not (t[2] in seen or seen.add(t[2]))][: n[y]]
        rows = [(1 - k, y, *t) for (k, y), found in best.items() for t in found]
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["view", "y", "sure", "id", "digest"])

    found = cut(others.withColumn("digest", F.xxhash64("text", "source", "lang", "n_chars")).mapInArrow(run, "view int, y int, sure double, id long, digest long"))
    found = found.groupBy("view", "y", "digest").agg(F.max("sure").alias("sure"), F.min("id").alias("id"))
    out: list[dict[int, int]] = [{}, {}]
    for view in (0, 1):
        for y in (0, 1):
            for r in found.where((F.col("view") == view) & (F.col("y") == y)).orderBy(F.desc("sure"), "id").limit(n[y]).collect():
                out[view][r["id"]] = y
    return out


def fit(source: DataFrame, known: DataFrame, limits: Limits, held_out: int) -> Model:
    """The model from rows (id, text, source, lang, n_chars) and labels (id, y)."""
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out_column("id", held_out)).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("id", "y")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return Model(None, [], (), prior)
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(limits.per_class) for y in (0, 1)]
    # At most 2 * per_class rows of three numbers.
    rows = _featured(source, drawn[0].unionByName(drawn[1]).withColumn("view", F.lit(-1)))
    others = source.where(F.col("id").isNotNull() & ~held_out_column("id", held_out))
    sampled = dict.fromkeys(r["id"] for r in rows.select("id").collect())  # at most 2 * per_class numbers
    given: list[dict[int, int]] = [dict(sampled), dict(sampled)]
    n = max(2, int(limits.share * sum(min(c, limits.per_class) for c in counts.values())))
    good = min(n - 1, max(1, round(n * prior)))
    for _ in range(limits.rounds):
        model = _fitted(rows, prior)
        if model.views is None:
            return model
        more = _surest(others, model, given, (n - good, good))
        picked = [(i, y, view) for view in (0, 1) for i, y in more[view].items()]
        if not picked:
            return model
        for view in (0, 1):
            given[view] |= more[view]
        rows = rows.unionByName(_featured(source, source.sparkSession.createDataFrame(picked, "id long, y int, view int")))
    return _fitted(rows, prior)


def classify(
    docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", label_col: str = "quality", held_out: int = 5
) -> DataFrame:
    """One row per document: doc_id, held_out, score, content_score, metadata_score, predicted."""
    source = _source(docs, id_col, text_col, source_col, lang_col, chars_col)
    model = fit(source, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")), limits, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, x, z in _views(batches):
            scores = shared.value.scores(x, z)
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(5), *(pa.array(s.astype(np.float64)) for s in scores), pa.array((scores[0] >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "content_score", "metadata_score", "predicted"])

    return source.withColumn("held_out", held_out_column("id", held_out)).mapInArrow(run, "doc_id long, held_out boolean, score double, content_score double, metadata_score double, predicted int")
