"""Toxicity by class-conditional Kneser-Ney models.

For each class a character model of order 6 inside words is counted on labelled documents. The
orders from three up are class-conditional, the lower ones pool both classes, so a rare expression
is smoothed through shared counts and carries no evidence unless its own characters do. A word's
evidence is the difference of its toxic and ordinary log-likelihoods; a document's is normalised by
length, over the whole text and over its densest stretch of 40 words. A logistic calibration, fitted
on documents that the counted folds leave out, turns these into a probability.

The models are fitted on a bounded sample of labelled rows (`Limits`); the label table is read
whole to draw it, and only the drawn documents reach the training task. Documents with the same whole
sequence of words in the same class count once. Every document is scored whole, where it is read, from
one table of n-gram log-ratios whose size the sample bounds.

Defined cases: null and empty texts have no words and get the calibrated prior; a null label or a
null id takes no part in fitting, nor does an id with both labels; of several rows with one id the
text with the least hash is trained on; without labels of both classes the score is the share of toxic
labels, or 0.5 without labels; repeated rows get the same score; other columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import mix, slices, text_bytes, word_hashes, words

ORDER, SHARED, DISCOUNT, STRETCH = 6, 2, 0.95, 40
#: Levels of evidence at which words are counted.
LEVELS = (1.5, 2.5, 3.5, 5.0)
_EDGE, _END, _SYMBOLS = 256, 257, 258
_COEFFICIENTS = mix(np.arange(11, 11 + ORDER, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Bytes that end a word: ASCII other than letters and digits.
_GAPS = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


@dataclass(frozen=True)
class Limits:
    """Bound of the labelled sample: documents of each class, each with its whole text."""

    per_class: int = 2500
    folds: int = 3


def _grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` symbols that end at each position."""
    h = np.full(len(symbols), order * 0x51ED2701, np.uint64)
    for d in range(order):
        h[d:] += (symbols[: len(symbols) - d].astype(np.uint64) + np.uint64(1)) * _COEFFICIENTS[d]
    return mix(h)


def _spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given words one after the other, each behind order-1 edges and before an end; word of each position; predicted positions."""
    sizes = ends - starts
    spans = sizes + ORDER
    first = np.cumsum(spans) - spans
    word = np.repeat(np.arange(len(sizes)), spans)
    inner = np.arange(len(word)) - first[word] - (ORDER - 1)
    symbols = np.full(len(word), _EDGE, np.int32)
    body = (inner >= 0) & (inner < sizes[word])
    symbols[body] = data[starts[word[body]] + inner[body]]
    symbols[inner == sizes[word]] = _END
    return symbols, word, inner >= 0


class Ratios:
    """Lookup of n-gram log-ratios: the longest known n-gram that ends at a position counts."""

    BITS = 20

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray]):
        self.keys, self.values, self.slots = [], [], []
        for k, v in zip(keys, values):
            order = np.argsort(k)
            self.keys.append(k[order])
            self.values.append(v[order].astype(np.float32))
            seen = np.zeros(1 << self.BITS, bool)
            seen[k >> np.uint64(64 - self.BITS)] = True
            self.slots.append(seen)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Evidence of each word."""
        if not len(starts):
            return np.zeros(0)
        symbols, word, predicted = _spell(data, starts, ends)
        out, open_ = np.zeros(len(symbols), np.float32), predicted.copy()
        for n in range(ORDER, SHARED, -1):
            keys, values, seen = self.keys[n - SHARED - 1], self.values[n - SHARED - 1], self.slots[n - SHARED - 1]
            if not len(keys):
                continue
            h = _grams(symbols, n)
            at = np.flatnonzero(open_ & seen[h >> np.uint64(64 - self.BITS)])
            slot = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            same = keys[slot] == h[at]
            out[at[same]] = values[slot[same]]
            open_[at[same]] = False
        return np.bincount(word, out, len(starts))


class _Counts:
    """n-grams of the sample's distinct words, counted per class and fold."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray):
        symbols, word, predicted = _spell(data, starts, ends)
        self.weights = weights  # [2 * folds, words]
        at = np.flatnonzero(predicted)
        self.levels = []
        self.word = word[at]
        for n in range(1, ORDER + 1):
            h = _grams(symbols, n)
            keys, first, ids = np.unique(h[at], return_index=True, return_inverse=True)
            context = np.unique(_grams(symbols, n - 1)[at[first] - 1] if n > 1 else np.zeros(len(first), np.uint64), return_inverse=True)[1]
            edged = symbols[at[first] - n + 1] == _EDGE
            self.levels.append((keys, first, ids.astype(np.int32), context, edged))

    def ratios(self, folds: list[int], n_folds: int) -> Ratios:
        """The log-ratio of every n-gram above the shared orders, from the given folds."""
        weight = [sum(self.weights[y * n_folds + f] for f in folds)[self.word] for y in (0, 1)]
        raw = [[np.bincount(ids, w, len(keys)) for w in weight] for keys, _, ids, _, _ in self.levels]
        counts = []
        for n, (keys, _, ids, _, edged) in enumerate(self.levels, 1):
            if n == ORDER:
                counts.append(raw[-1])
                continue
            longer_first = self.levels[n][1]
            suffix = ids[longer_first]  # the n-gram that each longer one ends with
            kinds = [np.bincount(suffix, raw[n][y] > 0, len(keys)) for y in (0, 1)]
            counts.append([np.where(edged, raw[n - 1][y], kinds[y]) for y in (0, 1)])
        lower = [np.full(1, 1 / _SYMBOLS)] * 2
        below = [np.zeros(len(self.levels[0][0]), np.int64)] * 1
        keys_out, values_out = [], []
        for n, (keys, first, ids, context, _) in enumerate(self.levels, 1):
            own = counts[n - 1] if n > SHARED else [counts[n - 1][0] + counts[n - 1][1]] * 2
            parent = below[0] if n == 1 else self.levels[n - 2][2][first]
            p = []
            for y in (0, 1):
                total = np.bincount(context, own[y])[context]
                kinds = np.bincount(context, own[y] > 0)[context]
                base = lower[y][parent]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p.append(np.where(total > 0, np.maximum(own[y] - DISCOUNT, 0) / total + DISCOUNT * np.minimum(kinds, total / DISCOUNT) / total * base, base))
            lower = p
            if n > SHARED:
                ratio = np.log(np.maximum(p[1], 1e-12)) - np.log(np.maximum(p[0], 1e-12))
                live = raw[n - 1][0] + raw[n - 1][1] > 0
                keys_out.append(keys[live])
                values_out.append(ratio[live])
        return Ratios(keys_out, values_out)


def _features(column: pa.Array, ratios: Ratios) -> np.ndarray:
    """Per row: normalised evidence of the whole, of the densest stretch, of the strongest word (bounded), and how many words pass each level."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    starts, ends, first = words(data, offsets, _GAPS)
    out = np.zeros((len(column), 3 + len(LEVELS)))
    if not len(starts):
        return out
    _, one, same = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    evidence = ratios.words(data, starts[one], ends[one])[same]
    total = np.concatenate([[0], np.cumsum(evidence)])
    sizes = np.diff(first)
    rows = np.flatnonzero(sizes)
    lo, hi = first[:-1][rows], first[1:][rows]
    out[rows, 0] = (total[hi] - total[lo]) / sizes[rows]
    number = np.repeat(np.arange(len(rows)), sizes[rows])
    ends_at = np.minimum(np.arange(len(evidence)) + STRETCH, hi[number])
    begin = np.maximum(ends_at - STRETCH, lo[number])
    out[rows, 1] = np.maximum.reduceat((total[ends_at] - total[begin]) / np.maximum(ends_at - begin, STRETCH / 4), lo)
    out[rows, 2] = np.minimum(np.maximum.reduceat(evidence, lo), 2 * LEVELS[-1])
    for k, level in enumerate(LEVELS):
        strong = np.concatenate([[0], np.cumsum(evidence >= level)])
        out[rows, 3 + k] = np.log1p(strong[hi] - strong[lo])
    return out


def _distinct(hashes: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows that are the first of their class with their whole sequence of words."""
    number = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    placed = [mix(hashes ^ mix(number.astype(np.uint64) * np.uint64(2 * lane + 1) + np.uint64(lane))) for lane in (1, 2)]
    keep, seen = np.zeros(len(y), bool), set()
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        digest = (int(y[r]), b - a, *(int(p[a:b].sum(dtype=np.uint64)) for p in placed))
        keep[r] = digest not in seen
        seen.add(digest)
    return keep


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton steps; centre, scale and coefficients (the last is the intercept)."""
    centre, scale = x.mean(0), x.std(0) + 1e-6
    a = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - penalty @ b
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, gradient)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, b


class Model:
    """The n-gram log-ratios and the calibration."""

    def __init__(self, ratios: Ratios | None, calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None, prior: float):
        self.ratios, self.calibration, self.prior = ratios, calibration, prior

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(column), self.prior)
        centre, scale, b = self.calibration
        z = (_features(column, self.ratios) - centre) / scale @ b[:-1] + b[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out_column(id_col: str, folds: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", held_out: int = 5) -> Model:
    """Fit on labelled rows outside the held-out fold, at most `limits.per_class` of each class."""
    known = labels.select(F.col(label_id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out_column("id", held_out))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("id", "y")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(None, None, prior)
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(limits.per_class) for y in (0, 1)]
    # At most 2 * per_class rows of two numbers.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "id")
    sample = rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()  # bounded by `limits`
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_train(rows, limits, prior))], pa.binary())], names=["model"])

    return pickle.loads(sample.select("id", "y", "text").repartition(1).mapInArrow(train, "model binary").first()["model"])


def _train(rows: pa.Table, limits: Limits, prior: float) -> Model:
    """The model from the sample's (id, y, text) rows."""
    rows = rows.sort_by("id").combine_chunks()
    y = rows["y"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return Model(None, None, prior)
    column = pa.concat_arrays(rows["text"].chunks)
    pieces, hashes, starts, ends, first, size = [], [], [], [], [0], 0
    for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0):
        data, offsets = text_bytes(pc.utf8_lower(part.column(0)))
        lo, hi, at = words(data, offsets, _GAPS)
        hashes.append(word_hashes(data, lo, hi))
        starts.append(lo + size)
        ends.append(hi + size)
        first += (at[1:] + first[-1]).tolist()
        pieces.append(data)
        size += len(data)
    data, hashes, starts, ends, first = np.concatenate(pieces), np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), np.array(first)
    _, one, same = np.unique(hashes, return_index=True, return_inverse=True)
    if not len(one):
        return Model(None, None, prior)
    unique = _distinct(hashes, first, y)
    fold = np.asarray(mix(rows["id"].to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(limits.folds), np.int64)
    # Each document counts a word once, and copies (the same words in the same order, in the same class) count as one document.
    row = np.repeat(np.arange(len(y)), np.diff(first))
    pairs = np.unique(row * len(one) + same)
    row, same = np.divmod(pairs[unique[pairs // len(one)]], len(one))
    cell = (y * limits.folds + fold)[row]
    weights = np.stack([np.bincount(same[cell == c], minlength=len(one)) for c in range(2 * limits.folds)]).astype(np.float32)
    counted = _Counts(data, starts[one], ends[one], weights)
    folds = list(range(limits.folds))
    x = np.zeros((len(y), 3 + len(LEVELS)))
    for f in folds:
        mine, ratios = np.flatnonzero(fold == f), counted.ratios([k for k in folds if k != f], limits.folds)
        parts = slices(pa.RecordBatch.from_arrays([column.take(pa.array(mine))], names=["text"]), 0)
        x[mine] = np.concatenate([_features(part.column(0), ratios) for part in parts]) if len(mine) else 0
    # The sample is balanced, the corpus is not: rows are weighted back to the labels' shares.
    weight = np.where(y == 1, prior / max(1e-9, (y == 1).mean()), (1 - prior) / max(1e-9, (y == 0).mean()))
    return Model(counted.ratios(folds, limits.folds), _logistic(x[unique], y[unique], weight[unique]), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                scores = shared.value.scores(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out_column(id_col, held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, whole and unchanged, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(shared.value.scores(part.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
