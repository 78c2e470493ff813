"""Removal of repeated passages of at least `length` words, found by difference-cover anchors.

A difference cover modulo p holds, for every remainder r, two members that differ by r. So for any
two equal windows of `length` words there is an offset below p at which both positions are, modulo
p, in the cover, and from there `length - p + 1` words are still inside both windows. Hashing only
the short windows at cover positions (6 of 31) therefore meets every repeat.

1. Exact copies are set aside by the hash of the whole word sequence: in a copy everything is
   covered, and it adds no window that its first document lacks.
2. Anchors are counted by hash, with partial sums before the shuffle; those found in two different
   texts are joined back to their documents.
3. Only windows that hold such an anchor are extended to full windows, hashed with 96 bits and
   reduced to the smallest document of each; windows of later documents are joined back.
4. Every document gets the starts of its covered windows and drops the words under them.

Hot passages: both reductions have map-side partial aggregates and carry two numbers. In the
joins back, the few keys with very many rows are sent to the tasks and their rows are dealt out evenly.
No group is ever gathered.

Defined cases: null text has no words; a row with a null id is neither judged nor used against
others; documents with fewer than `length` words keep everything; rows with the same id do not
cover each other, and with different texts they are judged separately; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import Packing, hot_of, join_least, slices, text_bytes, window_hashes, word_hashes, words

#: A perfect difference set, {1, 5, 11, 24, 25, 27} modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


class _Slice:
    """Word hashes of a run of rows; `first[r]` is the number of row r's first word."""

    def __init__(self, column: pa.Array):
        self.data, offsets = text_bytes(column)
        self.starts, self.ends, self.first = words(self.data, offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.sizes = np.diff(self.first)

    def whole(self, rows: np.ndarray, lane: int) -> np.ndarray:
        return window_hashes(self.hashes, self.first[:-1][rows], self.sizes[rows], lane).view(np.int64)

    def within(self, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of every window of `length` words in the given rows."""
        sizes = np.maximum(self.sizes[rows] - length + 1, 0)
        return np.repeat(rows, sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _usable(s: _Slice, ids: pa.Array, length: int) -> np.ndarray:
    return np.flatnonzero((s.sizes >= length) & np.asarray(ids.is_valid()))


def _ids(ids: pa.Array) -> np.ndarray:
    return np.asarray(ids.fill_null(0))


def _summaries(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                s = _Slice(part.column(1))
                rows = _usable(s, part.column(0), length)
                yield pa.RecordBatch.from_arrays([pa.array(_ids(part.column(0))[rows]), pa.array(s.whole(rows, 0)), pa.array(s.whole(rows, 1))], names=["doc_id", "t", "u"])

    return run


def _anchors(length: int, placed: bool):
    short, cover = length - PERIOD + 1, np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                s = _Slice(part.column(1))
                rows = _usable(s, part.column(0), length)
                row, at = s.within(rows, short)
                keep = cover[at % PERIOD]
                row, at = row[keep], at[keep]
                columns = {"h": window_hashes(s.hashes, s.first[:-1][row] + at, short).view(np.int64)}
                if placed:
                    columns |= {"doc_id": _ids(part.column(0))[row], "pos": at.astype(np.int32)}
                else:
                    t = np.zeros(len(s.sizes), np.int64)
                    t[rows] = s.whole(rows, 0)
                    columns["t"] = (t >> 24)[row]  # 40 bits tell the texts of one anchor apart
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    return run


def _candidates(part: pa.RecordBatch, t: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the anchors found for the id of each row that is not a copy."""
    row, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    copies = part.column(3).to_pylist()
    for r, own in zip(rows.tolist(), t.tolist()):
        if own not in (copies[r] or ()):
            values = np.asarray(part.column(2)[r].values, np.int64)
            values = values[values < sizes[r]]  # another text with this id may be longer
            row.append(np.full(len(values), r))
            at.append(values)
    return np.concatenate(row), np.concatenate(at)


def _version(t: np.ndarray) -> np.ndarray:
    """Tells texts with the same id apart."""
    return (t >> 48).astype(np.int16)


def _covered(found: pa.Array, t: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the covered windows that were found for each row's own text."""
    row, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, own in zip(rows.tolist(), _version(t).tolist()):
        if found[r].is_valid:
            entries = found[r].values
            for k, version in enumerate(entries.field("v").to_pylist()):
                if own == version:
                    values = np.asarray(entries.field("pos")[k].values, np.int64)
                    row.append(np.full(len(values), r))
                    at.append(values)
    return np.concatenate(row), np.concatenate(at)


def _marks(n: int, row_first: np.ndarray, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Words (by number in the slice) from `before` ahead of each place to `after` behind it."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(row_first + at - before, row_first), 1)
    np.add.at(change, np.minimum(row_first + at + after, n), -1)
    return np.cumsum(change[:-1]) > 0


def _windows(length: int, unpack):
    reach = PERIOD - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p for piece in unpack(batch.filter(batch.column(2).is_valid())) for p in slices(piece, 1)):
                s = _Slice(part.column(1))
                rows = _usable(s, part.column(0), length)
                t = s.whole(rows, 0)
                row, at = _candidates(part, t, rows, s.sizes)
                marked = _marks(len(s.hashes), s.first[:-1][row], at, reach, 1)
                row, at = s.within(rows, length)
                number = s.first[:-1][row] + at
                keep = marked[number]
                row, at, number = row[keep], at[keep], number[keep]
                version = np.zeros(len(s.sizes), np.int16)
                version[rows] = _version(t)
                a, b = (window_hashes(s.hashes, number, length, lane).view(np.int64) for lane in (0, 1))
                columns = (a, (b >> 32).astype(np.int32), _ids(part.column(0))[row], version[row], at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "doc_id", "v", "pos"])

    return run


def _results(length: int, unpack):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p for piece in unpack(batch) for p in slices(piece, 1)):
                s = _Slice(part.column(1))
                rows = _usable(s, part.column(0), length)
                row, at = _covered(part.column(2), s.whole(rows, 0), rows)
                copies = at < 0  # a copy is marked by the position -1
                gone = _marks(len(s.hashes), s.first[:-1][row[~copies]], at[~copies], 0, length)
                for r in row[copies].tolist():
                    gone[s.first[r] : s.first[r + 1]] = True
                total = np.zeros(len(gone) + 1, np.int64)
                np.cumsum(gone, out=total[1:])
                removed = total[s.first[1:]] - total[s.first[:-1]]
                digests, kept = [], []
                for r in range(part.num_rows):
                    lo, hi = s.first[r], s.first[r + 1]
                    text = s.data[s.starts[lo] : s.ends[hi - 1]].tobytes().split() if hi > lo else []
                    if removed[r]:
                        text = [w for w, g in zip(text, gone[lo:hi].tolist()) if not g]
                    kept.append(b" ".join(text))
                    digests.append(hashlib.sha256(kept[-1]).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.sizes), pa.array(removed), pa.array(digests), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Removed is each word under a window of `length` words whose sequence starts also in a document
    with a smaller id.
    """
    if length < PERIOD:
        raise ValueError(f"length is at least {PERIOD}")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    whole = docs.mapInArrow(_summaries(length), "doc_id long, t long, u long")
    firsts = whole.groupBy("t", "u").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = join_least(whole, firsts, ["t", "u"], hot_of(firsts, "n", docs.count()), ["doc_id"]).where("doc_id > first").select("doc_id", "t").distinct()

    # A word and the gap behind it take two bytes at least: no more windows than this.
    bound = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 + 4000
    shared = docs.mapInArrow(_anchors(length, False), "h long, t long").groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("h", F.lit(True).alias("twice"))
    # Hot anchors are a hint, taken from a 64th of the documents; whatever it holds, the join gives the same rows.
    some = docs.where("doc_id is not null and pmod(xxhash64(doc_id), 64) = 0").mapInArrow(_anchors(length, False), "h long, t long").groupBy("h").agg(F.count("*").alias("n")).where("n > 4")
    hot = hot_of(some, "n", bound // 64).select("h").orderBy("h").limit(8000).join(shared, "h", "left")
    hits = join_least(docs.mapInArrow(_anchors(length, True), "h long, doc_id long, pos int"), shared, ["h"], hot, ["doc_id", "pos"]).where("twice").groupBy("doc_id").agg(F.collect_set("pos").alias("pos"))
    hits = hits.join(copies.groupBy("doc_id").agg(F.collect_list("t").alias("copies")), "doc_id", "left")

    # Left joins keep the documents' side the same in both places, so that it is shuffled once.
    packing = Packing(docs)
    packed, unpack = packing.pack(), packing.opener()
    windows = packed.join(hits, "doc_id", "left").select("doc_id", "packed", "pos", "copies").mapInArrow(_windows(length, unpack), "a long, b int, doc_id long, v short, pos int")
    least = windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    covered = join_least(windows, least, ["a", "b"], hot_of(least, "n", bound), ["doc_id", "pos"]).where("doc_id > first").groupBy("doc_id", "v").agg(F.collect_set("pos").alias("pos"))
    whole_copies = copies.select("doc_id", F.shiftright("t", 48).cast("short").alias("v"), F.array(F.lit(-1)).alias("pos"))
    covered = covered.unionByName(whole_copies).groupBy("doc_id").agg(F.collect_list(F.struct("v", "pos")).alias("found"))
    return packed.join(covered, "doc_id", "left").select("doc_id", "packed", "found").mapInArrow(_results(length, unpack), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def oracle(length: int = 50) -> str:
    """The digest columns in DuckDB SQL, by comparing all windows."""
    return rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {length - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {length - 2})) AS i FROM w WHERE len(ws) >= {length})),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + o AS k FROM (SELECT p.doc_id, p.i, unnest(range(0, {length})) AS o FROM p JOIN f USING (h) WHERE p.doc_id > f.first)),
g AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id),
x AS (SELECT w.doc_id, w.ws, coalesce(g.gone, []) AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM x
"""
