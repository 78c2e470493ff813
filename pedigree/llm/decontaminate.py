"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs in a document with at most k edits shares at least
m - q + 1 - k*q q-grams with it, all of them close to one diagonal (document position minus passage
position). The q-grams of the benchmark are looked up in every document; the hits are counted in
overlapping diagonal bands, twice as wide as they are far apart, so that every occurrence lies
whole in one band; bands that meet the bound are verified by an alignment in the band's diagonals.

A q-gram that very many passages share is left out of the counts of those passages whose other q-grams
still give a bound (smaller by the number left out, so nothing is lost), and hits are expanded and
counted a bounded number at a time.

The hits of a text lie at its own positions, so a passage at a text's end, cut off there or not, has its band like
any other. Bands that meet the bound are aligned together, one row of all of them at a time, and leave as soon
as their edits exceed the budget: passages that share an opening cost little more than the opening.

The benchmark is taken in blocks of about `block_chars` characters (a stated query set against all
rows), two at a time sent to the tasks; equal passages are one. Where these are all, the documents pass once and
are never shuffled. A larger benchmark reads the documents once for every two blocks and keeps only what is
found, by the digest of the text; that is joined to the documents in the end (in `clean` an anti-join, the only
copy of their texts).

Defined cases: repeated items and items with the same text are all told; text is compared in lower case with runs of white space as one space; a null or
empty document, and a null or empty passage, match nothing; passages shorter than q must occur as
they are; repeated rows are judged one by one; texts of any length are scanned whole; other columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import cut, powers, slices

_BASE = 0x9E3779B97F4A7C15
_BITS = 22
_SCHEMA = "doc_id long, contaminated boolean, n_items long, item_ids array<long>, best_distance long"


@dataclass(frozen=True)
class Filter:
    """Parameters: length of q-grams, edits per character of a passage, characters of a block of the benchmark, blocks held at once;
    passages from which on a q-gram is common, pairs of a hit and a passage that are counted in one go, and characters of bands
    that are aligned in one go."""

    q: int = 12
    edit_rate: float = 0.06
    block_chars: int = 4_000_000
    blocks_at_once: int = 2
    common: int = 64
    pairs_at_once: int = 1 << 20
    cells_at_once: int = 1 << 20


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().replace("\x00", " ").split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    up, down = powers(_BASE, len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93) * up[: len(points)], out=total[1:])
    h = (total[q:] - total[:-q]) * down[: len(points) - q + 1]
    return h ^ (h >> np.uint64(29))


class Passages:
    """A block of benchmark passages, ready for lookup."""

    def __init__(self, items: list[tuple[int, str]], how: Filter):
        self.how = how
        same: dict[str, list[int]] = {}
        for item, text in items:
            if text := normalise(text):
                same.setdefault(text, []).append(item)
        self.short = [(text, ids) for text, ids in same.items() if len(text) < how.q]
        self.texts = [text for text in same if len(text) >= how.q]
        self.ids = [same[text] for text in self.texts]
        self.sizes = sizes = np.array([len(t) for t in self.texts], np.int64)
        self.longest = int(sizes.max(initial=0))
        self.points = [_points(text) for text in self.texts]
        self.budget = np.minimum((how.edit_rate * sizes).astype(np.int64), np.maximum(0, (sizes - how.q) // how.q - 1))
        self.bounds = np.maximum(1, sizes - how.q + 1 - self.budget * how.q)
        grams = [_grams(points, how.q) for points in self.points]
        h = np.concatenate([np.zeros(0, np.uint64), *grams])
        item, place = np.repeat(np.arange(len(grams)), [len(g) for g in grams]), np.concatenate([np.zeros(0, np.int64), *map(np.arange, map(len, grams))])
        _, slot, times = np.unique(h, return_inverse=True, return_counts=True)
        common = times[slot] > how.common
        left = self.bounds - np.bincount(item[common], minlength=len(grams))
        spared = left >= np.maximum(1, self.bounds // 4)  # these passages do without their common grams
        self.bounds = np.where(spared, left, self.bounds)
        keep = ~(common & spared[item]) if len(item) else common
        h, item, place = h[keep], item[keep], place[keep]
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.grams >> np.uint64(64 - _BITS)] = True

    def _bands(self, at: np.ndarray, slot: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, band, passage) of the bands that meet the bound, most hits first, for hits of gram `slot` at position `at` of text `row`."""
        times = self.count[slot]
        total = np.cumsum(times)
        keys, counts, begin = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        items, least = len(self.ids), -self.longest - 2
        bands = (int(at.max()) if len(at) else 0) - least + 2
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + self.how.pairs_at_once, side="right")))
            some = times[begin:stop]
            nth = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            hit = np.repeat(self.first[slot[begin:stop]], some) + nth
            item = self.item[hit]
            band = (np.repeat(at[begin:stop], some) - self.place[hit]) // (self.budget[item] + 1) - least
            key = (np.repeat(row[begin:stop], some) * bands + band) * items + item
            keys, same = np.unique(np.concatenate([keys, key, key - items]), return_inverse=True)
            counts = np.bincount(same, np.concatenate([counts, np.ones(2 * len(item), np.int64)]), len(keys)).astype(np.int64)
            begin = stop
        keep = counts >= self.bounds[keys % items]
        keys = keys[keep][np.argsort(-counts[keep], kind="stable")]
        return keys // items // bands, keys // items % bands + least, keys % items

    def search(self, texts: list[str]) -> list[dict[int, int]]:
        """Per text the passages found, with the fewest edits."""
        found: list[dict[int, int]] = [{} for _ in texts]
        for row, text in enumerate(texts):
            for short, ids in self.short:
                if short in text:
                    found[row] |= dict.fromkeys(ids, 0)
        if not len(self.grams):
            return found
        points = _points("\x00".join(texts))
        h = _grams(points, self.how.q)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - _BITS)])
        slot = np.searchsorted(self.grams, h[at])
        slot[slot == len(self.grams)] = 0
        same = self.grams[slot] == h[at]
        at, slot = at[same], slot[same]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        row = np.searchsorted(starts, at, side="right") - 1
        rows, bands, numbers = self._bands(at - starts[row], slot, row)
        best = np.full(len(rows), -1)
        exact = np.zeros(0, np.int64)  # (text, passage) that occur as they are: no further band is aligned
        pair = rows * len(self.ids) + numbers
        cells = np.cumsum(self.sizes[numbers] + 3 * self.budget[numbers] + 2)
        begin = 0
        while begin < len(rows):
            stop = max(begin + 1, int(np.searchsorted(cells, (cells[begin - 1] if begin else 0) + self.how.cells_at_once, side="right")))
            some = np.arange(begin, stop)
            some = some[~np.isin(pair[some], exact)]
            best[some] = self._aligned(points, starts, rows[some], bands[some], numbers[some])
            exact = np.union1d(exact, pair[some][best[some] == 0])
            begin = stop
        for k in np.flatnonzero(best >= 0).tolist():
            of = found[rows[k]]
            for item in self.ids[numbers[k]]:
                of[item] = min(int(best[k]), of.get(item, int(best[k])))
        return found

    def _aligned(self, points: np.ndarray, starts: np.ndarray, rows: np.ndarray, bands: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The fewest edits of each passage within its band of diagonals, -1 beyond its budget."""
        k = self.budget[numbers]
        low, high = bands * (k + 1) - k, (bands + 2) * (k + 1) - 1 + k  # diagonals of an occurrence with its edits
        best = np.full(len(rows), -1)
        for width in np.unique(high - low + 1).tolist():  # a width is a budget
            some = np.flatnonzero(high - low + 1 == width)
            best[some] = within([self.points[n] for n in numbers[some].tolist()], points, starts[rows[some]], starts[rows[some] + 1] - 1, low[some], width, int(k[some[0]]))
        return best


def within(passages: list[np.ndarray], points: np.ndarray, begins: np.ndarray, ends: np.ndarray, low: np.ndarray, width: int, k: int) -> np.ndarray:
    """The fewest edits that turn each passage into some part of its text along the `width` diagonals (text position minus passage position) from `low`, -1 beyond k.

    Passage i is aligned with points[begins[i]:ends[i]]. Only the bands' cells are filled, for all passages together,
    one row of all of them at a time; a passage leaves as soon as it can't come back below its budget. Places
    outside a text match nothing, which costs what leaving out the passage's character does.
    """
    order = np.argsort([-len(p) for p in passages], kind="stable")
    sizes = np.array([len(passages[i]) for i in order], np.int64)
    letters = np.zeros((len(order), int(sizes.max(initial=0))), np.uint32)
    for i, of in enumerate(order.tolist()):
        letters[i, : sizes[i]] = passages[of]
    place = low[order, None] + np.arange(letters.shape[1] + width - 1)[None, :]
    inside = (place >= 0) & (place < (ends - begins)[order, None])
    region = np.where(inside, points[np.where(inside, place + begins[order, None], 0)] if len(points) else 0, 0xFFFFFFFF).astype(np.uint32)
    best = np.full(len(order), -1)
    left = np.arange(len(order))
    row = np.zeros((len(order), width), np.int32)  # free start
    steps = np.arange(width, dtype=np.int32)
    for i in range(letters.shape[1]):
        new = row + (region[:, i : i + width] != letters[:, i, None])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        new -= steps
        row = np.minimum.accumulate(new, axis=1) + steps
        whole = int(np.searchsorted(-sizes, -(i + 1), side="left")), int(np.searchsorted(-sizes, -(i + 1), side="right"))
        if whole[0] < whole[1]:  # the shortest ones are done
            least = row[whole[0] :].min(axis=1)
            best[left[whole[0] :]] = np.where(least <= k, least, -1)
        go_on = sizes > i + 1
        if i % 8 == 7:
            go_on &= row.min(axis=1) <= k
        if not go_on.all():
            row, region, letters, sizes, left = row[go_on], region[go_on], letters[go_on], sizes[go_on], left[go_on]
            if not len(left):
                break
    out = np.empty(len(order), np.int64)
    out[order] = best
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, how: Filter) -> Iterator[Passages]:
    """The benchmark in blocks of about `block_chars` characters."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // how.block_chars)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()  # bounded by block_chars on average
        yield Passages([(r["item"], r["text"]) for r in rows], how)


def _groups(benchmark: DataFrame, item_col: str, text_col: str, how: Filter) -> Iterator[list[Passages]]:
    """The blocks, as many together as are held at once."""
    held: list[Passages] = []
    for passages in _blocks(benchmark, item_col, text_col, how):
        held.append(passages)
        if len(held) == how.blocks_at_once:
            yield held
            held = []
    if held:
        yield held


def _searched(batch: pa.RecordBatch, index: int, blocks: list[Passages]) -> Iterator[tuple[pa.RecordBatch, list[dict[int, int]]]]:
    for part in slices(batch, index, 1 << 20):
        texts = [normalise(x.as_py()) for x in part.column(index)]
        found: list[dict[int, int]] = [{} for _ in texts]
        for passages in blocks:
            for old, new in zip(found, passages.search(texts)):
                for item, distance in new.items():
                    old[item] = min(distance, old.get(item, distance))
        yield part, found


_FOUND = pa.map_(pa.int64(), pa.int64())


def _told(rows: DataFrame, shared) -> DataFrame:
    """`rows` (a key, text) with the passages found in place of the text."""
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _searched(batch, 1, shared.value):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(f.items()) for f in found], _FOUND)], names=[key, "found"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, found map<bigint, bigint>")


def _hits(texts: DataFrame, groups: Iterator[list[Passages]]) -> DataFrame | None:
    """(digest, item, distance) of what is found in `texts` (digest, text), one checkpoint of these few rows a group of blocks."""
    hits = None
    for blocks in groups:
        shared = texts.sparkSession.sparkContext.broadcast(blocks)  # bounded by block_chars
        some = cut(_told(texts, shared).where(F.size("found") > 0).select("digest", F.explode("found").alias("item", "distance")).groupBy("digest", "item").agg(F.min("distance").alias("distance")))
        shared.destroy()
        hits = some if hits is None else hits.unionAll(some)
    return hits


def _first_two(groups: Iterator[list[Passages]]) -> tuple[list[list[Passages]], Iterator[list[Passages]]]:
    first = list(islice(groups, 2))
    return first, chain(first, groups)


def find(docs: DataFrame, benchmark: DataFrame, how: Filter = Filter(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: contaminated or not, the passages found (ascending) and the fewest edits among them."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first, groups = _first_two(_groups(benchmark, item_col, item_text_col, how))
    if len(first) < 2:
        out = _told(source, docs.sparkSession.sparkContext.broadcast(first[0] if first else []))
    else:
        keyed = source.select("doc_id", F.md5("text").alias("digest"), "text")
        hits = _hits(keyed.select("digest", "text"), groups)
        hits = hits.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("item", "distance"))).alias("found"))
        out = keyed.select("doc_id", "digest").join(hits, "digest", "left").select("doc_id", F.coalesce("found", F.expr("cast(map() as map<bigint, bigint>)")).alias("found"))
    ids = F.array_sort(F.map_keys("found"))
    return out.select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_min(F.map_values("found")).alias("best_distance"))


def clean(docs: DataFrame, benchmark: DataFrame, how: Filter = Filter(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, whole and unchanged, in which no passage is found."""
    first, groups = _first_two(_groups(benchmark, item_col, item_text_col, how))
    if len(first) == 2:
        digest = F.md5(F.col(text_col).cast("string"))
        hits = _hits(docs.select(digest.alias("digest"), F.col(text_col).cast("string").alias("text")), groups)
        return docs.join(hits.select("digest").distinct(), digest == F.col("digest"), "left_anti")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(first[0] if first else [])  # bounded by block_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _searched(batch, at, shared.value):
                yield part.filter(pa.array([not x for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
