"""Periodic runs of words, found by refining classes of equal factors, and their removal.

Two positions of a text are of one class for length l if the l words from them are equal. Classes for l + 1 come
from those for l by splitting: a position moves by the class of its successor. Of the parts of a split class only
the smaller ones split others in the next step (the largest may be left out), so a position is moved a logarithmic
number of times. Members of a class are linked in the order of the text; a member whose next one is exactly l words
further is the start of a square of period l, and consecutive starts make up one run. The nearest member is at
distance l only if no smaller period holds, so every run is found under its smallest period and at no other.

In a run of `exponent` periods q every factor of length q occurs at least `exponent` - 1 times: a class with fewer
members can hold no run of this or a longer period and is not split any more. Most classes of ordinary text end so within a few steps.

All texts of a slice (`SLICE`, a longer text alone) go through one refinement in numpy; a mark after every
text ends all factors there. Links that become due are kept in lists by distance up to a horizon that doubles, so a
step costs what it moves. Words are told by 64-bit hashes within a text. Documents are never shuffled.

Defined cases: a null text has no words; a null id leaves its text as it is where words are to be repeated by rule
(`repeated`); an empty table gives no rows; repeated rows and rows with one id are judged one by one; other
columns are left alone, clashing names included; texts of any length are refined whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import mix, slices, text_bytes, word_hashes, words

#: Bytes of text that are refined together: steps have a fixed price, which a larger slice shares among more texts.
SLICE = 1 << 22

_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Classes:
    """Classes of equal factors of all texts of a slice; `grow` goes on to factors that are one word longer."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, members: int):
        texts = len(bounds) - 1
        self.total, self.members = len(values) + texts, members
        text = np.repeat(np.arange(texts), np.diff(bounds))
        with np.errstate(over="ignore"):
            keys = np.empty(self.total, np.uint64)
            marks = bounds[1:] + np.arange(texts)
            keys[marks] = mix(np.arange(texts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
            keys[np.arange(len(values)) + text] = mix(values ^ mix(text.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93)))
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if self.total else np.zeros(0, np.int64)
        self.size = np.diff(np.append(first, self.total))
        self.names = len(first)
        number = np.repeat(np.arange(self.names), self.size)
        self.cls = np.empty(self.total, np.int64)
        self.cls[order] = number
        self.next, self.last = np.full(self.total, self.total), np.full(self.total, -1)
        same = number[1:] == number[:-1]
        self.next[order[:-1][same]], self.last[order[1:][same]] = order[1:][same], order[:-1][same]
        # The largest class of each text splits nothing.
        owner = np.searchsorted(marks, order[first], side="left")
        by_size = np.lexsort((self.size, owner))
        largest = by_size[np.append(owner[by_size][1:] != owner[by_size][:-1], True)] if self.names else by_size
        small = np.ones(self.names, bool)
        small[largest] = False
        self.splitters, self.of = order[small[number]], number[small[number]]
        self.length, self.horizon = 1, 1
        self.due: dict[int, list[np.ndarray]] = defaultdict(list)
        self.active, self.marks, self.sizes = order, marks, np.diff(bounds)
        self._look(self._alive())

    def _alive(self) -> np.ndarray:
        """The positions in classes that are still split, in texts that can hold a run of the present length."""
        active = self.active[self.size[self.cls[self.active]] >= self.members]
        short = (self.sizes < self.length * (self.members + 1))[np.searchsorted(self.marks, active, side="left")]
        self.size[self.cls[active[short]]] = 0  # a class lies within one text
        self.active = active[~short]
        return self.active

    def _look(self, positions: np.ndarray) -> None:
        """Note the positions whose next member is at a distance that is due up to the horizon."""
        positions = positions[self.size[self.cls[positions]] >= self.members]
        distance = self.next[positions] - positions
        near = (distance >= self.length) & (distance <= self.horizon) & (self.next[positions] < self.total)
        positions, distance = positions[near], distance[near]
        if len(positions):
            order = np.argsort(distance, kind="stable")
            positions, distance = positions[order], distance[order]
            cuts = np.flatnonzero(distance[1:] != distance[:-1]) + 1
            for part, d in zip(np.split(positions, cuts), distance[np.concatenate([[0], cuts])].tolist()):
                self.due[d].append(part)

    def squares(self) -> np.ndarray:
        """Ascending starts of the squares whose smallest period is the present length."""
        found = self.due.pop(self.length, None)
        if not found:
            return np.zeros(0, np.int64)
        found = np.unique(np.concatenate(found))
        return found[(self.next[found] - found == self.length) & (self.size[self.cls[found]] >= self.members)]

    def grow(self) -> bool:
        """Go on to the next length; False if no class is left that could be split."""
        at = self.splitters - 1
        keep = at >= 0
        at, of = at[keep], self.of[keep]
        alive = self.size[self.cls[at]] >= self.members
        at, of = at[alive], of[alive]
        self.length += 1
        moved = self._split(at, of) if len(at) else None
        if self.length > self.horizon:
            self.horizon *= 2
            self._look(self._alive())
        elif moved is not None:
            self._look(moved)
        return len(self.splitters) > 0

    def _split(self, at: np.ndarray, of: np.ndarray) -> np.ndarray | None:
        """Move the positions `at`, whose successors are of the classes `of`, to classes of their own; returns positions with new links."""
        order = np.argsort(at)
        at, of = at[order], of[order]
        pair = self.cls[at] * (2 * self.names) + of
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        old = self.cls[at]
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        part = np.cumsum(first) - 1
        count = np.bincount(part)
        whole = count == self.size[old[first]]  # all of a class moves together: it stays
        if whole.any():
            keep = ~whole[part]
            at, old, part = at[keep], old[keep], part[keep]
            if not len(at):
                self.splitters, self.of = at, old
                return None
            part = np.unique(part, return_inverse=True)[1]
            count = np.bincount(part)
        head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        parent = old[head]  # by part, ascending
        # Links of those that stay: take out stretches of moved members.
        order = np.lexsort((at, old))
        gone = at[order]
        begin = np.concatenate([[True], self.next[gone[:-1]] != gone[1:]])
        left, right = self.last[gone[begin]], self.next[gone[np.append(begin[1:], True)]]
        stays, follows = left >= 0, right < self.total
        self.next[left[stays]], self.last[right[follows]] = right[stays], left[follows]
        # Links and names of those that move.
        self.next[at], self.last[at] = self.total, -1
        same = part[1:] == part[:-1]
        self.next[at[:-1][same]], self.last[at[1:][same]] = at[1:][same], at[:-1][same]
        if self.names + len(count) > len(self.size):
            self.size = np.concatenate([self.size, np.zeros(len(self.size) + len(count), self.size.dtype)])
        self.cls[at] = self.names + part
        self.size[self.names : self.names + len(count)] = count
        # The largest part of each split class splits nothing.
        group = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        split = parent[group]
        self.size[split] -= np.add.reduceat(count, group)
        left_over, most = self.size[split], np.maximum.reduceat(count, group)
        small = np.ones(len(count), bool)
        rank = np.lexsort((count, parent))
        largest = rank[np.append(group[1:] - 1, len(rank) - 1)]
        small[largest[left_over < most]] = False
        few = (left_over < most) & (left_over > 0)
        rest, names = self._members(split[few], left_over[few], np.concatenate([left[stays], right[follows]]))
        chosen = small[part]
        self.splitters = np.concatenate([at[chosen], rest])
        self.of = np.concatenate([self.names + part[chosen], names])
        self.names += len(count)
        return np.concatenate([at, left[stays]])

    def _members(self, names: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of some classes and their classes; `known` holds at least one member of each."""
        if not len(names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if int(sizes.max()) * 3000 > self.total:  # walking along the links would take longer than a look at all
            wanted = np.zeros(len(self.size), bool)
            wanted[names] = True
            found = np.flatnonzero(wanted[self.cls])
            return found, self.cls[found]
        by_class = np.argsort(self.cls[known], kind="stable")
        known = known[by_class][np.searchsorted(self.cls[known][by_class], names)]
        found = [known]
        for links, end in ((self.next, self.total), (self.last, -1)):
            here = links[known]
            while len(here := here[here != end]):
                found.append(here)
                here = links[here]
        found = np.concatenate(found)
        return found, self.cls[found]


def find_runs(values: np.ndarray, bounds: np.ndarray, shortest: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the text, length, period) of all runs of at least `shortest` words and `exponent` periods.

    `values` are the word hashes of all texts, text t has those from bounds[t] to bounds[t + 1].
    """
    longest = int(np.diff(bounds).max(initial=0))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if longest >= shortest:
        classes = Classes(values, bounds, exponent - 1)
        while classes.length * exponent <= longest:
            squares, q = classes.squares(), classes.length
            if len(squares):
                begin = np.concatenate([[True], squares[1:] != squares[:-1] + 1])
                start, end = squares[begin], squares[np.append(begin[1:], True)]
                length = end - start + 2 * q
                long = length >= max(shortest, exponent * q)
                found.append((start[long], length[long], np.full(long.sum(), q)))
            if not classes.grow():
                break
    start, length, period = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    text = np.searchsorted(bounds[1:] + np.arange(len(bounds) - 1), start, side="left")
    start = start - text - bounds[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def repeated(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from number a are to repeat with period p, None where a text of n words stays as it is."""
    if doc_id is None or not n:
        return None
    g, digit = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if digit:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _sequences(ids: list[int | None], first: np.ndarray, repeat: bool) -> np.ndarray:
    """The number of the word that stands at each place."""
    place = np.arange(first[-1])
    if repeat:
        for row, doc_id in enumerate(ids):
            n = int(first[row + 1] - first[row])
            if found := repeated(doc_id, n):
                a, p = found
                place[first[row] + a : first[row + 1]] = first[row] + a + np.arange(n - a) % p
    return place


def _judged(ids: pa.Array, column: pa.Array, repeat: bool) -> Iterator[tuple]:
    """Per row: the runs (start, length, period) and the kept words, joined."""
    data, offsets = text_bytes(column)
    starts, ends, first = words(data, offsets)
    place = _sequences(ids.to_pylist(), first, repeat)
    hashes = word_hashes(data, starts, ends)[place]
    text, start, length, period = find_runs(hashes, first)
    raw, begins = data.tobytes(), np.searchsorted(text, np.arange(len(column) + 1))
    for row in range(len(column)):
        runs = list(zip(*(x[begins[row] : begins[row + 1]].tolist() for x in (start, length, period))))
        whole = raw[offsets[row] : offsets[row + 1]].split()
        low, high = int(first[row]), int(first[row + 1])
        kept = np.ones(high - low, bool)
        for s, n, q in runs:
            kept[s + q : s + n] = False
        here = place[low:high] - low
        if runs or (high > low and here[-1] != high - low - 1):
            whole = [whole[k] for k in here[kept].tolist()]
        yield runs, b" ".join(whole)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: bool = False) -> DataFrame:
    """One row per document: its runs, and its words without those that only repeat a run's period (joined by one space).

    With `repeat`, the words of a tenth of the documents are first repeated by rule, so that there is something to find.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                found = list(_judged(part.column(0), part.column(1), repeat))
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in found]
                kept = [k.decode() for _, k in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(kept, pa.string())], names=["doc_id", "runs", "kept_text"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, kept_text string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: bool = True) -> DataFrame:
    """One row per document: number of runs, the longest one (ties: smallest start, then period), digests of all runs and of the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                rows = []
                for runs, kept in _judged(part.column(0), part.column(1), repeat):
                    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                    rows.append((len(runs), s, n, q, None if q is None else 1000 * n // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*rows)) or [()] * 7
                types = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, _SCHEMA)
