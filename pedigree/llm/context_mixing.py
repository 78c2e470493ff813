"""Language-model scoring by logistic context mixing.

A text is a sequence of words and one end. A word is spelled by the bits of its bytes under a Huffman
code; every bit is predicted in five hashed contexts (one, two, three and five characters back, and
the whole word so far with the kind of the preceding word; three of them with the text's topic, which
is stated first and paid for in the score). The predictions are mixed in the logistic
domain with weights that a gate selects by how often the longer contexts were seen, and refined by
a map from mixed prediction and gate to probability.

The context counts come from all training texts: words are counted per preceding kind with sums in
the batch and before the shuffle, and the contexts of each distinct word are added up in tables of a
fixed size, which are summed over the tasks. The mixer's weights and the map are fitted on all words of
all training texts, each as often as it occurs: every task adds up its words' gradients, from which all
weights take Newton steps. A word is predicted as in a text of its own, so what one text holds of it on average
is taken out of its counts. The topics are the centres of all training texts (k-means).

The base score (smoothed relative frequencies of words) needs the count of every word. The counts of
frequent words, at most `frequent`, are sent to the tasks; all other words are joined by hash, where
none is hot, as they are rare by construction.

What is coded is the lower-cased words and one byte behind each word and behind the text, by which
`bits_per_byte` divides. A word is spelled from its own characters and the kind of the word before, not from
that word's characters: so the job counts and scores distinct words instead of text positions.

Defined cases: null text is empty and consists of the end alone; without training texts every word is
unknown and all bits are even; rows with a null id are scored, and count as held out by the digest of
the empty text; repeated rows get equal scores; texts of any length are scored whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import cut, hot_of, join_least, mix, slices, text_bytes, window_hashes, words

KINDS = 5  # of the preceding word: none, sentence end, other punctuation, letter or digit, other byte
_END = 32  # the byte that ends a word
_TABLE_BITS = (18, 20, 20, 21, 22)
_BACK = (1, 2, 3, 5)
_OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in _TABLE_BITS])])
_SHIFTS = 32 - np.array(_TABLE_BITS, np.uint32)[:, None]
_DEPTH = 24  # first characters that words are seen to have in common
_CHARACTERS = 12_000  # that are spelled at a time and so stay in the cache
_ROWS = 1 << 20  # counts that a task holds before it adds them up and sends them
_CHUNK = 1 << 18
_DELTA = 0.4
_LEVELS = 8
_MAP_CELLS = 33
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of the first bytes of eight
_START = (0.25, 0.25, 0.4, 0.4, 0.1, 0.0)  # weights of the tables and the constant before the first step
_PRIOR = 2000.0  # decisions; pulls the weights of gates that are rarely met to their start
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NAMES = [f"n{c}" for c in range(KINDS)]
_GATES = _LEVELS * _LEVELS
_INPUTS = len(_TABLE_BITS) + 1
_KIND = np.full(256, 4, np.uint8)
_KIND[[ord(c) for c in ".!?"]] = 1
_KIND[[ord(c) for c in ",;:)\"'"]] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 3


@dataclass(frozen=True)
class Limits:
    """Bounds: words whose counts and spellings' scores are sent to the tasks, distinct words per training task, pieces of a table that are added up in one task, steps of the mixer, topics and the frequent words that tell them.

    The number of training tasks grows with the corpus; their tables have a fixed size and are added up in steps.
    """

    frequent: int = 1 << 20
    words_per_task: int = 400_000
    pieces: int = 64
    steps: int = 2
    topics: int = 12
    anchors: int = 64


def held_out_column(id_col: str, folds: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, a place of each, and each key's number among them; by hash, not sorted."""
    found = pa.array(keys).dictionary_encode()
    same = found.indices.to_numpy().astype(np.int64)
    one = np.zeros(len(found.dictionary), np.int64)
    one[same] = np.arange(len(keys))
    return found.dictionary.to_numpy(), one, same


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, of eight bytes at a time; `data` has eight bytes more."""
    eights = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    sizes = ends - starts
    out = mix((eights[starts] & _MASKS[np.minimum(sizes, 8)]) * _ODD + sizes.astype(np.uint64))
    more, done = np.flatnonzero(sizes > 8), 8
    while len(more):
        left = sizes[more] - done
        out[more] = mix((out[more] ^ (eights[starts[more] + done] & _MASKS[np.minimum(left, 8)])) * _ODD + np.uint64(done))
        more, done = more[left > 8], done + 8
    return out


class _Words:
    """The words of a run of rows: bounds, hashes and preceding kinds."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        padded = np.zeros(len(data) + 8, np.uint8)
        self.data = padded[: len(data)]
        np.take(_LOWER, data, out=self.data, mode="clip")
        self.starts, self.ends, self.first = words(self.data, offsets)
        self.sizes = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.hashes = _hashes(padded, self.starts, self.ends)
        kinds = np.zeros(len(self.starts), np.uint8)
        kinds[1:] = _KIND[self.data[self.ends[:-1] - 1]] if len(kinds) else 0
        kinds[self.first[:-1][self.first[:-1] < self.first[1:]]] = 0
        self.kinds = kinds

    def spelled(self, at: np.ndarray) -> pa.Array:
        """Words; in an array of all words and what is between them, each second one is a word."""
        bounds = np.append(np.column_stack([self.starts, self.ends]).ravel(), len(self.data)).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(self.data)]).take(pa.array(2 * at))


class Topics:
    """Texts told apart by how often frequent words, the anchors, occur in them."""

    def __init__(self, anchors: np.ndarray, centres: np.ndarray):
        self.anchors, self.centres = anchors, centres

    def points(self, w: _Words) -> np.ndarray:
        if not len(self.anchors):
            return np.zeros((len(w.sizes), 0))
        near = np.zeros(1 << 16, bool)
        near[self.anchors & np.uint64(0xFFFF)] = True
        some = np.flatnonzero(near[w.hashes & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.anchors, w.hashes[some]), len(self.anchors) - 1)
        hit = self.anchors[at] == w.hashes[some]
        counts = np.bincount(w.row[some[hit]] * len(self.anchors) + at[hit], minlength=len(w.sizes) * len(self.anchors)).reshape(len(w.sizes), -1)
        points = np.sqrt(counts)
        return points / (np.linalg.norm(points, axis=1, keepdims=True) + 1e-9)

    def of(self, w: _Words) -> np.ndarray:
        """The topic of each row; 0 without frequent words."""
        points = self.points(w)
        if not len(self.centres):
            return np.zeros(len(w.sizes), np.int64)
        return np.where(points.any(1), (points @ self.centres.T).argmax(1) + 1, 0)


def _count_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n) of the words of some slices."""

    def merged(found: list) -> pa.RecordBatch:
        h, n = (np.concatenate(x) for x in zip(*found))
        h, _, same = _grouped(h)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(same, n, len(h)).astype(np.int64))], names=["h", "n"])

    found, rows = [], 0
    for batch in batches:
        for part in slices(batch, 0):
            found.append(np.unique(_Words(part.column(0)).hashes, return_counts=True))
            rows += len(found[-1][0])
            if rows >= _ROWS:
                yield merged(found)
                found, rows = [], 0
    if found:
        yield merged(found)


def _points(topics: Topics):
    """The texts that hold anchors, as points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                points = topics.points(_Words(part.column(0))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(list(points[points.any(1)]), pa.list_(pa.float32()))], names=["point"])

    return run


def _topics(train: DataFrame, limits: Limits) -> Topics:
    """k-means over all texts; the anchors are the most frequent words of all of them."""
    often = train.mapInArrow(_count_hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(limits.anchors).toArrow()
    topics = Topics(np.sort(often["h"].to_numpy().view(np.uint64)), np.zeros((0, often.num_rows)))
    points = cut(train.mapInArrow(_points(topics), "point array<float>"))
    if not points.isEmpty():
        means = KMeans(k=max(2, limits.topics - 1), seed=1, distanceMeasure="cosine").fit(points.select(array_to_vector("point").alias("features")))
        topics.centres = np.round(np.array(means.clusterCenters()), 6)
    return topics


def _count_words(topics: Topics):
    """(h, topic, word, n0..n4, d) per batch, each word once a topic, `d` the texts that hold it; rows with the null word count the texts of a topic."""

    def merged(found: list) -> pa.RecordBatch:
        key, h, own, n = (np.concatenate(x) for x in list(zip(*found))[:4])
        _, one, same = _grouped(key)
        total = np.zeros((len(one), KINDS + 1), np.int64)
        for k in range(KINDS + 1):
            total[:, k] = np.bincount(same, n[:, k], len(one))
        return _counted(h[one].view(np.int64), own[one], pa.concat_arrays([x[4] for x in found]).take(pa.array(one)), total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, found, rows = np.zeros(256, np.int64), [], 0
        for batch in batches:
            for part in slices(batch, 0):
                w = _Words(part.column(0))
                topic = topics.of(w)
                texts += np.bincount(topic, minlength=256)
                if len(w.hashes):
                    own = topic[w.row]
                    key, one, same = _grouped(mix(w.hashes + own.astype(np.uint64)))
                    kinds = np.bincount(same * KINDS + w.kinds, minlength=len(key) * KINDS).reshape(-1, KINDS)
                    of_text = np.unique(same * np.int64(len(w.sizes)) + w.row) // len(w.sizes)
                    found.append((key, w.hashes[one], own[one], np.column_stack([kinds, np.bincount(of_text, minlength=len(key))]).astype(np.int32), w.spelled(one)))
                    rows += len(key)
                if rows >= _ROWS:
                    yield merged(found)
                    found, rows = [], 0
        if found:
            yield merged(found)
        some = np.flatnonzero(texts)
        yield _counted(np.zeros(len(some), np.int64), some, pa.nulls(len(some), pa.binary()), np.pad(texts[some, None], ((0, 0), (0, KINDS))))

    return run


def _counted(h: np.ndarray, topic: np.ndarray, spelled: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(h), pa.array(topic.astype(np.int32)), spelled, *(pa.array(n[:, c]) for c in range(KINDS + 1))]
    return pa.RecordBatch.from_arrays(columns, names=["h", "topic", "word", *_NAMES, "d"])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the counted words; behind them the powers of two of the counts per kind."""
    total = np.zeros(256 + 64, np.int64)
    for batch in filter(len, batches):
        data, starts, ends = _bytes_of(batch.column(0))
        counts = np.column_stack([np.asarray(batch.column(1 + c)) for c in range(KINDS)])
        n = counts.sum(1)
        total[:256] += np.bincount(data, np.repeat(n, ends - starts), 256).astype(np.int64)
        total[_END] += n.sum()
        total[256:] += np.bincount(np.frexp(counts[counts > 0].astype(np.float64))[1] - 1, minlength=64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["byte", "n"])


class Code:
    """A Huffman code over bytes; `node[b, k]` and `bit[b, k]` are the k-th decision that spells byte b."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, b, b) for b, n in enumerate(counts)]
        heapq.heapify(heap)
        inner = {}
        while len(heap) > 1:
            (m, _, a), (n, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            inner[256 + len(inner)] = (a, b)
            heapq.heappush(heap, (m + n, 255 + len(inner), 255 + len(inner)))
        paths: dict[int, list[tuple[int, int]]] = {heap[0][2]: []}
        stack = [heap[0][2]]
        while stack:
            at = stack.pop()
            for bit, below in enumerate(inner.get(at, ())):
                paths[below] = paths[at] + [(at - 256, bit)]
                stack.append(below)
        deepest = max(len(paths[b]) for b in range(256))
        self.length = np.array([len(paths[b]) for b in range(256)])
        self.node, self.bit = np.zeros((256, deepest), np.uint8), np.zeros((256, deepest), bool)
        for b in range(256):
            for k, (node, bit) in enumerate(paths[b]):
                self.node[b, k], self.bit[b, k] = node, bit

        # All decisions in one row, those of byte b from `first[b]` on.
        self.first = np.cumsum(self.length) - self.length
        own = np.repeat(np.arange(256), self.length), np.arange(self.length.sum()) - np.repeat(self.first, self.length)
        self.nodes, self.bits = (mix(self.node[own].astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32), self.bit[own]

    def events(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, topics: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(decisions per character, bit, slots in the five tables) of every decision that spells the words but for the first `skip` characters of each."""
        sizes = ends - starts + 1
        last = np.cumsum(sizes) - 1
        first = last - sizes + 1
        places = np.arange(last[-1] + 1)
        inner = places - np.repeat(first, sizes)
        source = places + np.repeat(starts - first, sizes)
        source[last] = 0
        text = data[source]
        text[last] = _END
        kept = np.flatnonzero(inner >= np.repeat(skip, sizes))
        wide = text.astype(np.uint64) + np.uint64(1)
        of = sizes - skip
        kind, topic = np.repeat(kinds.astype(np.uint64), of), np.repeat(topics.astype(np.uint64) + np.uint64(1), of)
        hashed = np.empty((len(_TABLE_BITS), len(kept)), np.uint32)
        seen = np.zeros(len(text), np.uint64)
        for d in range(1, max(_BACK) + 1):
            seen[d:] += wide[:-d] * np.uint64(263**d) * (inner[d:] >= d)
            if d in _BACK:
                c = seen[kept] + np.uint64(d)
                if d == 1:
                    c = c * np.uint64(KINDS) + kind * (inner[kept] == 0)
                hashed[_BACK.index(d)] = mix(c * np.uint64(257) + topic if d in (1, 3) else c) >> np.uint64(32)
        # The whole word so far: a running sum from the word's start.
        run = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mix(wide * _ODD + inner.astype(np.uint64)), out=run[1:])
        hashed[-1] = mix((run[kept] - np.repeat(run[first], of)) ^ (kind * np.uint64(257) + topic) * _ODD) >> np.uint64(32)
        text = text[kept]
        times = self.length[text]
        before = np.cumsum(times) - times
        own = np.arange(before[-1] + times[-1]) + np.repeat(self.first[text] - before, times)
        slots = np.take(hashed, np.repeat(np.arange(len(kept)), times), axis=1)
        slots += self.nodes[own]
        slots >>= _SHIFTS
        return times, self.bits[own], slots + _OFFSETS[:-1, None]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all values and where each begins and ends."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of words of about `_CHARACTERS` characters; a longer word is alone in its run."""
    bounds, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
    while begin < len(sizes):
        stop = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + _CHARACTERS, side="right")) - 1)
        yield slice(begin, stop)
        begin = stop


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(values), np.uint8), ends - sizes, ends


def _common(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many first characters each word has in common with the one before, of the same group; at most `_DEPTH`."""
    place = np.arange(_DEPTH)
    inside = place < (ends - starts)[:, None]
    head = np.where(inside, data[np.where(inside, starts[:, None] + place, 0)], _END)
    out = np.zeros(len(starts), np.int64)
    differs = (head[1:] != head[:-1]) | (group[1:] != group[:-1])[:, None]
    out[1:] = np.where(differs.any(1), differs.argmax(1), _DEPTH)
    return np.minimum(out, ends - starts)


def _spellings(code: Code, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bit, slots, how often, mean share of a text in the word after that kind, and in the word) of the decisions that spell counted words.

    A decision depends on nothing behind it, so a beginning that words have in common is spelled once,
    for all of them. The words come sorted; those of another batch or task are spelled on their own.
    """
    for batch in filter(len, batches):
        data, starts, ends = _bytes_of(batch.column(0))
        topics, n = np.asarray(batch.column(1)).astype(np.int64), np.column_stack([np.asarray(batch.column(2 + c)) for c in range(KINDS)])
        share = 1 / np.asarray(batch.column(2 + KINDS))
        kind, row = np.nonzero(n.T)
        count, starts, ends, topics = n[row, kind].astype(np.float64), starts[row], ends[row], topics[row]
        skip = _common(data, starts, ends, kind * 256 + topics)
        # Up to which word a beginning goes on.
        number = np.arange(len(row) + 1)
        upto = np.full((len(row) + 1, _DEPTH), len(row), np.int32)
        upto[:-1] = np.where(skip[:, None] <= np.arange(_DEPTH), number[:-1, None], len(row))
        upto = np.minimum.accumulate(upto[::-1], axis=0)[::-1]
        of = ends - starts + 1 - skip
        bounds = np.concatenate([[0], np.cumsum(of)])
        word = np.repeat(number[:-1], of)
        depth = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - skip, of)
        end = np.where(depth < _DEPTH, upto[word + 1, np.minimum(depth, _DEPTH - 1)], word + 1)
        summed = [np.concatenate([[0], np.cumsum(x)]) for x in (count, count * count * share[row], count * (n.sum(1) * share)[row])]
        total, of_kind, of_word = (x[end] - x[word] for x in summed)
        rest = np.column_stack([total, of_kind / total, of_word / total]).astype(np.float32).T
        for own in _chunks(of):
            times, bit, slots = code.events(data, starts[own], ends[own], kind[own], topics[own], skip[own])
            yield bit, slots, *(np.repeat(x, times) for x in rest[:, bounds[own.start] : bounds[own.stop]])


def _tables(code: Code):
    """Context counts of the task's distinct words, in compressed chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _OFFSETS[-1]), np.float32)
        flat = counts.reshape(-1)
        for bit, slots, weight, _, _ in _spellings(code, batches):
            slots += bit * np.int64(_OFFSETS[-1])
            for s in slots:
                np.add.at(flat, s, weight)
        press = zstandard.ZstdCompressor(level=1)
        for chunk in range(0, int(_OFFSETS[-1]), _CHUNK):
            piece = counts[:, chunk : chunk + _CHUNK]
            if piece.any():
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([chunk], pa.int64()), pa.array([press.compress(np.ascontiguousarray(piece).tobytes())], pa.binary())], names=["part", "chunk", "counts"])

    return run


def _add_chunks(table: pa.Table) -> pa.Table:
    """The sum of some pieces of one chunk, one piece after the other."""
    press, total = zstandard.ZstdDecompressor(), 0
    for piece in table["counts"]:
        total = total + np.frombuffer(press.decompress(piece.as_py()), np.float32)
    return pa.table({"part": table["part"][:1].cast(pa.int64()), "chunk": table["chunk"][:1].cast(pa.int64()), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _level(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + np.float32(1)), _LEVELS - 1).astype(np.uint8)


class Gates:
    """The mixer's weights, for each gate one of each table and a constant, and its map."""

    def __init__(self):
        self.weights = np.tile(np.array(_START, np.float32), (_GATES, 1))
        self.map = np.tile(_squash(np.linspace(-12, 12, _MAP_CELLS)), (_GATES, 1)).astype(np.float32)

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        told = np.ascontiguousarray(self.weights.T)
        logit = told[-1][gate]
        for own, weight in zip(x, told):
            logit += own * weight[gate]
        return np.clip(logit, -12, 12, out=logit)

    def cells(self, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (logit + np.float32(12)) * np.float32((_MAP_CELLS - 1) / 24)
        low = np.minimum(at.astype(np.int32), _MAP_CELLS - 2)
        return low, at - low.astype(np.float32)


def _decisions(code: Code, counts: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(logits of the tables, gate, bit, occurrences) of every decision that spells the words, predicted without one text's mean share of the words that it spells."""
    pairs = counts.view(np.int64).ravel()  # both counts of a slot at once
    for bit, slots, weight, of_kind, of_word in _spellings(code, batches):
        seen = np.take(pairs, slots).view(np.float32).reshape(*slots.shape, 2)
        no, yes = np.ascontiguousarray(seen[..., 0]), np.ascontiguousarray(seen[..., 1])
        for side, own in ((no, ~bit), (yes, bit)):
            kind, word = of_kind * own, of_word * own
            for i in range(len(slots)):
                side[i] -= kind if i in (0, 4) else word  # the contexts of these tables hold the kind
            np.maximum(side, 0, out=side)
        gate = _level(no[3] + yes[3]) + _level(no[4] + yes[4]) * np.uint8(_LEVELS)
        yes += np.float32(_DELTA)
        no += np.float32(_DELTA)
        yes /= no
        yield np.log(yes, out=yes), gate, bit, weight


def _sums(found: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found.ravel()[some])], names=["at", "value"])


def _slopes(sent, gates: Gates):
    """Per gate the loss, gradient and curvature of its weights, summed over the task's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((_GATES, 1 + _INPUTS + _INPUTS * _INPUTS))
        for x, gate, bit, weight in _decisions(*sent.value, batches):
            p = _squash(gates.mix(x, gate))
            order = np.argsort(gate, kind="stable")
            # Inputs, slope and loss side by side, so that one product a gate has all sums.
            left = np.empty((_INPUTS + 2, len(p)), np.float32)
            np.take(x, order, axis=1, out=left[: len(x)], mode="clip")
            left[len(x)] = 1
            np.take(weight * (bit - p), order, out=left[-2], mode="clip")
            np.take(weight * np.log(np.where(bit, p, 1 - p)), order, out=left[-1], mode="clip")
            right = left[:_INPUTS].copy()
            left[:_INPUTS] *= (weight * p * (1 - p))[order]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=_GATES))])
            for g in np.flatnonzero(np.diff(bounds)).tolist():
                own = slice(bounds[g], bounds[g + 1])
                sums = left[:, own] @ right[:, own].T
                out[g, 0] -= sums[-1, -1]
                out[g, 1 : 1 + _INPUTS] += sums[-2]
                out[g, 1 + _INPUTS :] += sums[:_INPUTS].ravel()
        yield from _sums(out)

    return run


def _hits(sent, gates: Gates):
    """Per gate and cell of the map how many decisions fell there and how many of them were 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, _GATES * _MAP_CELLS))
        for x, gate, bit, weight in _decisions(*sent.value, batches):
            low, part = gates.cells(gates.mix(x, gate))
            at = gate.astype(np.int64) * _MAP_CELLS + low
            high = weight * part
            for cell, share in ((at, weight - high), (at + 1, high)):
                out[0] += np.bincount(cell, share, out.shape[1])
                out[1] += np.bincount(cell, share * bit, out.shape[1])
        yield from _sums(out)

    return run


def _learn(spelled: DataFrame, sent, steps: int) -> Gates:
    """The gates fitted to all words: Newton steps, halved for gates whose loss grew, then the map."""

    def summed(part, *shape: int) -> np.ndarray:
        out = np.zeros(int(np.prod(shape)))
        found = words_.mapInArrow(part, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # a fixed size
        out[found["at"].to_numpy()] = found["value"].to_numpy()
        return out.reshape(shape)

    words_ = spelled.select("word", "topic", *_NAMES, "d")
    gates = Gates()
    start, best, least = gates.weights.astype(np.float64), gates.weights.astype(np.float64), np.full(_GATES, np.inf)
    step = np.zeros_like(best)
    for _ in range(steps):
        sums = summed(_slopes(sent, gates), _GATES, 1 + _INPUTS + _INPUTS * _INPUTS)
        tried = best + step
        loss = sums[:, 0] + 0.5 * _PRIOR * ((tried - start) ** 2).sum(1)
        better = loss < least
        slope = sums[:, 1 : 1 + _INPUTS] - _PRIOR * (tried - start)
        bend = sums[:, 1 + _INPUTS :].reshape(-1, _INPUTS, _INPUTS) + _PRIOR * np.eye(_INPUTS)
        step = np.where(better[:, None], np.linalg.solve(bend, slope[..., None])[..., 0], step / 2)
        best, least = np.where(better[:, None], tried, best), np.where(better, loss, least)
        gates.weights = np.round(best + step, 5).astype(np.float32)
    n, ones = summed(_hits(sent, gates), 2, _GATES, _MAP_CELLS)
    gates.map = np.clip((ones + 16 * gates.map) / (n + 16), 1e-6, 1 - 1e-6).astype(np.float32)
    return gates


class Mixer:
    """The tables as logits and levels of confidence, the gated weights and the map."""

    def __init__(self, code: Code, counts: np.ndarray, gates: Gates):
        self.code, self.gates = code, gates
        # In place, to keep one copy of the tables.
        self.levels = _level(counts[_OFFSETS[3] :].sum(1))
        counts += np.float32(_DELTA)
        np.log(counts, out=counts)
        self.logits = counts[:, 1] - counts[:, 0]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, topics: np.ndarray) -> np.ndarray:
        """log10 probability of each word after the given kind of word in a text of the topic; beginnings that a word has in common with the one before are scored once."""
        if not len(starts):
            return np.zeros(0)
        skip = _common(data, starts, ends, kinds.astype(np.int64) + topics.astype(np.int64) * KINDS)
        of = ends - starts + 1 - skip
        first = np.cumsum(of) - of
        scores = np.concatenate([self._characters(data, starts[own], ends[own], kinds[own], topics[own], skip[own]) for own in _chunks(of)])
        # The word that each of the first characters was scored with.
        place, number = np.arange(_DEPTH), np.arange(len(starts))[:, None]
        source = np.maximum.accumulate(np.where(skip[:, None] <= place, number, 0), axis=0)
        at = np.minimum((first - skip)[source] + place, len(scores) - 1)
        return np.add.reduceat(scores, first) + (scores[at] * (place < skip[:, None])).sum(1)

    def _characters(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, topics: np.ndarray, skip: np.ndarray) -> np.ndarray:
        times, bit, slots = self.code.events(data, starts, ends, kinds, topics, skip)
        cells = self.gates.map.ravel()
        gate = self.levels[slots[4] - _OFFSETS[3]] * np.uint8(_LEVELS) + self.levels[slots[3] - _OFFSETS[3]]
        logit = self.gates.mix(np.take(self.logits, slots), gate)
        low, part = self.gates.cells(logit)
        low += gate.astype(np.int32) * np.int32(_MAP_CELLS)
        below = cells[low]
        p = np.float32(0.5) * (_squash(logit) + below + (cells[low + 1] - below) * part)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.add.reduceat(np.log10(np.where(bit, p, 1 - p)), np.cumsum(times) - times, dtype=np.float64)


def _key(hashes: np.ndarray, kinds: np.ndarray, topics: np.ndarray) -> np.ndarray:
    """A word after a kind of word in a topic."""
    return hashes ^ mix((kinds + topics * np.int64(KINDS)).astype(np.uint64))


class Lookup:
    """Values by 64-bit key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values (0 elsewhere)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), self.values.dtype)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, np.where(known, self.values[at], 0)


class Model:
    """All that scoring needs: the topics, the mixer, what is known of frequent words, and the totals.

    The mixer is broadcast on its own (`sent`) and is no part of the model that is sent.
    """

    def __init__(self, topics: Topics, shares: np.ndarray, mixer: Mixer | None, counts: Lookup, spelled: Lookup, tokens: int, kinds: int, texts: int):
        self.topics, self.shares, self.mixer, self.counts, self.spelled = topics, shares, mixer, counts, spelled
        self.tokens, self.kinds, self.texts = tokens, kinds, texts
        self.sent = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mixer": None, "sent": None}

    @property
    def scale(self) -> float:
        return self.tokens + 0.1 * (self.kinds + 1)

    def words(self, w: _Words, topics: np.ndarray, mixer: Mixer | None) -> np.ndarray:
        """log10 probability of every word."""
        if mixer is None or not len(w.hashes):
            return np.full(len(w.hashes), np.log10(0.5))
        own = topics[w.row]
        keys, one, same = _grouped(_key(w.hashes, w.kinds, own))
        known, out = self.spelled.of(keys)
        out = out.astype(np.float64)
        if not known.all():
            new = np.flatnonzero(~known)
            new = new[pc.sort_indices(w.spelled(one[new])).to_numpy()]
            new = new[np.argsort((w.kinds + own * KINDS)[one[new]], kind="stable")]
            rest = one[new]
            out[new] = mixer.words(w.data, w.starts[rest], w.ends[rest], w.kinds[rest], own[rest])
        return out[same]


def _least(steps: list[tuple[int, int]], room: int) -> int:
    """The least power of two from which on all counts find room."""
    least = 1 << 62
    for step, n in reversed(steps):
        room -= n
        if room < 0:
            break
        least = 1 << step
    return least


def _spell_all(mixer):
    """(key, score) of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            data, starts, ends = _bytes_of(batch.column(0))
            order = np.argsort(np.asarray(batch.column(2)), kind="stable")  # words of a kind stay sorted
            kinds, topics = (np.asarray(batch.column(k)).astype(np.int64)[order] for k in (2, 3))
            scores = mixer.value.words(data, starts[order], ends[order], kinds, topics).astype(np.float32)
            keys = _key(np.asarray(batch.column(1)).view(np.uint64)[order], kinds, topics)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(scores)], names=["key", "score"])

    return run


def fit(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", held_out: int = 10) -> tuple[Model, DataFrame]:
    """The model, and the counts (h, c) of the words that are not frequent."""
    train = docs.where(~held_out_column(id_col, held_out)).select(F.col(text_col).cast("string").alias("text"))
    topics = _topics(train, limits)
    names = _NAMES
    fields = ", ".join(f"{n} long" for n in (*names, "d"))
    counted = train.mapInArrow(_count_words(topics), f"h long, topic int, word binary, {fields}").groupBy("word", "topic").agg(F.min("h").alias("h"), *(F.sum(n).alias(n) for n in (*names, "d")))
    # Sorted, so that words stand beside those that begin alike.
    counted = cut(counted.withColumn("end", F.col("word").isNull()).sortWithinPartitions("topic", "word"))
    shares = np.full(256, 0.5)
    for r in counted.where("end").collect():  # one row per topic
        shares[r["topic"]] += r["n0"]
    texts = int(round((shares - 0.5).sum()))
    shares = shares[: len(topics.centres) + 1] / shares[: len(topics.centres) + 1].sum()
    spelled = counted.where("not end")
    totals = cut(spelled.groupBy("h").agg(F.sum(F.expr(" + ".join(names))).alias("c")))
    # One row per power of two: a fixed bound.
    steps = sorted((r.step, r.n, r.c) for r in totals.groupBy(F.floor(F.log2("c")).cast("int").alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect())
    kinds = sum(n for _, n, _ in steps)
    tokens = sum(c for _, _, c in steps) + texts
    if not kinds:
        none = Lookup(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return Model(topics, shares, None, none, none, tokens, kinds + (texts > 0), texts), totals
    least = _least([(step, n) for step, n, _ in steps], limits.frequent)
    often = totals.where(F.col("c") >= least).toArrow()  # at most limits.frequent rows
    tasks = max(1, -(-kinds // limits.words_per_task))
    bytes_ = spelled.select("word", *names).mapInArrow(_histogram, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros(256 + 64, np.int64)
    histogram[bytes_["byte"].to_numpy()] = bytes_["n"].to_numpy()
    code = Code(histogram[:256])
    enough = _least(list(enumerate(histogram[256:].tolist())), limits.frequent)
    chunks = spelled.select("word", "topic", *names, "d").coalesce(tasks).mapInArrow(_tables(code), "part long, chunk long, counts binary")
    while tasks > 1:  # up to `pieces` tables of a chunk are added up in a task
        tasks = -(-tasks // limits.pieces)
        chunks = chunks.withColumn("part", F.col("part") % tasks).groupBy("chunk", "part").applyInArrow(_add_chunks, "part long, chunk long, counts binary")
    counts = np.zeros((int(_OFFSETS[-1]), 2), np.float32)
    press = zstandard.ZstdDecompressor()
    for r in chunks.toLocalIterator():  # the tables: a fixed size
        piece = np.frombuffer(press.decompress(bytes(r["counts"])), np.float32).reshape(2, -1)
        counts[r["chunk"] : r["chunk"] + piece.shape[1]] = piece.T
    told = docs.sparkSession.sparkContext.broadcast((code, counts))  # a fixed size
    gates = _learn(spelled, told, limits.steps)
    told.destroy()
    mixer = Mixer(code, counts, gates)
    del counts
    shared = docs.sparkSession.sparkContext.broadcast(mixer)  # a fixed size
    placed = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(n).alias("n")) for c, n in enumerate(names))))
    placed = spelled.where(F.greatest(*names) >= enough).select("word", "h", "topic", placed.alias("x")).where(F.col("x.n") >= enough)
    ready = placed.select("word", "h", "x.kind", "topic").mapInArrow(_spell_all(shared), "key long, score float").toArrow()  # at most limits.frequent rows
    spelled_ = Lookup(ready["key"].to_numpy().view(np.uint64), ready["score"].to_numpy())
    model = Model(topics, shares, mixer, Lookup(often["h"].to_numpy().view(np.uint64), often["c"].to_numpy()), spelled_, tokens, kinds + (texts > 0), texts)
    model.sent = shared
    return model, totals.where(F.col("c") < least)


def _whole(w: _Words) -> np.ndarray:
    out = np.zeros(len(w.sizes), np.int64)
    some = np.flatnonzero(w.sizes)
    if len(some):
        out[some] = window_hashes(w.hashes, w.first[:-1][some], w.sizes[some]).view(np.int64)
    return out


def score(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", held_out: int = 10) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    model, rare_counts = fit(docs, limits, id_col, text_col, held_out)
    shared, sent = docs.sparkSession.sparkContext.broadcast(model), model.sent  # bounded by limits.frequent; a fixed size
    model.mixer = None
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out_column(id_col, held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mixer = shared.value, sent.value if sent else None
        stop = (m.texts + 0.5) / (m.tokens + 1)
        for batch in batches:
            for part in slices(batch, 2):
                w = _Words(part.column(2))
                topic = m.topics.of(w)
                hashes, _, same = _grouped(w.hashes)
                known, c = (x[same] for x in m.counts.of(hashes))
                total = lambda x: np.bincount(w.row, x, len(w.sizes))
                scores = np.log10(m.shares[topic]) + total(m.words(w, topic, mixer)) + w.sizes * np.log10(1 - stop) + np.log10(stop)
                base = total(np.where(known, np.log10(c + 0.1) - np.log10(m.scale), 0.0)) + np.log10(m.texts + 0.1) - np.log10(m.scale)
                size = total(w.ends - w.starts) + w.sizes + 1  # bytes that are coded: words and their ends
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(total(~known))]).astype(np.int32)), pa.array(w.hashes[~known].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(_whole(w)), pa.array(w.sizes + 1), pa.array(total(known).astype(np.int64) + (m.texts > 0)), pa.array(base), pa.array(scores), pa.array(-scores * np.log2(10) / size), rest],
                    names=["doc_id", "held_out", "t", "n_tokens", "known_often", "base_often", "score", "bits_per_byte", "rest"],
                )

    scored = cut(source.mapInArrow(run, "doc_id long, held_out boolean, t long, n_tokens long, known_often long, base_often double, score double, bits_per_byte double, rest array<long>"))
    for held in (shared, sent):  # the scores are checkpointed
        if held:
            held.destroy()
    # Summed by text, not by id: equal texts add up and are divided by their number.
    spots = scored.select("t", F.explode("rest").alias("h")).join(rare_counts, "h", "left")
    sums = spots.groupBy("t").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1) - F.lit(float(np.log10(model.scale or 1)))).alias("base_rare"), F.sum(F.col("c").isNotNull().cast("long")).alias("known_rare"))
    sums = sums.join(scored.groupBy("t").agg(F.count("*").alias("copies")), "t")
    joined = join_least(scored.drop("rest"), sums, ["t"], hot_of(sums, "copies", scored.count()), ["doc_id"])
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known_often") + F.expr("coalesce(known_rare div copies, 0)")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_often") + F.coalesce(F.col("base_rare") / F.col("copies"), F.lit(0.0))).alias("base_score"), "score", "bits_per_byte",
    )
