"""Jaccard join of word n-gram sets by chosen paths.

Every document's set of five-word shingles is embedded as 64 min-hash tokens (coordinate, value), so
that two sets share about J * 64 of them. A run starts with all sets in one bucket and splits a bucket
by sampled coordinates: each is chosen with probability 1 / (threshold * 64), decided by the bucket
alone, and a set moves on to the child of its value. Pairs at the threshold keep one shared child on
average, other pairs lose theirs quickly. Buckets of at most `block` sets, buckets whose sets largely
resemble each other (splitting would not part them) and all buckets of the last level are compared pair
by pair; the others split further with all their sets. The number of runs follows from the target recall
at the threshold.

Sets that are equal are one set from the start (copies are members of it, never pairs). What comes out
of a bucket is no pairs but a spanning forest of its close sets (told by two bits of each token), so rows
stay in proportion to the sets. The forests' components are families; within a family every pair is
verified on the whole shingle sets, and again only counts of links per set and a spanning forest of the
links leave a task; these become classes by connected components. Buckets and families are counted with
partial sums before anything is joined; beyond a bound they are dealt into blocks and each pair of blocks
is compared on its own, so no group is gathered beyond two blocks.

Defined cases: words are maximal runs without ASCII white space, as they are; a document with fewer
than `width` words has its whole sequence as its one shingle; documents without words (null, empty)
and rows with a null id are linked to nothing and form their own class; repeated rows are copies; rows
with the same id and different texts are documents of their own, each in the class of its text; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import Packing, cut, mix, slices, text_bytes, window_hashes, word_hashes, words
from pedigree.llm.components import components

TOKENS = 64
_FACTORS = mix(np.arange(101, 101 + TOKENS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOW32 = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Join:
    """Parameters of the join."""

    threshold: float = 0.8
    width: int = 5
    recall: float = 0.99
    block: int = 2048
    alike: float = 0.25
    depth: int = 4
    differ: int = 23
    family_block: int = 512
    family_shingles: int = 1 << 20

    @property
    def runs(self) -> int:
        """Runs so that a pair at the threshold meets with the target recall even on the longest path."""
        meet = 1.0
        for _ in range(self.depth):
            meet = 1 - math.exp(-meet)  # a pair at the threshold has a Poisson(1) number of shared children
        return math.ceil(math.log(1 - self.recall) / math.log(1 - meet))


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and where each row's begin."""
    data, offsets = text_bytes(column)
    starts, ends, first = words(data, offsets)
    sizes = np.diff(first)
    counts = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(sizes)), counts)
    at = first[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    return window_hashes(word_hashes(data, starts, ends), at, np.minimum(width, sizes[row])), begin


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    h, begin = _shingles(column, width)
    return [np.unique(h[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def _digest(members: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    with np.errstate(over="ignore"):
        return int(mix(members).sum(dtype=np.uint64).view(np.int64)), int(mix(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _summaries(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = _sets(part.column(1), width)
                rows = [r for r, s in enumerate(sets) if len(s)]
                digests = [_digest(sets[r]) for r in rows]
                flat = np.concatenate([sets[r] for r in rows]) if rows else np.zeros(0, np.uint64)
                begin = np.cumsum([0] + [len(sets[r]) for r in rows])[:-1]
                tokens = np.empty((len(rows), TOKENS), np.uint32)
                for i in range(TOKENS if rows else 0):
                    tokens[:, i] = np.minimum.reduceat(flat * _FACTORS[i], begin) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), part.column(2).take(pa.array(rows, pa.int64())), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array([len(sets[r]) for r in rows], pa.int64())],
                    names=["doc_id", "t", "u", "v", "tokens", "size"],
                )

    return run


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _sketch(tokens: np.ndarray, bit: int = 0) -> np.ndarray:
    return np.packbits((tokens >> np.uint32(bit) & np.uint32(1)).astype(np.uint8), axis=1).view(np.uint64)[:, 0].view(np.int64)


def _child(node: np.ndarray | np.uint64, coordinate: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    return mix(node ^ (np.uint64(coordinate) << np.uint64(40)) ^ value.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _roots(how: Join):
    """First level: the runs share out the coordinates, 1 / threshold each on average."""
    deck = np.argsort(mix(np.arange(TOKENS, dtype=np.uint64) + np.uint64(77)))
    per_run = 1 / how.threshold
    bounds = [round(r * per_run) for r in range(how.runs + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tokens = np.asarray(batch.column(0)), _tokens(batch.column(1))
            nodes = [_child(mix(np.uint64([r + 1])), int(deck[k % TOKENS]), tokens[:, deck[k % TOKENS]]) for r in range(how.runs) for k in range(bounds[r], bounds[r + 1])]
            yield _rows(np.concatenate(nodes), np.tile(ids, len(nodes)), *(np.tile(_sketch(tokens, k), len(nodes)) for k in (0, 1)))

    return run


def _split(how: Join):
    """A further level, for rows (node, rep, tokens)."""
    limit = int(2**64 / (how.threshold * TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, ids, tokens = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1)), _tokens(batch.column(2))
            sketch, more, found = _sketch(tokens), _sketch(tokens, 1), []
            for i in range(TOKENS):
                chosen = np.flatnonzero(mix(node ^ np.uint64(i * 0x9E3779B97F4A7C15 & (2**64 - 1))) < np.uint64(limit))
                found.append((_child(node[chosen], i, tokens[chosen, i]), ids[chosen], sketch[chosen], more[chosen]))
            yield _rows(*(np.concatenate(x) for x in zip(*found)))

    return run


_ROW = "node long, rep long, sketch long, more long"


def _rows(node: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *map(pa.array, columns)], names=["node", "rep", "sketch", "more"])


def _forest(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1; near(i, others) tells which of the others i is linked to."""
    left, edges = np.arange(n), []
    while len(left) > 1:
        open_, left = [int(left[0])], left[1:]
        while open_ and len(left):
            i = open_.pop()
            told = near(i, left)
            if told.any():
                hit = left[told].tolist()
                edges += [(i, j) for j in hit]
                open_ += hit
                left = left[~told]
    return edges


def _close(differ: int):
    """Per bucket, or pair of its blocks, a spanning forest of the sets that differ in at most `differ` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                rep, sketch, more = (np.asarray(members.values.field(k)) for k in range(3))
                order = np.argsort(rep)
                rep, sketch, more = rep[order], sketch[order], more[order]
                for i, j in _forest(len(rep), lambda i, k: np.bitwise_count(((sketch[k] ^ sketch[i]) | (more[k] ^ more[i])).view(np.uint64)) <= differ):
                    a.append(min(rep[i], rep[j]))
                    b.append(max(rep[i], rep[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, key: str, blocks: str, *columns: str) -> DataFrame:
    """(key, lo, hi, members): the rows of each key by pairs of its `blocks` blocks, which hold (columns, slot)."""
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return rows.groupBy(key, F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi")).agg(F.collect_list(F.struct(*columns, "slot")).alias("members"))


def _compared(sized: DataFrame, how: Join) -> DataFrame:
    """Forests of the close sets in the buckets of `sized`."""
    groups = _dealt(sized.withColumn("blocks", F.ceil(F.col("n") / how.block)), "node", "blocks", "rep", "sketch", "more")
    return groups.where(F.size("members") > 1).select("members").mapInArrow(_close(how.differ), "a long, b long")


def _candidates(reps: DataFrame, how: Join) -> DataFrame:
    """Distinct links (a < b) that join whatever is close in some bucket."""
    rows, found = reps.select("rep", "tokens").mapInArrow(_roots(how), _ROW), []
    for level in range(how.depth):
        counts = rows.groupBy("node").agg(F.count("*").alias("n"), F.min_by(F.struct("sketch", "more"), "rep").alias("first")).where("n > 1")
        counts = cut(counts)  # with a plain exchange on either side the join can be split where a bucket is hot
        sized = cut(rows.join(counts, "node"))
        if level == how.depth - 1 or counts.where(F.col("n") > how.block).isEmpty():
            found.append(_compared(sized, how))
            break
        near = F.bit_count(F.expr("(sketch ^ first.sketch) | (more ^ first.more)")) <= how.differ
        mixed = sized.where(F.col("n") > how.block).groupBy("node").agg(F.avg(near.cast("int")).alias("share")).where(F.col("share") < how.alike)
        mixed = cut(mixed.select("node"))
        found.append(_compared(sized.join(mixed, "node", "left_anti"), how))
        rest = sized.join(mixed, "node", "left_semi")
        if rest.isEmpty():
            break
        rows = rest.select("node", "rep").join(reps.select("rep", "tokens"), "rep").select("node", "rep", "tokens").mapInArrow(_split(how), _ROW)
    return reduce(DataFrame.unionByName, found).distinct()


def _packed_sets(width: int, unpack):
    """The shingle sets of the families' members as sorted 32-bit hashes; another text with the same id is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p for piece in unpack(batch) for p in slices(piece, 1)):
                own = part.column(2).to_pylist()
                rows, sets = [], []
                for r, members in enumerate(_sets(part.column(1), width)):
                    if len(members) and _digest(members)[0] == own[r]:
                        rows.append(r)
                        sets.append(np.unique((members & _LOW32).astype(np.uint32)).tobytes())
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(3).take(rows), pa.array(sets, pa.binary()), part.column(4).take(rows), part.column(5).take(rows)], names=["rep", "shingles", "family", "blocks"])

    return run


def _verify(threshold: float):
    """Per family, or pair of its blocks: rows (a, b) of a spanning forest of the verified links, rows (a, null) with the number n of links of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                ids, one = np.unique(np.asarray(members.values.field(0)), return_index=True)
                if len(ids) < 2:
                    continue
                slot = np.asarray(members.values.field(2))[one]
                sets = [np.frombuffer(members.values.field(1)[k].as_buffer(), np.uint32) for k in one.tolist()]
                size = np.array([len(x) for x in sets])
                begin = np.cumsum(size) - size
                _, flat = np.unique(np.concatenate(sets), return_inverse=True)
                held, linked = np.zeros(flat.max() + 1, bool), np.zeros((len(ids), len(ids)), bool)
                across = slot.min() < slot.max()
                for i in range(len(ids) - 1):
                    mine = flat[begin[i] : begin[i] + size[i]]
                    held[mine] = True
                    shared = np.add.reduceat(held[flat[begin[i + 1] :]], begin[i + 1 :] - begin[i + 1], dtype=np.int64)
                    held[mine] = False
                    linked[i, i + 1 :] = shared >= threshold * (size[i] + size[i + 1 :] - shared) - 1e-9
                    if across:
                        linked[i, i + 1 :] &= slot[i + 1 :] != slot[i]
                linked |= linked.T
                degree, forest = linked.sum(1), _forest(len(ids), lambda i, k: linked[i, k])
                some = np.flatnonzero(degree)
                a = np.concatenate([ids[[min(e) for e in forest]], ids[some]]) if forest else ids[some]
                b = [int(ids[max(e)]) for e in forest] + [None] * len(some)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(forest) + degree[some].tolist(), pa.int64())], names=["a", "b", "n"])

    return run


@dataclass(frozen=True)
class Found:
    """What the join finds.

    rows: (doc_id, t, rep, first, n_copies) for every row with words; t is a hash of its text, rep its set, first the
    least (doc_id, t) of the set. links: verified links (a < b) between sets that span each class. degrees: (rep,
    n_links), the number of all links of a set. sets: (rep, first).
    """

    rows: DataFrame
    links: DataFrame
    degrees: DataFrame
    sets: DataFrame


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))


def links(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> Found:
    """The join of all documents with all. A set goes by its least doc_id, or, where several sets have the same one, by a number from its digest."""
    docs = _named(docs, id_col, text_col)
    whole = cut(docs.where("doc_id is not null").mapInArrow(_summaries(how.width), "doc_id long, t long, u long, v long, tokens binary, size long"))
    sets = cut(whole.groupBy("u", "v").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.count("*").alias("n_copies"), F.first("tokens").alias("tokens"), F.first("size").alias("size")))
    shared = sets.groupBy(F.col("first.doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("shared"))
    own = F.when(F.col("shared"), -F.abs(F.xxhash64("u", "v"))).otherwise(F.col("first.doc_id"))
    reps = cut(sets.join(shared, sets["first.doc_id"] == shared["id"], "left").withColumn("rep", own).drop("id", "shared"))
    families = components(_candidates(reps, how)).select(F.col("node").alias("rep"), F.col("root").alias("family"))
    families = cut(families.join(reps.select("rep", "u", "size", F.col("first.doc_id").alias("doc_id")), "rep"))
    blocks = families.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / how.family_block), F.ceil(F.sum("size") / how.family_shingles)).alias("blocks"))
    families = cut(families.join(blocks, "family").select("doc_id", "u", "rep", "family", "blocks"))
    packing = Packing(docs)
    needed = packing.pack().join(families, "doc_id").select("doc_id", "packed", "u", "rep", "family", "blocks")
    packed = needed.mapInArrow(_packed_sets(how.width, packing.opener()), "rep long, shingles binary, family long, blocks long")
    found = cut(_dealt(packed, "family", "blocks", "rep", "shingles").select("members").mapInArrow(_verify(how.threshold), "a long, b long, n long"))
    degrees = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    rows = whole.select("doc_id", "t", "u", "v").join(reps.select("u", "v", "rep", "first", "n_copies"), ["u", "v"]).select("doc_id", "t", "rep", "first", "n_copies")
    return Found(rows, found.where("b is not null").select("a", "b"), degrees, reps.select("rep", "first"))


def _classed(docs: DataFrame, how: Join, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, first, class_first, n_copies, n_links) for every row with words."""
    found = links(docs, how, id_col, text_col)
    roots = components(found.links).withColumnRenamed("node", "rep").join(found.sets, "rep")
    told = roots.join(roots.groupBy("root").agg(F.min("first").alias("class_first")), "root").join(found.degrees, "rep", "left")
    known = found.rows.join(cut(told.select("rep", "class_first", "n_links")), "rep", "left")
    return known.select("doc_id", "t", "first", F.coalesce("class_first", "first").alias("class_first"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), set_id (the least id with the same set), n_copies of the set, n_links of the set to others."""
    known = _classed(docs, how, id_col, text_col).select("doc_id", F.col("class_first.doc_id").alias("class_id"), F.col("first.doc_id").alias("set_id"), "n_copies", "n_links")
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]") | F.col("doc_id").isNull()
    rest = _named(docs, id_col, text_col).where(blank)
    return known.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")))


def keep_first(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, whole and unchanged, of the first document of each class: the least id, and of several texts with that id one.

    Of rows with the same id and the same text one stays.
    """
    later = _classed(docs, how, id_col, text_col).where(F.struct("doc_id", "t") != F.col("class_first")).select(F.col("doc_id").alias("later_id"), F.col("t").alias("later_t")).distinct()
    id_, t = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    marked = docs.select(F.struct("*").alias("row"), id_.alias("row_id"), t.alias("row_t"))
    kept = marked.join(later, (F.col("row_id") == F.col("later_id")) & (F.col("row_t") == F.col("later_t")), "left_anti")
    return kept.dropDuplicates(["row_id", "row_t"]).select("row.*")
