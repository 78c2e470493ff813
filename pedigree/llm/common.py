"""Helpers shared by the corpus operators.

Everything here is small and stateless: table reading, checkpoints in the folder that the
cluster shares, and vectorised hashing of words and windows inside Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedigree.session import cut as cut
from pedigree.session import shared_folder as shared_folder

#: Bytes of text that the numpy kernels look at in one go; a longer document is one slice of its own.
SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table `name` under `sf_dir`, restricted to `columns` when they are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def hot_of(least: DataFrame, n: str, bound: int, hot_keys: int = 4000) -> DataFrame:
    """The rows for keys with more than bound / hot_keys rows (column `n`): at most `hot_keys`, as there are at most `bound` rows."""
    return least.where(F.col(n) > bound // hot_keys)


def join_least(rows: DataFrame, least: DataFrame, on: list[str], hot: DataFrame, spread: list[str]) -> DataFrame:
    """`rows` with the columns of `least`, which has one row for each key of `on`; rows without a partner have nulls.

    `hot` has some keys with the same columns; as a bounded table it is sent to all tasks. Rows with
    these keys take a made-up first key (a long) from the columns of `spread` and so are dealt over all
    tasks in the join of the others. Keep the columns of both as they come out of one aggregate, so that
    it is computed once.
    """
    values = [c for c in least.columns if c not in on]
    told = F.broadcast(hot.select(*on, F.lit(True).alias("hot_"), *[F.col(c).alias(f"hot_{c}") for c in values]))
    tagged = rows.join(told, on, "left")
    key = [F.when(F.col("hot_"), F.xxhash64(*spread)).otherwise(F.col(c)).alias(f"key_{c}") if c == on[0] else F.col(c).alias(f"key_{c}") for c in on]
    rest = least.select(*[F.col(c).alias(f"key_{c}") for c in on], *values)
    joined = tagged.select(*tagged.columns, *key).join(rest, [f"key_{c}" for c in on], "left")
    return joined.select(*rows.columns, *[F.when(F.col("hot_"), F.col(f"hot_{c}")).otherwise(F.col(c)).alias(c) for c in values])


class Packing:
    """Compression of texts for a shuffle, with a dictionary from a bounded sample of them.

    At most 600 texts of 4,000 characters are looked at; the dictionary has 64 kB.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.source = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")
        sample = [r["x"].encode() for r in self.source.selectExpr("substring(text, 1, 4000) x").where("length(x) > 100").limit(600).collect()]
        try:
            self.dictionary = zstandard.train_dictionary(1 << 16, sample).as_bytes() if sum(map(len, sample)) > 1 << 20 else b""
        except zstandard.ZstdError:  # too little variety for one
            self.dictionary = b""

    def pack(self) -> DataFrame:
        """(doc_id, packed)."""
        dictionary = self.dictionary

        def run(batches):
            press = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=6)
            for batch in batches:
                packed = [press.compress(x.as_py().encode()) if x.is_valid else None for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

        return self.source.mapInArrow(run, "doc_id long, packed binary")

    def opener(self):
        """A function that turns the second column of a batch into texts again, some rows at a time."""
        dictionary = self.dictionary

        def unpack(batch: pa.RecordBatch):
            press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
            for k in range(0, batch.num_rows, 300):
                part = batch.slice(k, 300)
                texts = [press.decompress(x.as_py()).decode() if x.is_valid else None for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *part.columns[2:]], names=[part.schema.names[0], "text", *part.schema.names[2:]])

        return unpack


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows that hold about `limit` bytes of text; a longer text is alone in its run."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    first = 0
    while first < batch.num_rows:
        floor = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, floor + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row boundaries in them; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept per worker."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        n = max(n, SLICE_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return _POWERS[base]


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for every pair, from one running sum."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, special: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in `data` (words: maximal runs without ASCII white space) and, per row, the first word's number."""
    gap = _SPACE[data] if special is None else special[data]
    inner = ~gap
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = True
    after[cuts - 1] = True
    starts, ends = np.flatnonzero(inner & before), np.flatnonzero(inner & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word."""
    return runs_hash(_LETTER[data], starts, ends, _BASE)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, length: int | np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the `length` words from each start; lanes are independent."""
    return runs_hash(mix(hashes + _U(lane * 0x632BE59BD9B4E019 & (2**64 - 1))), starts, starts + length, _BASES[lane])
