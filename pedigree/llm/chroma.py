"""Media columns: chroma audio fingerprints, and search by offset histograms and bit errors.

A recording (mono samples, or anything that `decode` turns into samples) is cut into overlapping
frames; each frame's spectrum is folded into twelve pitch classes. Over the image of pitch classes and
time an integral image gives the sums of rectangles, sixteen filters compare rectangles at every time,
each result is quantised to two bits in Gray code, and the sixteen codes are packed into one 32-bit
integer per time.

Search takes some recordings as queries against all. Equal fingerprints are one class from the start,
so copies are members, never pairs. A query class looks up all its keys (the filters' signs at three
times) in the index of all classes, at every place where a key begins; the shared keys' offsets are counted
in a histogram for each pair, all offsets with at least `near_top` of the highest count are aligned, and the
least share of bit errors decides. No key and no candidate is left out. The two sides of the key join are
plain exchanges, so adaptive execution splits a key that very many recordings share; what comes out of it is
as large as the number of query recordings with that key times the number of all recordings with it.

Defined cases: null or too short media have an empty fingerprint, form their own class each and match
nothing; rows with a null id are left out of the search; repeated rows are copies; recordings of any
length are fingerprinted whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import cut

#: Rectangles of the filters by rule: four shapes at four places in the octave, 4 to 16 frames long.
SHAPES = ("level", "time", "pitch", "cross")
FILTERS = [(SHAPES[k % 4], (5 * k) % 12, 3 + (k * 7) % 6, 4 + 4 * (k // 4)) for k in range(16)]
SPAN = max(f[3] for f in FILTERS)


@dataclass(frozen=True)
class Audio:
    """Frames: sample rate, samples of a frame, samples from one frame to the next, and the quantiser's step."""

    rate: int = 4000
    frame: int = 1024
    hop: int = 500
    step: float = 0.25


@dataclass(frozen=True)
class Search:
    """Least shared keys at one offset, share of the highest count from which on an offset is aligned, bit errors per bit, least overlap in integers."""

    least_shared: int = 1
    near_top: float = 0.5
    bit_errors: float = 0.2
    overlap: int = 16


@lru_cache(maxsize=8)
def _fold(how: Audio) -> np.ndarray:
    """Bins of the spectrum to pitch classes, weights that fall off from each semitone; 55 Hz to 1,760 Hz."""
    hz = np.fft.rfftfreq(how.frame, 1 / how.rate)
    out = np.zeros((len(hz), 12), np.float32)
    used = np.flatnonzero((hz >= 55) & (hz <= 1760))
    note = 12 * np.log2(hz[used] / 55)
    low, part = np.floor(note).astype(int), note - np.floor(note)
    out[used, low % 12] += 1 - part
    out[used, (low + 1) % 12] += part
    return out


@lru_cache(maxsize=8)
def _window(how: Audio) -> np.ndarray:
    return np.hanning(how.frame).astype(np.float32)


def chroma(samples: np.ndarray, how: Audio) -> np.ndarray:
    """Frames by pitch classes, each frame of length one."""
    if len(samples) < how.frame:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, how.frame)[:: how.hop]
    image = []
    for k in range(0, len(frames), 2048):  # a long recording is not held as spectra at once
        power = np.abs(np.fft.rfft(frames[k : k + 2048] * _window(how), axis=1)).astype(np.float32) ** 2
        image.append(power @ _fold(how))
    image = np.concatenate(image)
    norm = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(norm > 1e-3, image / np.maximum(norm, 1e-9), 0)


def fingerprint(samples: np.ndarray | None, how: Audio = Audio()) -> np.ndarray:
    """One 32-bit integer per time at which all filters fit."""
    if samples is None:
        return np.zeros(0, np.uint32)
    image = chroma(np.asarray(samples, np.float32), how)
    times = len(image) - SPAN + 1
    if times < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([image, image], 1), 0), 1)  # pitch classes are a circle

    def box(first: int, last: int, low: int, high: int) -> np.ndarray:
        span = total[last : last + times] - total[first : first + times]
        return span[:, high] - span[:, low]

    out = np.zeros(times, np.uint32)
    for shape, low, height, length in FILTERS:
        half, middle, high = length // 2, low + height // 2, low + height
        if shape == "level":
            a, b = box(0, length, low, high), box(0, length, high, low + 12) * height / (12 - height)
        elif shape == "time":
            a, b = box(0, half, low, high), box(half, length, low, high)
        elif shape == "pitch":
            a, b = box(0, length, low, middle), box(0, length, middle, high) * (middle - low) / (high - middle)
        else:
            a = box(0, half, low, middle) + box(half, length, middle, high)
            b = box(0, half, middle, high) + box(half, length, low, middle)
        value = np.log1p(a) - np.log1p(b)
        level = (value > -how.step).astype(np.uint32) + (value > 0) + (value > how.step)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)
    return out


def fingerprints(media: DataFrame, id_col: str, media_col: str, decode: Callable[[object], np.ndarray | None], how: Audio = Audio()) -> DataFrame:
    """(rec_id, prints array<int>): one row per recording; decoding and fingerprinting are done one recording at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(decode(x.as_py()) if x.is_valid else None, how).view(np.int32) for x in batch.column(1)]
            ends = np.cumsum([0] + [len(p) for p in prints]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *prints])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["rec_id", "prints"])

    return media.select(F.col(id_col).cast("long").alias("rec_id"), F.col(media_col).alias("media")).mapInArrow(run, "rec_id long, prints array<int>")


def _signs(prints: np.ndarray) -> np.ndarray:
    """The upper bit of each filter's code: 16 bits."""
    out = np.zeros(len(prints), np.uint64)
    for k in range(16):
        out |= (prints >> np.uint64(2 * k + 1) & np.uint64(1)) << np.uint64(k)
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, class_id, pos): signs at a time and four and eight times later, wherever they differ from those a time before."""
    for batch in batches:
        keys, ids, places = [], [], []
        for rec, prints in zip(batch.column(0).to_pylist(), batch.column(1)):
            p = np.asarray(prints.values, np.int32).view(np.uint32).astype(np.uint64)
            signs = _signs(p)
            key = signs[:-8] << np.uint64(32) | signs[4:-4] << np.uint64(16) | signs[8:]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key = key[first]
            keys.append(key.view(np.int64))
            places.append(first.astype(np.int32))
            ids.append(np.full(len(key), rec))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))], names=["key", "class_id", "pos"])


def _compare(how: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for offsets, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                x, y = (np.asarray(v.values, np.int32).view(np.uint32) for v in (x, y))
                told = []
                for offset in offsets:
                    a, b = x[max(0, offset) :], y[max(0, -offset) :]
                    n = min(len(a), len(b))
                    if n >= how.overlap:
                        told.append((float(np.bitwise_count(a[:n] ^ b[:n]).sum() / (32 * n)), abs(offset), offset))
                best.append(min(told, default=(2.0, 0, 0)))
            keep = pa.array([e <= how.bit_errors for e, _, _ in best], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([o for _, _, o in best], pa.int32()), pa.array([e for e, _, _ in best], pa.float64())], names=["query_id", "class_id", "offset", "bit_errors"])
            yield out.filter(keep)

    return run


def search(prints: DataFrame, is_query: str = "rec_id % 50 = 0", how: Search = Search()) -> tuple[DataFrame, DataFrame]:
    """(members, matches): rec_id -> class_id, and the matches (query_id, class_id, offset, bit_errors) between class representatives.

    `offset` integers of the query precede the match's first one. A class is a query if a member is.
    """
    prints = prints.where("rec_id is not null")
    digest = F.struct(F.xxhash64("prints").alias("u"), F.hash("prints").alias("v"), F.when(F.size("prints") == 0, F.col("rec_id")).alias("own"))
    sized = prints.select("rec_id", digest.alias("digest"), "prints")
    classes = cut(sized.groupBy("digest").agg(F.min("rec_id").alias("class_id"), F.max(F.expr(is_query)).alias("query"), F.first("prints").alias("prints")))
    members = sized.select("rec_id", "digest").join(classes.select("digest", "class_id"), "digest").select("rec_id", "class_id")
    keys = classes.where(F.size("prints") > 8).select("class_id", "prints").mapInArrow(_keys, "key long, class_id long, pos int")
    keys = cut(keys)
    asked = keys.join(classes.where("query").select("class_id"), "class_id", "left_semi").select("key", F.col("class_id").alias("query_id"), F.col("pos").alias("at"))
    shared = asked.join(keys, "key").where("query_id <> class_id").groupBy("query_id", "class_id", (F.col("at") - F.col("pos")).alias("offset")).agg(F.count("*").alias("n"))
    told = shared.groupBy("query_id", "class_id").agg(F.max("n").alias("top"), F.collect_list(F.struct("n", "offset")).alias("all")).where(F.col("top") >= how.least_shared)
    pairs = told.select("query_id", "class_id", F.expr(f"transform(filter(all, x -> x.n >= {how.near_top} * top), x -> x.offset)").alias("offsets"))
    bodies = classes.select("class_id", "prints")
    both = pairs.join(bodies.withColumnRenamed("class_id", "query_id").withColumnRenamed("prints", "a"), "query_id").join(bodies.withColumnRenamed("prints", "b"), "class_id")
    matches = both.select("query_id", "class_id", "offsets", "a", "b").mapInArrow(_compare(how), "query_id long, class_id long, offset int, bit_errors double")
    return members, matches


def identify(prints: DataFrame, is_query: str = "rec_id % 50 = 0", how: Search = Search()) -> DataFrame:
    """One row per recording: rec_id, class_id (least id with an equal fingerprint), is_query, n_matches (matching other classes) and the nearest of them."""
    members, matches = search(prints, is_query, how)
    nearest = matches.groupBy("query_id").agg(F.count("*").alias("n_matches"), F.min(F.struct("bit_errors", "class_id", "offset")).alias("best"))
    joined = members.withColumn("is_query", F.expr(is_query)).join(nearest.withColumnRenamed("query_id", "class_id"), "class_id", "left")
    own = lambda c: F.when(F.col("is_query"), c)
    return joined.select(
        "rec_id", "class_id", "is_query", own(F.coalesce("n_matches", F.lit(0))).alias("n_matches"), own(F.col("best.class_id")).alias("best_class_id"),
        own(F.col("best.offset")).alias("best_offset"), own(F.col("best.bit_errors")).alias("best_bit_errors"),
    )


@lru_cache(maxsize=8)
def _notes(how: Audio, note_frames: int) -> np.ndarray:
    """The samples of the notes from an octave below 330 Hz to an octave above, each with its fifth."""
    hz = 330 * 2 ** (np.arange(-12, 13) / 12)
    t = np.arange(note_frames * how.hop) / how.rate
    return (8000 * (np.sin(2 * np.pi * hz[:, None] * t) + 0.5 * np.sin(3 * np.pi * hz[:, None] * t))).astype(np.int16)


def render(values: list[float] | None, how: Audio = Audio(), note_frames: int = 2) -> np.ndarray | None:
    """A recording for a row without media: its numbers as a melody, one note each with its fifth.

    The pitch follows the number's size relative to the row's spread, so that close rows sound alike.
    """
    if not values:
        return None
    x = np.nan_to_num(np.array(values, np.float64))
    steps = np.clip(np.round(6 * x / (np.sqrt((x * x).mean()) + 1e-12)), -12, 12)
    return _notes(how, note_frames)[steps.astype(np.int64) + 12].ravel()
