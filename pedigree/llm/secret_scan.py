"""Secret scans: fixed formats, plus a randomness test battery for tokens of unknown format.

The fixed formats (assignments, access keys, hexadecimal runs) are matched by pattern. Every other
long token is tested for randomness within the encoding that its characters imply: a chi-squared
test of a uniform alphabet, a runs test about the alphabet's middle and a test of serial
correlation, combined by Fisher's method. The result is a measure of how random a token looks, not yet
a decision: short ordinary tokens look random now and then.

The hypothesis to be rejected is that a token is ordinary. How random ordinary characters look is
measured on the corpus: the letters and digits of every text, run together as in long names (each word
with a capital) and cut into pieces of the length classes, go through the same battery in every encoding. A token's p-value is the share of ordinary pieces of its
encoding and length class that look as random as it does, and Benjamini-Hochberg control over all tokens
of that encoding and class bounds the share of ordinary tokens among those reported as `random`. Long
tokens so are told apart easily, short ones only if they are many or their alphabet is wide.

Two passes over the texts and one small aggregate (encodings x length classes x bins, a fixed
bound) between them; the texts are never shuffled. Pieces made by rule (`PRIOR`) stand for ordinary
text where the corpus has little.

Defined cases: null text is empty; an empty table gives no rows; repeated rows are scanned one by
one; offsets count code points, the end is exclusive; a run of token characters that no alphabet holds
(both + or / and - or _) is tested in parts; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import slices, text_bytes

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is the whole run
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_STANDARD, _URL_SAFE = re.compile(r"[A-Za-z0-9+/]{20,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{20,}={0,2}")
_KEYWORDS = ("passw", "secret", "token", "api")

#: Alphabets by encoding, the narrowest that holds a token's characters is inferred.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "lower36": string.digits + string.ascii_lowercase,
    "upper36": string.digits + string.ascii_uppercase,
    "letters": string.ascii_uppercase + string.ascii_lowercase,
    "base62": string.ascii_uppercase + string.ascii_lowercase + string.digits,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
}
_INDEX = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ALPHABETS.items()}
_SETS = {name: frozenset(alphabet) for name, alphabet in ALPHABETS.items()}
#: Length classes start here; a stratum is an encoding and a class.
LENGTH_CLASSES = (20, 28, 40, 64, 128)
#: Bins of the battery's -ln(p), by which the step-up procedure is run; the last holds all smaller p.
BINS_PER_E, BINS = 16, 1024
#: Ordinary pieces made by rule, of each length class: letters with Zipf's frequencies.
PRIOR = 1000


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed formats, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if any(_HEX.search(w) for w in text.split() if len(w) >= 16):
        found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def candidates(text: str, base: list[tuple[int, str, int]]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, token, encoding) of the long tokens that no fixed format touches."""
    if not any(len(w) >= 20 for w in text.split()):
        return
    for m in _TOKEN.finditer(text):
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        encoding = infer_encoding(m[0])
        if encoding:
            yield m.start(), m.end(), m[0], encoding
            continue
        for part in list(_STANDARD.finditer(m[0])) or list(_URL_SAFE.finditer(m[0])):
            yield m.start() + part.start(), m.start() + part.end(), part[0], infer_encoding(part[0])


def infer_encoding(token: str) -> str | None:
    """The narrowest alphabet that holds the token."""
    seen = set(token.rstrip("="))
    return next((name for name, chars in _SETS.items() if seen <= chars), None)


_GRID = np.linspace(-8, 37, 9001)
_LOG_TAIL = np.array([math.log(0.5 * math.erfc(z / math.sqrt(2))) for z in _GRID.tolist()])


def _surprise(z: np.ndarray) -> np.ndarray:
    """-ln of the upper tail of the normal distribution; beyond 37 as at 37."""
    return -np.interp(z, _GRID, _LOG_TAIL)


def battery(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """-ln of Fisher's combination of the three tests' p-values, for runs of values 0..k-1 that follow each other without gaps."""
    n, piece = sizes.astype(np.float64), np.repeat(np.arange(len(sizes)), sizes)
    total = lambda x: np.add.reduceat(x.astype(np.float64), starts)
    counts = np.bincount(piece * k + values, minlength=len(sizes) * k).reshape(-1, k)
    chi = (counts.astype(np.float64) ** 2).sum(1) * k / n - n
    df = k - 1
    uniform = _surprise((np.cbrt(chi / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = values >= k / 2
    inner = piece[1:] == piece[:-1]
    ups = total(high)
    downs = n - ups
    mean = 1 + 2 * ups * downs / n
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    changes = total(np.concatenate([[False], inner & (high[1:] != high[:-1])]))
    both = (ups > 0) & (downs > 0)
    runs = np.where(both, _surprise(np.abs(1 + changes - mean) / np.sqrt(var)), n * math.log(2)) - math.log(2)
    off = values - (total(values) / n)[piece]
    spread = total(off * off)
    near = total(np.concatenate([[0.0], off[1:] * off[:-1] * inner]))
    serial = np.where(spread > 0, near / np.maximum(spread, 1e-9), 1.0)
    half = uniform + np.maximum(runs, 0) + np.maximum(_surprise(np.abs(serial) * np.sqrt(n)) - math.log(2), 0)
    return half - np.log1p(half + half * half / 2)


def randomness(token: str, encoding: str) -> float:
    """The battery's -ln(p) of one token, under the hypothesis of random characters: small if it looks random."""
    values = np.array([_INDEX[encoding][c] for c in token.rstrip("=")])
    return float(battery(values, np.zeros(1, np.int64), np.array([len(values)]), len(ALPHABETS[encoding]))[0])


#: Letters and digits as numbers in an alphabet of one case (a to z, 0 to 9) and in one of two (A to Z, a to z, 0 to 9).
_ONE_CASE, _TWO_CASES = np.full(256, 255, np.uint8), np.full(256, 255, np.uint8)
for _k, _c in enumerate(string.ascii_lowercase + string.digits):
    _ONE_CASE[[ord(_c), ord(_c.upper())]] = _k
for _k, _c in enumerate(string.ascii_uppercase + string.ascii_lowercase + string.digits):
    _TWO_CASES[ord(_c)] = _k
_CYCLE = np.cumsum((0,) + LENGTH_CLASSES)


def ordinary(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """(stratum, -ln(p) of its pieces): each text's words run together as in a long name, cut into pieces of all length classes in turn, in every encoding.

    A character that an alphabet lacks counts as the one at its number modulo the alphabet's size.
    """
    known = _ONE_CASE[data] < 255
    named = data.copy()  # words run together as in names, each with a capital
    named[known & ~np.concatenate([[False], known[:-1]]) & (data >= 97)] -= 32
    at = np.flatnonzero(known)
    bounds = np.searchsorted(at, offsets)
    cycles = -(-np.diff(bounds) // _CYCLE[-1])
    text = np.repeat(np.arange(len(cycles)), cycles)
    first = bounds[:-1][text] + (np.arange(len(text)) - (np.cumsum(cycles) - cycles)[text]) * _CYCLE[-1]
    for j, size in enumerate(LENGTH_CLASSES):
        begin = first + _CYCLE[j]
        begin = begin[begin + size <= bounds[1:][text]]
        if len(begin):
            chars = named[at[begin[:, None] + np.arange(size)]].ravel()
            starts, sizes = np.arange(len(begin)) * size, np.full(len(begin), size)
            for name, alphabet in ALPHABETS.items():
                two = len(set(alphabet.lower())) < len(alphabet)
                values = (_TWO_CASES if two else _ONE_CASE)[chars].astype(np.int64) % len(alphabet)
                yield f"{name}:{size}", battery(values, starts, sizes, len(alphabet))


def _prior() -> Counter:
    """The histogram of the ordinary pieces made by rule."""
    rng = np.random.default_rng(0)
    chance = 1 / np.arange(1, 27)
    letters = np.frombuffer(b"etaoinshrdlcumwfgypbvkjxqz", np.uint8)[rng.choice(26, (PRIOR * _CYCLE[-1] // 5, 6), p=chance / chance.sum())]
    letters[:, -1] = 32
    found: Counter = Counter()
    for stratum, p in ordinary(letters.ravel(), np.array([0, letters.size])):
        found.update((stratum, at) for at in _bins(p).tolist())
    return found


def _stratum(token: str, encoding: str) -> str:
    return f"{encoding}:{max(x for x in LENGTH_CLASSES if len(token) >= x)}"


def _bins(surprise: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(surprise, 0) * BINS_PER_E, BINS - 1).astype(np.int64)


def random_bins(tokens: dict[tuple[str, int], int], pieces: dict[tuple[str, int], int], level: float) -> dict[str, int]:
    """Per stratum the bin below which tokens are reported: ordinariness is rejected by the step-up procedure on the share of ordinary pieces in the bin or below."""
    seen, common = ({s: np.zeros(BINS, np.int64) for s in {s for s, _ in x}} for x in (tokens, pieces))
    for table, x in ((seen, tokens), (common, pieces)):
        for (stratum, at), n in x.items():
            table[stratum][at] += n
    out = {}
    for stratum, counts in seen.items():
        null = common.get(stratum, np.zeros(BINS, np.int64))
        p = (1 + np.cumsum(null)) / (1 + null.sum())
        below = np.cumsum(counts)
        passed = np.flatnonzero(p * counts.sum() <= level * below)
        out[stratum] = int(passed[-1]) + 1 if len(passed) else 0
    return out


def thresholds(docs: DataFrame, text_col: str = "text", level: float = 0.05) -> dict[str, int]:
    """First pass: the corpus-wide histograms of the battery over tokens and over ordinary pieces, and the bins that are reported."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        pieces: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0):
                data, offsets = text_bytes(part.column(0))
                for stratum, p in ordinary(data, offsets):
                    pieces[stratum] = pieces.get(stratum, 0) + np.bincount(_bins(p), minlength=BINS)
                for text in part.column(0):
                    text = text.as_py() or ""
                    if any(len(w) >= 20 for w in text.split()):
                        for _, _, token, encoding in candidates(text, base_spans(text)):
                            tokens[_stratum(token, encoding), int(_bins(np.array(randomness(token, encoding))))] += 1
        rows = [(True, s, at, n) for (s, at), n in tokens.items()] + [(False, s, at, int(x[at])) for s, x in pieces.items() for at in np.flatnonzero(x).tolist()]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.string(), pa.int32(), pa.int64()))], names=["token", "stratum", "bin", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token boolean, stratum string, bin int, n long")
    # At most twice encodings x classes x bins rows: a fixed bound, whatever the corpus holds.
    rows = counted.groupBy("token", "stratum", "bin").agg(F.sum("n").alias("n")).collect()
    pieces = _prior()
    pieces.update({(r["stratum"], r["bin"]): r["n"] for r in rows if not r["token"]})
    return random_bins({(r["stratum"], r["bin"]): r["n"] for r in rows if r["token"]}, pieces, level)


def spans_of(text: str, reported: dict[str, int]) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The fixed-format spans and the random ones of one text."""
    base = base_spans(text)
    more = []
    for start, end, token, encoding in candidates(text, base):
        bound = reported.get(_stratum(token, encoding), 0)
        if bound and _bins(np.array(randomness(token, encoding))) < bound:
            more.append((start, "random", end))
    return base, more


def _told(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = 0.05) -> DataFrame:
    """One row per document: doc_id, counts by kind, the digest of the fixed-format spans, all spans."""
    reported = thresholds(docs, text_col, level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, more = spans_of(text.as_py() or "", reported)
                kinds = Counter(kind for _, kind, _ in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], len(more), hashlib.sha256(_told(base).encode()).hexdigest(), _told(base + more)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[secret]", level: float = 0.05) -> DataFrame:
    """The same rows and columns with every secret replaced by `mark`; the length column follows where there is one.

    A null text stays null. All other columns pass as they are.
    """
    reported = thresholds(docs, text_col, level)
    names = docs.columns
    at, size_at = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, more = spans_of(text, reported)
        out, end = [], 0
        for start, _, stop in sorted(base + more):
            if start >= end:
                out += [text[end:start], mark]
            end = max(end, stop)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [clean(x) for x in old]
            columns[at] = pa.array(new, columns[at].type)
            if size_at is not None:
                sizes = columns[size_at].to_pylist()
                columns[size_at] = pa.array([len(b) if a != b else s for a, b, s in zip(old, new, sizes)], columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
