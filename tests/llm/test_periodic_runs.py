import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from pedigree.llm import periodic_runs

DOCS = "doc_id long, text string"


def brute_runs(words):
    """All maximal runs by comparing words at every distance."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(words[i + k : i + length] == words[i : i + length - k] for k in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_refinement_matches_brute_force():
    rng = random.Random(13)
    code = np.random.default_rng(1).integers(0, 1 << 62, 9).astype(np.uint64)
    found = 0
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(0, 5)):
            n, letters = rng.choice([0, 1, 5, 6, 7, 20, 50, 90]), rng.choice([1, 2, 3, 9])
            words = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                p, s = rng.randint(1, max(1, n // 4)), rng.randrange(n)
                for i in range(s, min(n, s + rng.randint(0, n))):
                    words[i] = words[s + (i - s) % p]
            texts.append(words)
        bounds = np.cumsum([0] + [len(t) for t in texts])
        got = periodic_runs.find_runs(code[np.array([w for t in texts for w in t], int)], bounds)
        want = [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t)]
        assert list(zip(*(x.tolist() for x in got))) == want
        found += len(want)
    assert found > 300


def test_fibonacci_words_and_powers_have_their_runs_only():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for words in (b, [0] * 300, [0, 1, 0] * 100, ([0, 1] * 40 + [2]) * 5):
        got = periodic_runs.find_runs(np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([0, len(words)]))
        assert list(zip(*(x.tolist() for x in got[1:]))) == brute_runs(words)


def test_query_matches_brute_force(spark, sf_dir):
    from pedigree.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 30_000}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert set(docs) <= set(got)
    for doc_id, text in docs.items():
        assert got[doc_id] == brute_row(doc_id, text), doc_id
    assert sum(r[0] for r in got.values()) > 5


def test_defined_cases(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "ß " * 50, "x\x1cy " * 9, "k" * 100_000] + [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, "b b b b b b b"), (3, "b b b b b b b"), (None, "c c c c c c c")]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_runs", F.lit("clash")).withColumn("period", F.lit(None).cast("string"))
    got = sorted((tuple(r) for r in periodic_runs.digest(df).collect()), key=repr)
    want = [(i, *brute_row(i, t)) for i, t in rows if i is not None]
    want.append((None, 1, 0, 7, 1, 7000, hashlib.sha256(b"0,7,1\n").hexdigest(), hashlib.sha256(b"c").hexdigest()))
    assert got == sorted(want, key=repr)
    assert periodic_runs.digest(df.limit(0)).count() == 0


def test_collapse_keeps_one_period(spark):
    df = spark.createDataFrame([(7, "s " + "x y z " * 5 + "x e"), (8, "plain  words\nhere")], DOCS)
    got = {r.doc_id: r for r in periodic_runs.collapse(df).collect()}
    assert got[7].kept_text == "s x y z e" and [tuple(r) for r in got[7].runs] == [(1, 16, 3)]
    assert got[8].kept_text == "plain words here" and got[8].runs == []


def test_a_very_long_run_takes_linear_time():
    words = np.full(40_000, 5, np.uint64)
    assert [x.tolist() for x in periodic_runs.find_runs(words, np.array([0, len(words)]))] == [[0], [0], [40_000], [1]]
