"""op8's topics and mixer are fitted to all training texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pedigree.llm import context_mixing as cm


def test_topics_see_whole_texts(spark):
    texts = ["aa bb " * 800 + w * 3000 for w in ("cc ", "dd ") for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _ = cm.fit(df)
    words = cm._Words(df.select("text").toArrow()["text"].combine_chunks())
    topics = model.topics.of(words)
    assert len(set(topics[:20])) == len(set(topics[20:])) == 1 and topics[0] != topics[-1]


def test_the_mixer_learns_from_every_occurrence(spark, monkeypatch):
    texts = ["one two three, two. three three"] * 30 + [f"w{k} two" for k in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    learn = cm._learn

    def noted(spelled, sent, steps):
        code = sent.value[0]
        found = spelled.select("word", "topic", *cm._NAMES, "d").mapInArrow(cm._hits(sent, cm.Gates()), "at int, value double").where(F.col("at") < cm._GATES * cm._MAP_CELLS)
        seen.append((code, found.agg(F.sum("value")).first()[0]))
        return learn(spelled, sent, steps)

    monkeypatch.setattr(cm, "_learn", noted)
    cm.fit(df)
    train = [r.text for r in df.where(~cm.held_out_column("doc_id", 10)).collect()]
    (code, total), = seen
    assert np.isclose(total, sum(int(code.length[np.frombuffer((w + " ").encode(), np.uint8)].sum()) for t in train for w in t.split()), rtol=1e-5)


def test_common_beginnings_are_spelled_once_with_all_their_counts():
    rng = np.random.default_rng(8)
    words = sorted({bytes(rng.choice(list(b"ab"), rng.integers(1, 14))) for _ in range(400)} | {b"c" * k for k in (23, 24, 25, 26, 60)})
    topics, n, d = np.repeat([1, 2], len(words)), rng.integers(0, 9, (2 * len(words), cm.KINDS)), rng.integers(1, 5, 2 * len(words))
    n[:, 0] += 1
    batch = pa.RecordBatch.from_arrays([pa.array(words * 2, pa.binary()), pa.array(topics), *(pa.array(x) for x in n.T), pa.array(d)], names=["word", "topic", *cm._NAMES, "d"])
    code = cm.Code(np.ones(256, np.int64))
    size = int(cm._OFFSETS[-1])
    once = [np.zeros((3, 2 * size)) for _ in range(2)]
    decisions = 0
    for bit, slots, weight, of_kind, of_word in cm._spellings(code, iter([batch.slice(0, 300), batch.slice(300)])):
        decisions += len(bit)
        for s in slots:
            for k, x in enumerate((weight, weight * of_kind, weight * of_word)):
                once[0][k] += np.bincount(s + bit * size, x, 2 * size)
    row, kind = np.nonzero(n)
    data, starts, ends = cm._joined(words * 2)
    times, bit, slots = code.events(data, starts[row], ends[row], kind, topics[row], np.zeros(len(row), np.int64))
    of = np.repeat(np.arange(len(row)), (ends - starts + 1)[row]).repeat(times)
    count = n[row, kind]
    for s in slots:
        for k, x in enumerate((count, count * count / d[row], count * (n.sum(1) / d)[row])):
            once[1][k] += np.bincount(s + bit * size, x[of], 2 * size)
    assert np.allclose(*once, rtol=1e-5) and decisions < 0.8 * len(of)


def test_scores_do_not_depend_on_the_words_before():
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 50, (int(cm._OFFSETS[-1]), 2)).astype(np.float32)
    mixer = cm.Mixer(cm.Code(np.ones(256, np.int64)), counts, cm.Gates())
    words = sorted({bytes(rng.choice(list(b"ab"), rng.integers(1, 14))) for _ in range(300)} | {b"b" * k for k in (23, 24, 25, 26, 60)})
    words = [w for w in words for _ in range(2)]  # also equal ones side by side
    data, starts, ends = cm._joined(words)
    kinds, topics = np.sort(rng.integers(0, 2, len(words))), np.full(len(words), 3)
    alone = [mixer.words(data, starts[k : k + 1], ends[k : k + 1], kinds[k : k + 1], topics[k : k + 1])[0] for k in range(len(words))]
    assert np.allclose(mixer.words(data, starts, ends, kinds, topics), alone, rtol=1e-6)
