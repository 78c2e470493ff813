import random
import re

from pyspark.sql import functions as F

from pedigree.llm import license_scan

DOCS = "doc_id long, text string"


def brute_base(text):
    """Words by a regular expression, phrases by comparing lists at every place."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        wanted = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(wanted)] == wanted:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check_base(rows, found):
    found = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        r = found[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert bool(r.labels) == (r.score > 0) and r.labels.split(",") == sorted(set(r.labels.split(",")))


def test_base_columns_match_brute_force(spark):
    rng = random.Random(11)
    pieces = ["GNU", "general", "PUBLIC", "license", "License", "apache", "cc", "BY", "mit", "é", "0", "x1", "lesser", "version", "2", "ÀB", "CC"]
    glue = [" ", "\n", "-", "_", "  ", ", ", "", "\x00", "\x7f", "/"]
    texts = ["".join(rng.choice(pieces) + rng.choice(glue) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", " \n", "cc by cc by cc by", "CC-BY", "mit licenses", "The MIT\nLICENSE.", "x" * 200_000, "cc by " * 30_000, "Ⅷ mit license", "gnu general public licensex"]
    rows = list(enumerate(texts))
    check_base(rows, license_scan.scan(spark.createDataFrame(rows, DOCS)).collect())


def test_base_columns_of_the_table_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    from pedigree.llm.queries import QUERIES

    check_base(rows, QUERIES["op11_license_scan"](spark, sf_dir).collect())


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, "mit license", "a"), (1, "mit license", "b"), (None, None, "c")], DOCS + ", labels string").withColumn("score", F.lit("clash"))
    got = license_scan.scan(df).collect()
    assert [(r.doc_id, r.labels, r.n_words) for r in got] == [(1, "mit", 2), (1, "mit", 2), (None, "", 0)]
    assert license_scan.scan(df.limit(0)).count() == 0


class Side:
    """An operand of Python's own operators, whose precedence is that of and / or."""

    def __init__(self, burden):
        self.burden = burden

    def __and__(self, other):
        return Side(max(self.burden, other.burden))

    def __or__(self, other):
        return Side(min(self.burden, other.burden))

    def __matmul__(self, other):
        return Side(2 if self.burden == 3 else self.burden)


def test_expressions_match_pythons_own_parser():
    rng = random.Random(3)
    names = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0+", "MPL-2.0", "AGPL-3.0", "CC0-1.0", "cc-by-nc-4.0"]

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(names)
            return (name + " WITH Classpath-exception-2.0", f"(Side({license_scan.burden(name.lower())}) @ 0)") if rng.random() < 0.3 else (name, f"Side({license_scan.burden(name.lower())})")
        parts = [some(depth - 1) for _ in range(rng.randint(2, 4))]
        ops = [rng.choice([("AND", "&"), ("or", "|")]) for _ in parts[1:]]
        text = parts[0][0] + "".join(f" {o[0]} {p[0]}" for o, p in zip(ops, parts[1:]))
        code = parts[0][1] + "".join(f" {o[1]} {p[1]}" for o, p in zip(ops, parts[1:]))
        return (f"({text})", f"({code})") if rng.random() < 0.7 else (text, code)

    for _ in range(500):
        text, code = some(3)
        found = license_scan.scan_text(f"// SPDX-License-Identifier: {text} */".encode())
        assert found.burden == eval(code).burden, text
        # The printed form means the same.
        assert license_scan.scan_text(f"License: {found.expressions[0]}".encode()).burden == found.burden


def told(text):
    found = license_scan.scan_text(text.encode())
    return found.labels, found.expressions, found.burden


def test_tags_and_notices():
    assert told('"license": "MIT OR GPL-2.0-only",') == (["gpl", "mit"], ["mit or gpl-2.0-only"], 1)
    assert told("license: see file") == ([], [], None)
    assert told("SPDX-License-Identifier: LicenseRef-Own") == (["unlisted"], ["licenseref-own"], 5)
    assert told("SPDX-License-Identifier: (MIT AND (Apache-2.0 or") == (["apache", "mit"], ["mit and apache-2.0"], 1)
    assert told("SPDX-License-Identifier: MIT) AND x") == (["mit"], ["mit"], 1)
    assert told("SPDX-License-Identifier: OR MIT") == ([], [], None)
    assert told("License: MIT.\nMore text.")[0] == ["mit"]
    assert told("Licensed under CC BY-NC 4.0.") == (["cc-by", "cc-by-nc"], [], 5)
    assert told("licensed under the GNU General Public License, version 3.") == (["gpl", "gpl-3.0"], [], 3)
    assert told("a sentence about licences and the word license itself") == ([], [], None)
    weights = [license_scan.scan_text(t.encode()).score for t in ("the mit license", "Released under the MIT License", "License: MIT")]
    assert weights == sorted(weights) and weights[0] == 0.6 and weights[-1] == 0.99
