"""Licence scans: notice phrases and identifier tags by one automaton, licence expressions by a shunting yard.

A text is reduced to its words (A-Z lowered; runs of digits, letters a-z and characters beyond ASCII), joined by one
space. One Aho-Corasick automaton finds all phrases as consecutive words in one pass, overlapping ones included. Behind
an identifier tag (`SPDX-License-Identifier:`, `license =` and the like) the text itself is read as an expression of
identifiers with `and`, `or`, `with` and parentheses: a shunting yard turns it into postfix order, which is evaluated
to the identifiers' labels and a burden: `and` takes the heavier side, `or` the lighter one, `with` a known exception
eases strong copyleft to weak. Burdens: 0 public domain, 1 permissive, 2 weak copyleft, 3 strong copyleft, 4 network
copyleft, 5 use is restricted or the terms are unknown.

`score` is how sure it is that a text carries a licence: 1 - product of (1 - weight) over its different findings, with
the weights of bare names, of sentences of notices and of tags. 0 without a finding.

Defined cases: a null or empty text has no words and no finding; names inside an evaluated expression are counted, but
add neither weight nor burden of their own; an expression ends before the first token that does
not fit, an operator without a right side is left out, parentheses left open end with the expression; an unknown
identifier is `unlisted` behind an SPDX tag and ends the expression behind others; repeated rows are scanned one by
one; null ids stay null; an empty table gives no rows; other columns are left alone. Texts are scanned whole, never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases that every scan counts, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

NAME, SENTENCE, TAG = 0.6, 0.9, 0.99

# Further phrases, their labels and weights.
NOTICES = {
    "gnu general public license version 2": ("gpl-2.0", SENTENCE),
    "gnu general public license version 3": ("gpl-3.0", SENTENCE),
    "gnu lesser general public license": ("lgpl", SENTENCE),
    "gnu affero general public license": ("agpl", SENTENCE),
    "apache license version 2 0": ("apache-2.0", SENTENCE),
    "mozilla public license": ("mpl", SENTENCE),
    "eclipse public license": ("epl", SENTENCE),
    "boost software license": ("bsl", SENTENCE),
    "bsd license": ("bsd", NAME),
    "isc license": ("isc", NAME),
    "zlib license": ("zlib", NAME),
    "open font license": ("ofl", NAME),
    "released under the mit license": ("mit", SENTENCE),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", SENTENCE),
    "redistribution and use in source and binary forms": ("bsd", SENTENCE),
    "permission to use copy modify and or distribute this software": ("isc", SENTENCE),
    "this is free and unencumbered software released into the public domain": ("unlicense", SENTENCE),
    "cc by sa": ("cc-by-sa", NAME),
    "cc by nd": ("cc-by-nd", NAME),
    "cc by nc": ("cc-by-nc", NAME),
    "cc by nc sa": ("cc-by-nc-sa", NAME),
    "cc by nc nd": ("cc-by-nc-nd", NAME),
    "cc0 1 0 universal": ("cc0", SENTENCE),
    "creative commons attribution": ("cc-by", SENTENCE),
    "creative commons attribution sharealike": ("cc-by-sa", SENTENCE),
    "creative commons attribution noncommercial": ("cc-by-nc", SENTENCE),
    "all rights reserved": ("all-rights-reserved", SENTENCE),
}

# Tags behind which an expression stands; True where any identifier is believed.
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False}

# Burdens by the longest fitting beginning of an identifier or label.
BURDENS = {
    "0bsd": 0, "cc0": 0, "unlicense": 0, "wtfpl": 0,
    "apache": 1, "artistic": 1, "blueoak": 1, "bsd": 1, "bsl": 1, "cc-by": 1, "isc": 1, "mit": 1, "ofl": 1, "postgresql": 1, "psf": 1, "python": 1, "zlib": 1,
    "cddl": 2, "epl": 2, "lgpl": 2, "mpl": 2,
    "cc-by-sa": 3, "eupl": 3, "gpl": 3,
    "agpl": 4,
    "all-rights-reserved": 5, "busl": 5, "cc-by-nc": 5, "cc-by-nd": 5, "sspl": 5,
}
EXCEPTIONS = ("autoconf-exception", "bison-exception", "classpath-exception", "font-exception", "gcc-exception", "linux-syscall-note", "llvm-exception", "openssl-exception", "openvpn-openssl-exception", "qt-gpl-exception", "u-boot-exception")
UNLISTED, UNKNOWN_BURDEN = "unlisted", 5

_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_ASSIGN = re.compile(rb"""["']?[\t ]*[:=][\t ]*["']?""")
_TOKEN = re.compile(rb"[\t ]*(\(|\)|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?)")
_RANKS = {"or": 1, "and": 2, "with": 3}


class Term(NamedTuple):
    """A part of an expression: its text, labels, burden and the rank of its outermost operator (4: none)."""

    text: str
    labels: frozenset
    burden: int
    rank: int = 4


def family(name: str) -> str | None:
    """The listed beginning of an identifier, None for an unknown one."""
    fits = [k for k in BURDENS if name.startswith(k) and not name[len(k) : len(k) + 1].isalpha()]
    return max(fits, key=len, default=None)


def burden(label: str) -> int:
    return BURDENS.get(family(label) or "", UNKNOWN_BURDEN)


def operand(name: str) -> Term:
    listed = family(name)
    return Term(name, frozenset([listed or UNLISTED]), BURDENS[listed] if listed else UNKNOWN_BURDEN)


def postfix(tokens: list[str]) -> list[str]:
    """Shunting yard: identifiers and operators (`with` before `and` before `or`, from the left) in postfix order.

    `tokens` are in lower case and fit together; parentheses may be left open.
    """
    out, held = [], []
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in _RANKS:
            while held and _RANKS.get(held[-1], 0) >= _RANKS[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    return out + [t for t in reversed(held) if t != "("]


def joined(operator: str, left: Term, right: Term) -> Term:
    rank = _RANKS[operator]
    text = f" {operator} ".join(t.text if t.rank >= rank else f"({t.text})" for t in (left, right))
    if operator == "with":
        known = any(right.text.startswith(x) for x in EXCEPTIONS)
        return Term(text, left.labels, min(left.burden, 2) if known and left.burden == 3 else left.burden, rank)
    pick = max if operator == "and" else min
    return Term(text, left.labels | right.labels, pick(left.burden, right.burden), rank)


def evaluate(tokens: list[str]) -> Term:
    stack: list[Term] = []
    for token in postfix(tokens):
        if token in _RANKS:
            right = stack.pop()
            stack.append(joined(token, stack.pop(), right))
        else:
            stack.append(operand(token))
    return stack[0]


def fitting(raw: bytes, at: int, believed: bool) -> tuple[list[str], int]:
    """The tokens of the expression at `at`, as many as fit together (none without one), and where it ends."""
    tokens: list[str] = []
    complete, end, depth, begin = 0, at, 0, True  # tokens up to the last operand or parenthesis, their end, open parentheses, an operand is due
    while match := _TOKEN.match(raw, at):
        token = match[1].decode().lower()
        if begin:
            if token == "(":
                depth += 1
            elif token in _RANKS or token == ")" or not (believed or family(token) or (tokens and tokens[-1] == "with")):
                break
            else:
                begin = False
        elif token == ")":
            if not depth:
                break
            depth -= 1
        elif token in _RANKS:
            begin = True
        else:
            break
        tokens.append(token)
        at = match.end()
        if not begin:
            complete, end = len(tokens), at
    return tokens[:complete], end


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


class Findings(NamedTuple):
    n_words: int
    places: list[int]  # starts of base phrases
    base: list[str]
    labels: list[str]
    expressions: list[str]
    burden: int | None
    score: float


def scan_text(raw: bytes) -> Findings:
    """All findings of one text (UTF-8)."""
    plain = raw.translate(_WORD_BYTES)
    words = plain.split()
    line = f" {b' '.join(words).decode()} "
    hits = [(end - len(phrase) - 1, phrase) for end, phrase in _automaton().iter(line)]
    if not hits:
        return Findings(len(words), [], [], [], [], None, 0.0)
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 0x20)
    hits = list(zip(np.searchsorted(spaces, [at for at, _ in hits]).tolist(), (phrase for _, phrase in hits)))
    places, base, weights, burdens, expressions = [], set(), {}, [], []
    ends, behind = None, 0  # a name inside an expression is no finding of its own
    for at, phrase in hits:
        if phrase in BASE:
            places.append(at)
            base.add(BASE[phrase])
            if at >= behind:
                weights[BASE[phrase], NAME] = NAME
        if phrase in NOTICES and at >= behind:
            label, weight = NOTICES[phrase]
            weights[label, weight] = weight
        if phrase in TAGS:
            if ends is None:
                gap = np.frombuffer(plain + b" ", np.uint8) == 0x20
                ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
            assigned = _ASSIGN.match(raw, int(ends[at + phrase.count(" ")]))
            tokens, end = fitting(raw, assigned.end(), TAGS[phrase]) if assigned else ([], 0)
            if tokens:
                behind = int(np.searchsorted(ends, end, side="right"))
                term = evaluate(tokens)
                expressions.append(term.text)
                burdens.append(term.burden)
                weights |= {(label, TAG): TAG for label in term.labels}
    labels = {label for label, _ in weights}
    tagged = {label for label, weight in weights if weight == TAG}
    burdens += [burden(label) for label in labels - tagged]
    missed = 1.0
    for _, weight in sorted(weights):
        missed *= 1 - weight
    return Findings(len(words), places, sorted(base), sorted(labels | base), sorted(set(expressions)), max(burdens, default=None), round(1 - missed, 6) if weights else 0.0)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, burden long"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels, score; the evaluated expressions and the heaviest burden of all findings (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                f = scan_text(text.as_py().encode() if text.is_valid else b"")
                first, last = (min(f.places), max(f.places)) if f.places else (None, None)
                rows.append((f.n_words, len(f.places), first, last, ",".join(f.base), ",".join(f.labels), f.score, "; ".join(f.expressions), f.burden))
            columns = list(zip(*rows)) or [()] * 9
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)
