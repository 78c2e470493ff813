"""Repair of conversations to the order system? (user assistant)+ by the cheapest edits, over a trie of signatures.

A row is blank (no visible character), a duplicate (role and text seen earlier in the conversation) or truncated (its
last visible character ends no sentence); the first of these counts. Edits: Keep 0, Rerole to user or assistant 3,
Delete 4 (the only edit of blank rows and duplicates), Insert an empty user or assistant row 3; a truncated row
that stays adds 3. Of the cheapest sequences of edits the ASCII-least is taken.

What decides is a conversation's signature, one character a row for role and fault. Signatures are dealt by range and
sorted, so that a task meets them in the order of a prefix trie: the path to the present node is a stack of DP
layers, a layer is computed once for all signatures that share the prefix, answers are read off where a signature
ends. A layer holds, for each state of the order, the least cost, the rank of its edits among the states' (edits up to
a row are never a prefix of others up to it, so ranks settle all ties) and where they came from; layers that differ by
a cost only are one, so that a step is mostly a lookup.

1. Light rows (no texts but the first characters, for order, and a digest) are counted before they are exchanged. The first turn of each
   role and text in a conversation tells duplicates; texts that very many rows share are joined by `join_least`.
2. Rows are dealt by range of conversation and turn, so a conversation of any size is spread over tasks; each task
   writes pieces of signatures. A conversation's signature (one byte a row, as the audit that is returned) is put together from its pieces.
3. The trie gives cost and audit. Rows and audits are then sorted by conversation and read in one stream, which
   holds a single batch. The digest of a repaired conversation is a sequential hash, so this stream is one task a conversation.

Defined cases: null role or text is one space; a null id is a conversation of its own; null turns come first; rows
with one turn follow by role, the first 40 characters of their texts, and digest, repeated ones adjacently; a
conversation without rows has zeros, an empty audit and the digest of the empty string; an empty table gives no rows;
other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedigree.llm.common import hot_of, join_least

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = ("user", "assistant")

#: Signature: letters a to p are four times the role (s, u, a, other) plus the fault (none, blank, duplicate, truncated).
_FAULTS = {"none": 0, "blank": 1, "duplicate": 2, "truncated": 3}
_LETTERS = "".join(map(chr, range(97, 113)))
#: What the DP needs: a row's role (capital: truncated), d for what must go.
_SYMBOLS = "".join(r if f == 0 else r.upper() if f == 3 else "d" for r in "suao" for f in range(4))

# States of the order: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
_FILLED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}

Layer = tuple  # per state None or (cost above the least, rank)


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """(state, inserts): two inserts reach every state there is, more would only go round."""
    for n in range(3):
        yield state, n
        state = _FILLED[state]


@cache
def step(layer: Layer, symbol: str) -> tuple[Layer, int, tuple]:
    """The layer after one more row, what its least cost is above the one before, and per state (state before, edits)."""
    role, late = symbol.lower(), TRUNCATED * symbol.isupper()
    best: dict[int, tuple] = {}
    for before, known in enumerate(layer):
        if known is None:
            continue
        for state, n in _inserted(before):
            ways = [(state, "D", DELETE)]
            if symbol != "d":
                ways.append((_FILLED[state], "R", REROLE + late))
                if (role, state) in _KEPT:
                    ways.append((_KEPT[role, state], "K", late))
            for after, edit, price in ways:
                found = (known[0] + n * INSERT + price, known[1], "I" * n + edit, before)
                if after not in best or found < best[after]:
                    best[after] = found
    least = min(b[0] for b in best.values())
    ranks = {state: rank for rank, state in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    new = tuple((best[s][0] - least, ranks[s]) if s in best else None for s in range(4))
    return new, least, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


@cache
def finish(layer: Layer) -> tuple[int, int, str]:
    """Cost above the layer's least, state and inserts that end the order best."""
    ends = [(known[0] + n * INSERT, known[1], "I" * n, before) for before, known in enumerate(layer) if known for state, n in _inserted(before) if state in (START, ASSISTANT)]
    cost, _, inserts, state = min(ends)
    return cost, state, inserts


class Trie:
    """The path of the signature that was asked last; ask in sorted order."""

    def __init__(self):
        self.signature = ""
        self.path: list[tuple[Layer, int, tuple | None]] = [(((0, 0), None, None, None), 0, None)]
        self.made = 0

    def _shared(self, signature: str) -> int:
        """Length of the prefix shared with the last signature."""
        low, high = 0, min(len(signature), len(self.signature))
        while low < high:
            middle = (low + high + 1) // 2
            if signature[low:middle] == self.signature[low:middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, audit)."""
        shared = self._shared(signature)
        del self.path[shared + 1 :]
        layer, cost, _ = self.path[-1]
        for symbol in signature[shared:]:
            layer, more, back = step(layer, symbol)
            cost += more
            self.path.append((layer, cost, back))
        self.made += len(signature) - shared
        self.signature = signature
        more, state, inserts = finish(layer)
        edits = [inserts]
        for _, _, back in reversed(self.path[1:]):
            state, edit = back[state]
            edits.append(edit)
        return cost + more, "".join(reversed(edits))


def _visible(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def rows_of(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, copies) with defined nulls; `copies` 0 leaves a row out, 2 repeats it."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of `rows_of`, a quarter of them damaged by the checksum of conversation and turn: 0 left out, 1 emptied, 2 without sentence ends, 3 repeated, 4 role user."""
    rows = rows_of(conversations)
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


#: A conversation's key without nulls, and the order of its rows.
_KEY = ["conv", "no_id"]
_ORDER = ["turn", "role", "head", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("no_id"),
        "turn",
        "role",
        F.substring("text", 1, 40).alias("head"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
        "text",
        "copies",
    )


def _light(rows: DataFrame) -> DataFrame:
    """Rows without texts, equal ones as one with their number; those left out keep only conversation and turn."""
    visible = _visible(F.col("text"))
    fault = F.when(visible == "", _FAULTS["blank"]).when(~F.substring(visible, -1, 1).isin(".", "!", "?"), _FAULTS["truncated"]).otherwise(_FAULTS["none"])
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    here = F.col("copies") > 0
    light = _keyed(rows).select(*_KEY, "turn", *[F.when(here, F.col(c)).alias(c) for c in _ORDER[1:]], F.when(here, role * 4 + fault).cast("int").alias("code"), "copies")
    return light.groupBy(*_KEY, *_ORDER, "code").agg(F.sum("copies").alias("copies"))


def _with_duplicates(light: DataFrame, bound: int) -> DataFrame:
    """Each light row with `first`: no earlier turn of the conversation has its role and text."""
    least = light.groupBy(*_KEY, "digest").agg(F.min("turn").alias("at"), F.max(F.col("turn").isNull()).alias("before"), F.count("*").alias("n"))
    told = join_least(light, least, [*_KEY, "digest"], hot_of(least, "n", bound), _ORDER)
    first = F.when(F.col("before"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("at"))
    return told.select(*_KEY, *_ORDER, "code", "copies", F.coalesce(first, F.lit(True)).alias("first"))


_PIECE = "conv long, no_id boolean, part long, seq long, low long, high long, n_turns long, signature string"


def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of signatures, of the rows of a conversation in one batch; (part, seq) is their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, no_id = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            has_turn = np.asarray(batch.column(2).is_valid())
            turn = batch.column(2).fill_null(0).to_numpy()
            code, copies = (batch.column(k).fill_null(0).to_numpy().astype(np.int64) for k in (3, 4))
            first = batch.column(5).to_numpy(zero_copy_only=False)
            code = np.where(first | (code % 4 == _FAULTS["blank"]), code, code // 4 * 4 + _FAULTS["duplicate"])
            ends = np.cumsum(copies)
            letters = np.repeat(np.where(code % 4 == _FAULTS["blank"], code, code // 4 * 4 + _FAULTS["duplicate"]), copies).astype(np.uint8)
            letters[(ends - copies)[copies > 0]] = code[copies > 0]  # further copies of a row are duplicates
            letters += 97
            cuts = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (no_id[1:] != no_id[:-1])]))
            rows = []
            for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
                turns = turn[begin:end][has_turn[begin:end] & (copies[begin:end] > 0)]
                low, high, n = (int(turns[0]), int(turns[-1]), 1 + int(np.count_nonzero(turns[1:] != turns[:-1]))) if len(turns) else (None, None, 0)
                signature = letters[ends[begin] - copies[begin] : ends[end - 1]].tobytes().decode()
                rows.append((int(conv[begin]), bool(no_id[begin]), part, seq, low, high, n, signature))
                seq += 1
            columns = list(zip(*rows))
            types = [pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _PIECE.split(", ")])

    spread = rows.repartitionByRange(*_KEY, *_ORDER).sortWithinPartitions(*_KEY, *_ORDER)
    return spread.select(*_KEY, "turn", "code", "copies", "first").mapInArrow(run, _PIECE)


def signatures(rows: DataFrame, bound: int) -> DataFrame:
    """(conv, no_id, gaps, signature) of every conversation."""
    parts = F.array_sort(F.collect_list(F.struct("part", "seq", "low", "high", "n_turns", "signature")))
    whole = _pieces(_with_duplicates(_light(rows), bound)).groupBy(*_KEY).agg(parts.alias("parts"))
    turned = F.filter("parts", lambda x: x["n_turns"] > 0)
    whole = whole.select(*_KEY, F.array_join(F.transform("parts", lambda x: x["signature"]), "").alias("signature"), turned.alias("turned"))
    rest = F.greatest(F.size("turned") - 1, F.lit(0))
    # A turn that goes on in the next piece is one turn.
    shared = F.zip_with(F.slice("turned", F.lit(1), rest), F.slice("turned", F.lit(2), rest), lambda x, y: (x["high"] == y["low"]).cast("long"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    turns = total(F.transform("turned", lambda x: x["n_turns"])) - total(shared)
    gaps = F.array_max(F.transform("turned", lambda x: x["high"])) - F.array_min(F.transform("turned", lambda x: x["low"])) + 1 - turns
    return whole.select(*_KEY, F.coalesce(gaps, F.lit(0)).alias("gaps"), "signature")


_ANSWER = "conv long, no_id boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}


def answers(rows: DataFrame, bound: int) -> DataFrame:
    """Counts, cost and audit of every conversation, from the trie of signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        legal = np.zeros((4, 4), bool)
        for pair in _LEGAL:
            legal["suao".index(pair[0]), "suao".index(pair[1])] = True
        for batch in batches:
            out = []
            for letters, symbols in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                codes = np.frombuffer(letters.encode(), np.uint8) - 97
                faults, roles = np.bincount(codes % 4, minlength=4), codes // 4
                out.append((*faults[1:].tolist(), int(np.count_nonzero(~legal[roles[:-1], roles[1:]])), *trie.answer(symbols)))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], names=[x.split()[0] for x in _ANSWER.split(", ")])

    signed = signatures(rows, bound).withColumn("symbols", F.translate("signature", _LETTERS, _SYMBOLS))
    spread = signed.repartitionByRange(F.substring("symbols", 1, 64), "no_id", "conv").sortWithinPartitions("symbols", "no_id", "conv")
    return spread.select(*_KEY, "gaps", "signature", "symbols").mapInArrow(run, _ANSWER)


class Repair:
    """The edits of one conversation, applied to its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _filled(self) -> str:
        self.state = _FILLED[self.state]
        return ROLES[self.state - USER]

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._filled(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that stand for the next one."""
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._filled(), text
        elif edit == "K":
            self.state = _KEPT[role[0], self.state]
            yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()


def _streamed(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Audits and rows of a conversation, one behind the other: (conv, no_id, is_row, answer columns, role, text, copies)."""
    more = [c for c in told.columns if c not in _KEY]
    texts = _keyed(rows.where("copies > 0")).select(*_KEY, F.lit(1).alias("is_row"), *[F.lit(None).cast(dict(told.dtypes)[c]).alias(c) for c in more], *_ORDER, "text", "copies")
    heads = told.select(*_KEY, F.lit(0).alias("is_row"), *more, *[F.lit(None).cast(dict(texts.dtypes)[c]).alias(c) for c in (*_ORDER, "text", "copies")])
    return heads.unionAll(texts).repartition(*_KEY).sortWithinPartitions(*_KEY, "is_row", *_ORDER).select(*_KEY, "is_row", *more, "role", "text", "copies")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired rows: (conv_id, place, edit, role, text); `rows` as of `rows_of`."""
    return _applied(rows, "conv_id long, place long, edit string, role string, text string", _listed)


def audited(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, audit and the digest of the repaired rows (`role:text`, joined by newlines)."""
    return _applied(rows, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", _hashed)


def _applied(rows: DataFrame, schema: str, follow) -> DataFrame:
    bound = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]
        out: list[tuple] = []
        done = follow(out)
        next(done)
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                for record in zip(*(c.to_pylist() for c in batch.slice(part, 1000).columns)):
                    done.send(record)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out.clear()
        done.send(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return _streamed(rows, answers(rows, bound)).mapInArrow(run, schema)


def _hashed(out: list[tuple]):
    """Receive records, put one row per conversation into `out`."""
    head = repair = total = None
    begun = False

    def add(found: Iterator[tuple[str, str, str]]) -> None:
        nonlocal begun
        for _, role, text in found:
            total.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True

    while True:
        record = yield
        if record is None or not record[2]:
            if head:
                add(repair.end())
                out.append((*head, total.hexdigest()))
            if record is None:
                yield
                return
            head = (None if record[1] else record[0], *record[3:10])
            repair, total, begun = Repair(record[9]), hashlib.sha256(), False
        else:
            for _ in range(record[12]):
                add(repair.row(record[10], record[11]))


def _listed(out: list[tuple]):
    """Receive records, put the repaired rows into `out`."""
    conv = repair = None
    place = 0

    def add(found: Iterator[tuple[str, str, str]]) -> None:
        nonlocal place
        for edit, role, text in found:
            out.append((conv, place, edit, role, text))
            place += 1

    while True:
        record = yield
        if record is None or not record[2]:
            if repair:
                add(repair.end())
            if record is None:
                yield
                return
            conv, repair, place = None if record[1] else record[0], Repair(record[9]), 0
        else:
            for _ in range(record[12]):
                add(repair.row(record[10], record[11]))
