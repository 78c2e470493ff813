import collections
import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from pedigree.llm import conversation_repair

ROWS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """(cost, audit, roles and texts) by a search over single edits, in the order of cost and audit; rows are (role, text, fault)."""
    heap = [(0, "", 0, ())]
    seen = set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        shape = "".join(role[0] for role, _ in out)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, out
        key = (at, shape[-1:] or "^", bool(shape))
        if (key, cost, audit) in seen or cost > 200:
            continue
        seen.add((key, cost, audit))
        ways = [("I", 3, 0, [(r, "")]) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            ways.append(("D", 4, 1, []))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                ways.append(("K", late, 1, [(role, text)]))
                ways += [("R", 3 + late, 1, [(r, text)]) for r in ("user", "assistant")]
        for edit, price, rows_used, more in ways:
            new = (*out, *more)
            initials = "".join((role or " ")[0] for role, _ in new)
            if re.fullmatch("s?((ua)*u?)", initials):  # can still be completed
                heapq.heappush(heap, (cost + price, audit + edit, at + rows_used, new))


def brute(table, damage=True):
    """All columns by conversation, from plain lists."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in table:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    result = {}
    for conv, rows in groups.items():
        left = []
        for turn, role, text in rows:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, told, counts = set(), [], collections.Counter()
        for _, role, text in left:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            told.append((role, text, fault))
        turns = {t for t, _, _ in left if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, out = cheapest(told)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        result[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return result


def check(found, want):
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(found) == len(want) and set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def made(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(8)):
            text = rng.choice(["a.", "b!", "b!", "no end", "", " \t", "x. \n", "long " * 20 + ".", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 5, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows


def test_random_conversations_match_a_search(spark):
    rows = made(random.Random(12), 400)
    df = spark.createDataFrame(rows, ROWS)
    check(conversation_repair.audited(conversation_repair.damaged(df)).collect(), brute(rows))
    check(conversation_repair.audited(conversation_repair.rows_of(df)).collect(), brute(rows, damage=False))


def test_query_matches_a_search(spark, sf_dir):
    from pedigree.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(QUERIES["op12_conversation_repair"](spark, sf_dir).collect(), brute(rows))


def test_layers_are_made_once_a_prefix():
    signatures = sorted("".join(random.Random(k).choice("suaoSUAd") for _ in range(k % 9)) for k in range(300))
    trie = conversation_repair.Trie()
    for signature in signatures:
        alone = conversation_repair.Trie()
        assert trie.answer(signature) == alone.answer(signature)
    assert trie.made == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})


def test_large_conversations_are_put_together_from_pieces(spark):
    rng = random.Random(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(5, k // 2, rng.choice(["user", "assistant"]), f"t{k % 40}.") for k in range(300)] + [(None, None, "user", f"n{k}.") for k in range(60)] + [(8, k, "user" if k % 2 else "assistant", "same.") for k in range(90)]
        df = spark.createDataFrame(rows, ROWS).repartition(5)
        got = {r.conv_id: r for r in conversation_repair.audited(conversation_repair.rows_of(df)).collect()}
        turned = {r.conv_id: r for r in conversation_repair.repaired(conversation_repair.rows_of(df)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("rows")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (got[5].gaps, got[None].gaps, got[8].gaps, got[8].duplicate) == (0, 0, 0, 88)
    ordered = sorted((r for r in rows if r[0] == 5), key=lambda r: (r[1], r[2], r[3]))
    seen, symbols = set(), ""
    for _, _, role, text in ordered:
        symbols += "d" if (role, text) in seen else role[0]
        seen.add((role, text))
    assert (got[5].cost, got[5].audit) == conversation_repair.Trie().answer(symbols)
    for conv in (5, None, 8):
        told = "\n".join(f"{r.role}:{r.text}" for r in turned[conv].rows)
        assert hashlib.sha256(told.encode()).hexdigest() == got[conv].repaired_sha256


def test_defined_cases(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "dropped."), (None, None, None, None), (3, 4, "tool", "x" * 100_000 + "."), (3, 9, "user", "hi.")]
    df = spark.createDataFrame(rows, ROWS).withColumn("audit", F.lit("clash")).withColumn("copies", F.lit(7))
    found = conversation_repair.audited(conversation_repair.damaged(df)).collect()
    check(found, brute(rows))
    assert {tuple(r)[1:] for r in found if r.conv_id == gone} == {(0, 0, 0, 0, 0, 0, "", EMPTY)}
    assert conversation_repair.audited(conversation_repair.damaged(df.limit(0))).count() == 0
