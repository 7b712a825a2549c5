"""Conversation repair against a plain search over whole edit strings."""

import hashlib
import random
import zlib
from functools import cache
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lexmill.llm import conversations, queries

SPACE = " \t\n\x0b\x0c\r"
ROLE = {"u": "user", "a": "assistant"}


def needed(before):
    return {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[before]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows):
    """rows of one conversation after damage, in order."""
    blank = duplicate = truncated = illegal = 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    @cache
    def best(i, before, inserted):
        """The least (cost, edits, result) from row i on, with the role initial before it."""
        options = []
        if i == len(rows) and before in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            for to in needed(before):
                if to != "s":
                    cost, edits, result = best(i, to, inserted + 1)
                    options.append((cost + 5, "I" + edits, ((ROLE[to], ""), *result)))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, edits, result = best(i + 1, before, 0)
            options.append((cost + 2, "D" + edits, result))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for to in needed(before):
                    cost, edits, result = best(i + 1, to, 0)
                    if role[:1] == to:
                        options.append((cost + more, "K" + edits, ((role, text), *result)))
                    if to != "s":
                        options.append((cost + more + 1, "R" + edits, ((ROLE[to], text), *result)))
        return min(options, key=lambda o: o[:2], default=(float("inf"), "", ()))

    cost, audit, result = best(0, "", 0)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest())


def expected(rows):
    out = {conv: plain([]) for conv, *_ in rows}
    after = sorted(damaged(rows), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0))
    return out | {conv: plain(list(own)) for conv, own in groupby(after, key=lambda r: r[0])}


@pytest.fixture(scope="module")
def odd():
    rnd, rows = random.Random(6), []
    texts = ["Yes.", "No!", "and then", "", " \n", "é?", "well. ", None, "x" * 50_000]
    for conv in [None, *range(400)]:
        for turn in sorted(rnd.sample(range(-2, 14), rnd.choice((1, 2, 5, 9)))):
            rows.append((conv, turn, rnd.choice(("user", "assistant", "system", "tool", "", None)), rnd.choice(texts)))
        if rnd.random() < 0.2:
            rows.append((conv, None, "user", "Late."))
    return rows


def compare(got, rows):
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r.conv_id


def test_the_query_against_a_plain_search(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op12_conversation_repair(spark, folder).collect(), rows)


def test_odd_conversations(spark, odd):
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("copies", "key", "symbols", "part", "plan")})
    compare(conversations.audit_table(conversations.with_faults_injected(df)).collect(), odd)
    assert conversations.audit_table(conversations.with_faults_injected(df.limit(0))).count() == 0


def test_repeated_rows_of_one_turn(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversations.audit_table(df).collect()}
    assert (got[1].duplicate, got[1].audit, got[1].illegal) == (1, "KDK", 1)
    assert (got[2].blank, got[2].audit, got[2].cost, got[2].repaired_sha256) == (1, "D", 2, hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"), (2, 0, "user", "A?"), (2, 1, "assistant", "B.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in conversations.repair(df).orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Why?"), (2, 0, "user", "A?"), (2, 1, "assistant", "B.")]


def test_each_node_is_computed_once(monkeypatch):
    made, real = [], conversations.node_before
    monkeypatch.setattr(conversations, "node_before", lambda s, after: made.append(s) or real(s, after))
    strings = ["UAUA", "AUA", "SUAUA", "UA", "xUA", "", "UxA"]
    got = {s: (cost, audit) for s, cost, audit in conversations.solved(sorted(s[::-1] for s in strings))}
    assert len(made) == len({s[k:] for s in strings for k in range(len(s))})
    assert got == {"UAUA": (0, "KKKK"), "AUA": (2, "DKK"), "SUAUA": (0, "KKKKK"), "UA": (0, "KK"), "xUA": (2, "DKK"), "": (0, ""), "UxA": (2, "KDK")}


def test_a_long_conversation(spark):
    roles = ("user", "assistant")
    rows = spark.range(60_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(*map(F.lit, roles)), (F.col("id") % 2 + 1).cast("int")).alias("role"), F.concat(F.lit("no "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    (row,) = conversations.audit_table(rows).collect()
    assert (row.cost, row.audit, row.gaps) == (0, "K" * 60_000, 0)
