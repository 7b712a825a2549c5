"""Conversation structure repair: the cheapest edits that give every conversation a regular sequence of roles.

A conversation's rows are read in order once for their faults, which leaves one symbol a
row. The symbol strings of all conversations, minimised from their ends, form an automaton
in which a node stands for one suffix: cost-to-go and the best next edit are computed once
for each node and grammar state. The edits then meet the rows again to give the repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.store import Scratch

#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Conversations of one symbol string are dealt to so many keys when they meet its result.
SALTS = 1024
USER, ASSISTANT = "user", "assistant"
LEGAL = frozenset({"su", "ua", "au"})
#: Grammar states of `(s?(ua)+)?`: nothing yet, after s, after u, after a; the role each needs next, and where that leads.
NEEDS = ("u", "u", "a", "u")
NEXT = (2, 2, 3, 2)
FINAL = (0, 3)
#: What a plan says of a conversation beside its edits.
PLAN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Symbols: roles s, u, a or another, lower case if truncated, upper case if whole; x for rows that have to go.
MUST_GO = "x"


def with_faults_injected(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0, 1 or 2): rows damaged by crc32 of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its `.`, `!` and `?`, 3 repeats it and 4
    sets its role to user. A null counts as one space; ids and turns stay null. Dropped rows
    stay as rows of no copies, so that no conversation is lost.
    """
    whole = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.encode(F.concat(whole[0], F.lit(":"), whole[1]), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(whole[3], "[.!?]", "")).otherwise(whole[3])
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, USER).otherwise(whole[2]).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _normal(rows: DataFrame) -> DataFrame:
    """The five columns read, a null role or text as one space, one copy where nothing is said."""
    copies = F.coalesce(F.col("copies").cast("int"), F.lit(1)) if "copies" in rows.columns else F.lit(1)
    own = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *own, copies.alias("copies"))


def _row_key() -> Column:
    """Equal for equal role and text: a digest of both, the role closed by its length."""
    return F.unhex(F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8")))


def _in_order(rows: DataFrame, *columns: str, first: str | None = None) -> DataFrame:
    """Each conversation in one task, by turn (nulls first), rows of one turn by their key; Spark's sort spills."""
    order = [F.col("conv_id").asc_nulls_first(), *([first] if first else []), F.col("turn").asc_nulls_first(), "key"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).select(*columns)


def _values(batches, size: int = 500) -> Iterator[tuple]:
    """Rows of Arrow batches, turned into Python values a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns), strict=True)


class Reading:
    """What the rows of one conversation, read in order, say of it."""

    def __init__(self, conv_id):
        self.conv_id, self.seen, self.symbols = conv_id, set(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turn, initial: str, key: bytes, shown: str) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        symbol = initial.upper() if initial in ("s", "u", "a") else "O"
        if not shown:
            self.blank += 1
            symbol = MUST_GO
        elif key in self.seen:
            self.duplicate += 1
            symbol = MUST_GO
        elif shown not in ".!?":
            self.truncated += 1
            symbol = symbol.lower()
        self.seen.add(key)
        self.symbols.append(symbol)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.symbols)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_SIGNATURE = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("symbols", pa.string())])
_SIGNATURE_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, symbols string"


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, symbols for every conv_id of (conv_id, turn, role, text, copies).

    Only digests of the rows are shuffled. A conversation is read as a stream: beside its
    symbols, memory holds 16 bytes for each of its distinct rows.
    """
    rows = _normal(rows)
    shown = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    digest = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), _row_key().alias("key"), shown.alias("shown"), "copies")

    def read(batches):
        def conversations():
            now = None
            for conv_id, turn, initial, key, shown, copies in _values(batches):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield now.row()
                    now = Reading(conv_id)
                for _ in range(copies):
                    now.add(turn, initial, key, shown)
            if now is not None:
                yield now.row()

        yield from _batches(conversations(), _SIGNATURE)

    return _in_order(digest, "conv_id", "turn", "initial", "key", "shown", "copies").mapInArrow(read, _SIGNATURE_SQL)


class Node(NamedTuple):
    """A suffix of symbols: cost-to-go and best next edit by grammar state. The edits differ in their letters, so the letter alone settles ties."""

    cost: tuple[float, ...]
    edit: tuple[str, ...]


def _with_inserts(cost: list[float], edit: list[str]) -> Node:
    """Inserting leads to another state of the same node and always costs, so two rounds settle it."""
    for _ in range(2):
        for q in range(4):
            cost[q], edit[q] = min((cost[q], edit[q]), (INSERT + cost[NEXT[q]], "I"))
    return Node(tuple(cost), tuple(edit))


END = _with_inserts([0.0 if q in FINAL else float("inf") for q in range(4)], ["" for _ in range(4)])


def _kept(symbol: str, q: int) -> int | None:
    """Where keeping the row's role leads, if the grammar allows it."""
    role = symbol.lower()
    if role == "s":
        return 1 if q == 0 else None
    return NEXT[q] if role == NEEDS[q] else None


def node_before(symbol: str, after: Node) -> Node:
    """The node of a symbol and the suffix behind it."""
    stay = TRUNCATED if symbol.islower() else 0
    cost, edit = [], []
    for q in range(4):
        options = [(DELETE + after.cost[q], "D")]
        if symbol != MUST_GO:
            options.append((REROLE + stay + after.cost[NEXT[q]], "R"))
            if (to := _kept(symbol, q)) is not None:
                options.append((stay + after.cost[to], "K"))
        best = min(options)
        cost.append(best[0])
        edit.append(best[1])
    return _with_inserts(cost, edit)


def _audit(symbols: str, nodes: list[Node]) -> str:
    """The best edits, read off the nodes from the whole string to its end."""
    out, q, left = [], 0, len(symbols)
    while edit := nodes[left].edit[q]:
        out.append(edit)
        if edit == "I":
            q = NEXT[q]
            continue
        symbol = symbols[len(symbols) - left]
        if edit != "D":
            q = _kept(symbol, q) if edit == "K" else NEXT[q]
        left -= 1
    return "".join(out)


def solved(turned: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """(symbols, cost, audit) of reversed symbol strings in order: the nodes of the ending that a string shares with the one before are kept."""
    before, nodes = "", [END]
    for now in turned:
        shared = next((k for k, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
        del nodes[shared + 1 :]
        for symbol in now[shared:]:
            nodes.append(node_before(symbol, nodes[-1]))
        before, symbols = now, now[::-1]
        yield symbols, int(nodes[-1].cost[0]), _audit(symbols, nodes)


def best_edits(distinct: DataFrame) -> DataFrame:
    """(symbols, cost, audit) of distinct symbol strings.

    Strings are dealt and sorted from their ends, so that those with a common suffix follow
    one another and the nodes of that suffix are taken over from the string before. Only a
    suffix that meets a border between two tasks is computed twice. Memory is one string's nodes.
    """

    schema = pa.schema([("symbols", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def solve(batches):
        yield from _batches(solved(turned for (turned,) in _values(batches)), schema)

    turned = distinct.select(F.reverse("symbols").alias("turned"))
    return turned.repartitionByRange("turned").sortWithinPartitions("turned").mapInArrow(solve, "symbols string, cost long, audit string")


def plan_edits(read: DataFrame, scratch: Scratch) -> DataFrame:
    """`signatures` with cost and audit. Very common strings are split over salts; a rare one has as many salts as conversations, so nothing is multiplied."""
    salted = read.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    pairs = salted.groupBy("symbols", "salt").count().drop("count")
    results = scratch.save(best_edits(read.select("symbols").distinct()), "solved")
    met = pairs.join(results, "symbols")
    return salted.join(met, ["symbols", "salt"]).drop("salt")


class Repair:
    """Follows the edits through a conversation's rows and gives the repaired ones."""

    def __init__(self, audit: str):
        self.audit, self.at, self.q = audit, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield (USER if NEEDS[self.q] == "u" else ASSISTANT), ""
            self.q, self.at = NEXT[self.q], self.at + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield (USER if NEEDS[self.q] == "u" else ASSISTANT), text
            self.q = NEXT[self.q]
        elif edit == "K":
            yield role, text
            self.q = 1 if role[0] == "s" else NEXT[self.q]

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def _with_plans(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan before its rows, in order."""
    more = planned.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), "audit", F.lit("").alias("text"), F.lit(0).alias("copies"), F.struct(*PLAN).alias("plan"))
    own = _normal(rows).select("conv_id", F.lit(1).alias("part"), "turn", _row_key().alias("key"), F.col("role").alias("audit"), "text", "copies", F.lit(None).cast(more.schema["plan"].dataType).alias("plan"))
    return _in_order(more.unionByName(own), "conv_id", "part", "audit", "text", "copies", "plan", first="part")


def _follow(batches) -> Iterator[tuple]:
    """(conv_id, plan, audit, None) at a conversation's start, (conv_id, None, role, text) for each repaired row."""
    now = conv = None
    for conv_id, part, audit, text, copies, plan in _values(batches):
        if part == 0:
            if now is not None:
                yield from ((conv, None, *pair) for pair in now.end())
            now, conv = Repair(audit), conv_id
            yield conv_id, plan, audit, None
            continue
        for _ in range(copies):
            yield from ((conv, None, *pair) for pair in now.row(audit, text))
    if now is not None:
        yield from ((conv, None, *pair) for pair in now.end())


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, position, role, text) of (conv_id, turn, role, text and, if given, copies), positions from 0; odd rows as in `audit_table`."""
    scratch = Scratch(rows.sparkSession)
    planned = plan_edits(scratch.save(signatures(rows), "signatures"), scratch)

    def run(batches):
        def out():
            position = 0
            for conv_id, plan, role, text in _follow(batches):
                if plan is not None:
                    position = 0
                else:
                    yield conv_id, position, role, text
                    position += 1

        yield from _batches(out(), pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    return _with_plans(rows, planned).mapInArrow(run, "conv_id long, position long, role string, text string")


def audit_table(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of (conv_id, turn, role, text and, if given, copies): its faults, the cost and edits of its repair, and a digest of the result.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (edits as K, R,
    D and I in order; ties by ASCII) and repaired_sha256, the hash of `role:text` lines. A
    null role or text is one space, rows without an id are one conversation, further columns
    are ignored; a conversation without copies has zeros, an empty
    audit and the hash of nothing; an empty table gives an empty result. Rows of one turn
    are ordered by a digest of role and text. The digest of one conversation needs its rows
    in one task, which reads them as a stream and holds one row at a time.
    """
    scratch = Scratch(rows.sparkSession)
    planned = plan_edits(scratch.save(signatures(rows), "signatures"), scratch)

    def run(batches):
        def out():
            now = digest = None
            for conv_id, plan, first, text in _follow(batches):
                if plan is not None:
                    if now is not None:
                        yield *now, digest.hexdigest()
                    now, digest, empty = (conv_id, *(plan[c] for c in PLAN), first), hashlib.sha256(), True
                else:
                    digest.update(f"{'' if empty else chr(10)}{first}:{text}".encode())
                    empty = False
            if now is not None:
                yield *now, digest.hexdigest()

        yield from _batches(out(), pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in PLAN), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    return _with_plans(rows, planned).mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in PLAN)}, audit string, repaired_sha256 string")
