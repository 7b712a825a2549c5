"""Secrets in texts: keys, tokens and passwords, found by one automaton for all rules in one pass over the bytes."""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import automaton as am
from lexmill.llm import textscan as ts

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


class Rule(NamedTuple):
    """What stands before the secret's last run, the characters of that run, and how many of them there must be; shorter matches drop, without a second try."""

    kind: str
    head: str
    tail: str
    least: int

    @property
    def pattern(self) -> str:
        return f"({self.head}){self.tail}+"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base rules. An access key has 16 characters or more with its AKIA, a hex run 32 with the four of its head.
BASE = (
    Rule("assign", f"({'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 8),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "[0-9a-f]" * 4, "[0-9a-f]", 28),
)
BASE_KINDS = frozenset(r.kind for r in BASE)
# Public forms of issued credentials. Each needs its issuer's mark, so that prose holds none.
ISSUED = (
    Rule("github", "gh[oprsu]_", "[A-Za-z0-9]", 36),
    Rule("gitlab", "glpat-", "[A-Za-z0-9_-]", 20),
    Rule("slack", "xox[abeprs]-", "[A-Za-z0-9-]", 20),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("stripe", "[prs]k_(live|test)_", "[A-Za-z0-9]", 16),
    Rule("npm", "npm_", "[A-Za-z0-9]", 36),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 16),
    Rule("bearer", r"[Aa]uthorization:\x20*[Bb]earer\x20+", "[A-Za-z0-9._~+/=-]", 16),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY----", "-", 1),
    Rule("login", r"://[A-Za-z0-9._%+-]+:[A-Za-z0-9._~%!$&*+=-]+@", "[A-Za-z0-9.-]", 4),
)
RULES = (*BASE, *ISSUED)


class Plan(NamedTuple):
    """Rules compiled: each base rule scans alone, the issued forms as one, so that their spans never overlap and the automaton stays small."""

    rules: tuple[Rule, ...]
    patterns: tuple[str, ...]
    compiled: am.Automaton


@cache
def compile_plan(rules: tuple[Rule, ...] = RULES) -> Plan:
    own = [r for r in rules if r in BASE]
    issued = [r for r in rules if r not in BASE]
    patterns = [r.pattern for r in own] + (["|".join(r.pattern for r in issued)] if issued else [])
    return Plan((*own, *issued), tuple(patterns), am.compile_rules(patterns, len(own)))


class Scanner:
    """Spans of many texts at once; built in each task from the transition arrays."""

    def __init__(self, plan: Plan):
        self.plan, own = plan, len(BASE_KINDS & {r.kind for r in plan.rules})
        self.steps = plan.compiled.table.tolist()
        self.least = [r.least for r in plan.rules[:own]] + [1] * (len(plan.patterns) - own)
        self.readers = [am.Reader(p) for p in plan.patterns]
        self.own, self.forms = own, [(k, r.least, re.compile(f"(?:{r.head})({r.tail}+)".encode())) for k, r in enumerate(plan.rules) if k >= own]

    def _form(self, match: bytes) -> int:
        """The rule of an issued form, by its head; -1 where its last run is too short."""
        for k, least, form in self.forms:
            if m := form.fullmatch(match):
                return k if len(m[m.lastindex]) >= least else -1
        return -1

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Each text's (start, rule, end) in code points, in order; a null text has none."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for row, _, data, at in ts.chunks(column, am.STEPS * am.LANES):
            joined = np.insert(data, at[1:], am.PART)
            first = at[:-1] + np.arange(len(at) - 1)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for scanned, floor, seen, end in am.runs(self.plan.compiled, self.steps, joined, self.least):
                for text, low, shown, stop in zip((np.searchsorted(first, seen, side="right") - 1).tolist(), floor.tolist(), seen.tolist(), end.tolist(), strict=True):
                    start = self.readers[scanned].first(joined, max(low, int(first[text])), shown)
                    rule = scanned if scanned < self.own else self._form(joined[start:stop].tobytes())
                    if rule >= 0:
                        found.setdefault(text, []).append((start, rule, stop))
            for text, spans in found.items():
                begin, end = int(first[text]), int(at[text + 1]) + text
                points = np.concatenate(([0], np.cumsum((joined[begin:end] & 0xC0) != 0x80)))
                out[row + text] = sorted((int(points[a - begin]), rule, int(points[b - begin])) for a, rule, b in spans)
        return out


def _slices(batches, size: int = 1000):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns doc_id, base (spans of the kinds in BASE) and spans (all of them): arrays of
    (kind, start, end) in code points with an exclusive end, by start, then kind in the
    order of the rules. Spans of one kind never overlap; those of different kinds may. Null
    and empty texts have no spans, repeated rows repeat, a null id stays null, an empty
    table gives an empty result and further columns are ignored. Work is linear in a text.
    """
    plan = compile_plan(rules)

    def run(batches):
        scanner = Scanner(plan)
        for part in _slices(batches):
            every = [[{"kind": plan.rules[r].kind, "start": a, "end": b} for a, r, b in own] for own in scanner.spans(part.column(1))]
            first = [[s for s in own if s["kind"] in BASE_KINDS] for own in every]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(first, pa.list_(SPAN)), pa.array(every, pa.list_(SPAN))], names=["doc_id", "base", "spans"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, all spans as one string, and how many the issued forms add."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.filter("base", lambda s: s["kind"] == kind)

    return found.select(
        "doc_id",
        *(F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns with every secret replaced by its kind in angle brackets.

    Spans that overlap go as one, by the kind of the first. A null text stays null, an empty
    one empty; repeated rows repeat, an empty table gives an empty result, and further
    columns stay as they are.
    """
    plan = compile_plan(rules)

    def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for a, rule, b in spans:
            if a >= at:
                out += [text[at:a], f"<{plan.rules[rule].kind}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        scanner = Scanner(plan)
        for batch in _slices(batches):
            k = batch.schema.get_field_index(text_col)
            texts = batch.column(k)
            new = [masked(t, s) for t, s in zip(texts.to_pylist(), scanner.spans(texts), strict=True)]
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
