"""Secrets by the automaton against plain regular expressions, on random and planted texts."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import automaton, secret_scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
BITS = (
    ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "AKIA", "A", "0", "f", "abcdef01", "é", "日本", "\n", "\x00", "."]
    + ["ghp_", "xoxb-", "eyJ", "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "://", "u:", "pw@", "Authorization:", "Bearer ", "sk_live_", "AIza", "Zz9Zz9Zz9Zz9Zz9Zz9", "npm_", "glpat-"]
)


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def plain_issued(text):
    """The match whose shortest form ends first, of several the leftmost, taken to its longest end."""
    forms = [re.compile(f"(?:{r.head})({r.tail}+)") for r in secret_scan.ISSUED]
    found, done, end = [], 0, 1
    while end <= len(text):
        first = next((a for a in range(done, end) if any(f.fullmatch(text, a, end) for f in forms)), None)
        if first is not None:
            m, k = max(((f.match(text, first), k) for k, f in enumerate(forms)), key=lambda x: x[0].end() if x[0] else -1)
            if len(m[m.lastindex]) >= secret_scan.ISSUED[k].least:
                found.append((first, k + 3, m.end()))
            done = end = m.end()
        end += 1
    return found


@pytest.fixture(scope="module")
def scanner():
    return secret_scan.Scanner(secret_scan.compile_plan())


def test_random_texts(scanner):
    rnd = random.Random(4)
    for _ in range(60):
        texts = ["".join(rnd.choice(BITS) for _ in range(rnd.choice((1, 5, 30)))) for _ in range(8)] + ["", None]
        assert scanner.spans(pa.array(texts)) == [sorted(plain_base(t or "") + plain_issued(t or "")) for t in texts]


def test_long_texts_cross_blocks_and_lanes(scanner):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(BITS[:21]) for _ in range(120_000)), "secret=password:" + "a" * 300_000 + " token=abcdefgh1" + " é" * 200_000 + "secret=12345678", "0" * 600_000]
    assert [[s for s in own if s[1] < 3] for own in scanner.spans(pa.array(texts))] == [plain_base(t) for t in texts]


def test_a_failing_match_is_used_up(scanner):
    assert scanner.spans(pa.array(["secret=api_key:abcdefgh12", "api_key:abcdefgh12"])) == [[], [(0, 0, 18)]]


def test_planted_credentials_and_clean_prose(scanner):
    run = "Ab3" * 20
    planted = {
        f"use ghp_{run[:36]} now": "github", f"x glpat-{run[:20]}": "gitlab", f"xoxb-{run[:24]}": "slack", f"AIza{run[:35]}": "google", f"sk_live_{run[:24]}": "stripe",
        f"npm_{run[:36]}": "npm", f"eyJ{run[:20]}.eyJ{run[:20]}.{run[:30]}": "jwt", f"Authorization: Bearer {run[:30]}": "bearer", "-----BEGIN RSA PRIVATE KEY-----": "pem", "https://me:pass1@host.org/x": "login",
    }
    for text, kind in planted.items():
        assert [secret_scan.RULES[r].kind for _, r, _ in scanner.spans(pa.array([text]))[0]] == [kind], text
    clean = ["the secret: a walk", "token = x", "see https://host.org:8080/a@b", "a bearer of news", "AKIA is a name", "deadbeef faded", "BEGIN PRIVATE KEY", "password: short"]
    assert scanner.spans(pa.array(clean)) == [[] for _ in clean]


def test_the_automaton_is_minimal_and_refuses_rules_it_cannot_decide():
    small = automaton.compile_rules(["(ab|cb)c+"])
    assert small.size == 4  # nothing, a or c, b, c: both branches share what follows
    with pytest.raises(ValueError):
        automaton.compile_rules(["ax*b|xx"])


def test_the_operator_on_odd_rows(spark):
    hit = "token = 'abcdefgh12' é " + "0a" * 20
    rows = [(1, hit), (1, hit), (2, None), (3, ""), (None, "é AKIA" + "Q7" * 8), (4, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("own"), "base": F.lit(1)})
    got = sorted(map(tuple, secret_scan.span_digest(secret_scan.find_secrets(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "spans").collect()), key=str)
    first = (1, 1, 0, 1, "assign:0:19,hex:23:63")
    assert got == sorted([first, first, (2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (None, 0, 1, 0, "access:2:22"), (4, 0, 0, 0, "")], key=str)
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r.text or "")[:40] for r in clean.collect()) == sorted(["<assign>' é <hex>"] * 2 + ["", "", "é <access>", "x" * 40])
