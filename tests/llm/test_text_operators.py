"""BPE, personal data, quality, page text, licenses and toxicity, each against a plain version or known cases."""

import hashlib
import html
import re
import zlib
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import bpe, html_text, license_scan, pii, quality, toxicity
from tests.llm.brute import words_of

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("label", T.IntegerType()), ("n_words", T.StringType()))])
PLAIN = "the cat of the house and a dog in the garden that is with for to " * 12
TEXTS = [
    "", None, "  ", "a", PLAIN, PLAIN, PLAIN.upper(), "Licensed under the APACHE\tLicense, Version 2.0.\nCC BY-NC 4.0", "one two three one two three\none two\none two\n\n \nx # $ é",
    "mail a.b@c.de, 1.2.3.4 and 999.1.1.1 or 4111 1111 1111 1111, +1 (555) 123-4567", "it's we'll ’S <|endoftext|> x<|startoftext|>y Σίσυφος ΟΔΟΣ İ \x1c \x85 日本 12",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\nto deal in the software without restriction",
    "| ".join(f"cell{k}" for k in range(150)), "word " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, i % 2, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, PLAIN, "xx", None, None), (4, PLAIN, "en", 1, "x")], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_equals_the_library(docs):
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = vocabularies.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = bpe.encode_table(docs, path).collect()
    assert len(got) == docs.count()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else PLAIN) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def plain_spans(text):
    text = text or ""
    kept = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    kept["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    kept["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    kept["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return kept


def test_base_spans_equal_plain_patterns(docs):
    got = by_id(pii.span_digest(pii.find_personal_data(docs)))
    for i, t in enumerate(TEXTS):
        spans = plain_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, own in spans.items() for a, b in own)
        assert [got[i][f"n_{k}"] for k in spans] == [len(own) for own in spans.values()]
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert got[9].n_email == got[9].n_ip == got[9].n_card == got[9].n_phone == 1


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe (at) example [dot] com now", "email", "john.doe (at) example [dot] com"),
        ("write to jo at example dot com", "email", "jo at example dot com"),
        ("раураl@ехample.com", "email", "раураl@ехample.com"),
        ("call plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
        ("192[.]168[.]1[.]20", "ip", "192[.]168[.]1[.]20"),
        ("４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
    ],
)
def test_disguised_spans_map_to_the_source(text, kind, found):
    spans = pii.disguised(text, pii.find(text))[kind]
    assert [text[a:b] for a, b in spans] == [found]


def test_plain_words_are_left_alone(spark, docs):
    for text in ("see me at home. the dot and one two", "look at the dot", PLAIN):
        assert not any(pii.disguised(text, pii.find(text)).values())
    masked = by_id(pii.redact(docs.where("doc_id is not null")))
    assert masked[9].text == "mail <email>, <ip> and 999.1.1.1 or <card>, <phone>" and masked[1].text is None and masked[4].text == PLAIN


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("call plus 49 30 12345678 now", "phone", "plus 49 30 12345678"),
        ("pay " + ", ".join(["four"] + ["one"] * 15), "card", ", ".join(["four"] + ["one"] * 15)),
        ("ask jo.doe at example.com please", "email", "jo.doe at example.com"),
        ("ask jo at example dot museum please", "email", "jo at example dot museum"),
        ("ask jo at example dot it", "email", "jo at example dot it"),
    ],
)
def test_the_gate_lets_all_disguises_through(text, kind, found):
    assert [text[a:b] for a, b in pii.disguised(text, pii.find(text))[kind]] == [found]


def test_gated_and_ungated_results_are_equal(monkeypatch):
    import random

    rnd = random.Random(8)
    parts = "plus at dot (at) [dot] four one, two- 49 1234 30 . @ jo example com it the раu \u200b １２ 4111 1111 , look +1".split(" ")
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(3000)]
    gated = [pii.disguised(t, pii.find(t)) for t in texts]
    monkeypatch.setattr(pii, "changes", lambda text: True)
    assert gated == [pii.disguised(t, pii.find(t)) for t in texts] and any(any(g.values()) for g in gated)


def plain_quality(text):
    w = words_of(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_equal_plain_counts(docs):
    judged = quality.judge(docs)
    assert "Arrow" not in judged._jdf.queryExecution().toString() and "Python" not in judged._jdf.queryExecution().toString()
    got = by_id(judged)
    for i, t in enumerate(TEXTS):
        want = plain_quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_measuring_runs_no_python(docs, tmp_path):
    plan = quality.measure(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan


def test_divergence_drops_a_text_unlike_its_language(spark):
    import random

    rnd = random.Random(1)
    prose = [" ".join(rnd.choice("the of and to in a is that house cat dog tree garden walks sees".split()) + rnd.choice(["", "", ",", "s", "y", "ed", "er"]) for _ in range(300)) for _ in range(30)]
    odd = " ".join(f"{rnd.choice('QXZ')}{rnd.randrange(10**6)}#%" for _ in range(300))
    got = by_id(quality.judge(spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate([*prose, odd])], SCHEMA)))
    assert not got[30].kept and not got[30].base_failed and all(got[i].kept for i in range(30) if not got[i].base_failed)


def test_page_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-nav"><header>Site</header><nav><ul><li><a>Menu, home</a></ul></nav>
      <div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First <b>para</b>graph, with text.<p>Second&nbsp;one:
      it goes on, and on.<div class="ad">Buy!</div><aside>Related</aside><p>Third.</p><form>Mail</form><section id="comments"><p>Nice, thanks!</p></section></article>
      <div class="sidebar">Links</div><footer>&copy; site</footer><script>var t="</p>";</script></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>plain text"), (4, "x", "<nav>only</nav>"), (5, "y", "a < b")]
    got = html_text.extract_table(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert text == {1: "A & B First paragraph, with text. Second one: it goes on, and on. Third.", 2: "", 3: "", None: "plain text", 4: "", 5: "a < b"}
    assert all(r.n_chars == len(r.text) for r in got)


def test_page_text_keeps_titles_sections_and_misleading_names():
    long = "A sentence of the article, with marks; it goes on, and on, for a while. " * 12
    short = "A later section, much shorter, but still of the article. " * 3
    page = f"<body><div class=menu>Home</div><article><h1>Title</h1><div class=body><p>{long}<p>{long}</div><section><p>{short}</section></article></body>"
    assert html_text.extract(page).split() == f"Title {long} {long} {short}".split()
    for name in ("content with-sidebar", "no-header"):
        page = f"<body><div class='{name}'><h2>Head</h2><p>{long}<p>{long}<div class=sidebar>Links</div></div><div class=footer>Imprint</div></body>"
        assert html_text.extract(page).split() == f"Head {long} {long}".split()


def test_license_phrases_and_notices(docs):
    got = by_id(license_scan.scan(docs))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(TEXTS):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert got[7].base_labels == "apache,cc-by" and got[7].score == 1.0
    assert got[11].labels == "mit" and got[11].n_base == 0 and 0.8 <= got[11].score <= 1.0 and got[4].score == 0.0


def test_prefix_index_finds_what_full_comparison_finds():
    import random

    import numpy as np

    rnd, known = random.Random(2), license_scan.templates()
    frequency = np.array([rnd.randrange(1000) for _ in range(license_scan.VOCABULARY)])
    index = license_scan.prefix_index(known, frequency, 80)
    for _ in range(2000):
        base = rnd.choice(index.sets)
        block = np.unique([x for x in base if rnd.random() < rnd.choice([0.7, 0.85, 1])] + [rnd.randrange(len(index.rank)) for _ in range(rnd.randrange(5))]).astype(int)
        want = {t for t, s in enumerate(index.sets) if len(np.intersect1d(s, block)) * 100 >= 80 * len(s)}
        assert {t for step in index.postings for t in license_scan.contained(block, index, step)} == want


def test_toxicity_score_equals_the_plain_sum():
    import numpy as np

    weights = np.zeros(toxicity.SIZE, dtype=np.float32)
    rnd = np.random.default_rng(1)
    at = rnd.integers(toxicity.SIZE, size=toxicity.SIZE // 3)
    weights[at] = rnd.standard_normal(len(at)) / 20
    model, mask = toxicity.Model(weights, -0.3), (1 << 32) - 1

    def bucket(gram):  # the rolling hash of one n-gram, said for one gram
        h = 0
        for c in gram:
            code = ((ord(c) + 1) * 0x9E3779B1) & mask
            h = (h * 0x85EBCA6B + (code ^ (code >> 15))) & mask
        return ((((h ^ (h >> 13)) * 0xC2B2AE35) + len(gram)) & mask) >> (32 - toxicity.HASH_BITS)

    texts = ["Some words, here!", "", None, "x", "ação — é dreadful", "same same same same"]
    for text, got in zip(texts, toxicity.score_texts(texts, model), strict=True):
        plain = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in f" {(text or '').lower()} ")
        grams = {plain[i : i + n] for n in toxicity.LENGTHS for i in range(len(plain) - n + 1)}
        total = sum(float(weights[b]) for b in {bucket(g) for g in grams}) - 0.3
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-6


def test_toxicity_learns_and_generalises(spark):
    import random

    rnd = random.Random(4)
    mild, bad = [f"word{chr(97 + k)}{chr(98 + k % 7)}" for k in range(20)], ["dreadfool", "nastymoron"]
    rows = []
    for i in range(900):
        w = [rnd.choice(mild) for _ in range(rnd.randrange(5, 80))]
        if i % 6 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(bad) + rnd.choice(["", "!", "s"])
        rows.append((i, " ".join(w), None, int(i % 6 == 0), None))
    table = spark.createDataFrame(rows, SCHEMA)
    labels = table.select("doc_id", F.col("label").alias("toxic"))
    model = toxicity.fit(toxicity.training_rows(table, labels))
    edge = spark.createDataFrame([(1000, None, None, None, None), (None, "", None, None, None)], SCHEMA)
    scored = toxicity.score(table.unionByName(edge), model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(scored) == 902 and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id < 900]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in scored if r.doc_id is not None)
    assert sum((r.score >= 0.7) == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity.reject(table, model).count() >= 740
    alone = toxicity.fit(toxicity.training_rows(table.limit(0), labels))
    assert toxicity.score(table.limit(0), alone).count() == 0


def test_every_given_page_is_its_article():
    pages = Path("/root/testdata/sf0.01/pages.parquet")
    if not pages.exists():
        pytest.skip("no test tables here")
    blocks = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|td|th|blockquote|pre|figure|figcaption)\b[^>]*>"
    for row in pq.read_table(pages).to_pylist():
        inside = re.search(r"<article[^>]*>(.*?)</article>", row["html"], re.DOTALL)[1]
        inside = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "", inside)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(blocks, " ", inside))).split())
        assert html_text.extract(row["html"]) == want, row["page_id"]
