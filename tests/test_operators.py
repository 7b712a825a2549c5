"""Operators on small rows of their own, and the lexer against a plain line-by-line fold."""

import json
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.config import Chunking, Patterns
from lexmill.functions import text
from lexmill.operators import answers, chunking, history, index, lexer, search
from lexmill.sources import documents
from lexmill.streaming import intake

LAW = """LEI Nº 9.001, de 3 de maio de 2011
CAPÍTULO I
Das regras
Art. 1º Esta lei segue a Lei Federal nº 10.257/2001
e outras normas.
Art. 2º São fins:
I - o primeiro;
II - o segundo (NR);
Capítulo II - Do uso
SEÇÃO I
Dos lotes
Art. 3. O lote tem:
§ 1º Área mínima.
Parágrafo único. Nada mais.
a) sala;
1. item;
Obs: ver anexo
Subseção II
"""


def plain_fold(rows):
    """Token types of lines by the state machine, one line after another."""
    p, out, last = Patterns(), [], None
    for line in rows:
        ci = re.IGNORECASE
        for name, pattern, flags in (("CAPITULO", p.chapter, ci), ("SUBSECAO", p.subsection, ci), ("SECAO", p.section, ci), ("ARTIGO", p.article, 0), ("PARAGRAFO", p.paragraph, ci), ("INCISO", p.inciso, 0), ("ALINEA", p.alinea, 0)):
            if re.search(pattern, line, flags):
                kind = name
                break
        else:
            title = len(line) <= 120 and line[-1] not in ".;:"
            if re.search(p.item, line) and last in ("ALINEA", "INCISO", "ITEM"):
                kind = "ITEM"
            elif re.search(p.note, line, ci):
                kind = "OBSERVACAO"
            elif last == "CAPITULO" and title:
                kind = "TITULO_CAPITULO"
            elif last in ("SECAO", "SUBSECAO") and title:
                kind = "TITULO_SECAO"
            elif last in ("ARTIGO", "CAPUT"):
                kind = "CAPUT"
            else:
                kind = "TEXTO"
        out.append(kind)
        if kind not in ("OBSERVACAO", "TEXTO"):
            last = kind
        elif kind == "TEXTO" and last in ("CAPITULO", "SECAO", "SUBSECAO"):
            last = "TEXTO"
    return out


def test_lexer_equals_the_fold(spark):
    rnd = random.Random(7)
    lines = ["CAPÍTULO I", "Seção II", "Subseção 3", "Art. 4º caput", "§ 1º x", "I - y", "a) z", "1. w", "Obs: n", "free title", "a sentence.", "t" * 130, "1) v"]
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 25))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate([*texts, LAW])), "doc_id long, text string")
    got = {}
    for r in lexer.main_tokens(lexer.lines(docs)).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.type)
    for k, t in enumerate([*texts, LAW]):
        assert got[k] == plain_fold([x.strip() for x in t.split("\n") if x.strip()]), t


def test_one_law(spark):
    toks = lexer.tokens(lexer.lines(spark.createDataFrame([(1, LAW)], "doc_id long, text string")))
    counts = {r["type"]: r["count"] for r in toks.groupBy("type").count().collect()}
    assert counts["ARTIGO"] == 3 and counts["CAPITULO"] == 2 and counts["REFERENCIA_LEGAL"] == 2 and counts["NOVA_REDACAO"] == 1 and counts["DOCUMENT"] == 1
    arts = [tuple(r)[2:] for r in lexer.articles(toks).orderBy("idx").collect()]
    assert arts == [
        ("1", "Art. 1", "CAPÍTULO I — Das regras", "", "Esta lei segue a Lei Federal nº 10.257/2001 e outras normas."),
        ("2", "Art. 2", "CAPÍTULO I — Das regras", "", "São fins:"),
        ("3", "Art. 3", "CAPÍTULO II — Do uso", "Seção I — Dos lotes", "O lote tem:"),
    ]
    parents = lexer.with_parents(toks).where("depth is not null").collect()
    by = {r.idx: r for r in parents}
    assert {(r.type, by[r.parent_idx].type if r.parent_idx >= 0 else None) for r in parents} >= {("INCISO", "ARTIGO"), ("SECAO", "CAPITULO"), ("ALINEA", "PARAGRAFO"), ("ITEM", "ALINEA"), ("CAPITULO", None)}
    named = {(r.type, r.label) for r in lexer.labels(toks).collect()}
    assert {("PARAGRAFO", "Parágrafo único"), ("PARAGRAFO", "§ 1º"), ("ALINEA", "a)"), ("ITEM", "1."), ("SUBSECAO", "Subseção II")} <= named


def test_cleaning(spark):
    cases = [("a   b", "a b"), ("a\r\nb\rc", "a\nb\nc"), ("a\n\n\n\nb", "a\n\nb"), ("“x” ‘y’", "\"x\" 'y'"), ("lei muni-\ncipal", "lei municipal"), ("a\x07b", "ab"), ("a b", "a b"), ("  a \n b  ", "a\nb"), ("café Ã§", "café ç"), ("word- \nrest", "word-\nrest"), ("", "")]
    got = text.clean(spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.cleaned for r in got] == [w for _, w in cases]
    assert got[0].n_remover_espacos_extras == 1 and got[8].n_corrigir_encoding == 1 and got[1].n_normalizar_quebras == 2


@pytest.mark.parametrize(("limit", "overlap", "want"), [(10, 0, [[0, 1], [2], [3, 4]]), (10, 1, [[0, 1], [1, 2], [2, 3], [3, 4]]), (3, 0, [[0], [1], [2], [3], [4]])])
def test_pack_units(spark, limit, overlap, want):
    df = spark.createDataFrame([([4, 5, 6, 5, 5],)], "t array<bigint>")
    assert df.select(chunking.pack_units(F.col("t"), F.lit(limit), overlap)).first()[0] == want


def test_chunks_name_their_parts(spark):
    rows = [(1, 5, "Lei 1", "Cap I", "", "Art. 5", ["um " * 40, "dois " * 40, "três " * 40]), (1, 9, "Lei 1", "", "", "Art. 9", [])]
    got = chunking.chunks(spark.createDataFrame(rows, "doc_id long, idx int, title string, chapter string, section string, label string, units array<string>"), Chunking(max_tokens=100, overlap=0)).orderBy("chunk_index").collect()
    assert [(r.idx, r.part, r.total_parts) for r in got] == [(5, 1, 2), (5, 2, 2), (9, 1, 1)]
    assert got[0].content.startswith("Lei 1 > Cap I > Art. 5\n[Parte 1/2]\n\num") and got[2].content == "Lei 1 > Art. 9\n\n"


def test_figure_boxes(spark):
    rows = [(1, 1, k, 1000, 1000, b) for k, b in enumerate([[50.0, 10.0, 10.0, 90.0], [0.0, 0.0, 0.5, 50.0], [-20.0, 0.0, 130.0, 100.0], [1.0, 2.0, 3.0], [0.0, 0.0, 5.0, 5.0], [0.0, 0.0, float("nan"), 9.0]])]
    got = chunking.valid_boxes(spark.createDataFrame(rows, "document_id long, page int, ord int, page_width int, page_height int, bbox array<double>")).orderBy("figure_index").collect()
    assert [(r.figure_index, r.width, r.height) for r in got] == [(0, 400, 800), (1, 1000, 1000)]


@pytest.mark.parametrize(
    ("reference", "name", "fits"),
    [("lei nº 10.257/2001", "lei federal 10257", True), ("luos", "lei luos do municipio", True), ("plano diretor municipal", "plano diretor", True), ("codigo de obras", "lei tributaria", False), ("xy", "abc", False), ("ab", "xx ab yy", True)],
)
def test_reference_matching(spark, reference, name, fits):
    got = search.match_references(spark.createDataFrame([(reference,)], "ref string"), spark.createDataFrame([(1, name)], "document_id long, name string"))
    assert (got.count() == 1) == fits


def test_detect_type(spark):
    rows = [("A.PDF", None, None, "PDF"), ("x.md", None, None, "MARKDOWN"), ("x.bin", "text/html", None, "HTML"), (None, None, "t", "PASTED"), ("x", None, None, "TXT")]
    got = spark.createDataFrame(rows, "name string, mime string, pasted string, want string").select(documents.detect_type(F.col("name"), F.col("mime"), F.col("pasted")), "want").collect()
    assert all(a == b for a, b in got)


def test_index_rows_and_upsert_are_idempotent(spark):
    calls = []

    def client():
        def embed(texts):
            calls.append(len(texts))
            return [(k, [float(len(t))] * 3) for k, t in enumerate(texts) if t != "skip"][::-1]

        return embed

    chunks = spark.createDataFrame([("a", "xx"), ("b", "yyy"), ("c", "skip")], "chunk_id string, content string")
    made = {r.chunk_id: (list(r.vector), r.dimension) for r in index.apply_model(chunks, client, batch_size=2).collect()}
    assert made == {"a": ([2.0] * 3, 3), "b": ([3.0] * 3, 3), "c": ([], 0)}
    old = chunks.select("chunk_id", F.sha2("content", 256).alias("hash"), F.lit("m").alias("model"))
    assert index.pending_embeddings(chunks, old, "m").where("pending").count() == 0
    assert index.pending_embeddings(chunks, old, "n").where("pending").count() == 3
    assert index.upsert(old, old.limit(1), ["chunk_id"]).count() == 3
    vectors = spark.createDataFrame([("a", [1.0]), ("b", None)], "chunk_id string, vector array<double>")
    rows = chunks.selectExpr("chunk_id", "1 document_id", "4 chunk_index", "'Art. 1' article", "'' chapter", "'' section", "1 part", "1 total_parts", "struct('x' as tema) enrichment")
    good, bad = index.index_rows(vectors, rows, spark.createDataFrame([(1, "lei")], "document_id int, name string"))
    assert [(r.chunk_id, r.metadata.documento, r.metadata.chunk_index, r.metadata.enriquecimento.tema, r.indexed) for r in good.collect()] == [("a", "lei", 4, "x", True)]
    assert [r.chunk_id for r in bad.collect()] == ["b"]
    stored = spark.createDataFrame([("a", "h", True), ("z", "h", True)], "chunk_id string, hash string, indexed boolean").withColumn("indexed_at", F.current_timestamp())
    fresh = index.upsert_embeddings(stored, spark.createDataFrame([("a", "h2")], "chunk_id string, hash string"))
    assert {r.chunk_id: (r.hash, r.indexed, r.indexed_at is None) for r in fresh.collect()} == {"a": ("h2", False, True), "z": ("h", True, False)}


def test_validation_cases(spark):
    retrieved = spark.createDataFrame([(1, 0, "c1", "lei a", "art. 1"), (1, 1, "c2", "lei a", "art. 10"), (2, 0, "c3", "lei b", None)], "question_id long, ord int, chunk_id string, law string, article string")
    cited = spark.createDataFrame([(1, 0, "lei a", "art. 10"), (1, 1, "lei z", None), (2, 0, "lei b", "art. 3")], "question_id long, cite int, law string, article string")
    done = answers.reconcile(cited, retrieved).withColumn("shown", F.concat_ws(" ", "law", "article"))
    assert {(r.question_id, r.cite): r.chunk_id for r in done.collect()} == {(1, 0): "c1", (1, 1): None, (2, 0): "c3"}
    given = spark.createDataFrame([(1, "ALTO", False, 0), (2, "ALTO", True, 0), (3, "BAIXO", False, 0)], "question_id long, confidence string, has_conflict boolean, n_conflicts int")
    got = {r.question_id: (r.valid, r.insufficient, r.warnings) for r in answers.validate(given, done, retrieved).collect()}
    assert got == {1: (False, False, ["1" + answers.WARN_UNRESOLVED + "lei z"]), 2: (False, False, [answers.WARN_CONFLICT]), 3: (False, True, [answers.WARN_EMPTY])}


def test_streams_are_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, LAW), (2, "x  y")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        intake.intake(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/tokens"))
    assert got.where("type = 'ARTIGO'").count() == 3 and got.where("doc_id = 2").count() == 2
    assert spark.read.parquet(str(tmp_path / "out/nodes")).where("type = 'ARTIGO'").count() == 3
    chunks = spark.read.parquet(str(tmp_path / "out/chunks")).orderBy("chunk_index").collect()
    assert len(chunks) == 3 and chunks[1].content.endswith("Art. 2 São fins:\nI - o primeiro;\nII - o segundo (NR);")


def test_embeddings_outlive_a_new_checkpoint(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def client():
        def embed(texts):
            calls.add(len(texts))
            return [(k, [float(len(t))]) for k, t in enumerate(texts)]

        return embed

    def run(rows, cp):
        folder = str(tmp_path / f"chunks-{cp}-{len(list(tmp_path.glob(f'chunks-{cp}*')))}")
        spark.createDataFrame(rows, "chunk_id string, content string").write.parquet(folder)
        stream = spark.readStream.schema("chunk_id string, content string").parquet(folder)
        intake.refresh_embeddings(stream, str(tmp_path / "emb"), str(tmp_path / f"cp-{cp}-{folder[-1]}"), client, "m").awaitTermination()
        return {r.chunk_id: r.vector[0] for r in intake.current_embeddings(spark, str(tmp_path / "emb")).collect()}

    assert run([("a", "xx"), ("b", "yy")], "one") == {"a": 2.0, "b": 2.0}
    assert run([("a", "xx"), ("b", "yyy"), ("c", "z")], "two") == {"a": 2.0, "b": 3.0, "c": 1.0}
    assert calls.value == 4


def test_the_tree_of_a_law(spark):
    text_ = "Lei 1\nSeção I\nAntes\nArt. 1º Um (NR)\nobs: nota\nCAPÍTULO II\nArt. 2 Dois\nI - a\na) b\n1. c\nsolto\n2) d\n§ 1º p (NR)\nII - e\nCAPÍTULO III\n§ 2º órfão\nIV - órfão\nSubseção V\nArt. 3. Três segue a Lei nº 9.999, de 2001"
    tree = lexer.nodes(lexer.tokens(lexer.lines(spark.createDataFrame([(1, text_)], "doc_id long, text string"))))
    full = {r.idx: r.full_text for r in lexer.full_texts(lexer.structure_of(tree)).collect()}
    assert list(dict(sorted(full.items())).values()) == [
        "Art. 1 Um (NR)\nNova redação: (NR)\nobs: nota",
        "Art. 2 Dois\nI - a\na) b solto\n1. c\n2. d\n§ 1º p (NR)\nII - e",
        "Art. 3 Três segue a Lei nº 9.999, de 2001",
    ]
    assert [(r.label, r.chapter_index) for r in lexer.chapters_of(tree).orderBy("chapter_index").collect()] == [("(sem capítulo)", 0), ("CAPÍTULO II", 1), ("CAPÍTULO III", 2)]
    assert [(r.label, r.is_subsection) for r in lexer.sections_of(tree).orderBy("section_index").collect()] == [("Seção I", False), ("Subseção V", True)]
    assert [(r.label, r.inciso_index, r.paragraph_idx is None) for r in lexer.incisos_of(tree).orderBy("inciso_index").collect()] == [("I", 0, True), ("II", 1, False)]
    assert [(r.label, r["items"]) for r in lexer.alineas_of(tree).collect()] == [("a", [("1", "c"), ("2", "d")])]
    law = lexer.law_documents(tree).first().law
    assert law.titulo == "Lei 1" and [c.rotulo for c in law.capitulos] == ["", "CAPÍTULO II", "CAPÍTULO III"] and not law.artigos
    first = law.capitulos[0].secoes[0].artigos[0]
    assert (first.numero, first.caput, first.observacoes) == ("1", "Um (NR)", ["Nova redação: (NR)", "obs: nota"])
    second = law.capitulos[1].artigos[0]
    assert second.incisos[0].alineas[0].itens[1].texto == "d" and second.paragrafos[0].incisos[0].texto == "e"
    assert law.capitulos[2].secoes[0].artigos[0].referencias == ["Lei nº 9.999, de 2001"]
    counts = {r["type"]: r.n for r in lexer.node_counts(tree).collect()}
    assert counts["ARTIGO"] == counts["CAPUT"] == 3 and counts["DOCUMENT"] == 1 and counts["NOVA_REDACAO"] == 2


def test_the_tree_takes_one_exchange_and_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, LAW)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    toks = lexer.tokens(lexer.lines(spark.read.parquet(str(tmp_path / "docs"))))
    tree = lexer.nodes(toks)
    for df in (toks.groupBy("doc_id", "type").count(), lexer.articles_of(tree), lexer.full_texts(lexer.structure_of(tree)), lexer.law_documents(tree), lexer.articles_with_texts(tree), lexer.law_trees(tree)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan


def test_exports_with_their_exact_fields(spark):
    docs = spark.createDataFrame([(1, "lei 1.pdf"), (2, "b.txt")], "document_id long, name string")
    chunks = spark.createDataFrame([(1, 1, "z", 3), (1, 0, "a \"b\"", None)], "document_id long, chunk_index int, content string, token_count long")
    got = {r.document_id: (r.file_name, json.loads(r.body)) for r in documents.export_fields("chunks", docs, chunks).collect()}
    none = dict.fromkeys(("charCount", "part", "totalParts", "originArticle", "originChapter", "originSection", "enrichment"))
    assert got == {1: ("lei_1-chunks.json", [{"index": 0, "content": 'a "b"', "tokenCount": None} | none, {"index": 1, "content": "z", "tokenCount": 3} | none]), 2: ("b-chunks.json", [])}
    logs = spark.createDataFrame([("b", 1, "CLEANING", 2), ("a", 1, "TREE", 2), ("c", 1, "UPLOAD", 1)], "id string, document_id long, step string, created_at long")
    (body,) = [json.loads(r.body) for r in documents.export_fields("logs", docs, logs).collect() if r.document_id == 1]
    assert [(x["id"], x["documentId"], x["meta"]) for x in body] == [("c", 1, None), ("a", 1, None), ("b", 1, None)] and list(body[0]) == ["id", "documentId", "step", "level", "message", "meta", "createdAt"]


def test_trees_as_nested_json(spark):
    text_ = 'Lei 1\nantes\nSeção I\nAntes\nArt. 1º Um (NR)\nobs: "nota"\nCAPÍTULO II\nArt. 2 Dois\nI - a\na) b\n1. c\nsolto\n§ 1º p (NR)\nII - e\nCAPÍTULO III\n§ 2º órfão\nIV - órfão\n'
    tree = lexer.nodes(lexer.tokens(lexer.lines(spark.createDataFrame([(1, text_), (2, LAW)], "doc_id long, text string"))))
    rows = {(r.doc_id, r.idx): r for r in tree.collect()}

    def plain(doc, idx):
        r = rows[doc, idx]
        below = sorted(k for (d, k), c in rows.items() if d == doc and k and max(c.parent_idx, 0) == idx)
        own = {"id": str(idx), "type": r.type, "label": r.label or "", "number": r.number, "title": r.title, "text": r.text, "startLine": r.line_no}
        return {k: v for k, v in own.items() if v not in (None, "") or k == "label"} | {"children": [plain(doc, k) for k in below]}

    got = {r.doc_id: json.loads(r.tree) for r in lexer.law_trees(tree).collect()}
    assert got == {1: plain(1, 0), 2: plain(2, 0)}
    docs = spark.createDataFrame([(1, "lei 1.txt"), (3, "x.txt")], "document_id long, name string")
    bodies = {r.document_id: (r.file_name, r.body) for r in documents.export("tree", docs, lexer.law_trees(tree).withColumnRenamed("doc_id", "document_id"), []).collect()}
    assert bodies[3] == ("x-arvore.json", "null") and bodies[1][0] == "lei_1-arvore.json" and json.loads(bodies[1][1]) == got[1]


def test_links_by_repeated_labels(spark):
    text_ = "Lei 1\nArt. 1 Zero\nCAPÍTULO I\nSeção I\nArt. 2 Um\nCAPÍTULO II\nSeção I\nArt. 3 Dois\nCAPÍTULO I\nArt. 4 Três"
    tree = lexer.nodes(lexer.tokens(lexer.lines(spark.createDataFrame([(1, text_)], "doc_id long, text string"))))
    heads = {r.idx: r.label for r in tree.collect() if r.type in ("CAPITULO", "SECAO")}
    at = [i for i, _ in sorted(heads.items())]  # chapter I, section I, chapter II, section I, chapter I
    real = [(r.chapter_idx, r.section_idx) for r in lexer.article_links(tree).orderBy("idx").collect()]
    assert real == [(None, None), (at[0], at[1]), (at[2], at[3]), (at[4], None)]
    last = [(r.chapter_idx, r.section_idx) for r in lexer.article_links(tree, link_by_label=True).orderBy("idx").collect()]
    assert last == [(None, None), (at[4], at[3]), (at[2], at[3]), (at[4], None)]


def test_given_titles(spark):
    turns = spark.createDataFrame([(c, 0, "user", f"pergunta {c}") for c in (1, 2, 3)], "conv_id long, turn long, role string, text string")
    titles = spark.createDataFrame([(1, "Muros"), (2, None)], "conv_id long, title string")
    assert {r.conv_id: r.title for r in history.conversation_list(turns, titles).collect()} == {1: "Muros", 2: "pergunta 2", 3: "pergunta 3"}


def test_folding_sends_only_wide_texts_to_python(spark):
    texts = ["ÀÉÎÕÜÇ Ññ ß Ø ÿ µ", "Ação", "İstanbul Ǻ ǻ", "Σ e\u0301 日本", "", None, "ﬁ Å Å"]
    fold = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not "\u0300" <= c <= "\u036f")
    df = spark.createDataFrame([(t,) for t in texts] + [(chr(c),) for c in range(1, 0x250)], "t string")
    assert [r.f for r in df.select("t", text.fold("t").alias("f")).collect()] == [fold(r.t) for r in df.collect()]


def test_chunks_of_named_documents_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_CHUNKS", 7)
    rnd = random.Random(4)
    rows = [(k, k % 3, [float(rnd.randrange(-3, 4)) for _ in range(4)]) for k in range(120)] + [(120, 1, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, document_id long, vector array<float>")
    matches = spark.createDataFrame([(q, q % 3, 0, 0, "ref", "Lei", "Art. 1") for q in range(6)], "question_id long, document_id long, ord int, pos int, reference string, origin_document string, origin_article string")
    asked = spark.createDataFrame([(q, [1.0, float(q), -1.0, 0.5]) for q in range(6)], "question_id long, vector array<double>")

    def near(q):
        a = [1.0, float(q), -1.0, 0.5]
        dot = lambda x, y: sum(p * r for p, r in zip(x, y, strict=True))
        found = [(round(max(0.0, 1 - (dot(a, v) / (dot(a, a) * dot(v, v)) ** 0.5 if any(v) else 0.0)), 9), k) for k, d, v in rows if d == q % 3 and v]
        return [k for _, k in sorted(found)[:2]]

    got = {}
    for r in search.cross_reference_chunks(matches, asked, vectors).orderBy("rank").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got == {q: near(q) for q in range(6)}


def test_html_to_text(spark):
    cases = [
        ("a&ccedil;&atilde;o &#233; &#xE9;&nbsp;x", "ação é é x"),
        ("<p>a</p><nav><style>b{}</style>Menu</nav><p>c</p>", "a\nc"),
        ("<script>var t='</p>';</script>x<!-- y -->z<img src=q>w", "xzw"),
        ("<a href='u'>link</a> <b>bold<br>next", "link bold\nnext"),
        ("1 < 2 &amp;lt; 3", "1 < 2 &lt; 3"),
        ("x<script>never closed", "x"),
        ("<nav><nav>in</nav>MENU</nav>after</nav>more", "aftermore"),
        ("a<NAV class='x'>b<nav>c</nav>d", "a"),
        ('<a title="a>b">t</a>', "t"),
        ("<img alt='x>y'>z", "z"),
        ('<a title="<nav>">kept</a><p title="</p>">p</p>', "kept\np"),
        ("<!-- <script> -->seen<script src='a>b'>x</script>", "seen"),
        ('left <b title="open>text', "left"),
        ("<!DOCTYPE html><p>x</p>a <3 b", "x\na <3 b"),
        ("", ""),
    ]
    got = spark.createDataFrame([(c,) for c, _ in cases], "h string").select(documents.html_to_text(F.col("h"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_references_without_a_semicolon(spark):
    cases = [
        ("<title>and&amp</title>x &am &copy;&amp;lt; &ccedil; &ampx;", "and&\nx &am ©&lt; ç &x;", "and&amp\nx &am ©&lt; ç &ampx;"),
        ("&amp;&amp;&amp<p>&#233 &#233;", "&&&\né é", "&&&amp\n&#233 é"),
        ("a&amp;quot;b &quot;c&quot;", 'a&quot;b "c"', 'a&quot;b "c"'),
    ]
    rows = spark.createDataFrame([(c,) for c, _, _ in cases], "h string")
    got = rows.select(documents.html_to_text(F.col("h")), documents.html_to_text(F.col("h"), closed=True)).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_line_diffs_are_the_runs_of_line_diff(spark):
    pairs = [(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "a"), (3, "same", "same"), (4, None, None), (5, "", "q\n")]
    df = spark.createDataFrame(pairs, "k long, b string, a string").repartition(1)
    want = [(r.k, r.pos, r.run.op, r.run.text) for r in df.select("k", F.posexplode(text.line_diff("b", "a")).alias("pos", "run")).collect()]
    got = text.line_diffs(df, "k", "b", "a").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert text._diff_runs("a\nb", "a\nc\nd") == [("=", "a"), ("-", "b"), ("+", "c\nd")]


def test_chapters_and_searched_articles_read_the_texts_once(spark, tmp_path):
    rows = [(1, LAW), (2, "Seção I\nA\nCAPÍTULO I\nB\nArt. 1 x"), (3, "Art. 1 x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    tree = lexer.nodes(lexer.tokens(lexer.lines(spark.read.parquet(str(tmp_path / "docs")))))
    chapters = lexer.chapters_of(tree)
    assert chapters._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [(r.idx, r.label, r.chapter_index) for r in chapters.where("doc_id = 2").orderBy("idx").collect()] == [(-1, "(sem capítulo)", 0), (3, "CAPÍTULO I", 1)]
    arts = lexer.articles_with_texts(tree).select(F.col("doc_id").alias("document_id"), F.col("idx").alias("article_index"), "label", "number", "caput", "full_text")
    names = spark.createDataFrame([(1, "Lei 1")], "document_id long, name string")
    found = history.search_articles(spark.createDataFrame([(1, "art. 1"), (2, "lei 1")], "query_id long, query string"), arts, names)
    assert "/docs" not in found._jdf.queryExecution().optimizedPlan().toString() and str(tmp_path) not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.document_id) for r in found.collect()} >= {(1, 1), (1, 3), (2, 1)}


def test_viewed_articles_take_one_exchange(spark, tmp_path):
    odd = "Art. 1º a\nI - b\na) c\n1. d\nObs: x\n§ 1º e (NR)\nII - f\na) g\nParágrafo único. h\n1. i\nCAPÍTULO I\nIII - k\nArt. 2º\nl"
    spark.createDataFrame([(1, LAW), (2, odd), (3, "no article"), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    tree = lexer.nodes(lexer.tokens(lexer.lines(spark.read.parquet(str(tmp_path / "docs")))))
    chunks = spark.createDataFrame([(1, 1, 5, 1, "x", ("REVOGADO",))], "doc_id long, article_idx int, chunk_id long, part int, content string, enrichment struct<observacoes: string>")
    figures = spark.createDataFrame([], "doc_id long, article_idx int, page int, figure_index int, figure_id long")
    done = history.article_viewer(tree, chunks, figures)
    assert done._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    arts = lexer.articles_with_parts(tree)
    assert arts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    texts = {(r.doc_id, r.idx): r.full_text for r in lexer.full_texts(lexer.structure_of(tree)).collect()}
    assert {(r.doc_id, r.idx): r.full_text for r in done.collect()} == texts and len(texts) >= 3
    nested = {r.doc_id: r.law for r in lexer.law_documents(tree).collect()}
    own = {(r.doc_id, r.number): (r.paragrafos, r.incisos) for r in arts.collect()}
    assert own[2, "1"] == (nested[2].artigos[0].paragrafos, nested[2].artigos[0].incisos) and own[2, "1"][1][0].alineas[0].itens[0].texto == "d"


def test_entities_are_parsed_once_a_row(spark):
    raw = '{"medidas": ["3 m", " "], "lei": ["x", 4, null], "zona": "text", "other": ["y"]}'
    df = spark.createDataFrame([(raw,), ("[",), (None,)], "raw string").select(answers.parse_entities(F.col("raw")).alias("e"))
    done = df.select(answers.entity_terms(F.col("e")).alias("terms"))
    assert [r.terms for r in done.collect()] == [["x", "3 m"], [], []]
    assert done._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson") == 1


def test_cues_spare_no_fitting_line(spark):
    odd = ["ſ", "LEİ nº 5", "leı nº 7", "Lei nº 10.257 (nr)", "a REDAÇÃO DADA PELA b", "mEdIdA Provisória nº 3", "( NR )", "\u2003\ufeff Decreto-Lei nº 1\u3000", "x", "emenda constitucional nº 9 ( Nova Redação )"]
    df = spark.createDataFrame([(1, "\n".join(odd))], "doc_id long, text string")
    got = [(r.type, r.text) for r in lexer.tokens(lexer.lines(df)).orderBy("idx").collect() if r.type in ("NOVA_REDACAO", "REFERENCIA_LEGAL")]
    plain = Patterns(amendment=Patterns.amendment + "(?:)", citation=Patterns.citation + "(?:)")  # the same, without cues
    want = [(r.type, r.text) for r in lexer.tokens(lexer.lines(df), plain).orderBy("idx").collect() if r.type in ("NOVA_REDACAO", "REFERENCIA_LEGAL")]
    assert got == want and len(got) >= 8


def test_a_block_of_questions_is_compared_some_at_a_time():
    rng, n = np.random.default_rng(5), 3 * search.QUESTIONS_AT_ONCE + 1
    q, x = rng.normal(size=(n, 8)), rng.normal(size=(200, 8))
    excluded = [[k % 5] if k % 2 else [] for k in range(n)]
    row = [[list(range(n))], [q.tolist()], [excluded], [list(range(200))], [[c % 5 for c in range(200)]], [x.tolist()]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=list("abcdef"))
    done = list(search._block_top_k(3, False)([batch]))
    assert max(len(set(b.column(0).to_pylist())) for b in done) == search.QUESTIONS_AT_ONCE
    got = [r for b in done for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    distance = 1 - search._unit(q) @ search._unit(x).T
    for k in range(n):
        distance[k, [c for c in range(200) if c % 5 in excluded[k]]] = np.inf
    assert got == [(k, c) for k in range(n) for c in np.argsort(distance[k])[:3].tolist()]


def test_exports(spark):
    docs = spark.createDataFrame([(1, "lei nº 1.pdf"), (2, "b-2.txt")], "document_id long, name string")
    rows = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "document_id long, index int, content string")
    got = {r.document_id: (r.file_name, r.body) for r in documents.export("chunks", docs, rows, ["index"]).collect()}
    assert got == {1: ("lei_n_1-chunks.json", '[{"index":1,"content":"x"},{"index":2,"content":"y"}]'), 2: ("b-2-chunks.json", "[]")}


def test_line_diff_rebuilds_both_sides(spark):
    rnd = random.Random(4)
    rows = [(k, "\n".join(rnd.choice("abcd") for _ in range(rnd.randrange(30))), "\n".join(rnd.choice("abcd") for _ in range(rnd.randrange(30)))) for k in range(60)] + [(60, "a\nb", "a\nb"), (61, "", "x"), (62, None, "x")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    for r, (_, a, b) in zip(df.select("k", text.line_diff("a", "b").alias("d")).orderBy("k").collect(), rows, strict=True):
        side = lambda ops, d=r.d: [line for run in d if run.op in ops for line in run.text.split("\n")]
        assert side("=-") == (a.split("\n") if a is not None else []) and side("=+") == b.split("\n")
        assert all(x.op != y.op for x, y in zip(r.d, r.d[1:], strict=False))
    got = text.line_changes(df.where("k >= 60"), "k", "a", "b").orderBy("k").collect()
    assert [(r.added, r.removed) for r in got] == [(0, 0), (1, 1), (1, 0)]


def test_a_shortest_edit():
    assert [op for op, _ in text._diff_lines(list("abcabba"), list("cbabac"))].count("=") == 4


def test_line_diff_is_shortest_at_every_size(monkeypatch):
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, before = [0], row
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
        return row

    rnd = random.Random(1)
    for _ in range(150):
        a, b = ([rnd.randrange(rnd.choice((2, 4, 30))) for _ in range(rnd.randrange(40))] for _ in "ab")
        monkeypatch.setattr(text, "BLOCK_BITS", rnd.choice((3, 8, 64)))
        assert text._common_lengths(a, b).tolist() == common(a, b)
        for limit in (0, 3, 1_000):
            monkeypatch.setattr(text, "DIRECT_EDITS", limit)
            edits = text._diff_lines(a, b)
            assert [t for op, t in edits if op != "+"] == a and [t for op, t in edits if op != "-"] == b
            assert sum(op == "=" for op, _ in edits) == common(a, b)[-1]


def test_line_diff_of_many_edits():
    a, b = ([f"{side}{i}" if i % 2 else f"both {i}" for i in range(9_000)] for side in "ab")
    assert sum(op == "=" for op, _ in text._diff_lines(a, b)) == 4_500


def test_line_diff_reads_whole_texts(spark):
    same = "\n".join(f"line {i}" for i in range(40_000))
    long = "w " * 150_000
    pairs = [(1, f"{same}\nend", f"{same}\nother end"), (2, long, f"{long}x"), (3, "\n".join("abc" * 80_000), "x")]
    got = text.line_diffs(spark.createDataFrame(pairs, "k long, b string, a string"), "k", "b", "a").collect()
    runs = {k: [(r.op, r.text) for r in sorted(got, key=lambda r: r.pos) if r.k == k] for k in (1, 2, 3)}
    assert runs[1] == [("=", same), ("-", "end"), ("+", "other end")]
    assert runs[2] == [("-", long), ("+", f"{long}x")]
    assert runs[3] == [("-", pairs[2][1]), ("+", "x")]


def test_line_diff_of_long_lists():
    rnd = random.Random(7)
    a = [f"line {rnd.randrange(30_000)}" for _ in range(30_000)]
    b = [line if rnd.random() < 0.9 else f"new {i}" for i, line in enumerate(a)]
    edits = text._diff_lines(a, b)
    assert [t for op, t in edits if op != "+"] == a and [t for op, t in edits if op != "-"] == b
    assert sum(op == "=" for op, _ in edits) >= sum(x == y for x, y in zip(a, b, strict=True))


def test_article_offsets_follow_each_other(spark):
    docs = spark.createDataFrame([(1, "Sumário Art. 1 x Art. 1º y ARTIGO 2 z Art 10 w"), (2, None)], "document_id long, text string")
    arts = spark.createDataFrame([(1, "a", 0, "1"), (1, "b", 1, "1"), (1, "c", 2, "2"), (1, "d", 3, "1"), (1, "e", 4, "10"), (2, "f", 0, "1")], "document_id long, article_id string, article_index int, number string")
    got = {r.article_id: r.offset for r in chunking.locate_articles(docs, arts).collect()}
    assert got == {"a": 8, "b": 17, "c": 27, "d": None, "e": 38, "f": None}


def test_figures_take_the_last_article_before_them(spark):
    arts = spark.createDataFrame([(1, "a1", 0, 1), (1, "a2", 1, 2), (1, "a3", 2, 2), (1, "a4", 3, None), (2, "b", 0, 5)], "document_id long, article_id string, article_index int, page int")
    figures = spark.createDataFrame([(1, "f0", 0), (1, "f1", 1), (1, "f2", 2), (1, "f9", 9), (2, "g", 4)], "document_id long, figure_id string, page int")
    linked = chunking.figures_to_articles(figures, arts)
    assert {r.figure_id: r.article_id for r in linked.collect()} == {"f0": None, "f1": "a1", "f2": "a3", "f9": "a3", "g": None}
    chunks = spark.createDataFrame([(1, "a1", "c1", 1, 0), (1, "a1", "c1b", 2, 1), (1, "a3", "c3", 1, 2), (1, "a3", "c3x", 1, 3)], "document_id long, article_id string, chunk_id string, part int, chunk_index int")
    assert {r.figure_id: r.chunk_id for r in chunking.figures_to_chunks(linked, chunks).collect()} == {"f0": None, "f1": "c1", "f2": "c3x", "f9": "c3x", "g": None}


def test_categories_want_numbers(spark):
    cases = [('{"categoria": "Muros", "confianca": 7}', "Muros", 1.0), ('{"categoria": "Nada", "confianca": 0.4}', "Outros", 0.4), ('{"categoria": "Muros", "confianca": "0.7"}', "Muros", 0.0), ('{"categoria": 3, "confianca": true}', "Outros", 0.0), ("no json", "Outros", 0.0), (None, "Outros", 0.0)]
    got = spark.createDataFrame([(c[0],) for c in cases], "raw string").select(answers.parse_category(F.col("raw")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_containment_with_many_equal_starts(spark):
    names = [f"lei municipal numero {k} de {k % 7}" for k in range(300)] + ["ab", "x", "lei"]
    texts = [f"ver lei municipal numero {k} de {k % 7} e outras" for k in range(0, 300, 3)] + ["xyz", "cab"]
    inner, outer = spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (search.BROADCAST_CHARS, 100):  # one automaton for all, or a join by grams
        got = [(r.n, r.t) for r in search.contained(inner, outer, "n", "t", broadcast_chars=limit).collect()]
        assert sorted(got) == sorted((n, t) for n in names for t in texts if n in t)
    assert search.contained(inner.where("n = ''"), outer, "n", "t").count() == 0


def test_texts_are_read_once_and_where_they_lie(spark):
    texts = spark.createDataFrame([(k, f"é lei {k} plano" if k % 3 else None) for k in range(50)], "document_id long, text string")
    asked = spark.createDataFrame([(1, " Plano "), (2, "LEI 4"), (3, ""), (4, "lei 4")], "query_id long, query string")
    found = history.manual_search(asked, texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 2 and plan.count("MapInArrow") == 1  # documents and queries once, no grams
    got = {(r.query_id, r.document_id) for r in found.collect()}
    low = {k: f"é lei {k} plano" for k in range(50) if k % 3}
    want = {q: [k for k, t in low.items() if x in t][:30] for q, x in ((1, "plano"), (2, "lei 4"), (4, "lei 4"))}
    assert got == {(q, k) for q, ks in want.items() for k in ks}


def test_reference_matching_equals_the_rule(spark):
    rnd = random.Random(9)
    words = ["lei", "federal", "municipal", "decreto", "codigo", "obras", "plano", "diretor", "uso", "solo"]
    texts = lambda n: [" ".join([*(rnd.choice(words) for _ in range(rnd.randrange(1, 6))), *([rnd.choice(["10.257", "1257", "77", "2001"])] if rnd.random() < 0.4 else [])]) for _ in range(n)]
    refs, names = sorted(set(texts(80))), texts(50)

    def fits(ref, name):
        numbers = lambda t: {n.replace(".", "") for n in re.findall(r"\d[\d.]*\d|\d+", t) if len(n.replace(".", "")) >= 4}
        mine, theirs = [w for w in re.split(r"[^a-z0-9]+", name) if len(w) >= 4], {w for w in re.split(r"[^a-z0-9]+", ref) if len(w) >= 4}
        shared = sum(w in theirs for w in mine)
        return ref in name or name in ref or bool(numbers(ref) & numbers(name)) or (shared > 0 and shared / len(mine) >= 0.4)

    got = search.match_references(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame(list(enumerate(names)), "document_id long, name string"))
    assert {(r.ref, r.document_id) for r in got.collect()} == {(r, k) for r in refs for k, n in enumerate(names) if fits(r, n)}


def test_vector_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUESTION_BLOCK", 5)
    monkeypatch.setattr(search, "VECTOR_FLOATS", 200)
    rnd = random.Random(3)
    rows = [(k, k % 6, [float(rnd.randrange(-3, 4)) for _ in range(4)]) for k in range(400)] + [(400, 1, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, document_id long, vector array<float>")
    asked = spark.createDataFrame([(k, rows[k][2], [k % 6] if k % 2 else []) for k in range(20) if any(rows[k][2])] + [(99, [], [])], "question_id long, vector array<float>, excluded array<bigint>")

    def distance(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        n = (dot(a, a) * dot(b, b)) ** 0.5
        return round(1 - dot(a, b) / n, 9) if n else 1.0

    for per in (False, True):
        got = {}
        for r in search.vector_top_k(asked, vectors, 4, per_document=per).collect():
            got.setdefault((r.question_id, r.document_id if per else None), []).append((r["rank"], r.chunk_id))
        want = {}
        for q, v, out in asked.collect():
            for c, doc, x in rows:
                if v and x is not None and doc not in out:
                    want.setdefault((q, doc if per else None), []).append((distance(v, x), c))
        assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == {k: [c for _, c in sorted(v)[:4]] for k, v in want.items()}


def test_rerank_reads_only_numbers(spark):
    candidates = spark.createDataFrame([(q, r, "r") for q in (1, 2) for r in range(4)], "question_id long, rank int, reason string")
    raw = [(1, '{"scores": [{"index": 1, "score": 9.5}, {"index": "0", "score": 10}, {"index": 2, "score": true}, {"index": 3, "score": 99}, {"index": 3, "score": -4}, {"index": 7, "score": 1}]}'), (2, "none")]
    got = search.rerank(candidates, spark.createDataFrame(raw, "question_id long, raw string"), 3).orderBy("question_id", "final_rank").collect()
    assert [(r.question_id, r["rank"], r.score) for r in got] == [(1, 1, 9.5), (1, 0, 0.0), (1, 2, 0.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0)]
    off = search.rerank(candidates, None, 2, enabled=False).where("question_id = 1").orderBy("final_rank").collect()
    assert [(r["rank"], r.score) for r in off] == [(0, None), (1, None)] and off[0].reason == "r" + search.RERANK_OFF


def test_articles_are_found_by_any_part(spark):
    arts = spark.createDataFrame([(1, 0, "Art. 1", "1", "Recuo frontal", "Art. 1 Recuo frontal\nI - três metros"), (2, 0, "Art. 7", "7", "x", "Art. 7 x")], "document_id long, article_index int, label string, number string, caput string, full_text string")
    docs = spark.createDataFrame([(1, "Código de Obras"), (2, "Plano Diretor")], "document_id long, name string")
    asked = spark.createDataFrame([(1, " TRÊS "), (2, "diretor"), (3, "tres"), (4, "  "), (5, "art. 7")], "query_id long, query string")
    got = {(r.query_id, r.document_id) for r in history.search_articles(asked, arts, docs).collect()}
    assert got == {(1, 1), (2, 2), (5, 2)}
    assert [(r.query_id, r.document_id) for r in history.search_documents(asked, docs).collect()] == [(2, 2)]
