"""The question flow: a run from questions to checked answers, its ledger, failing calls and questions without evidence."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.config import Retrieval
from lexmill.operators import answers, flow

TEMPLATES = flow.Templates("K {{PERGUNTA}}", "E {{PERGUNTA}}", "R {{PERGUNTA}}\n{{TRECHOS}}", "A {{PERGUNTA}}\n{{CONTEXTO}}")


@pytest.fixture(scope="module")
def knowledge(spark):
    enrichment = "struct<tema:string,subtema:string,categoria:string,palavras_chave:array<string>,assuntos:array<string>,resumo:string,observacoes:string,referencias:array<string>>"
    chunk = lambda k, doc, text, refs=(): (k, doc, text, k, "Cap", None, ("Muros", "", "Muros", [], [], f"resumo {k}", "", list(refs)))
    chunks = [chunk(1, 10, "muro de dois metros", ["Lei nº 2.000"]), chunk(2, 10, "piscina"), chunk(3, 20, "altura revogada"), chunk(4, 20, "recuo"), chunk(5, 30, "outro")]
    vectors = [(1, 10, [1.0, 0.0], True), (2, 10, [0.9, 0.1], True), (3, 20, [0.0, 1.0], True), (4, 20, [0.1, 1.0], False), (5, 30, [-1.0, 0.0], True)]
    return flow.Knowledge(
        spark.createDataFrame(vectors, "chunk_id long, document_id long, vector array<double>, indexed boolean"),
        spark.createDataFrame(chunks, f"chunk_id long, document_id long, content string, article_id long, chapter_label string, section_label string, enrichment {enrichment}"),
        spark.createDataFrame([(d, f"Lei {n}") for d, n in ((10, "1.000"), (20, "2.000"), (30, "3.000"))], "document_id long, document_name string").withColumn("document_created_at", F.make_timestamp(F.lit(2024), F.lit(5), F.lit(2), F.lit(0), F.lit(0), F.lit(0))),
        spark.createDataFrame([(k, f"Art. {k}") for k in range(1, 6)], "article_id long, article_label string"),
    )


def test_a_run_its_failures_and_its_rerun(spark, knowledge, tmp_path):
    log, broken = tmp_path / "log", tmp_path / "broken"
    log.mkdir()
    broken.touch()

    def client():
        import uuid

        def one(prompt):
            (log / uuid.uuid4().hex).write_text(prompt)
            if prompt.startswith("K "):
                return json.dumps({"categoria": "Muros", "confianca": 0.9})
            if prompt.startswith("E "):
                return json.dumps({"lei": ["PISCINA"], "medidas": [7]})
            if prompt.startswith("R "):
                return json.dumps({"scores": [{"index": 1, "score": 9}, {"index": 0, "score": 3}]})
            if broken.exists():
                raise RuntimeError("no answer")
            return json.dumps({"resumo_executivo": "ok", "nivel_confianca": "MEDIO", "artigos_utilizados": [{"lei": "lei 2.000", "artigo": "art. 3"}]})

        return lambda prompts: [{"raw": one(p), "tokens_in": 10, "tokens_out": 2} for p in prompts]

    questions = spark.createDataFrame([(7, "Qual o muro?", [1.0, 0.05]), (7, "Qual o muro?", [1.0, 0.05]), (8, "Sem vetor", None)], "question_id long, text string, vector array<double>")
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, usd_in double, usd_out double")
    run = lambda: flow.ask_questions(questions, knowledge, client, "m", prices, TEMPLATES, str(tmp_path / "ledger"), Retrieval(vector_k=2, metadata_k=2, final_k=2, per_document=2))
    failed = {r.question_id: r for r in run().questions.collect()}
    assert (failed[7].answer.resumo_executivo, failed[7].insufficient, failed[7].cost_usd) == ("", True, 0.0)
    calls = len(list(log.iterdir()))
    assert calls == 6  # two questions are classified and read for entities, one is reranked and answered
    broken.unlink()
    done = run()
    assert len(list(log.iterdir())) == calls + 1
    got = {r.question_id: r for r in done.questions.collect()}
    assert (got[8].answer.resumo_executivo, got[8].valid, got[8].warnings) == (answers.NO_EVIDENCE, False, [answers.WARN_EMPTY])
    q = got[7]
    assert (q.category, q.confidence, q.entities.lei, q.entities.medidas, q.answer.resumo_executivo, q.valid, q.insufficient, q.tokens_in) == ("Muros", 0.9, ["PISCINA"], [], "ok", True, False, 10)
    stages = {}
    for r in done.retrievals.orderBy("stage", "rank").collect():
        stages.setdefault(r.stage, []).append((r.chunk_id, r.score))
    assert {s: [c for c, _ in own] for s, own in stages.items()} == {"VECTOR": [1, 2], "METADATA": [1, 2], "REFERENCE": [3], "RERANK": [2, 1]}
    assert stages["RERANK"] == [(2, 9.0), (1, 3.0)]
    assert q.prompt.index("[Documento 1]\nLei: Lei 1.000\nCapítulo: Cap\nSeção: —\nArtigo: Art. 2") < q.prompt.index("[Documento 3] (referência cruzada)\nLei: Lei 2.000") and "Possivelmente revogada" in q.prompt
    assert [(r.chunk_id, r.motivo_recuperacao) for r in done.evidences.orderBy("ord").collect()][2] == (3, 'Referência cruzada — citada em "Lei 1.000" (Art. 1): "Lei nº 2.000"')
    trace = {r.question_id: r for r in done.traces.collect()}
    assert [c.chunk_id for c in trace[7].rerank_stage] == [2, 1] and trace[8].vector_stage == []
