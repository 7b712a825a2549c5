"""The question flow as one registered query: every hundredth vector asks, all others answer."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from lexmill.operators import answers, flow
from lexmill.config import Patterns
from lexmill.plans.queries import _DIST, register, table
from lexmill.plans.retrieval import _CHUNKS, _MATCH, _knowledge
from lexmill.sources.staged import shared_folder

TEMPLATES = flow.Templates(category="K {{PERGUNTA}}", entities="E {{PERGUNTA}}", rerank="R {{PERGUNTA}}\n{{TRECHOS}}", answer="A {{PERGUNTA}}\n{{CONTEXTO}}")


def stand_in_client():
    """A stand-in for a model: each answer follows from its prompt alone, by rules that SQL can state."""

    def one(prompt: str) -> str:
        if prompt.startswith("K "):
            return json.dumps({"categoria": answers.CATEGORIES[len(prompt) % len(answers.CATEGORIES)], "confianca": 0.5})
        if prompt.startswith("E "):
            return json.dumps({"lei": [prompt[2:8]], "artigo": ["Art. 1"]})
        if prompt.startswith("R "):
            n = len(re.findall(r"(?m)^\[\d+\] Lei: ", prompt))
            return json.dumps({"scores": [{"index": i, "score": i * 7 % 11} for i in range(n)]})
        laws = re.findall(r"(?m)^Lei: (.*)\n", prompt)
        return json.dumps({"resumo_executivo": str(len(laws)), "nivel_confianca": "ALTO", "artigos_utilizados": [{"lei": laws[0]}, {"lei": "Lei perdida", "artigo": "Art. 0"}]})

    return lambda prompts: [{"raw": one(p), "tokens_in": len(p), "tokens_out": 1} for p in prompts]


def answered(spark, d) -> flow.Answered:
    embeddings, chunks, documents, articles = _knowledge(spark, d)
    text, none = F.lit(""), F.array().cast("array<string>")
    cited = F.when(F.col("chunk_id") % 3 == 0, F.array(F.concat(F.lit("Lei nº "), F.col("chunk_id") % 40 + 1000))).otherwise(none)
    enrichment = F.struct(F.lit("Zoneamento").alias("tema"), text.alias("subtema"), F.element_at(F.array(*map(F.lit, answers.CATEGORIES)), (F.col("chunk_id") % 22 + 1).cast("int")).alias("categoria"), none.alias("palavras_chave"), none.alias("assuntos"), text.alias("resumo"), text.alias("observacoes"), cited.alias("referencias"))
    chunks = chunks.withColumn("enrichment", enrichment)
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    questions = asked.select(F.col("vec_id").alias("question_id"), F.coalesce(F.substring("text", 1, 60), F.lit("")).alias("text"), F.col("embedding").alias("vector"))
    prices = spark.createDataFrame([("stand-in", 0.5, 2.0)], "model string, usd_in double, usd_out double")
    return flow.ask_questions(questions, flow.Knowledge(embeddings, chunks, documents, articles), stand_in_client, "stand-in", prices, TEMPLATES, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")


_KINDS = "[" + ", ".join(f"'{c}'" for c in answers.CATEGORIES) + "]"
_FLOW = rf"""WITH {_CHUNKS}, c0 AS (SELECT ck.*, 'Lei nº ' || (1000 + document_id) AS name, 'Art. ' || article_id AS article, ({_KINDS})[chunk_id % 22 + 1] AS kind FROM ck),
c AS (SELECT *, strip_accents(lower(name || ' | ' || coalesce(article || ' | ', '') || 'Zoneamento | ' || kind)) AS hay, strip_accents(lower(' ' || content)) AS f FROM c0),
q0 AS (SELECT v.vec_id AS question_id, coalesce(d.text[:60], '') AS text FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id WHERE v.vec_id % 100 = 0),
q AS (SELECT *, ({_KINDS})[(2 + length(text)) % 22 + 1] AS category, list_filter([text[:6], 'Art. 1'], lambda t: trim(t) <> '') AS named FROM q0),
v AS (SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round({_DIST}, 9) AS rounded, {_DIST} AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DIST}, 9), v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id % 11 > 0 QUALIFY rank <= 30),
mk AS (SELECT v.*, q.text, q.category, c.* EXCLUDE (chunk_id), len(list_filter(q.named, lambda t: length(t) >= 3 AND contains(c.hay, strip_accents(lower(t))))) + contains(c.hay, strip_accents(lower(q.category)))::INT AS matches FROM v JOIN q USING (question_id) JOIN c USING (chunk_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY matches DESC, dist, rank) - 1 AS ord FROM mk QUALIFY ord < 15),
ru AS (SELECT question_id, ord, unnest(l) AS ref, generate_subscripts(l, 1) AS pos FROM (SELECT question_id, ord, list_concat(CASE WHEN chunk_id % 3 = 0 THEN ['Lei nº ' || (chunk_id % 40 + 1000)] ELSE []::VARCHAR[] END, list_transform(regexp_extract_all(content, '(?i){Patterns().citation}', 1), lambda x: trim(x))) AS l FROM m)),
rf AS (SELECT question_id, ord, ref, min(pos) AS pos FROM ru GROUP BY ALL),
nm AS (SELECT document_id, strip_accents(lower(name)) AS name FROM (SELECT DISTINCT document_id, name FROM c)), {_MATCH},
x AS (SELECT question_id, document_id, min([ord, pos]) AS o FROM rf JOIN mt ON mt.ref = strip_accents(lower(rf.ref)) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.question_id = rf.question_id AND m.document_id = mt.document_id) GROUP BY ALL),
xn AS (SELECT x.*, v.vec_id AS chunk_id, row_number() OVER (PARTITION BY question_id, document_id ORDER BY round({_DIST}, 9), v.vec_id) AS nth FROM x JOIN embeddings q ON q.vec_id = x.question_id JOIN embeddings v ON v.label = x.document_id AND v.vec_id % 11 > 0 QUALIFY nth <= 2),
xc AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY o, document_id, nth) - 1 AS ord FROM xn),
r AS (SELECT question_id, chunk_id, place AS ord FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY least(10, ord * 7 % 11) DESC, ord) - 1 AS place FROM m) WHERE place < 8),
b AS (SELECT question_id, chunk_id, xref, row_number() OVER (PARTITION BY question_id ORDER BY xref, ord) AS n FROM (SELECT *, false AS xref FROM r UNION ALL SELECT *, true FROM xc)),
cx AS (SELECT question_id, count(*) AS n, string_agg('[Documento ' || n || ']' || CASE WHEN xref THEN ' (referência cruzada)' ELSE '' END || chr(10) || 'Lei: ' || name || chr(10) || 'Capítulo: ' || chr(10) || 'Seção: —' || chr(10) || 'Artigo: ' || coalesce(article, '—') || chr(10) || 'Situação: '
  || CASE WHEN regexp_matches(f, 'revogad') THEN 'Possivelmente revogada' WHEN regexp_matches(f, 'nova redacao|redacao dada pel') THEN 'Alterada (nova redação)' ELSE 'Vigente' END || chr(10) || 'Data de cadastro na base: ' || lpad((document_id % 28 + 1)::VARCHAR, 2, '0') || '/05/2024' || chr(10) || 'Resumo: (sem resumo)' || chr(10) || 'Texto:' || chr(10) || repeat(chr(34), 3) || chr(10) || content || chr(10) || repeat(chr(34), 3), chr(10) || chr(10) ORDER BY n) AS context FROM b JOIN c USING (chunk_id) GROUP BY 1),
p AS (SELECT question_id, category, n, 'A ' || text || chr(10) || context AS prompt FROM q JOIN cx USING (question_id)),
st AS (SELECT question_id, coalesce(string_agg(chunk_id, ',' ORDER BY ord) FILTER (s = 1), '') AS vector_chunks, coalesce(string_agg(chunk_id, ',' ORDER BY ord) FILTER (s = 2), '') AS metadata_chunks, coalesce(string_agg(chunk_id, ',' ORDER BY ord) FILTER (s = 3), '') AS reference_chunks, coalesce(string_agg(chunk_id, ',' ORDER BY ord) FILTER (s = 4), '') AS rerank_chunks
  FROM (SELECT question_id, chunk_id, rank AS ord, 1 AS s FROM v UNION ALL SELECT question_id, chunk_id, ord, 2 FROM m UNION ALL SELECT question_id, chunk_id, ord, 3 FROM xc UNION ALL SELECT question_id, chunk_id, ord, 4 FROM r) GROUP BY 1)
SELECT p.question_id, category, sha256(prompt) AS prompt_hash, n::VARCHAR AS resumo, length(prompt) AS tokens_in, round((length(prompt) * 0.5 + 2.0) / 1e6, 9) AS cost_usd, false AS valid, false AS insufficient,
  '1 artigo(s) citado(s) pela IA não corresponderam a nenhum documento recuperado: Lei perdida Art. 0' AS warnings, vector_chunks, metadata_chunks, reference_chunks, rerank_chunks FROM p JOIN st USING (question_id)"""


@register(_FLOW)
def w2_question_flow(spark, d):
    done = answered(spark, d)
    stages = done.retrievals.groupBy("question_id").pivot("stage", list(answers.STAGES)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), ","))
    stages = stages.select("question_id", *(F.coalesce(s, F.lit("")).alias(f"{s.lower()}_chunks") for s in answers.STAGES))
    q = done.questions.select("question_id", "category", F.sha2("prompt", 256).alias("prompt_hash"), F.col("answer.resumo_executivo").alias("resumo"), "tokens_in", F.round("cost_usd", 9).alias("cost_usd"), "valid", "insufficient", F.array_join("warnings", " | ").alias("warnings"))
    return q.join(stages, "question_id", "left")
