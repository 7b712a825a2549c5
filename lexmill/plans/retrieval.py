"""Registered queries: from questions to ranked evidence, contexts, answers and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import answers, history, index, search
from lexmill.plans.queries import _DIST, _LAW, P, as_law, register, table

# Chunks, documents and articles behind the vectors: chunk vec_id holds the text of doc_id = vec_id, its document is the label.

_CHUNKS = "ck AS (SELECT v.vec_id AS chunk_id, v.label::BIGINT AS document_id, coalesce(d.text, '') AS content, CASE WHEN v.vec_id % 7 > 0 THEN v.vec_id END AS article_id FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id)"


def _knowledge(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(embeddings, chunks, documents, articles)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("document_id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 11 > 0).alias("indexed"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    article = F.when(F.col("chunk_id") % 7 > 0, F.col("chunk_id"))
    chunks = e.select("chunk_id", "document_id").join(texts, "chunk_id", "left").select("chunk_id", "document_id", F.coalesce("text", F.lit("")).alias("content"), article.alias("article_id"), F.lit("").alias("chapter_label"), F.lit(None).cast("string").alias("section_label"))
    documents = e.select("document_id").distinct().select("document_id", F.concat(F.lit("Lei nº "), F.col("document_id") + 1000).alias("document_name"), F.make_timestamp(F.lit(2024), F.lit(5), F.col("document_id") % 28 + 1, F.lit(0), F.lit(0), F.lit(0)).alias("document_created_at"))
    articles = chunks.where("article_id is not null").select("article_id", F.concat(F.lit("Art. "), "article_id").alias("article_label"))
    return e, chunks, documents, articles


@register(f"""WITH {_CHUNKS}, t AS (SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, v.label::BIGINT AS document_id, {_DIST} AS dist FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id % 11 > 0 AND v.label <> q.label
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DIST}, 9), v.vec_id) <= 30)
  SELECT t.question_id, t.chunk_id, t.document_id, row_number() OVER (PARTITION BY t.question_id ORDER BY round(dist, 9), t.chunk_id) AS rank, sha256(ck.content) AS content_hash, 'Lei nº ' || (1000 + t.document_id) AS document_name, 'Art. ' || ck.article_id AS article_label,
    'Similaridade vetorial (distância cosseno = ' || printf('%.4f', greatest(0.0, dist)) || ')' AS reason FROM t JOIN ck USING (chunk_id)""")
def f2_vector_search(spark, d):
    e = table(spark, d, "embeddings")
    questions = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"), F.array(F.col("label").cast("long")).alias("excluded"))
    found = search.vector_search(questions, *_knowledge(spark, d))
    return found.select("question_id", "chunk_id", "document_id", "rank", F.sha2("content", 256).alias("content_hash"), "document_name", "article_label", "reason")


@register("""WITH c AS (SELECT conv_id AS question_id, turn AS rank, role, CASE WHEN turn % 3 > 0 THEN (turn * 7 % 10) / 10.0 END AS distance, strip_accents(lower(role || ' | ' || text || ' | Zoneamento')) AS h FROM conversations),
  m AS (SELECT *, list_filter(['the ', 'que', 'xx', 'que'], lambda t: contains(h, t)) AS hits, contains(h, role) AS cat FROM c),
  n AS (SELECT *, len(hits) + cat::INT AS matches FROM m)
  SELECT question_id, rank, matches, row_number() OVER (PARTITION BY question_id ORDER BY matches DESC, coalesce(distance, 1.0), rank) AS new_rank,
    CASE WHEN matches > 0 THEN 'Metadados combinam com a consulta (' || concat_ws('; ', CASE WHEN cat THEN 'categoria "' || role || '"' END, CASE WHEN len(hits) > 0 THEN 'termos: ' || array_to_string(hits, ', ') END) || ')' ELSE 'r' END AS reason FROM n QUALIFY new_rank <= 3""")
def f8_metadata_rerank(spark, d):
    turns = table(spark, d, "conversations")
    enrichment = F.struct(F.lit("Zoneamento").alias("tema"), F.lit("").alias("subtema"), F.lit(None).cast("string").alias("categoria"), F.array().cast("array<string>").alias("palavras_chave"), F.lit(None).cast("array<string>").alias("assuntos"))
    candidates = turns.withColumn("enrichment", enrichment).select(
        F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), search.haystack(F.col("role"), F.col("text"), F.lit(""), F.lit(None).cast("string"), F.col("enrichment")).alias("haystack"),
        F.array(*map(F.lit, ("the ", "que", "xx", "que"))).alias("terms"), F.col("role").alias("category"), F.col("role").alias("category_name"), F.when(F.col("turn") % 3 > 0, F.col("turn") * 7 % 10 / 10).alias("distance"), F.lit("r").alias("reason"),
    )
    return search.metadata_rerank(candidates, 3).select("question_id", "rank", "matches", "new_rank", "reason")


# References in whole law texts

_CITED = _LAW + f""",
whole AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS content FROM law GROUP BY doc_id),
rl AS (SELECT doc_id, list_concat(CASE WHEN doc_id % 2 = 0 THEN ['Lei nº 77', 'LUOS'] ELSE []::VARCHAR[] END, list_transform(regexp_extract_all(content, '(?i){P.citation}', 1), lambda x: trim(x))) AS l FROM whole),
ru AS (SELECT doc_id, unnest(l) AS ref, generate_subscripts(l, 1) AS pos FROM rl),
rf AS (SELECT doc_id, ref, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS pos FROM ru GROUP BY doc_id, ref)
"""


def _cited(spark, d) -> DataFrame:
    """(doc_id, refs): what each whole law text names, and two listed references of every second one."""
    listed = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(" Lei nº 77"), F.lit("LUOS "), F.lit(" ")))
    return as_law(table(spark, d, "documents")).select("doc_id", search.reference_candidates(listed, F.col("text")).alias("refs"))


_MATCH = r"""rw AS (SELECT DISTINCT strip_accents(lower(ref)) AS ref FROM rf), rk AS (SELECT ref, list_filter(regexp_split_to_array(ref, '[^\p{L}\p{N}]+'), lambda w: length(w) >= 4) AS w, list_filter(list_transform(regexp_extract_all(ref, '\d[\d.]*\d|\d+'), lambda x: replace(x, '.', '')), lambda x: length(x) >= 4) AS k FROM rw),
  nk AS (SELECT document_id, name, list_filter(regexp_split_to_array(name, '[^\p{L}\p{N}]+'), lambda w: length(w) >= 4) AS w, list_filter(list_transform(regexp_extract_all(name, '\d[\d.]*\d|\d+'), lambda x: replace(x, '.', '')), lambda x: length(x) >= 4) AS k FROM nm),
  mt AS (SELECT ref, document_id FROM rk, nk WHERE contains(ref, name) OR contains(name, ref) OR list_has_any(rk.k, nk.k) OR (len(nk.w) > 0 AND len(list_filter(nk.w, lambda w: list_contains(rk.w, w))) > 0 AND len(list_filter(nk.w, lambda w: list_contains(rk.w, w))) * 10 >= len(nk.w) * 4))"""


@register(f"WITH {_CITED} SELECT doc_id, ref, pos FROM rf")
def f9_reference_candidates(spark, d):
    return _cited(spark, d).select("doc_id", F.posexplode("refs").alias("pos", "ref"))


@register(f"""WITH {_CITED}, nm AS (SELECT item_id AS document_id, strip_accents(lower(CASE WHEN item_id % 3 = 0 THEN 'Lei nº ' || (1000 + item_id) ELSE 'Lei Municipal nº ' || (1000 + item_id) || ': ' || text END)) AS name FROM benchmark), {_MATCH} SELECT * FROM mt""")
def f10_match_references(spark, d):
    refs = _cited(spark, d).select(F.explode("refs").alias("r")).select(T.fold("r").alias("ref"))
    number = F.col("item_id") + 1000
    name = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Lei nº "), number)).otherwise(F.concat(F.lit("Lei Municipal nº "), number, F.lit(": "), F.col("text")))
    return search.match_references(refs, table(spark, d, "benchmark").select(F.col("item_id").alias("document_id"), T.fold(name).alias("name")))


_CROSS = f"""{_CITED}, dn AS (SELECT DISTINCT label::BIGINT AS document_id, 'Lei nº ' || (1000 + label) AS document_name FROM embeddings), nm AS (SELECT document_id, strip_accents(lower(document_name)) AS name FROM dn), {_MATCH},
  cr AS (SELECT c.doc_id - c.doc_id % 100 AS question_id, rf.ref AS reference, mt.document_id, min((c.doc_id, rf.pos)) AS o FROM documents c JOIN rf ON rf.doc_id = c.doc_id JOIN mt ON mt.ref = strip_accents(lower(rf.ref))
    WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id // 100 = c.doc_id // 100 AND p.doc_id % 3 = mt.document_id) GROUP BY ALL),
  cx AS (SELECT question_id, reference, document_id, o[1] AS ord, o[2] AS pos, 'Lei nº ' || (1000 + o[1] % 3) AS origin_document, CASE WHEN o[1] % 4 > 0 THEN 'Art. ' || o[1] END AS origin_article FROM (SELECT question_id, reference, document_id, [o[1], o[2]] AS o FROM cr))"""


def _crossed(spark, d) -> DataFrame:
    """Cross references of each hundred documents taken as one question's candidates."""
    k = F.col("doc_id")
    candidates = _cited(spark, d).select((k - k % 100).alias("question_id"), k.alias("ord"), (k % 3).alias("document_id"), F.concat(F.lit("Lei nº "), k % 3 + 1000).alias("document_name"), F.when(k % 4 > 0, F.concat(F.lit("Art. "), k)).alias("article_label"), "refs")
    return search.cross_references(candidates, _knowledge(spark, d)[2].select("document_id", "document_name"))


@register(f"WITH {_CROSS} SELECT question_id, reference, document_id, ord, pos, origin_document, origin_article FROM cx")
def f11_cross_references(spark, d):
    return _crossed(spark, d).select("question_id", "reference", "document_id", "ord", "pos", "origin_document", "origin_article")


@register(f"""WITH {_CROSS}, f AS (SELECT * FROM cx QUALIFY row_number() OVER (PARTITION BY question_id, document_id ORDER BY ord, pos, reference) = 1),
  n AS (SELECT f.*, v.vec_id AS chunk_id, round({_DIST}, 9) AS dist FROM f JOIN embeddings q ON q.vec_id = f.question_id JOIN embeddings v ON v.label = f.document_id QUALIFY row_number() OVER (PARTITION BY f.question_id, f.document_id ORDER BY round({_DIST}, 9), v.vec_id) <= 2)
  SELECT question_id, document_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY ord, pos, document_id, dist, chunk_id) - 1 AS rank, 'Referência cruzada — citada em "' || origin_document || '"' || coalesce(' (' || origin_article || ')', '') || ': "' || reference || '"' AS reason FROM n""")
def f12_cross_reference_chunks(spark, d):
    questions = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    found = search.cross_reference_chunks(_crossed(spark, d), questions, _knowledge(spark, d)[0])
    return found.select("question_id", "document_id", "chunk_id", "rank", "reason")


@register("""SELECT conv_id AS question_id, string_agg('[' || n || '] Lei: ' || role || ' | Artigo: ' || CASE WHEN turn % 2 = 0 THEN '—' ELSE 'Art. ' || turn END || ' | Trecho: ' || CASE WHEN length(text) > 500 THEN text[:500] || '…' ELSE text END, chr(10) || chr(10) ORDER BY n) AS prompt
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) GROUP BY 1""")
def f13_rerank_prompts(spark, d):
    t = F.col("turn")
    return answers.rerank_prompts(table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), t.alias("rank"), F.col("role").alias("document"), F.when(t % 2 == 1, F.concat(F.lit("Art. "), t)).alias("article"), "text"))


_SCORED = """WITH s AS (SELECT conv_id AS question_id, turn AS rank, CASE WHEN conv_id % 3 = 0 OR turn % 5 = 4 THEN 0.0 ELSE greatest(0, least(10, length(text) % 15 - 2))::DOUBLE END AS score FROM conversations)"""


def _scores(spark, d) -> DataFrame:
    """(question_id, raw): a score for most turns by the length of their text, first a wrong one that a later entry mends."""
    turns = table(spark, d, "conversations").where("turn % 5 < 4")
    entry = F.format_string('{"index": %d, "score": 9}, {"index": %d, "score": %d}, {"index": "%d", "score": 8}', "turn", "turn", F.length("text") % 15 - 2, "turn")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"]), ", ")
    return turns.groupBy("conv_id").agg(listed.alias("l")).select(F.col("conv_id").alias("question_id"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("not json "), "l")).otherwise(F.concat(F.lit('{"scores": ['), "l", F.lit(', {"index": 999, "score": 10}, "x", {"index": 0}]}'))).alias("raw"))


def _ranked(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), F.lit("r").alias("reason"))


@register(f"{_SCORED} SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) - 1 AS final_rank, 'Reranking: relevância ' || printf('%.1f', score) || '/10 para a pergunta' AS reason FROM s QUALIFY final_rank < 4")
def f15_rerank(spark, d):
    return search.rerank(_ranked(spark, d), _scores(spark, d), 4).select("question_id", "rank", "score", "final_rank", "reason")


@register("SELECT conv_id AS question_id, turn AS rank, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS final_rank, 'r (reranking desativado — ordem anterior mantida)' AS reason FROM conversations QUALIFY final_rank < 4")
def f15_rerank_disabled(spark, d):
    return search.rerank(_ranked(spark, d), None, 4, enabled=False).select("question_id", "rank", "final_rank", "reason")


# Reading what models say

_WITH_PROPS = "SELECT *, (props->>'k')::INT AS k FROM events"


@register(f"""SELECT event_id, CASE WHEN k % 4 = 0 THEN 'Zoneamento' ELSE 'Outros' END AS category, CASE WHEN k % 5 = 0 THEN 0.0 WHEN k % 5 = 1 THEN 0.0 ELSE greatest(0.0, least(1.0, value / 10.0 - 0.2)) END AS confidence FROM ({_WITH_PROPS}) WHERE k % 6 < 5
  UNION ALL SELECT event_id, 'Outros', 0.0 FROM ({_WITH_PROPS}) WHERE k % 6 = 5""")
def f5_categories(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    confidence = F.when(k % 5 == 0, "true").when(k % 5 == 1, '"0.7"').otherwise((F.col("value") / 10 - 0.2).cast("string"))
    raw = F.concat(F.lit('{"categoria": '), F.when(k % 4 == 0, '"Zoneamento"').when(k % 4 == 1, "3").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))), F.lit(', "confianca": '), confidence, F.lit("}"))
    parsed = table(spark, d, "events").select("event_id", answers.parse_category(F.when(k % 6 == 5, F.col("props").substr(F.lit(2), F.lit(50))).otherwise(raw)).alias("c"))
    return parsed.select("event_id", "c.category", "c.confidence")


def _entities(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    raw = F.when(k % 3 == 0, F.concat(F.lit('{"medidas": ["'), k, F.lit(' m", " "], "lei": ["'), "event_type", F.lit('", 4, null], "other": ["x"]}'))).when(k % 3 == 1, F.concat(F.lit('{"lei": "text", "zona": ["ZR-'), k, F.lit('"]}'))).otherwise("[")
    return table(spark, d, "events").select("event_id", answers.parse_entities(raw).alias("e"))


@register(f"""SELECT event_id, CASE WHEN k % 3 = 0 THEN event_type ELSE '' END AS lei, CASE WHEN k % 3 = 0 THEN k || ' m| ' ELSE '' END AS medidas, CASE WHEN k % 3 = 1 THEN 'ZR-' || k ELSE '' END AS zona, 0 AS cidade FROM ({_WITH_PROPS})""")
def f6_entities(spark, d):
    return _entities(spark, d).select("event_id", *(F.array_join(f"e.{c}", "|").alias(c) for c in ("lei", "medidas", "zona")), F.size("e.cidade").alias("cidade"))


@register(f"""SELECT event_id, CASE k % 3 WHEN 0 THEN event_type || '|' || k || ' m' WHEN 1 THEN 'ZR-' || k ELSE '' END AS terms FROM ({_WITH_PROPS})""")
def f7_entities(spark, d):
    return _entities(spark, d).select("event_id", F.array_join(answers.entity_terms(F.col("e")), "|").alias("terms"))


# The ten fields of an enrichment.
STRINGS = ("resumo", "tema", "subtema", "categoria", "observacoes", "explicacao")
LISTS = ("palavras_chave", "assuntos", "referencias", "perguntas")


@register(f"""SELECT event_id, CASE WHEN k % 4 = 0 THEN '' ELSE event_type END AS tema, CASE WHEN k % 4 IN (1, 3) THEN 'x ' || k ELSE '' END AS resumo, CASE WHEN k % 4 = 2 THEN 'a|b' ELSE '' END AS assuntos, CASE WHEN k % 4 IN (1, 2, 3) THEN 'p' || k ELSE '' END AS palavras_chave, '' AS observacoes FROM ({_WITH_PROPS})""")
def e4_parse_enrichment(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.format_string('{"tema": "%s", "resumo": %s, "assuntos": %s, "palavras_chave": ["p%d", {"z": 1}], "observacoes": null, "other": {}}', "event_type", F.when(k % 4 == 2, "5").otherwise(F.concat(F.lit('"x '), k, F.lit('"'))), F.when(k % 4 == 2, '["a", 1, "b", null]').otherwise('"no list"'), k)
    raw = F.when(k % 4 == 0, F.concat("props", F.lit("}"))).otherwise(text)
    parsed = table(spark, d, "events").select("event_id", index.parse_enrichment(raw, STRINGS, LISTS).alias("e"))
    return parsed.select("event_id", "e.tema", "e.resumo", "e.observacoes", *(F.array_join(f"e.{c}", "|").alias(c) for c in ("assuntos", "palavras_chave")))


@register("""SELECT conv_id, turn, 'R: ' || text AS resumo, CASE WHEN turn % 3 = 0 THEN 'ALTO' ELSE 'BAIXO' END AS nivel, turn % 2 = 0 AS has_conflict, CASE WHEN turn % 2 = 0 THEN 'lei ' || turn || '|Art. ' || turn || ';x|' ELSE '' END AS cited, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS conflicts, CASE WHEN turn % 2 = 0 THEN 'v' || turn ELSE '' END AS valor
  FROM conversations WHERE turn % 4 < 3 UNION ALL SELECT conv_id, turn, '', 'BAIXO', false, '', 0, '' FROM conversations WHERE turn % 4 = 3""")
def g6_parse_answers(spark, d):
    t = F.col("turn")
    listed = F.when(t % 2 == 0, F.format_string('[{"lei": "lei %d", "artigo": "Art. %d"}, 5, "s", {"lei": "x", "artigo": 7}]', t, t)).otherwise('"no list"')
    conflicts = F.when(t % 2 == 0, F.format_string('[{"tema": "t", "versoes": [{"lei": "a", "valor": "v%d"}, 1]}]', t)).otherwise("null")
    head = F.to_json(F.struct(F.concat(F.lit("R: "), "text").alias("resumo_executivo")))
    body = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(', "nivel_confianca": '), F.when(t % 3 == 0, '"ALTO"').when(t % 3 == 1, '"alto"').otherwise("1"), F.lit(', "has_conflict": '), F.when(t % 2 == 0, "true").otherwise('"true"'), F.lit(', "artigos_utilizados": '), listed, F.lit(', "conflict_details": '), conflicts, F.lit("}"))
    raw = F.when(t % 4 == 3, F.concat(F.lit("Answer: "), body)).otherwise(body)
    a = table(spark, d, "conversations").withColumn("h", head).select("conv_id", "turn", answers.parse_answer(raw).alias("a"))
    cited = F.array_join(F.transform("a.artigos_utilizados", lambda c: F.concat_ws("|", c["lei"], F.coalesce(c["artigo"], F.lit("-")))), ";")
    valor = F.array_join(F.flatten(F.transform("a.conflict_details", lambda c: F.transform(c["versoes"], lambda v: v["valor"]))), ";")
    return a.select("conv_id", "turn", F.col("a.resumo_executivo").alias("resumo"), F.col("a.nivel_confianca").alias("nivel"), "a.has_conflict", cited.alias("cited"), F.size("a.conflict_details").alias("conflicts"), valor.alias("valor"))


# Contexts and answers


def _blocks(spark, d) -> DataFrame:
    """Turns as retrieved chunks of their conversation; odd ones are cross references."""
    t = F.col("turn")
    notes = F.when(t % 4 == 0, "Redação dada pela Lei 9").otherwise("")
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("question_id"), t.alias("ord"), t.alias("chunk_id"), F.col("role").alias("document_name"), F.lit(None).cast("string").alias("chapter_label"), F.col("role").alias("section_label"), F.when(t % 2 == 1, F.concat(F.lit("Art. "), t)).alias("article_label"),
        F.col("text").alias("content"), F.when(t % 3 > 0, F.make_date(F.lit(2024), F.lit(5), (t % 3).cast("int"))).alias("document_created_at"), F.when(t % 2 == 1, "REFERENCE").otherwise("RERANK").alias("stage"), F.struct(F.when(t % 3 == 1, F.col("role")).otherwise("").alias("resumo"), notes.alias("observacoes")).alias("enrichment"),
    )
    return answers.context_blocks(rows)


_CONTEXT = """b AS (SELECT conv_id AS question_id, turn, role, text, turn % 2 = 1 AS xref, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2 = 1, turn) AS n, strip_accents(lower(CASE WHEN turn % 4 = 0 THEN 'Redação dada pela Lei 9 ' ELSE ' ' END || text)) AS f FROM conversations),
  s AS (SELECT *, CASE WHEN regexp_matches(f, 'revogad') THEN 'Possivelmente revogada' WHEN regexp_matches(f, 'nova redacao|redacao dada pel') THEN 'Alterada (nova redação)' ELSE 'Vigente' END AS status FROM b),
  cx AS (SELECT question_id, string_agg('[Documento ' || n || ']' || CASE WHEN xref THEN ' (referência cruzada)' ELSE '' END || chr(10) || 'Lei: ' || role || chr(10) || 'Capítulo: —' || chr(10) || 'Seção: ' || role || chr(10) || 'Artigo: ' || CASE WHEN turn % 2 = 1 THEN 'Art. ' || turn ELSE '—' END || chr(10) || 'Situação: ' || status || chr(10) || 'Data de cadastro na base: ' || CASE WHEN turn % 3 > 0 THEN '0' || (turn % 3) || '/05/2024' ELSE '—' END || chr(10) || 'Resumo: ' || CASE WHEN turn % 3 = 1 THEN role ELSE '(sem resumo)' END || chr(10) || 'Texto:' || chr(10) || '\"""' || chr(10) || text || chr(10) || '\"""', chr(10) || chr(10) ORDER BY n) AS context FROM s GROUP BY 1)"""


@register(f"WITH {_CONTEXT} SELECT question_id, turn AS ord, status, xref AS cross_reference, CASE WHEN turn % 3 = 1 THEN role ELSE '(sem resumo)' END AS summary FROM s")
def g2_context_blocks(spark, d):
    return _blocks(spark, d).select("question_id", "ord", "status", "cross_reference", "summary")


@register(f"WITH {_CONTEXT} SELECT * FROM cx")
def g3_contexts(spark, d):
    return answers.build_contexts(_blocks(spark, d))


TEMPLATE = "Contexto:\n{{CONTEXTO}}\nPergunta: {{PERGUNTA}}"
_PROMPTS = f"""WITH {_CONTEXT}, p AS (SELECT q.item_id AS question_id, 'Contexto:' || chr(10) || coalesce(nullif(cx.context, ''), '(nenhum documento recuperado)') || chr(10) || 'Pergunta: ' || q.text AS prompt, cx.context IS NOT NULL AS has_evidence FROM benchmark q LEFT JOIN cx ON cx.question_id = q.item_id AND q.item_id % 5 > 0)"""


def _prompts(spark, d) -> DataFrame:
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return answers.answer_prompts(questions, answers.build_contexts(_blocks(spark, d).where("question_id % 5 > 0")), TEMPLATE)


@register(f"{_PROMPTS} SELECT * FROM p")
def g4_answer_prompts(spark, d):
    return _prompts(spark, d)


def echo_client():
    """A stand-in for a model: it answers every prompt by its length."""
    return lambda prompt: (f'{{"resumo_executivo": "{len(prompt)}", "nivel_confianca": "ALTO"}}', len(prompt), 2)


@register(f"""{_PROMPTS} SELECT question_id, CASE WHEN has_evidence THEN length(prompt)::VARCHAR ELSE 'Não há informação suficiente na Base de Conhecimento para responder a esta pergunta com segurança.' END AS resumo, CASE WHEN has_evidence THEN 'ALTO' ELSE 'BAIXO' END AS nivel,
  CASE WHEN has_evidence THEN length(prompt) ELSE 0 END AS tokens_in, CASE WHEN has_evidence THEN round((length(prompt) * 0.5 + 2 * 2.0) / 1e6, 9) ELSE 0.0 END AS cost_usd FROM p""")
def g5_answers(spark, d):
    prices = spark.createDataFrame([("echo", 0.5, 2.0)], "model string, usd_in double, usd_out double")
    made = answers.generate_answers(_prompts(spark, d), echo_client, "echo", prices)
    return made.select("question_id", F.col("answer.resumo_executivo").alias("resumo"), F.col("answer.nivel_confianca").alias("nivel"), "tokens_in", F.round("cost_usd", 9).alias("cost_usd"))


@register("SELECT doc_id AS chunk_id, length('T: ' || text || ' C: ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE '(sem contexto)' END) AS tokens_in, 'ok ' || length(text) AS resumo, round((length('T: ' || text || ' C: ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE '(sem contexto)' END) * 0.5 + 1 * 2.0) / 1e6, 9) AS cost_usd FROM documents")
def e3_enrich(spark, d):
    def client():
        return lambda prompt: (f'{{"resumo": "ok {len(prompt.split(" C: ")[0]) - 3}"}}', len(prompt), 1)

    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.replace("text", F.lit(" C: "), F.lit(" c: ")).alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("context"))
    prices = spark.createDataFrame([("echo", 0.5, 2.0)], "model string, usd_in double, usd_out double")
    made = index.enrich(chunks, "T: {{TEXTO}} C: {{CONTEXTO}}", client, "echo", prices, STRINGS, LISTS)
    return made.select("chunk_id", "tokens_in", F.col("enrichment.resumo").alias("resumo"), F.round("cost_usd", 9).alias("cost_usd"))


@register("SELECT doc_id AS chunk_id, [length(text), 1]::DOUBLE[] AS vector, 2 AS dimension FROM documents WHERE doc_id % 10 > 0 UNION ALL SELECT doc_id, []::DOUBLE[], 0 FROM documents WHERE doc_id % 10 = 0")
def e7_embed(spark, d):
    def client():
        return lambda texts: [(k, [float(len(t) - 1), 1.0]) for k, t in enumerate(texts) if t[0] != "0"][::-1]

    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat((F.col("doc_id") % 10).cast("string"), "text").alias("content"))
    made = index.apply_model(chunks, client)
    return made.select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector", "dimension")


# Index upkeep


@register("SELECT user_id AS document_id, count(*) FILTER (event_type <> 'view') AS enriched, count(*) AS total, round(coalesce(sum(value) FILTER (event_type <> 'view'), 0.0), 2) AS cost_usd, coalesce(sum((props->>'k')::BIGINT), 0)::BIGINT AS duration_ms FROM events GROUP BY 1")
def e5_enrichment_totals(spark, d):
    made = F.col("event_type") != "view"
    e = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.when(made, F.col("props")).alias("enrichment"), F.when(made, F.col("value")).alias("cost_usd"), F.get_json_object("props", "$.k").cast("long").alias("duration_ms"))
    return index.enrichment_totals(e).withColumn("cost_usd", F.round("cost_usd", 2))


@register("""SELECT doc_id AS chunk_id, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE sha256(text) END AS hash, l.doc_id IS NULL AS indexed, CASE WHEN l.doc_id IS NULL THEN 7 END AS at_day FROM documents LEFT JOIN labels l USING (doc_id)""")
def e8_upsert(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct()
    old = docs.select(F.col("doc_id").alias("chunk_id"), F.lit("old").alias("hash"), F.lit(True).alias("indexed"), F.make_timestamp(F.lit(2024), F.lit(1), F.lit(7), F.lit(0), F.lit(0), F.lit(0)).alias("indexed_at"))
    new = docs.join(labels, "doc_id").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("hash"))
    return index.upsert_embeddings(old, new).select("chunk_id", "hash", "indexed", F.day("indexed_at").alias("at_day"))


@register("""SELECT vec_id AS chunk_id, CASE WHEN vec_id % 7 > 0 THEN 'Lei nº ' || (1000 + label) || '|Art. ' || vec_id || '|' || (vec_id % 2 + 1) || '|2|' || vec_id || '|' || coalesce(d.lang, '') END AS metadata, CASE WHEN vec_id % 7 > 0 THEN true END AS indexed, CASE WHEN vec_id % 7 = 0 THEN 'no vector for chunk ' || vec_id END AS error
  FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id""")
def e9_index_rows(spark, d):
    e, chunks, documents, _ = _knowledge(spark, d)
    k = F.col("chunk_id")
    langs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.struct("lang").alias("enrichment"))
    rows = chunks.join(langs, "chunk_id", "left").select("chunk_id", "document_id", k.alias("chunk_index"), F.concat(F.lit("Art. "), k).alias("article"), F.lit("").alias("chapter"), F.lit("").alias("section"), (k % 2 + 1).alias("part"), F.lit(2).alias("total_parts"), "enrichment")
    good, bad = index.index_rows(e.select("chunk_id", F.when(k % 7 > 0, F.col("vector")).alias("vector")), rows, documents.withColumnRenamed("document_name", "name"))
    m = F.concat_ws("|", "metadata.documento", "metadata.artigo", "metadata.parte", "metadata.total_partes", "metadata.chunk_index", F.coalesce("metadata.enriquecimento.lang", F.lit("")))
    none = F.lit(None)
    return good.select("chunk_id", m.alias("metadata"), "indexed", none.cast("string").alias("error")).unionByName(bad.select("chunk_id", none.cast("string").alias("metadata"), none.cast("boolean").alias("indexed"), "error"))


# Checks, evidence and trace


def _evidence(spark, d) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, d, "conversations")
    t = F.col("turn")
    got = turns.where("role = 'assistant'").select(F.col("conv_id").alias("question_id"), t.alias("ord"), t.alias("chunk_id"), F.concat(F.lit("lei "), t % 4).alias("law"), F.concat(F.lit("art. "), t).alias("article"))
    cited = turns.where("role = 'user'").select(F.col("conv_id").alias("question_id"), t.alias("cite"), F.concat(F.lit("lei "), t % 4 + 1).alias("law"), F.when(t % 4 == 0, F.concat(F.lit("art. "), t + 1)).alias("article"))
    return cited, got


_RECONCILED = """WITH r AS (SELECT conv_id AS question_id, turn AS chunk_id, 'lei ' || (turn % 4) AS law, 'art. ' || turn AS article FROM conversations WHERE role = 'assistant'),
  c AS (SELECT conv_id AS question_id, turn AS cite, 'lei ' || (turn % 4 + 1) AS law, CASE WHEN turn % 4 = 0 THEN 'art. ' || (turn + 1) END AS article FROM conversations WHERE role = 'user'),
  x AS (SELECT c.question_id, c.cite, c.law, c.article, (SELECT min(r.chunk_id) FROM r WHERE r.question_id = c.question_id AND (contains(r.law, c.law) OR contains(c.law, r.law)) AND (c.article IS NULL OR contains(r.article, c.article) OR contains(c.article, r.article))) AS chunk_id FROM c)"""


@register(f"{_RECONCILED} SELECT * FROM x")
def g7_reconcile(spark, d):
    return answers.reconcile(*_evidence(spark, d))


@register(f"""{_RECONCILED}, a AS (SELECT conv_id AS question_id, conv_id % 2 = 0 AS conflict FROM conversations GROUP BY conv_id),
  k AS (SELECT a.*, (SELECT count(*) FROM r WHERE r.question_id = a.question_id) AS nr, (SELECT count(*) FROM x WHERE x.question_id = a.question_id) AS nc, (SELECT list(trim(x.law || ' ' || coalesce(x.article, '')) ORDER BY x.cite) FROM x WHERE x.question_id = a.question_id AND x.chunk_id IS NULL) AS lost FROM a),
  w AS (SELECT *, array_to_string(list_filter([CASE WHEN nr = 0 THEN 'Nenhum documento foi recuperado — a resposta não deve ser exibida sem evidência.' END,
    CASE WHEN nr > 0 AND len(lost) > 0 THEN len(lost) || ' artigo(s) citado(s) pela IA não corresponderam a nenhum documento recuperado: ' || array_to_string(lost, ', ') END,
    CASE WHEN nr > 0 AND conflict THEN 'A resposta sinalizou divergência entre normas, mas não detalhou as versões — verifique manualmente.' END,
    CASE WHEN nr > 0 AND nc = 0 THEN 'A resposta não cita nenhum artigo do contexto recuperado; nível de confiança deveria ser BAIXO.' END], lambda z: z IS NOT NULL), '; ') AS warnings FROM k)
  SELECT question_id, warnings = '' AS valid, nr = 0 OR nc = 0 AS insufficient, warnings FROM w""")
def g8_validate(spark, d):
    cited, got = _evidence(spark, d)
    given = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("question_id")).agg(F.lit("ALTO").alias("confidence"), F.lit(0).alias("n_conflicts")).withColumn("has_conflict", F.col("question_id") % 2 == 0)
    found = answers.reconcile(cited, got).withColumn("shown", F.concat_ws(" ", "law", "article"))
    return answers.validate(given, found, got).withColumn("warnings", F.array_join("warnings", "; "))


@register("SELECT conv_id AS question_id, turn AS ord, turn AS chunk_id, role AS lei, CASE WHEN turn % 2 = 1 THEN 'Art. ' || turn END AS artigo, NULL::VARCHAR AS capitulo, role AS secao, turn / 10.0 AS score_similaridade, 'r' || turn AS motivo_recuperacao FROM conversations")
def g9_evidences(spark, d):
    return answers.evidences(_blocks(spark, d).withColumns({"distance": F.col("ord") / 10, "reason": F.concat(F.lit("r"), "ord")}))


def _log(spark, d) -> DataFrame:
    """Every turn as a retrieved chunk of one of the four stages."""
    t = F.col("turn")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), t.cast("long").alias("chunk_id"), t.alias("ord"), (t / 10).alias("distance"), (t + 0.5).alias("rerank_score"), F.concat(F.lit("r"), t).alias("reason"))
    return history.retrieval_log({s: rows.where(F.col("ord") % 4 == k) for k, s in enumerate(answers.STAGES)}, "RERANK")


_LOGGED = """WITH lg AS (SELECT conv_id AS question_id, (['VECTOR', 'METADATA', 'REFERENCE', 'RERANK'])[turn % 4 + 1] AS stage, row_number() OVER (PARTITION BY conv_id, turn % 4 ORDER BY turn) - 1 AS rank, turn AS chunk_id, CASE WHEN turn % 4 = 3 THEN turn + 0.5 ELSE turn / 10.0 END AS score, 'r' || turn AS reason FROM conversations)"""


@register(f"""{_LOGGED} SELECT q.item_id AS question_id, 'm' AS model, length(q.text) AS tokens, coalesce(string_agg(chunk_id || '/' || reason, ',' ORDER BY rank) FILTER (stage = 'VECTOR'), '') AS vector, coalesce(string_agg(chunk_id || '/' || reason, ',' ORDER BY rank) FILTER (stage = 'METADATA'), '') AS metadata,
  coalesce(string_agg(chunk_id || '/' || reason, ',' ORDER BY rank) FILTER (stage = 'RERANK'), '') AS rerank FROM benchmark q LEFT JOIN lg ON lg.question_id = q.item_id GROUP BY q.item_id, q.text""")
def g10_traces(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    made = q.select("question_id", F.lit("m").alias("model"), F.length("text").alias("tokens"))
    done = answers.traces(q, _log(spark, d), made)
    shown = lambda c: F.array_join(F.transform(f"{c}_stage", lambda x: F.concat(x["chunk_id"], F.lit("/"), x["reason"])), ",").alias(c)
    return done.select("question_id", "model", "tokens", shown("vector"), shown("metadata"), shown("rerank"))


# History


@register(f"{_LOGGED} SELECT * FROM lg")
def h2_retrieval_log(spark, d):
    return _log(spark, d)


@register("""SELECT conv_id * 100 + turn AS question_id, s.stage, s.ord, CASE s.stage WHEN 'GENERATION' THEN text WHEN 'RERANK' THEN CASE WHEN turn % 2 = 0 THEN text ELSE '' END ELSE role END AS prompt, s.stage || '!' AS raw, CASE WHEN s.ord < 2 THEN 'a' ELSE 'b' END AS model
  FROM conversations, (VALUES ('CLASSIFICATION', 0), ('ENTITY_EXTRACTION', 1), ('RERANK', 2), ('GENERATION', 3)) s(stage, ord) WHERE s.stage <> 'RERANK' OR (turn % 2 = 0 AND text <> '')""")
def h3_prompt_log(spark, d):
    t = table(spark, d, "conversations")
    raws = {f"{c}_raw": F.lit(f"{s}!") for c, s in (("classification", "CLASSIFICATION"), ("entity", "ENTITY_EXTRACTION"), ("rerank", "RERANK"), ("generation", "GENERATION"))}
    prompts = {"classification_prompt": F.col("role"), "entity_prompt": F.col("role"), "rerank_prompt": F.when(F.col("turn") % 2 == 0, F.col("text")), "generation_prompt": F.col("text")}
    models = {"classification_model": F.lit("a"), "entity_model": F.lit("a"), "model": F.lit("b")}
    return history.prompt_log(t.withColumn("question_id", F.col("conv_id") * 100 + F.col("turn")).withColumns(raws | prompts | models))


@register(f"""{_LOGGED}, {_CHUNKS} SELECT lg.question_id, lg.stage, lg.rank, lg.chunk_id, 'Lei nº ' || (1000 + ck.document_id) AS document_name, 'Art. ' || ck.article_id AS article_label, sha256(ck.content) AS content_hash, row_number() OVER (PARTITION BY lg.question_id ORDER BY lg.stage, lg.rank) AS place FROM lg JOIN ck USING (chunk_id)""")
def h7_question_retrievals(spark, d):
    from pyspark.sql.window import Window

    _, chunks, documents, articles = _knowledge(spark, d)
    done = history.question_retrievals(_log(spark, d), chunks, articles, documents)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("stage", "rank"))
    return done.select("question_id", "stage", "rank", "chunk_id", "document_name", "article_label", F.sha2("content", 256).alias("content_hash"), place.alias("place"))


@register("""SELECT a.item_id AS answer_id, a.item_id + 1 AS question_id, sha256(a.text) AS question_hash, count(e.event_id) FILTER (e.event_type IN ('click', 'purchase')) AS up, count(e.event_id) FILTER (e.event_type = 'error') AS down FROM benchmark a LEFT JOIN events e ON e.user_id = a.item_id GROUP BY a.item_id, a.text""")
def h8_feedback(spark, d):
    b = table(spark, d, "benchmark")
    rating = F.when(F.col("event_type").isin("click", "purchase"), "UP").when(F.col("event_type") == "error", "DOWN").otherwise("?")
    rated = table(spark, d, "events").select(F.col("user_id").alias("answer_id"), rating.alias("rating"))
    made = b.select(F.col("item_id").alias("answer_id"), (F.col("item_id") + 1).alias("question_id"))
    asked = b.select((F.col("item_id") + 1).alias("question_id"), F.sha2("text", 256).alias("question_hash"))
    return history.answers_with_feedback(rated, made, asked).select("answer_id", "question_id", "question_hash", "up", "down")


@register("""WITH m AS (SELECT event_type AS type, user_id AS ref_id, event_id AS "at", props AS title FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1)
  SELECT type, ref_id, "at", title, row_number() OVER (PARTITION BY type ORDER BY "at" DESC, ref_id) AS place FROM m WHERE NOT (type = 'view' AND ref_id IN (SELECT item_id FROM benchmark))""")
def h9_favourite_list(spark, d):
    marks = table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("ref_id"), F.col("event_id").alias("at"), F.col("props").alias("title"))
    removed = table(spark, d, "benchmark").select(F.lit("view").alias("type"), F.col("item_id").alias("ref_id"))
    return history.favourites(marks, removed)


@register("""SELECT d.doc_id AS document_id, 0 AS tokens, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS chapters, 0 AS articles, (SELECT count(*) FROM events e WHERE e.user_id = d.doc_id) AS chunks, (SELECT count(*) FROM events e WHERE e.user_id = d.doc_id AND e.event_type <> 'view') AS embeddings, 0 AS figures,
  (SELECT count(*) FROM events e WHERE e.user_id = d.doc_id AND e.event_type = 'click') AS indexed FROM documents d""")
def h11_document_detail(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("document_id"), "event_type")
    children = {"chapters": table(spark, d, "labels").select(F.col("doc_id").alias("document_id")), "chunks": e, "embeddings": e.where("event_type <> 'view'"), "indexed": e.where("event_type = 'click'")}
    return history.document_detail(table(spark, d, "documents").select(F.col("doc_id").alias("document_id")), children)


_AMENDED = """WITH t AS (SELECT doc_id, doc_id % 40 AS law, text, CASE WHEN doc_id % 9 = 0 THEN 'Artigo REVOGADO' WHEN doc_id % 9 < 3 THEN 'Nova Redação' ELSE '' END AS notes FROM documents),
  k AS (SELECT *, CASE WHEN regexp_matches(strip_accents(lower(notes || ' ' || text)), 'revogad') THEN 'REVOGACAO' WHEN regexp_matches(strip_accents(lower(notes || ' ' || text)), 'nova redacao|redacao dada pel') THEN 'NOVA_REDACAO' END AS kind FROM t),
  a AS (SELECT law, doc_id AS chunk_id, 'Art. ' || doc_id AS article, kind, coalesce(nullif(notes, ''), substr(text, 1, 240)) AS snippet, bool_or(kind = 'REVOGACAO') OVER (PARTITION BY law) AS has_revoked FROM k WHERE kind IS NOT NULL)"""


def _amended(spark, d) -> DataFrame:
    k = F.col("doc_id")
    notes = F.when(k % 9 == 0, "Artigo REVOGADO").when(k % 9 < 3, "Nova Redação").otherwise("")
    return table(spark, d, "documents").select((k % 40).alias("law"), k.alias("chunk_id"), F.concat(F.lit("Art. "), k).alias("article"), notes.alias("notes"), F.col("text").alias("content"))


@register(f"{_AMENDED} SELECT * FROM a")
def h12_amendments(spark, d):
    return history.amendments(_amended(spark, d))


@register(f"{_AMENDED} SELECT l.law, CASE WHEN (SELECT bool_or(has_revoked) FROM a WHERE a.law = l.law) THEN 'Contém dispositivos possivelmente revogados' ELSE 'Vigente' END AS status FROM (SELECT DISTINCT law FROM t) l")
def h13_law_status(spark, d):
    rows = _amended(spark, d)
    return history.law_status(history.amendments(rows), rows)


@register("""WITH q AS (SELECT item_id AS query_id, lower(trim(split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3))) AS q FROM benchmark) SELECT query_id, doc_id AS document_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank, substr(text, 1, 240) AS excerpt
  FROM documents, q WHERE q <> '' AND contains(lower(text), q) QUALIFY rank <= 30""")
def h16_manual_search(spark, d):
    words = F.split("text", " ", -1)
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(word(1), F.lit(" "), word(2)).alias("query"))
    return history.manual_search(queries, table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"))


_JOBS = "j AS (SELECT user_id AS document_id, event_type AS step, CASE WHEN (props->>'k')::INT % 5 = 0 THEN 'RUNNING' ELSE 'DONE' END AS status, ts AS started_at, CASE WHEN (props->>'k')::INT % 5 > 0 THEN ts + to_microseconds((value * 1000000)::BIGINT) END AS finished_at FROM events)"


def _jobs(spark, d) -> DataFrame:
    running = F.get_json_object("props", "$.k").cast("int") % 5 == 0
    at = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(at) + F.round(F.col("value") * 1000000).cast("long"))
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("step"), F.when(running, "RUNNING").otherwise("DONE").alias("status"), at.alias("started_at"), F.when(~running, end).alias("finished_at"))


@register(f"WITH {_JOBS} SELECT document_id, step, status, round((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 3) AS seconds, row_number() OVER (PARTITION BY document_id ORDER BY started_at, step) AS place FROM j")
def h17_job_durations(spark, d):
    return history.jobs(_jobs(spark, d)).select("document_id", "step", "status", "seconds", "place")


@register(f"WITH {_JOBS} SELECT step, status, count(*) AS n FROM j GROUP BY ALL")
def h17_job_counts(spark, d):
    return history.job_counts(_jobs(spark, d))


@register("SELECT vec_id AS chunk_id, label::BIGINT AS document_id, vec_id % 11 > 0 AS indexed, vec_id AS chunk_index, CASE WHEN vec_id % 7 > 0 THEN 'Art. ' || vec_id END AS origin_article FROM embeddings")
def h18_embedding_list(spark, d):
    e, chunks, _, articles = _knowledge(spark, d)
    rows = chunks.join(articles, "article_id", "left").select("chunk_id", F.col("chunk_id").alias("chunk_index"), F.col("article_label").alias("origin_article"))
    return history.embedding_list(e, rows)


@register("SELECT user_id AS document_id, event_id AS figure_id, event_id % 4 AS page, event_id AS figure_index, d.doc_id AS article_id, d.lang AS article_label FROM events LEFT JOIN documents d ON d.doc_id = event_id AND event_id % 2 = 0 WHERE event_id % 4 = 2")
def h18_figure_list(spark, d):
    figures = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("figure_id"), (F.col("event_id") % 4).alias("page"), F.col("event_id").alias("figure_index"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("article_id"))
    arts = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("lang").alias("label"))
    done = history.figure_list(figures, arts, 2)
    return done.withColumn("article_id", F.when(F.col("article_label").isNotNull(), F.col("article_id")))
