"""More registered queries: labels, links, prompts, deletion and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import chunking, history, index, lexer
from lexmill.plans.queries import _PARENTS, P, law_tokens, register, table


@register(f"""WITH {_PARENTS} SELECT doc_id, idx, type, CASE type WHEN 'INCISO' THEN regexp_extract(text, '{P.inciso}', 1) WHEN 'ALINEA' THEN regexp_extract(text, '{P.alinea}', 1) || ')'
  WHEN 'ITEM' THEN regexp_extract(text, '{P.item}', 1) || '.' WHEN 'ARTIGO' THEN 'Art. ' || regexp_extract(text, '{P.article}', 1)
  WHEN 'PARAGRAFO' THEN CASE WHEN regexp_extract(text, '(?i){P.paragraph}', 1) = '' THEN 'Parágrafo único' ELSE '§ ' || regexp_extract(text, '(?i){P.paragraph}', 1) || 'º' END
  WHEN 'CAPITULO' THEN 'CAPÍTULO ' || regexp_extract(text, '(?i){P.chapter}', 1) WHEN 'SECAO' THEN 'Seção ' || regexp_extract(text, '(?i){P.section}', 1) ELSE 'Subseção ' || regexp_extract(text, '(?i){P.subsection}', 1) END AS label
  FROM dp WHERE depth IS NOT NULL""")
def c8_labels(spark, d):
    return lexer.labels(law_tokens(spark, d)).select("doc_id", "idx", "type", "label")


@register("""WITH a AS (SELECT page_id // 5 AS doc_id, page_id AS article_id, page_id % 5 AS idx, (page_id % 3)::VARCHAR AS number FROM pages), l AS (SELECT doc_id, number, arg_max(article_id, idx) AS article_id FROM a GROUP BY ALL)
  SELECT p.page_id AS chunk_id, p.page_id // 5 AS doc_id, (p.page_id % 4)::VARCHAR AS number, l.article_id FROM pages p LEFT JOIN l ON l.doc_id = p.page_id // 5 AND l.number = (p.page_id % 4)::VARCHAR""")
def d4_link_by_number(spark, d):
    pages = table(spark, d, "pages").withColumn("doc_id", F.floor(F.col("page_id") / 5))
    arts = pages.select("doc_id", F.col("page_id").alias("article_id"), (F.col("page_id") % 5).alias("idx"), (F.col("page_id") % 3).cast("string").alias("number"))
    return chunking.link_by_number(pages.select(F.col("page_id").alias("chunk_id"), "doc_id", (F.col("page_id") % 4).cast("string").alias("number")), arts)


@register("SELECT conv_id, turn, replace(replace('Contexto: {{CONTEXTO}} / {{TEXTO}}', '{{TEXTO}}', text), '{{CONTEXTO}}', CASE WHEN turn % 2 = 0 THEN role ELSE '(sem contexto)' END) AS prompt FROM conversations")
def e2_prompt_fill(spark, d):
    given = F.when(F.col("turn") % 2 == 0, F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", index.fill_prompt(F.lit("Contexto: {{CONTEXTO}} / {{TEXTO}}"), F.col("text"), given).alias("prompt"))


@register("SELECT 'labels' AS name, doc_id, quality || ',' || toxic AS own FROM labels WHERE doc_id % 4 > 0 UNION ALL SELECT 'documents', doc_id, sha256(text) FROM documents WHERE doc_id % 4 > 0")
def e12_cascade_delete(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    left = index.cascade_delete({"documents": docs, "labels": labels}, docs.where("doc_id % 4 = 0").select("doc_id"), "doc_id")
    own = {"documents": F.sha2("text", 256), "labels": F.concat_ws(",", "quality", "toxic")}
    rows = [df.select(F.lit(name).alias("name"), "doc_id", own[name].alias("own")) for name, df in left.items()]
    return rows[0].unionByName(rows[1])


@register("SELECT label AS document_id, count(*) AS chunks, count(*) FILTER (vec_id % 3 > 0) AS indexed, count(*) = count(*) FILTER (vec_id % 3 > 0) AS complete FROM embeddings GROUP BY 1")
def h19_index_coverage(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("document_id"), "vec_id")
    done = history.dashboard(e.select("document_id").distinct(), {"chunks": e, "indexed": e.where("vec_id % 3 > 0")})
    return done.withColumn("complete", F.col("chunks") == F.col("indexed"))
