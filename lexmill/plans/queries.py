"""Registered queries of the library's own operators, with the same results said in DuckDB SQL.

The given tables play the roles of the legal corpus: `as_law` turns every text into a law
by prefixing its lines by a rule on (doc_id, line), pages are parts of documents,
embeddings are chunks (label: document), conversations are questions and answers, events
are logs. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import SPACE, Patterns
from lexmill.functions import text as T
from lexmill.operators import chunking, history, index, lexer, search
from lexmill.sources import documents as sources

P = Patterns()
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Registers a query with its SQL; without one, tests hold it against a plain version."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def as_law(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the text's lines prefixed as headings, articles and their parts."""

    def line(l, i):
        n = F.get(F.array(*map(F.lit, ROMAN)), F.pmod((i / 14).cast("int"), F.lit(10)))
        cases = {
            0: F.concat(F.lit("CAPÍTULO "), n), 2: F.concat(F.lit("Seção "), n, F.lit(" - Normas")), 3: F.concat(F.lit("Art. "), i, F.lit("º "), l),
            5: F.concat(F.lit("§ "), i % 3 + 1, F.lit("º "), l, F.lit(" (NR)")), 6: F.concat(F.lit("I - "), l), 7: F.concat(F.lit("a) "), l), 8: F.concat(F.lit("1. "), l),
            9: F.concat(F.lit("Art. "), i, F.lit(". "), l, F.lit(" nos termos da Lei nº "), F.col("doc_id") % 50 + 1000, F.lit(", de 2001; e do Decreto nº 12."), i),
            10: F.concat(F.lit("Parágrafo único. "), l), 11: F.concat(F.lit("II - "), l), 12: F.concat(F.lit("Subseção "), n), 13: F.concat(F.lit("Obs: "), l),
        }
        out = F
        for k, c in cases.items():
            out = out.when(F.pmod(i + F.col("doc_id"), F.lit(14)) == k, c)
        return out.otherwise(l)

    return docs.select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n").alias("text"))


def law_tokens(spark, d):
    return lexer.tokens(lexer.lines(as_law(table(spark, d, "documents"))))


_LAW = """
src AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
rawl AS (SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) - 1 AS i FROM src),
law AS (SELECT doc_id, i, CASE (i + doc_id) % 14
  WHEN 0 THEN 'CAPÍTULO ' || r WHEN 2 THEN 'Seção ' || r || ' - Normas' WHEN 3 THEN 'Art. ' || i || 'º ' || l
  WHEN 5 THEN '§ ' || (i % 3 + 1) || 'º ' || l || ' (NR)' WHEN 6 THEN 'I - ' || l WHEN 7 THEN 'a) ' || l WHEN 8 THEN '1. ' || l
  WHEN 9 THEN 'Art. ' || i || '. ' || l || ' nos termos da Lei nº ' || (doc_id % 50 + 1000) || ', de 2001; e do Decreto nº 12.' || i
  WHEN 10 THEN 'Parágrafo único. ' || l WHEN 11 THEN 'II - ' || l WHEN 12 THEN 'Subseção ' || r WHEN 13 THEN 'Obs: ' || l ELSE l END AS raw
  FROM (SELECT *, (['I','II','III','IV','V','VI','VII','VIII','IX','X'])[(i // 14) % 10 + 1] AS r FROM rawl)),
ln AS (SELECT doc_id, i + 1 AS line_no, raw, regexp_replace(raw, '^SP+|SP+$', '', 'g') AS line,
  coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM law),
lines AS (SELECT * FROM ln WHERE line <> '')
""".replace("SP", SPACE)

_CLASS = "CASE " + " ".join(
    f"WHEN regexp_matches(line, '{p}') THEN '{n}'"
    for p, n in (
        ("(?i)" + P.chapter, "CAPITULO"), ("(?i)" + P.subsection, "SUBSECAO"), ("(?i)" + P.section, "SECAO"), (P.article, "ARTIGO"), ("(?i)" + P.paragraph, "PARAGRAFO"), (P.inciso, "INCISO"), (P.alinea, "ALINEA"),
    )
) + " ELSE 'FREE' END"

_TOKENS = _LAW + f""",
cl AS (SELECT *, {_CLASS} AS cls FROM lines),
cx AS (SELECT *, last_value(CASE WHEN cls <> 'FREE' THEN cls END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hard,
  sum((cls <> 'FREE')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM cl),
it AS (SELECT *, cls = 'FREE' AND regexp_matches(line, '{P.item}') AND coalesce(hard IN ('ALINEA', 'INCISO'), false) AS item FROM cx),
nt AS (SELECT *, cls = 'FREE' AND NOT item AND regexp_matches(line, '(?i){P.note}') AS note FROM it),
fr AS (SELECT *, sum((cls = 'FREE' AND NOT item AND NOT note)::INT) OVER (PARTITION BY doc_id, grp ORDER BY line_no) AS nth FROM nt),
main AS (SELECT doc_id, line_no, position, line, CASE WHEN cls <> 'FREE' THEN cls WHEN item THEN 'ITEM' WHEN note THEN 'OBSERVACAO'
  WHEN hard = 'CAPITULO' AND nth = 1 AND length(line) <= 120 AND NOT regexp_matches(line, '[.;:]$') THEN 'TITULO_CAPITULO'
  WHEN hard IN ('SECAO', 'SUBSECAO') AND nth = 1 AND length(line) <= 120 AND NOT regexp_matches(line, '[.;:]$') THEN 'TITULO_SECAO'
  WHEN hard = 'ARTIGO' THEN 'CAPUT' ELSE 'TEXTO' END AS type FROM fr),
cited AS (SELECT doc_id, line_no, position, unnest(c) AS text, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(line, '(?i){P.citation}', 1) AS c FROM main)),
every AS (SELECT doc_id, line_no, position, 0 AS kind, 0 AS pos, type, line AS text FROM main
  UNION ALL SELECT doc_id, line_no, position, 1, 0, 'NOVA_REDACAO', regexp_extract(line, '(?i){P.amendment}', 1) FROM main WHERE regexp_extract(line, '(?i){P.amendment}', 1) <> ''
  UNION ALL SELECT doc_id, line_no, position, 2, pos, 'REFERENCIA_LEGAL', text FROM cited
  UNION ALL SELECT doc_id, min(line_no), arg_min(position, line_no), -1, 0, 'DOCUMENT', arg_min(line, line_no) FROM main GROUP BY doc_id),
tok AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, kind, pos) - 1 AS idx, type, text, position, line_no FROM every)
"""
_L = lambda d: f"last_value(CASE WHEN depth = {d} THEN idx END IGNORE NULLS) OVER w AS l{d}"
_PARENTS = _TOKENS + f""",
dp AS (SELECT *, CASE type {' '.join(f"WHEN '{n}' THEN {d}" for n, d in lexer.DEPTH.items())} END AS depth FROM tok),
ls AS (SELECT *, {', '.join(_L(d) for d in range(1, 8))} FROM dp WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
par AS (SELECT doc_id, idx, type, depth, CASE depth WHEN 1 THEN -1 {' '.join(f"WHEN {d} THEN greatest(-1, {', '.join(f'coalesce(l{k}, -1)' for k in range(1, d))})" for d in range(2, 9))} END AS parent_idx FROM ls)
"""


@register(f"WITH {_LAW} SELECT doc_id, line_no, line, position FROM lines")
def c1_lines(spark, d):
    return lexer.lines(as_law(table(spark, d, "documents"))).select("doc_id", "line_no", "line", "position")


@register(f"WITH {_LAW} SELECT {_CLASS} AS cls, count(*) AS n FROM lines GROUP BY 1")
def c2_line_classes(spark, d):
    return lexer.lines(as_law(table(spark, d, "documents"))).groupBy(lexer.line_class(F.col("line")).alias("cls")).agg(F.count("*").alias("n"))


@register(f"WITH {_TOKENS} SELECT * FROM tok")
def c5_tokens(spark, d):
    return law_tokens(spark, d)


@register(f"WITH {_TOKENS} SELECT doc_id, type, count(*) AS n FROM tok GROUP BY ALL")
def c6_token_counts(spark, d):
    return law_tokens(spark, d).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@register(f"WITH {_PARENTS} SELECT doc_id, idx, type, parent_idx FROM par WHERE depth IS NOT NULL")
def c7_parents(spark, d):
    return lexer.with_parents(law_tokens(spark, d)).where("depth is not null").select("doc_id", "idx", "type", "parent_idx")


@register(f"""WITH {_TOKENS},
lab AS (SELECT *, CASE WHEN type IN ('SECAO','SUBSECAO','CAPITULO') THEN regexp_extract(text, '(?i)' || CASE type WHEN 'CAPITULO' THEN '{P.chapter}' WHEN 'SECAO' THEN '{P.section}' ELSE '{P.subsection}' END, 1)
  WHEN type = 'ARTIGO' THEN regexp_extract(text, '{P.article}', 1) END AS number,
  regexp_replace(CASE WHEN type IN ('SECAO','SUBSECAO','CAPITULO') THEN regexp_extract(text, '(?i)' || CASE type WHEN 'CAPITULO' THEN '{P.chapter}' WHEN 'SECAO' THEN '{P.section}' ELSE '{P.subsection}' END, 2)
  WHEN type = 'ARTIGO' THEN regexp_extract(text, '{P.article}', 2) END, '^{SPACE}+|{SPACE}+$', '', 'g') AS body FROM tok),
ix AS (SELECT *, last_value(CASE WHEN type = 'CAPITULO' THEN idx END IGNORE NULLS) OVER w AS ch, last_value(CASE WHEN type IN ('SECAO','SUBSECAO') THEN idx END IGNORE NULLS) OVER w AS se,
  last_value(CASE WHEN type = 'ARTIGO' THEN idx END IGNORE NULLS) OVER w AS ar FROM lab WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
cht AS (SELECT doc_id, ch, string_agg(coalesce(body, text), ' ' ORDER BY idx) AS t FROM ix WHERE type IN ('CAPITULO','TITULO_CAPITULO') AND coalesce(body, text) <> '' GROUP BY ALL),
set_ AS (SELECT doc_id, se, string_agg(coalesce(body, text), ' ' ORDER BY idx) AS t FROM ix WHERE type IN ('SECAO','SUBSECAO','TITULO_SECAO') AND coalesce(body, text) <> '' GROUP BY ALL),
cap AS (SELECT doc_id, ar, string_agg(coalesce(body, text), ' ' ORDER BY idx) AS t FROM ix WHERE type IN ('ARTIGO','CAPUT') AND coalesce(body, text) <> '' GROUP BY ALL)
SELECT a.doc_id, a.idx, a.number, 'Art. ' || a.number AS label,
  CASE WHEN a.ch IS NULL THEN '' ELSE concat_ws(' — ', 'CAPÍTULO ' || c.number, cht.t) END AS chapter,
  CASE WHEN a.se IS NULL OR a.se < coalesce(a.ch, -1) THEN '' ELSE concat_ws(' — ', CASE s.type WHEN 'SECAO' THEN 'Seção ' ELSE 'Subseção ' END || s.number, set_.t) END AS section, coalesce(cap.t, '') AS caput
FROM ix a LEFT JOIN ix c ON c.doc_id = a.doc_id AND c.idx = a.ch LEFT JOIN ix s ON s.doc_id = a.doc_id AND s.idx = a.se
LEFT JOIN cht ON cht.doc_id = a.doc_id AND cht.ch = a.ch LEFT JOIN set_ ON set_.doc_id = a.doc_id AND set_.se = a.se LEFT JOIN cap ON cap.doc_id = a.doc_id AND cap.ar = a.idx WHERE a.type = 'ARTIGO'""")
def c13_articles(spark, d):
    return lexer.articles(law_tokens(spark, d))


_TOKEN_COUNT = r"len(regexp_extract_all({}, '\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}]'))"


def _files(spark, d) -> DataFrame:
    """Documents as uploads: the name's ending, media type and kind of content follow from doc_id."""
    k = F.pmod("doc_id", F.lit(7))
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".DOCX", ".htm", ".md", ".txt", ".bin", ""))), (k + 1).cast("int"))
    pasted = k == 6
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), F.when(~pasted, F.concat(F.lit("lei "), "doc_id", ending)).alias("name"), F.when(k == 5, "application/pdf").alias("mime"),
        F.when(k.isin(2, 3, 4), F.encode("text", "UTF-8")).alias("content"), F.when(k < 2, F.col("n_chars")).alias("size_bytes"), F.when(pasted, F.col("text")).alias("pasted"),
    )


# Cleaning and text


def _dirty(spark, d) -> DataFrame:
    """Texts with the faults that cleaning repairs, by a rule on doc_id."""
    t = F.col("text")
    bad = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  “"), F.replace(t, F.lit(". "), F.lit(".  \r\n\t ")), F.lit("”\n\n\n\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.replace(t, F.lit("en"), F.lit("e-\nn")), F.lit(" Ã§ \u00a0 \x07x"))).otherwise(t)
    return table(spark, d, "documents").select("doc_id", bad.alias("text"))


def _clean_sql() -> str:
    ctes = ["""WITH dirty AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  “' || replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(9) || ' ') || '”' || repeat(chr(10), 4)
      WHEN 1 THEN replace(text, 'en', 'e-' || chr(10) || 'n') || ' Ã§ ' || chr(160) || ' ' || chr(7) || 'x' ELSE text END AS text FROM documents)"""]
    fixed = "nfc_normalize(text)"
    for wrong, right in T.MOJIBAKE:
        fixed = f"replace({fixed}, '{wrong}', '{right}')"
    ctes.append(f"s0 AS (SELECT *, {fixed} AS t FROM dirty)")
    ctes.append("k0 AS (SELECT *, CASE WHEN t = text THEN 0 ELSE 1 END AS n_corrigir_encoding FROM s0)")
    for k, (name, pattern, new) in enumerate(T.CLEANING):
        p = pattern.replace("(?md)", "(?m)").replace("'", "''")
        value = {"$1$2": "'\\1\\2'", "'": "''''"}.get(new) or " || ".join(["''", *("chr(10)" if c == "\n" else f"'{c}'" for c in new)])
        ctes.append(f"k{k + 1} AS (SELECT * REPLACE (regexp_replace(t, '{p}', {value}, 'g') AS t), len(regexp_extract_all(t, '{p}')) AS n_{name} FROM k{k})")
    return ", ".join(ctes) + f", done AS (SELECT *, regexp_replace(t, '^{SPACE}+|{SPACE}+$', '', 'g') AS cleaned FROM k{len(T.CLEANING)})"


_COUNTS = ["n_corrigir_encoding", *(f"n_{n}" for n, _, _ in T.CLEANING)]


@register(f"""{_clean_sql()} SELECT doc_id, sha256(cleaned) AS cleaned_hash, {', '.join(_COUNTS)}, length(text) AS chars_before, length(cleaned) AS chars_after,
  len(string_split(text, chr(10))) AS lines_before, len(string_split(cleaned, chr(10))) AS lines_after FROM done""")
def b1_clean(spark, d):
    return T.clean(_dirty(spark, d)).select("doc_id", F.sha2("cleaned", 256).alias("cleaned_hash"), *_COUNTS, "chars_before", "chars_after", "lines_before", "lines_after")


@register(f"{_clean_sql()} SELECT operation[3:] AS operation, total FROM (UNPIVOT (SELECT {', '.join(f'sum({c})::BIGINT AS {c}' for c in _COUNTS)} FROM done) ON * INTO NAME operation VALUE total) WHERE total > 0")
def b3_cleaning_totals(spark, d):
    return T.cleaning_totals(T.clean(_dirty(spark, d)))


@register("SELECT doc_id, sha256(strip_accents(lower(text))) AS folded_hash FROM documents")
def b4_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.fold("text"), 256).alias("folded_hash"))


@register(f"SELECT doc_id, sha256(text) AS hash, {_TOKEN_COUNT.format('text')} AS tokens, CASE WHEN length(text) > 500 THEN text[:500] || '…' ELSE text END AS short, text[:240] AS snippet FROM documents")
def b5_hash_tokens_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), T.count_tokens(F.col("text")).cast("long").alias("tokens"), T.truncate(F.col("text")).alias("short"), F.substring("text", 1, 240).alias("snippet"))


# US dollars per million tokens in and out of some models.
PRICES = (("small", 0.15, 0.6), ("large", 2.5, 10.0))


@register("""SELECT lang, count(*) AS calls, round(sum(coalesce((n_chars * i + (n_chars // 4) * o) / 1e6, 0.0)), 3) AS cost_usd FROM documents
  LEFT JOIN (VALUES ('small', 0.15, 0.6), ('large', 2.5, 10.0)) p(model, i, o) ON p.model = CASE doc_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'none' END GROUP BY lang""")
def b7_cost(spark, d):
    calls = table(spark, d, "documents").select("lang", F.when(F.col("doc_id") % 3 == 0, "small").when(F.col("doc_id") % 3 == 1, "large").otherwise("none").alias("model"), F.col("n_chars").alias("tokens_in"), F.floor(F.col("n_chars") / 4).alias("tokens_out"))
    priced = T.with_cost(calls, spark.createDataFrame(PRICES, "model string, usd_in double, usd_out double"))
    return priced.groupBy("lang").agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 3).alias("cost_usd"))


# Figures and pages


@register("""WITH a AS (SELECT page_id // 5 AS d, page_id AS article_id, page_id % 5 AS i, CASE WHEN page_id % 3 > 0 THEN page_id % 4 END AS page FROM pages), f AS (SELECT page_id // 5 AS document_id, page_id AS figure_id, page_id % 5 AS page FROM pages)
  SELECT document_id, figure_id, f.page, arg_max(article_id, i) AS article_id FROM f LEFT JOIN a ON a.d = f.document_id AND a.page <= f.page GROUP BY ALL""")
def d8_figures_to_articles(spark, d):
    pages = table(spark, d, "pages").withColumn("document_id", F.floor(F.col("page_id") / 5))
    arts = pages.select("document_id", F.col("page_id").alias("article_id"), (F.col("page_id") % 5).alias("article_index"), F.when(F.col("page_id") % 3 > 0, F.col("page_id") % 4).alias("page"))
    figures = pages.select("document_id", F.col("page_id").alias("figure_id"), (F.col("page_id") % 5).alias("page"))
    return chunking.figures_to_articles(figures, arts)


# Index maintenance


@register("""SELECT doc_id AS chunk_id, sha256(text) AS hash, quality IS NULL OR quality = 0 OR toxic = 1 AS pending FROM documents LEFT JOIN labels USING (doc_id)""")
def e6_pending_embeddings(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    old = labels.join(docs, "doc_id").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise("old").alias("hash"), F.when(F.col("toxic") == 1, "m0").otherwise("m1").alias("model"))
    return index.pending_embeddings(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), old, "m1")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def e1_pending_enrichment(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    made = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "m1").otherwise("m0").alias("model"))
    return index.pending_enrichment(chunks, made, "m1").withColumnRenamed("chunk_id", "doc_id")


@register("""WITH s AS (SELECT event_id, event_id % 10 AS st, user_id % 9 AS sp FROM events) SELECT event_id, st >= sp AS eligible, (['EXTRACTED','CLEANED','TOKENIZED','PARSED','STRUCTURED','CHUNKED','ENRICHED','EMBEDDED','INDEXED'])[sp + 1] AS after FROM s""")
def e10_step_eligibility(spark, d):
    name = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    step = name(index.STEPS, F.col("user_id") % 9)
    return table(spark, d, "events").select("event_id", index.eligible(name(index.STATUSES, F.col("event_id") % 10), step).alias("eligible"), index.status_after(step).alias("after"))


@register("""WITH r AS (SELECT doc_id, CASE quality WHEN 1 THEN 9 ELSE 3 END AS s FROM labels) SELECT k.name, doc_id AS document_id FROM documents, (VALUES ('tokens', 3), ('structure', 5), ('chunks', 6), ('embeddings', 8)) k(name, last)
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = documents.doc_id AND r.s <= k.last)""")
def e11_invalidate(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    rerun = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "INDEXING").otherwise("TOKENIZATION").alias("step"))
    left = index.invalidate({n: docs for n in index.CLEARED_UP_TO}, rerun)
    out = None
    for name, df in left.items():
        part = df.select(F.lit(name).alias("name"), "document_id")
        out = part if out is None else out.unionByName(part)
    return out


# Retrieval

_DIST = "1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    chunk = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("document_id"), F.col("embedding").alias("vector"))
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")), chunk


@register(f"""SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round({_DIST}, 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DIST}, 9), v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY rank <= 30""")
def f1_vector_top_k(spark, d):
    questions, chunks = _vectors(spark, d)
    return search.vector_top_k(questions, chunks, 30).select("question_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


@register(f"""SELECT q.vec_id AS question_id, v.label::BIGINT AS document_id, v.vec_id AS chunk_id, printf('%.4f', greatest(0.0, {_DIST})) AS reason FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id, v.label ORDER BY round({_DIST}, 9), v.vec_id) <= 2""")
def f3_top_k_per_document(spark, d):
    questions, chunks = _vectors(spark, d)
    found = search.vector_top_k(questions, chunks, 2, per_document=True)
    return found.select("question_id", "document_id", "chunk_id", F.format_string("%.4f", "distance").alias("reason"))


# Answers


# History and views


@register("SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS question_idx FROM conversations WHERE role = 'user'")
def h1_question_index(spark, d):
    return history.question_index(table(spark, d, "conversations"))


@register("SELECT conv_id, coalesce(substr(arg_min(text, turn) FILTER (role = 'user'), 1, 80), 'Conversa') AS title, count(*) FILTER (role = 'user') AS n_questions, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def h5_conversation_list(spark, d):
    return history.conversation_list(table(spark, d, "conversations"))


@register("""WITH n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS question_idx, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM n WHERE role = 'user'""")
def h6_exchanges(spark, d):
    return history.exchanges(table(spark, d, "conversations"))


@register("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def h9_favourites(spark, d):
    return history.latest_by_key(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@register("""SELECT label AS document_id, count(*) AS chunks, count(*) FILTER (vec_id % 3 > 0) AS embedded, count(*) FILTER (vec_id % 5 = 0) AS indexed FROM embeddings GROUP BY 1""")
def h10_dashboard(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("document_id"), "vec_id")
    return history.dashboard(e.select("document_id").distinct(), {"chunks": e, "embedded": e.where("vec_id % 3 > 0"), "indexed": e.where("vec_id % 5 = 0")})


@register("""SELECT doc_id AS document_id, CASE WHEN doc_id % 7 = 6 THEN '' ELSE 'lei ' || doc_id || (['.pdf','.DOCX','.htm','.md','.txt','.bin'])[doc_id % 7 + 1] END AS name,
  (['PDF','DOCX','HTML','MARKDOWN','TXT','PDF','PASTED'])[doc_id % 7 + 1] AS type, CASE WHEN doc_id % 7 IN (2, 3, 4, 6) THEN (['','','html-to-text','markdown-passthrough','utf8','','pasted-text'])[doc_id % 7 + 1] END AS engine,
  CASE WHEN doc_id % 7 < 2 THEN n_chars WHEN doc_id % 7 IN (2, 3, 4) THEN strlen(text) WHEN doc_id % 7 = 6 THEN length(text) ELSE 0 END AS size_bytes, 'UPLOADED' AS status,
  CASE WHEN doc_id % 7 IN (3, 4, 6) THEN sha256(text) END AS text_hash FROM documents""")
def a1_register_documents(spark, d):
    done = sources.register(_files(spark, d))
    return done.select("document_id", "name", "type", "engine", "size_bytes", "status", F.when(F.col("type") != "HTML", F.sha2("text", 256)).alias("text_hash"))
