"""From evidence to answers: legal status, contexts and prompts, generation, tolerant reading, checks, evidence and trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions.text import fold, truncate, with_cost
from lexmill.operators.index import call_model

# Kinds of questions; the last one stands for all others.
CATEGORIES = (
    "Licenciamento", "Zoneamento", "Uso do Solo", "Recuos", "Coeficiente", "Taxa de Ocupação", "Altura", "Piscinas", "Muros", "Demolição", "Reforma", "Alvarás",
    "Habite-se", "Fiscalização", "Infrações", "Regularização", "Parcelamento", "Edificações", "Movimento de Terra", "Acessibilidade", "Segurança", "Outros",
)

# Kinds of entities in a question, in the order in which their terms are listed.
ENTITY_KEYS = (
    "cidade", "lei", "artigo", "tipoObra", "tipoImovel", "zona", "uso", "medidas", "altura", "area", "coeficiente", "taxa", "recuo", "documentos", "orgaosPublicos", "normas",
)

# Levels of confidence, the last one where none is given, and what is answered without evidence.
CONFIDENCE = ("ALTO", "MEDIO", "BAIXO")
NO_EVIDENCE = "Não há informação suficiente na Base de Conhecimento para responder a esta pergunta com segurança."
NO_EVIDENCE_NOTE = "Nenhum documento relevante foi recuperado. Verifique se a legislação necessária já foi indexada na Fase 1."
NO_CONTEXT, NO_SUMMARY = "(nenhum documento recuperado)", "(sem resumo)"

# Warnings of the checks.
WARN_EMPTY = "Nenhum documento foi recuperado — a resposta não deve ser exibida sem evidência."
WARN_UNRESOLVED = " artigo(s) citado(s) pela IA não corresponderam a nenhum documento recuperado: "
WARN_CONFLICT = "A resposta sinalizou divergência entre normas, mas não detalhou as versões — verifique manualmente."
WARN_UNCITED = "A resposta não cita nenhum artigo do contexto recuperado; nível de confiança deveria ser BAIXO."


def legal_status(folded: Column) -> Column:
    """From the folded notes and content: revoked wins over amended."""
    return F.when(folded.rlike("revogad"), "Possivelmente revogada").when(folded.rlike("nova redacao|redacao dada pel"), "Alterada (nova redação)").otherwise("Vigente")


def context_blocks(retrieved: DataFrame) -> DataFrame:
    """Adds law, summary, status and cross_reference to retrieved chunks (document_name, content, stage, enrichment: resumo, observacoes)."""
    notes = F.concat_ws(" ", F.coalesce("enrichment.observacoes", F.lit("")), "content")
    return retrieved.withColumns({
        "law": F.col("document_name"),
        "summary": F.coalesce(F.nullif("enrichment.resumo", F.lit("")), F.lit(NO_SUMMARY)),
        "status": legal_status(fold(notes)),
        "cross_reference": F.col("stage") == "REFERENCE",
    })


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\n{name}: "), F.coalesce(value, F.lit("—")))


def build_contexts(blocks: DataFrame) -> DataFrame:
    """(question_id, context): blocks numbered from 1, main ones before cross references, joined by a blank line.

    blocks (question_id, ord, law, chapter_label, section_label, article_label, status,
    document_created_at, summary, content, cross_reference); ord orders each of the two.
    """
    place = Window.partitionBy("question_id").orderBy("cross_reference", "ord")
    text = F.concat(
        F.lit("[Documento "), F.col("n"), F.lit("]"), F.when(F.col("cross_reference"), " (referência cruzada)").otherwise(""),
        _line("Lei", F.col("law")), _line("Capítulo", F.col("chapter_label")), _line("Seção", F.col("section_label")), _line("Artigo", F.col("article_label")), _line("Situação", F.col("status")),
        _line("Data de cadastro na base", F.date_format("document_created_at", "dd/MM/yyyy")), _line("Resumo", F.col("summary")), F.lit('\nTexto:\n"""\n'), F.col("content"), F.lit('\n"""'),
    )
    df = blocks.withColumn("n", F.row_number().over(place)).withColumn("text", text)
    listed = F.array_sort(F.collect_list(F.struct("n", "text")))
    return df.groupBy("question_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("context"))


def answer_prompts(questions: DataFrame, contexts: DataFrame, template: str) -> DataFrame:
    """(question_id, prompt, has_evidence): the template with the question (question_id, text), then its context put in, literally."""
    df = questions.join(contexts, "question_id", "left")
    context = F.coalesce(F.nullif("context", F.lit("")), F.lit(NO_CONTEXT))
    asked = F.replace(F.lit(template), F.lit("{{PERGUNTA}}"), F.col("text"))
    return df.select("question_id", F.replace(asked, F.lit("{{CONTEXTO}}"), context).alias("prompt"), F.col("context").isNotNull().alias("has_evidence"))


def generate_answers(prompts: DataFrame, client, model: str, prices: DataFrame) -> DataFrame:
    """(question_id, prompt, raw, model, tokens_in, tokens_out, duration_ms, cost_usd, answer) by an injected client.

    Without evidence no call is made: the answer says so, with low confidence and no cost.
    """
    made = with_cost(call_model(prompts.where("has_evidence"), "question_id", client, model), prices).withColumn("answer", parse_answer(F.col("raw")))
    return with_answers_without_evidence(made, prompts, model)


def with_answers_without_evidence(made: DataFrame, prompts: DataFrame, model: str) -> DataFrame:
    """Answers that were generated, and those of the prompts without evidence."""
    none = {"raw": F.lit(""), "model": F.lit(model), "tokens_in": F.lit(0).cast("long"), "tokens_out": F.lit(0).cast("long"), "duration_ms": F.lit(0).cast("long"), "cost_usd": F.lit(0.0)}
    empty = parse_answer(F.lit("{}")).withField("resumo_executivo", F.lit(NO_EVIDENCE)).withField("observacoes", F.lit(NO_EVIDENCE_NOTE))
    bare = prompts.where("not has_evidence").select("question_id", "prompt").withColumns(none).withColumn("answer", empty)
    return made.unionByName(bare.select(*made.columns))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column, name: str) -> Column:
    """The field if it is a string, else ''."""
    part = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(_kind(part) == "STRING", F.try_variant_get(v, f"$.{name}", "string")).otherwise("")


def _optional(v: Column, name: str) -> Column:
    """Null if the field is missing or null; else as `_text`."""
    part = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(part.isNotNull() & (_kind(part) != "VOID"), _text(v, name))


def _items(v: Column, name: str) -> Column:
    """The list's entries that are objects or lists themselves."""
    parts = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(parts, lambda x: x.isNotNull() & _kind(x).rlike("^(OBJECT|STRUCT|ARRAY)"))


def parse_answer(raw: Column) -> Column:
    """Tolerant reading of a model's answer: what has another type than it should is empty, an unknown confidence is the lowest, a conflict only a true one."""
    v = F.try_parse_json(raw)
    level = F.try_variant_get(v, "$.nivel_confianca", "string")
    cited = lambda x: F.struct(*(_text(x, n).alias(n) for n in ("lei",)), *(_optional(x, n).alias(n) for n in ("capitulo", "secao", "artigo")), _text(x, "trecho").alias("trecho"))
    crossed = lambda x: F.struct(_text(x, "lei").alias("lei"), _optional(x, "artigo").alias("artigo"), _text(x, "motivo").alias("motivo"))
    version = lambda x: F.struct(_text(x, "lei").alias("lei"), _optional(x, "artigo").alias("artigo"), _text(x, "valor").alias("valor"))
    conflict = lambda x: F.struct(_text(x, "tema").alias("tema"), F.transform(_items(x, "versoes"), version).alias("versoes"))
    flag = F.try_variant_get(v, "$.has_conflict", "variant")
    return F.struct(
        _text(v, "resumo_executivo").alias("resumo_executivo"),
        _text(v, "fundamentacao").alias("fundamentacao"),
        F.transform(_items(v, "artigos_utilizados"), cited).alias("artigos_utilizados"),
        F.transform(_items(v, "referencias_cruzadas"), crossed).alias("referencias_cruzadas"),
        _text(v, "observacoes").alias("observacoes"),
        F.when(level.isin(*CONFIDENCE), level).otherwise(CONFIDENCE[-1]).alias("nivel_confianca"),
        ((_kind(flag) == "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$.has_conflict", "boolean"), F.lit(False))).alias("has_conflict"),
        F.transform(_items(v, "conflict_details"), conflict).alias("conflict_details"),
    )


def parse_category(raw: Column, closed: tuple[str, ...] = CATEGORIES, other: str = CATEGORIES[-1]) -> Column:
    """Tolerant reading of {"categoria", "confianca"}: an unknown category is the other one; a confidence that is a number is clamped to 0..1, else 0."""
    v = F.try_parse_json(raw)
    name = _text(v, "categoria")
    part = F.try_variant_get(v, "$.confianca", "variant")
    number = F.when(_kind(part).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(v, "$.confianca", "double"))
    return F.struct(F.when(name.isin(*closed), name).otherwise(other).alias("category"), F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(0.0).alias("confidence"))


def parse_entities(raw: Column, keys: tuple[str, ...] = ENTITY_KEYS) -> Column:
    """A struct with the strings of each key; what is no list, or no string in one, is left out, and so are other keys."""

    def strings(v, key):
        parts = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
        own = F.filter(parts, lambda x: _kind(x) == "STRING")
        return F.transform(own, lambda x: F.try_variant_get(x, "$", "string"))

    # The text is parsed once: as an argument it is not put in the place of each of its uses.
    return F.get(F.transform(F.array(F.try_parse_json(raw)), lambda v: F.struct(*(strings(v, k).alias(k) for k in keys))), F.lit(0))


def entity_terms(entities: Column, keys: tuple[str, ...] = ENTITY_KEYS) -> Column:
    """The terms of all keys in key order, without blank ones."""
    return F.filter(F.concat(*(entities[k] for k in keys)), lambda t: F.trim(t) != "")


def reconcile(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Adds chunk_id: the first chunk (question_id, ord, chunk_id, law, article; folded) that a citation (question_id, cite, law, article) fits.

    Law names must contain one another, and article labels too where both are given; null where no chunk fits.
    """
    c, r = cited.alias("c"), retrieved.alias("r")
    either = lambda a, b: F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a))
    law = either("c.law", "r.law")
    article = F.col("c.article").isNull() | F.col("r.article").isNull() | (F.col("c.article") == "") | (F.col("r.article") == "") | either("c.article", "r.article")
    fits = c.join(r, (F.col("c.question_id") == F.col("r.question_id")) & law & article)
    first = fits.groupBy(F.col("c.question_id").alias("question_id"), F.col("c.cite").alias("cite")).agg(F.min_by("r.chunk_id", "r.ord").alias("chunk_id"))
    return cited.join(first, ["question_id", "cite"], "left")


def validate(answers: DataFrame, reconciled: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(question_id, valid, insufficient, warnings: array) of answers (question_id, confidence, has_conflict, n_conflicts).

    reconciled (question_id, cite, chunk_id, shown: law and article as cited) tells which citations found a chunk.
    """
    lost = F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNull(), F.struct("cite", F.trim("shown").alias("shown")))))
    cites = reconciled.groupBy("question_id").agg(F.count("*").alias("n_cited"), F.transform(lost, lambda x: x["shown"]).alias("lost"))
    found = retrieved.groupBy("question_id").agg(F.count("*").alias("n_chunks"))
    df = answers.join(cites, "question_id", "left").join(found, "question_id", "left").na.fill(0, ["n_cited", "n_chunks"])
    none, uncited, n_lost = F.col("n_chunks") == 0, F.col("n_cited") == 0, F.coalesce(F.size("lost"), F.lit(0))
    warnings = F.array_compact(F.array(
        F.when(none, WARN_EMPTY),
        F.when(~none & (n_lost > 0), F.concat(n_lost, F.lit(WARN_UNRESOLVED), F.array_join("lost", ", "))),
        F.when(~none & F.col("has_conflict") & (F.col("n_conflicts") == 0), WARN_CONFLICT),
        F.when(~none & uncited & (F.col("confidence") != "BAIXO"), WARN_UNCITED),
    ))
    return df.select("question_id", (F.size(warnings) == 0).alias("valid"), (none | uncited).alias("insufficient"), warnings.alias("warnings"))


def evidences(retrieved: DataFrame) -> DataFrame:
    """(question_id, ord, chunk_id, lei, artigo, capitulo, secao, score_similaridade, motivo_recuperacao) of each question's chunks."""
    return retrieved.select(
        "question_id", "ord", "chunk_id", F.col("document_name").alias("lei"), F.col("article_label").alias("artigo"), F.col("chapter_label").alias("capitulo"), F.col("section_label").alias("secao"),
        F.col("distance").alias("score_similaridade"), F.col("reason").alias("motivo_recuperacao"),
    )


# The stages of a retrieval, in the order in which they are run.
STAGES = ("VECTOR", "METADATA", "REFERENCE", "RERANK")


def traces(questions: DataFrame, log: DataFrame, generated: DataFrame) -> DataFrame:
    """How each answer came about: the question's row, an ordered array of chunks for each stage, and the model's data.

    log (question_id, stage, rank, chunk_id, score, reason); generated (question_id, prompt, raw, model, ...).
    """
    listed = lambda stage: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("stage") == stage, F.struct("rank", "chunk_id", "score", "reason")))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"), x["reason"].alias("reason"))
    )
    staged = log.groupBy("question_id").agg(*(listed(s).alias(f"{s.lower()}_stage") for s in STAGES))
    none = lambda c: F.array().cast(staged.schema[c].dataType)
    df = questions.join(staged, "question_id", "left").join(generated, "question_id", "left")
    return df.withColumns({f"{s.lower()}_stage": F.coalesce(f"{s.lower()}_stage", none(f"{s.lower()}_stage")) for s in STAGES})


def rerank_prompts(candidates: DataFrame, excerpt: int = 500) -> DataFrame:
    """(question_id, prompt): candidates (question_id, rank, document, article, text) as numbered excerpts, in order of rank."""
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("rank")) - 1
    line = F.concat(F.lit("["), n, F.lit("] Lei: "), "document", F.lit(" | Artigo: "), F.coalesce("article", F.lit("—")), F.lit(" | Trecho: "), truncate(F.col("text"), excerpt))
    listed = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return candidates.withColumn("line", line).groupBy("question_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("prompt"))
