"""Conversations, logs, favourites, corpus views, viewers and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions.text import fold
from lexmill.operators.answers import legal_status
from lexmill.operators.search import contained
from lexmill.sources.staged import staged


def question_index(turns: DataFrame) -> DataFrame:
    """User turns (conv_id, turn, role, text) with their number within the conversation, from 0."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return turns.where("role = 'user'").select("conv_id", "turn", "text", (F.row_number().over(order) - 1).alias("question_idx"))


def conversation_list(turns: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(conv_id, title, n_questions, last_turn): a given title (conv_id, title) that is not null, else the first 80 characters of the first question."""
    users = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.count("*").alias("n_questions"))
    every = turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    title = F.coalesce(F.substring("first", 1, 80), F.lit("Conversa"))
    if titles is not None:
        given = titles.where("title is not null").groupBy("conv_id").agg(F.min("title").alias("given"))
        every = every.join(given, "conv_id", "left")
        title = F.coalesce("given", title)
    return every.join(users, "conv_id", "left").select("conv_id", title.alias("title"), F.coalesce("n_questions", F.lit(0)).alias("n_questions"), "last_turn")


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, question_idx, question, answer): each question with the assistant turn right after it."""
    nxt = Window.partitionBy("conv_id").orderBy("turn")
    df = turns.withColumns({"next_role": F.lead("role").over(nxt), "next_text": F.lead("text").over(nxt)}).where("role = 'user'")
    idx = F.row_number().over(nxt) - 1
    return df.select("conv_id", idx.alias("question_idx"), F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert where the last write wins."""
    by = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def dashboard(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Documents (document_id, ...) with the number of rows of each child table, counted before they are joined."""
    out = documents
    for name, child in children.items():
        out = out.join(child.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left").na.fill(0, [name])
    return out


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lower(F.trim("query")).alias("q")).where("q <> ''")


def _first(found: DataFrame, order: list[str], limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def search_documents(queries: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, document_id, rank): documents (document_id, name) whose name holds the query, in any case but with its accents."""
    q = _asked(queries)
    hits = contained(q, documents.select("document_id", F.lower("name").alias("low")), "q", "low", ["document_id"])
    return _first(hits.join(q, "q").select("query_id", "document_id").distinct(), ["document_id"], limit)


def search_articles(queries: DataFrame, articles: DataFrame, documents: DataFrame, limit: int = 30) -> DataFrame:
    """(query_id, document_id, article_index, rank, label, excerpt): articles whose label, number, full text or document name holds the query.

    articles (document_id, article_index, label, number, caput, full_text), documents
    (document_id, name). Each text is read once for all queries; one that holds several
    comes out once for each. The articles are written once, as three branches read them.
    """
    q = _asked(queries)
    articles = staged(articles.select("document_id", "article_index", "label", F.substring("caput", 1, 240).alias("excerpt"), F.lower(F.concat_ws("\n", "label", "number", "full_text")).alias("low")))
    own = articles.select("document_id", "article_index", "low")
    direct = contained(q, own, "q", "low", ["document_id", "article_index"]).join(q, "q").select("query_id", "document_id", "article_index")
    named = search_documents(queries, documents, 1 << 30).select("query_id", "document_id").join(articles.select("document_id", "article_index"), "document_id")
    hits = _first(direct.unionByName(named.select(*direct.columns)).distinct(), ["document_id", "article_index"], limit)
    shown = articles.select("document_id", "article_index", "label", "excerpt")
    return hits.join(shown, ["document_id", "article_index"])


def manual_search(queries: DataFrame, documents: DataFrame, limit: int = 30) -> DataFrame:
    """(query_id, document_id, rank, excerpt): documents whose text holds the query, in any case but with its accents."""
    q = _asked(queries)
    own = documents.select("document_id", F.substring("text", 1, 240).alias("excerpt"), F.lower("text").alias("low"))
    hits = contained(q, own, "q", "low", ["document_id", "excerpt"]).join(q, "q").select("query_id", "document_id", "excerpt")
    return _first(hits.distinct(), ["document_id"], limit)


def retrieval_log(stages: dict[str, DataFrame], scored_stage: str) -> DataFrame:
    """All stages as one log (question_id, stage, rank from 0, chunk_id, score, reason): the rerank score in its stage, else the distance."""
    out = None
    for stage, df in stages.items():
        rank = F.row_number().over(Window.partitionBy("question_id").orderBy("ord")) - 1
        part = df.select("question_id", F.lit(stage).alias("stage"), rank.alias("rank"), "chunk_id", F.col("rerank_score" if stage == scored_stage else "distance").alias("score"), "reason")
        out = part if out is None else out.unionByName(part)
    return out


def question_retrievals(log: DataFrame, chunks: DataFrame, articles: DataFrame, documents: DataFrame) -> DataFrame:
    """The log with chunk, article and document of every row; stages in alphabetical order, then ranks."""
    joined = log.join(chunks, "chunk_id").join(documents, "document_id").join(articles, "article_id", "left")
    return joined.sortWithinPartitions("question_id", "stage", "rank")


def prompt_log(exchanges: DataFrame) -> DataFrame:
    """(question_id, stage, ord, prompt, raw, model): one row a stage of exchanges with classification, entity, rerank and generation columns.

    A question whose rerank was not asked for has no such row.
    """
    stages = (("CLASSIFICATION", "classification", "classification_model"), ("ENTITY_EXTRACTION", "entity", "entity_model"), ("RERANK", "rerank", "model"), ("GENERATION", "generation", "model"))
    rows = [F.struct(F.lit(name).alias("stage"), F.lit(k).alias("ord"), F.col(f"{c}_prompt").alias("prompt"), F.col(f"{c}_raw").alias("raw"), F.col(m).alias("model")) for k, (name, c, m) in enumerate(stages)]
    every = exchanges.select("question_id", F.explode(F.array(*rows)).alias("r")).select("question_id", "r.*")
    return every.where("stage <> 'RERANK' or coalesce(prompt, '') <> ''")


def feedback_counts(ratings: DataFrame) -> DataFrame:
    """(answer_id, up, down); other ratings are not feedback."""
    return ratings.groupBy("answer_id").agg(F.count_if(F.col("rating") == "UP").alias("up"), F.count_if(F.col("rating") == "DOWN").alias("down"))


def answers_with_feedback(ratings: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Each answer (answer_id, question_id, ...) with its question and its counts of feedback, 0 without any."""
    counts = feedback_counts(ratings.where(F.col("rating").isin("UP", "DOWN")))
    return answers.join(questions, "question_id").join(counts, "answer_id", "left").na.fill(0, ["up", "down"])


def favourites(marks: DataFrame, removed: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """The last mark of each (type, ref_id) of marks (type, ref_id, at, title, note) without removed ones (type, ref_id), of one type or all, newest first within a type."""
    kept = latest_by_key(marks, ["type", "ref_id"], ["at"])
    if removed is not None:
        kept = kept.join(removed.select("type", "ref_id").distinct(), ["type", "ref_id"], "left_anti")
    if kind is not None:
        kept = kept.where(F.col("type") == kind)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("at"), "ref_id")))


#: What the detail of a document counts.
DETAIL = ("tokens", "chapters", "articles", "chunks", "embeddings", "figures", "indexed")


def document_detail(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Documents with the counters of `DETAIL`; a table that is not given counts 0."""
    out = dashboard(documents, {n: children[n] for n in DETAIL if n in children})
    return out.select(*documents.columns, *(F.col(n) if n in children else F.lit(0).cast("long").alias(n) for n in DETAIL))


def amendments(chunks: DataFrame) -> DataFrame:
    """Amended chunks (law, chunk_id, article, notes, content) with their kind and snippet, and whether the law has revoked pieces.

    The snippet is the note, else the first 240 characters.
    """
    folded = fold(F.concat_ws(" ", F.coalesce("notes", F.lit("")), "content"))
    df = chunks.withColumn("folded", folded)
    kind = F.when(F.col("folded").rlike("revogad"), "REVOGACAO").when(F.col("folded").rlike("nova redacao|redacao dada pel"), "NOVA_REDACAO")
    found = df.withColumn("kind", kind).where("kind is not null")
    revoked = F.max(F.col("kind") == "REVOGACAO").over(Window.partitionBy("law"))
    snippet = F.coalesce(F.nullif("notes", F.lit("")), F.substring("content", 1, 240))
    return found.select("law", "chunk_id", "article", "kind", snippet.alias("snippet"), revoked.alias("has_revoked"))


# The status of a law with and without revoked pieces.
LAW_STATUS = ("Contém dispositivos possivelmente revogados", "Vigente")


def law_status(timeline: DataFrame, laws: DataFrame) -> DataFrame:
    """(law, status) of every law, from its amendments."""
    revoked = timeline.groupBy("law").agg(F.max("has_revoked").alias("r"))
    return laws.select("law").distinct().join(revoked, "law", "left").select("law", F.when(F.coalesce("r", F.lit(False)), LAW_STATUS[0]).otherwise(LAW_STATUS[1]).alias("status"))


def law_navigation(tree: DataFrame) -> DataFrame:
    """(doc_id, ord, level, label, title, articles): the entries of a law's table of contents, each with the labels of its own articles in order.

    First the articles outside every chapter and section, then chapters and sections in the
    order of the text. From `lexer.nodes`, by one aggregate over each document's tree.
    """
    group = F.when(F.col("type") == "ARTIGO", F.when(F.col("parent_type") == "DOCUMENT", -1).otherwise(F.col("parent_idx"))).otherwise(F.col("idx"))
    own = F.first(F.when(F.col("type") != "ARTIGO", F.struct("type", "label", "title")), ignorenulls=True)
    arts = F.array_sort(F.collect_list(F.when(F.col("type") == "ARTIGO", F.struct("idx", "label"))))
    rows = tree.where(F.col("type").isin("CAPITULO", "SECAO", "SUBSECAO", "ARTIGO")).groupBy("doc_id", group.alias("ord")).agg(own.alias("own"), arts.alias("a"))
    return rows.select("doc_id", "ord", F.coalesce("own.type", F.lit("DOCUMENT")).alias("level"), F.coalesce("own.label", F.lit("")).alias("label"), F.coalesce("own.title", F.lit("")).alias("title"), F.transform("a", lambda x: x["label"]).alias("articles"))


def article_viewer(tree: DataFrame, chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Each article of a tree of `lexer` with its headings, full text, nested parts and what `with_chunks_and_figures` adds."""
    from lexmill.operators import lexer

    return with_chunks_and_figures(lexer.articles_with_parts(tree), chunks, figures)


def with_chunks_and_figures(articles: DataFrame, chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Articles (doc_id, idx, ...) with chunk ids by part, figures by page, and status and enrichment of their first chunk.

    chunks (doc_id, article_idx, chunk_id, part, content, enrichment with observacoes), figures (doc_id, article_idx, page,
    figure_index, figure_id). A chunk is judged where it lies, so its content does not travel; all columns of the articles do.
    """
    status = legal_status(fold(F.concat_ws(" ", F.coalesce("enrichment.observacoes", F.lit("")), "content")))
    judged = chunks.select("doc_id", F.col("article_idx").alias("idx"), "part", "chunk_id", "enrichment", status.alias("status"))
    pieces = judged.groupBy("doc_id", "idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"), F.min_by(F.struct("status", "enrichment"), F.struct("part", "chunk_id")).alias("first")
    )
    shown = figures.groupBy("doc_id", F.col("article_idx").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "figure_index", "figure_id"))), lambda x: x["figure_id"]).alias("figure_ids"))
    ids = lambda c: F.coalesce(c, F.array().cast("array<bigint>")).alias(c)
    df = articles.join(pieces, ["doc_id", "idx"], "left").join(shown, ["doc_id", "idx"], "left")
    return df.select(*articles.columns, ids("chunk_ids"), ids("figure_ids"), F.coalesce("first.status", F.lit("Vigente")).alias("status"), F.col("first.enrichment").alias("enrichment"))


def jobs(rows: DataFrame) -> DataFrame:
    """Jobs (document_id, step, status, started_at, finished_at) with their seconds, null while one of the times is, in time order within the document."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    order = Window.partitionBy("document_id").orderBy("started_at", "step")
    return rows.withColumns({"seconds": F.round(seconds("finished_at") - seconds("started_at"), 3), "place": F.row_number().over(order)})


def job_counts(rows: DataFrame) -> DataFrame:
    """(step, status, n)."""
    return rows.groupBy("step", "status").agg(F.count("*").alias("n"))


def embedding_list(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings without their vectors, with index and article of their chunk (chunk_id, chunk_index, origin_article)."""
    return embeddings.drop("vector").join(chunks.select("chunk_id", "chunk_index", "origin_article"), "chunk_id", "left")


def figure_list(figures: DataFrame, articles: DataFrame, page: int | None = None) -> DataFrame:
    """Figures with the label of their article (article_id, label), of one page or all, by page and index."""
    own = figures if page is None else figures.where(F.col("page") == page)
    return own.join(articles.select("article_id", F.col("label").alias("article_label")), "article_id", "left").sortWithinPartitions("document_id", "page", "figure_index")
