"""Retrieval for many questions at once: vector top-k, metadata re-rank, cross references and their chunks, rerank."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.config import Patterns, Retrieval
from lexmill.functions.text import fold
from lexmill.sources.staged import staged

#: Questions in a block, and floats of vectors in a block (4 MB): what a task compares at a time.
QUESTION_BLOCK, VECTOR_FLOATS = 512, 1 << 20
#: Questions of a block whose distances are held together: a few MB for each of their copies.
QUESTIONS_AT_ONCE = 32
#: Characters of all texts looked for that every task may get at once: an automaton of some 100 MB.
BROADCAST_CHARS = 1 << 20
#: Chunks of one document in a block.
BLOCK_CHUNKS = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def _blocks(df: DataFrame, key: str, n: int, *columns: str) -> DataFrame:
    """Rows dealt by hash into n blocks: (block, one array for each column)."""
    dealt = df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return dealt.select("block", *(F.col(f"rows.{c}").alias(c) for c in columns))


def _block_top_k(k: int, per_document: bool):
    """The k best of a block of vectors for each question of a block, of all or of each document."""
    names = ["question_id", "chunk_id", "document_id", "distance"]

    def best(distance, rows, ids, chunk, document):
        # Everything nearer than the k-th, and of those as near as it the smaller chunks.
        rounded = np.round(distance[:, rows], 9)
        n = min(k, len(rows))
        worst = np.partition(rounded, n - 1, axis=1)[:, n - 1 : n]
        q, v = np.nonzero(rounded <= worst)
        order = np.lexsort((chunk[rows[v]], rounded[q, v], q))
        q, v = q[order], v[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, v = q[keep], rows[v[keep]]
        finite = np.isfinite(distance[q, v])
        q, v = q[finite], v[finite]
        return ids[q], chunk[v], document[v], distance[q, v]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vector, excluded, chunk, document, vectors = (batch.column(c)[row].values for c in range(6))
                q = _unit(vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
                x = _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(chunk), -1))
                ids, chunk, document = (c.to_numpy(zero_copy_only=False) for c in (ids, chunk, document))
                groups = [np.flatnonzero(document == d) for d in np.unique(document)] if per_document else [np.arange(len(chunk))]
                for at in range(0, len(ids), QUESTIONS_AT_ONCE):
                    some = slice(at, at + QUESTIONS_AT_ONCE)
                    distance = np.maximum(0.0, 1.0 - q[some] @ x.T)
                    for n, out in enumerate(excluded[some].to_pylist()):
                        if out:
                            distance[n, np.isin(document, out)] = np.inf
                    for own in groups:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best(distance, own, ids[some], chunk, document)], names=names)

    return run


def vector_top_k(questions: DataFrame, vectors: DataFrame, k: int, per_document: bool = False) -> DataFrame:
    """(question_id, chunk_id, document_id, distance, rank): the k nearest by cosine distance, of all or of each document.

    questions (question_id, vector, and excluded: array of document ids, if some may not
    answer) are a stated set; vectors (chunk_id, document_id, vector). Both are dealt into
    blocks on Spark, the question blocks travel to every block of vectors, and a meeting of
    two is one matrix product that hands on k rows a question. Nothing passes the driver
    but two counts. Ties go to the smaller chunk_id; an empty vector gets no rows.
    """
    usable = questions.where("vector is not null and size(vector) > 0")
    if "excluded" not in usable.columns:
        usable = usable.withColumn("excluded", F.array().cast("array<bigint>"))
    known = vectors.where("vector is not null").select("chunk_id", F.col("document_id").cast("long").alias("document_id"), "vector")
    size = known.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    n_vectors = max(1, -(-(size["n"] * (size["d"] or 1)) // VECTOR_FLOATS))
    n_questions = max(1, -(-usable.count() // QUESTION_BLOCK))
    left = _blocks(usable, "question_id", n_questions, "question_id", "vector", "excluded").select(F.explode(F.sequence(F.lit(0), F.lit(n_vectors - 1))).alias("block"), "question_id", F.col("vector").alias("q"), "excluded")
    right = _blocks(known, "chunk_id", n_vectors, "chunk_id", "document_id", "vector")
    met = left.join(right, "block").select("question_id", "q", "excluded", "chunk_id", "document_id", "vector")
    found = met.mapInArrow(_block_top_k(k, per_document), "question_id long, chunk_id long, document_id long, distance double")
    by = ["question_id", "document_id"] if per_document else ["question_id"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("distance", 9), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# What is said of how a chunk was found.
VECTOR_REASON = "Similaridade vetorial (distância cosseno = %.4f)"
METADATA_REASON, CATEGORY_PART, TERMS_PART = "Metadados combinam com a consulta (", 'categoria "', "termos: "
REFERENCE_REASON = 'Referência cruzada — citada em "'
RERANK_REASON, RERANK_OFF = "Reranking: relevância %.1f/10 para a pergunta", " (reranking desativado — ordem anterior mantida)"


def vector_reason(distance: Column) -> Column:
    return F.format_string(VECTOR_REASON, distance)


def with_attributes(found: DataFrame, chunks: DataFrame, documents: DataFrame, articles: DataFrame) -> DataFrame:
    """Retrieved rows (question_id, chunk_id, document_id, distance, rank) with what is said of their chunk, document and article, stage and reason.

    chunks (chunk_id, content, article_id, chapter_label, section_label, enrichment),
    documents (document_id, document_name, document_created_at), articles (article_id, article_label).
    """
    df = found.join(chunks.drop("document_id"), "chunk_id").join(documents, "document_id").join(articles.select("article_id", "article_label"), "article_id", "left")
    return df.withColumns({"stage": F.lit("VECTOR"), "reason": vector_reason(F.col("distance")), "rerank_score": F.lit(None).cast("double")})


def vector_search(questions: DataFrame, embeddings: DataFrame, chunks: DataFrame, documents: DataFrame, articles: DataFrame, k: int = Retrieval().vector_k) -> DataFrame:
    """The k nearest indexed chunks of each question, with attributes; a question's excluded documents take no part.

    The attributes are joined to k rows a question, after the search.
    """
    indexed = embeddings.where("indexed and vector is not null")
    return with_attributes(vector_top_k(questions, indexed, k), chunks, documents, articles)


def haystack(document: Column, article: Column, chapter: Column, section: Column, enrichment: Column) -> Column:
    """What a chunk says of itself, joined by " | " and folded; enrichment has tema, subtema, categoria, palavras_chave, assuntos."""
    listed = lambda c: F.coalesce(F.array_join(enrichment[c], " "), F.lit(""))
    parts = [document, article, chapter, section, enrichment["tema"], enrichment["subtema"], enrichment["categoria"], listed("palavras_chave"), listed("assuntos")]
    return fold(F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts)))


def metadata_rerank(candidates: DataFrame, k: int = Retrieval().metadata_k) -> DataFrame:
    """Re-rank candidates (question_id, rank, distance, haystack, terms, category; texts folded) by matches in the haystack.

    Terms of three characters and more count each time they are listed; the category counts
    once. Order: matches, distance (null as 1), prior rank; the first k stay. With a column
    reason, it says what matched (category_name is the category as written).
    """
    hay = F.col("haystack")
    matched = F.filter("terms", lambda t: (F.length(t) >= 3) & F.contains(hay, t))
    df = candidates.withColumns({"matched": matched, "category_match": F.contains(hay, F.col("category"))})
    df = df.withColumn("matches", F.size("matched") + F.col("category_match").cast("int"))
    if "reason" in df.columns:
        said = F.concat_ws(
            "; ",
            F.when(F.col("category_match"), F.concat(F.lit(CATEGORY_PART), "category_name", F.lit('"'))),
            F.when(F.size("matched") > 0, F.concat(F.lit(TERMS_PART), F.array_join("matched", ", "))),
        )
        df = df.withColumns({"stage": F.lit("METADATA"), "reason": F.when(F.col("matches") > 0, F.concat(F.lit(METADATA_REASON), said, F.lit(")"))).otherwise(F.col("reason"))})
    order = Window.partitionBy("question_id").orderBy(F.desc("matches"), F.coalesce("distance", F.lit(1.0)), "rank")
    return df.drop("category_match").withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def reference_candidates(listed: Column, content: Column, p: Patterns = Patterns()) -> Column:
    """References a chunk names: those listed, then citations in its content, once each in first-seen order."""
    own = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r != "")
    cited = F.transform(F.regexp_extract_all(content, F.lit("(?iu)" + p.citation), 1), lambda r: F.trim(r))
    return F.array_distinct(F.concat(own, cited))


def _numbers(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(\d[\d.]*\d|\d+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda n: F.replace(n, F.lit("."), F.lit(""))), lambda n: F.length(n) >= 4))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4)


def _with_grams(df: DataFrame, text: str, n: int) -> DataFrame:
    """A row for each distinct gram of n characters of a text; all other columns go along."""
    # The characters are a column of their own: an index into a string counts from its start, one into an array does not.
    spelled = df.withColumn("__c", F.split(text, ""))
    gram = F.transform("__c", lambda c, i: F.concat(c, *(F.get("__c", i + k) for k in range(1, n))))
    return spelled.withColumn("gram", F.explode(F.array_distinct(F.filter(gram, lambda g: g.isNotNull() & (F.length(g) == n))))).drop("__c")


def _held_patterns(patterns: list[str], keys: int, schema: str):
    """The distinct patterns that each text of a batch holds, with its keys, by one automaton for all of them."""

    def run(batches):
        automaton = ahocorasick.Automaton()
        for k, pattern in enumerate(patterns):
            automaton.add_word(pattern, k)
        automaton.make_automaton()
        known = pa.array(patterns, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                held = [{k for _, k in automaton.iter(t)} for t in part.column(keys).to_pylist()]
                if any(held):
                    rows = pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]))
                    inner = known.take(pa.array([k for h in held for k in sorted(h)], pa.int64()))
                    yield pa.RecordBatch.from_arrays([inner, *(part.column(c).take(rows) for c in range(keys))], names=schema)

    return run


def contained(shorter: DataFrame, longer: DataFrame, inner: str, outer: str, keys: list[str] | None = None, size: int = 4, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Distinct (inner, keys) where the outer text of the row with those keys holds the inner one (both not empty).

    keys name the rows of `longer`; without them the outer text names itself. While the inner
    texts have no more than `broadcast_chars` characters together (they are counted first),
    every task gets all of them as one automaton, so that each outer text is read once, where
    it lies, and gives a row for each inner text it holds. More of them are joined by their
    rarest grams.
    """
    keys = keys or [outer]
    inside = staged(shorter.select(F.col(inner).alias("inner")).where("inner <> ''").distinct())
    total = inside.agg(F.coalesce(F.sum(F.length("inner") + 1), F.lit(0))).first()[0]
    if total > broadcast_chars:
        return _contained_by_grams(inside, longer, inner, outer, keys, size)
    patterns = [r[0] for r in inside.collect()]
    texts = longer.select(*(F.col(c).alias(f"k{k}") for k, c in enumerate(keys)), F.col(outer).alias("text")).where("text <> ''")
    names = ["inner", *(f"k{k}" for k in range(len(keys)))]
    schema = ", ".join(["inner string", *(f"k{k} {texts.schema[f'k{k}'].dataType.simpleString()}" for k in range(len(keys)))])
    if not patterns:
        found = texts.select(F.lit("").alias("inner"), *names[1:]).limit(0)
    else:
        found = texts.mapInArrow(_held_patterns(patterns, len(keys), names), schema)
    return found.select(F.col("inner").alias(inner), *(F.col(f"k{k}").alias(c) for k, c in enumerate(keys))).distinct()


def _contained_by_grams(inside: DataFrame, longer: DataFrame, inner: str, outer: str, keys: list[str], size: int) -> DataFrame:
    """`contained` for inner texts without bound: each is looked for by the one of its grams that fewest of them have.

    A start that most of them share is thus never the key of the join. Texts give keys and
    grams to it; the rows that hold the gram meet their texts again and are compared.
    """
    b = longer.select(*dict.fromkeys([*keys, outer])).where(F.col(outer) != "")
    if keys == [outer]:
        b = b.distinct()
    found = None
    # Texts shorter than a gram are grams themselves; at most `size` numbers come to the driver.
    for n in sorted(r[0] for r in inside.select(F.least(F.length("inner"), F.lit(size))).distinct().collect()):
        own = _with_grams(inside.where(F.length("inner") >= size if n == size else F.length("inner") == n), "inner", n)
        rare = own.groupBy("gram").agg(F.count("*").alias("holders"))
        key = staged(own.join(rare, "gram").groupBy("inner").agg(F.min_by("gram", F.struct("holders", "gram")).alias("gram")))
        met = _with_grams(b, outer, n).select(*keys, "gram").join(key, "gram").select("inner", *keys)
        found = met if found is None else found.unionByName(met)
    if keys != [outer]:
        found = found.distinct().join(b, keys)
    return found.where(F.contains(outer, F.col("inner"))).select(F.col("inner").alias(inner), *keys).distinct()


def match_references(references: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (reference, document_id) of references and document names (folded texts `ref`, `name`) that match.

    They match if one contains the other, if they share a number of four digits or more
    (dots left out), or if at least 40 % of the name's words of four letters and more occur
    in the reference. The first is a scan, the others are equi-joins on
    rare keys: numbers, and as many of the name's rarest words as must hold one of the
    shared ones, after which the whole lists are compared. Both sides are written once, as
    every branch reads them.
    """
    refs = staged(references.select("ref").where("ref <> ''").distinct())
    docs = staged(names.select("document_id", "name").where("name <> ''").distinct())
    texts = docs.select("name").distinct()
    rn = refs.select("ref", F.explode(_numbers(F.col("ref"))).alias("n"))
    by_number = rn.join(texts.select("name", F.explode(_numbers(F.col("name"))).alias("n")), "n").select("ref", "name")

    rw = refs.select("ref", F.explode(F.array_distinct(_words(F.col("ref")))).alias("w"))
    held = rw.groupBy("w").agg(F.count("*").alias("held"))
    dw = texts.select("name", F.posexplode(_words(F.col("name"))).alias("p", "w")).join(held, "w", "left")
    total = F.count("*").over(Window.partitionBy("name"))
    rare = F.row_number().over(Window.partitionBy("name").orderBy(F.coalesce("held", F.lit(0)), "w", "p"))
    # Of t words at least ceil(0.4 t) must be shared, so one of any t - ceil(0.4 t) + 1 is.
    keys = dw.withColumns({"total": total, "rare": rare}).where(F.col("rare") <= F.col("total") - F.ceil(F.col("total") * 4 / 10 - 1e-9) + 1)
    pairs = keys.where("held is not null").select("name", "w").distinct().join(rw, "w").select("ref", "name").distinct()
    mine, theirs = _words(F.col("name")), F.array_distinct(_words(F.col("ref")))
    by_word = pairs.where(F.size(F.filter(mine, lambda w: F.array_contains(theirs, w))) * 10 >= F.size(mine) * 4)

    inside = contained(texts, refs, "name", "ref").select("ref", "name").unionByName(contained(refs, texts, "ref", "name").select("ref", "name"))
    return by_number.unionByName(by_word).unionByName(inside).distinct().join(docs, "name").select("ref", "document_id").distinct()


def cross_references(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, reference, document_id, document_name, ord, pos, origin_document, origin_article): documents that the candidates name but do not hold.

    candidates (question_id, ord, document_id, document_name, article_label, refs: array),
    documents (document_id, document_name). Documents of the candidate set are left out; of
    a document and reference the first stays, in the order of chunk and candidate.
    """
    candidates = staged(candidates)
    named = staged(candidates.select("question_id", "ord", "document_name", "article_label", F.posexplode("refs").alias("pos", "reference")).withColumn("ref", fold("reference")))
    folded = documents.select("document_id", fold("document_name").alias("name"))
    pairs = match_references(named.select("ref"), folded)
    origin = F.struct("ord", "pos", F.col("document_name").alias("origin_document"), F.col("article_label").alias("origin_article"))
    met = named.join(pairs, "ref").groupBy("question_id", "document_id", "reference").agg(F.min(origin).alias("o"))
    absent = met.join(candidates.select("question_id", "document_id").distinct(), ["question_id", "document_id"], "left_anti")
    return absent.join(documents, "document_id").select("question_id", "reference", "document_id", "document_name", "o.*")


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


def _nearest_in_block(n: int):
    """The n nearest of a block of vectors for the question in its row."""

    def run(batches):
        for batch in batches:
            for question, document, q, chunk, vectors in zip(*(batch.column(c) for c in range(5)), strict=True):
                ids = chunk.values.to_numpy(zero_copy_only=False)
                x = _unit(vectors.values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
                distance = np.maximum(0.0, 1.0 - x @ _unit(q.values.to_numpy(zero_copy_only=False).astype(np.float64)))
                order = np.lexsort((ids, np.round(distance, 9)))[:n]
                yield pa.RecordBatch.from_arrays([pa.array([c.as_py()] * len(order), pa.int64()) for c in (question, document)] + [pa.array(ids[order]), pa.array(distance[order])], names=["question_id", "document_id", "chunk_id", "distance"])

    return run


def cross_reference_chunks(matches: DataFrame, questions: DataFrame, vectors: DataFrame, n: int = Retrieval().per_document) -> DataFrame:
    """(question_id, document_id, chunk_id, distance, rank, reason): the n nearest chunks of each document that a question's candidates name.

    Only the documents named are searched, by an equi-join on them: a document's vectors are
    dealt into blocks of some thousand, and a meeting of a question and a block is one
    product that hands on n rows. The reason is the document's first match; rank runs over
    the question, documents in the order of theirs.
    """
    first = matches.groupBy("question_id", "document_id").agg(F.min(F.struct("ord", "pos", "document_id", "reference", "origin_document", "origin_article")).alias("m"))
    asked = first.join(questions.where("vector is not null and size(vector) > 0").select("question_id", F.col("vector").alias("q")), "question_id")
    known = vectors.where("vector is not null").select("document_id", "chunk_id", "vector").join(first.select("document_id").distinct(), "document_id", "left_semi")
    sized = known.join(known.groupBy("document_id").agg(F.count("*").alias("size")), "document_id")
    salt = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("size") / BLOCK_CHUNKS))
    blocks = sized.groupBy("document_id", salt.alias("salt")).agg(F.collect_list(F.struct("chunk_id", "vector")).alias("rows"))
    met = asked.select("question_id", "document_id", "q").join(blocks, "document_id").select("question_id", "document_id", "q", "rows.chunk_id", "rows.vector")
    near = met.mapInArrow(_nearest_in_block(n), "question_id long, document_id long, chunk_id long, distance double")
    near = near.join(first, ["question_id", "document_id"])
    nth = F.row_number().over(Window.partitionBy("question_id", "document_id").orderBy(F.round("distance", 9), "chunk_id"))
    best = near.withColumn("nth", nth).where(F.col("nth") <= n)
    article = F.when(F.coalesce("m.origin_article", F.lit("")) != "", F.concat(F.lit(" ("), "m.origin_article", F.lit(")"))).otherwise("")
    reason = F.concat(F.lit(REFERENCE_REASON), "m.origin_document", F.lit('"'), article, F.lit(': "'), "m.reference", F.lit('"'))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("m.ord", "m.pos", "document_id", "nth")) - 1
    return best.select("question_id", "document_id", "chunk_id", "distance", rank.alias("rank"), F.lit("REFERENCE").alias("stage"), reason.alias("reason"))


def rerank(candidates: DataFrame, scores: DataFrame | None, k: int = Retrieval().final_k, enabled: bool = True) -> DataFrame:
    """Order candidates (question_id, rank from 0) by scores (question_id, raw json), stable, and keep k.

    The json is {"scores": [{"index", "score"}]}; an entry counts if both are numbers and
    the index is a whole one of a candidate; a score is clamped to 0..10, of a repeated
    index the last counts, a missing one is 0, and so are all of a json that cannot be
    read. Not enabled: the first k in their prior order, without a score. With a column
    reason, it says so.
    """
    order = Window.partitionBy("question_id")
    if not enabled:
        df = candidates.withColumns({"score": F.lit(None).cast("double"), "final_rank": F.row_number().over(order.orderBy("rank")) - 1}).where(F.col("final_rank") < k)
        return df.withColumns({"stage": F.lit("RERANK"), "reason": F.concat("reason", F.lit(RERANK_OFF))}) if "reason" in df.columns else df
    entries = F.try_variant_get(F.try_parse_json("raw"), "$.scores", "array<variant>")
    parsed = scores.select("question_id", F.posexplode(entries).alias("pos", "e"))
    number = lambda c: F.when(_is_number(F.try_variant_get("e", f"$.{c}", "variant")), F.try_variant_get("e", f"$.{c}", "double"))
    valid = parsed.select("question_id", "pos", number("index").alias("i"), number("score").alias("s")).where("i is not null and s is not null and i = floor(i) and abs(i) < 1e9")
    last = valid.groupBy("question_id", F.col("i").cast("int").alias("rank")).agg(F.max_by("s", "pos").alias("s"))
    last = last.select("question_id", "rank", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("s"))).alias("score"))
    df = candidates.join(last, ["question_id", "rank"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    df = df.withColumn("final_rank", F.row_number().over(order.orderBy(F.desc("score"), "rank")) - 1).where(F.col("final_rank") < k)
    return df.withColumns({"stage": F.lit("RERANK"), "reason": F.format_string(RERANK_REASON, "score")}) if "reason" in df.columns else df


def _is_number(v: Column) -> Column:
    """Whether a JSON value is a number."""
    return F.coalesce(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.lit(False))
