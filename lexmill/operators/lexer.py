"""Structural lexing and the tree of a legal text, as windows over its lines.

All windows and aggregates are partitioned by the document, so the one exchange of the
lines serves them all; parents' attributes are carried forward and never joined back.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.config import CUES, Patterns
from lexmill.functions.text import trim

# Depth of the structural tokens.
DEPTH = {"CAPITULO": 1, "SECAO": 2, "SUBSECAO": 3, "ARTIGO": 4, "PARAGRAFO": 5, "INCISO": 6, "ALINEA": 7, "ITEM": 8}
HARD = tuple(k for k in DEPTH if k != "ITEM")


def _upto(order: str):
    return Window.partitionBy("doc_id").orderBy(order)


def _before(order: str):
    return _upto(order).rowsBetween(Window.unboundedPreceding, -1)


def _last(condition: Column, value: Column, over) -> Column:
    """The value of the last row that fits the condition."""
    return F.last(F.when(condition, value), ignorenulls=True).over(over)


def lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, line_no from 1, raw, line, position): non-blank lines with the offset of their raw line."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("i", "raw"))
    raw = raw.select("doc_id", (F.col("i") + 1).alias("line_no"), "raw", trim(F.col("raw")).alias("line"))
    position = F.coalesce(F.sum(F.length("raw") + 1).over(_before("line_no")), F.lit(0))
    return raw.withColumn("position", position).where("line <> ''")


def line_class(line: Column, p: Patterns = Patterns()) -> Column:
    """The first pattern that a line fits; item-shaped and free lines are told apart by their context later."""
    ci = "(?iu)"
    order = [
        (ci + p.chapter, "CAPITULO"), (ci + p.subsection, "SUBSECAO"), (ci + p.section, "SECAO"), (p.article, "ARTIGO"), (ci + p.paragraph, "PARAGRAFO"),
        (p.inciso, "INCISO"), (p.alinea, "ALINEA"),
    ]
    out = F
    for pattern, name in order:
        out = out.when(line.rlike(pattern), name)
    return out.otherwise("FREE")


def main_tokens(numbered: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    """One token per non-blank line, with its type resolved from the lines before it."""
    line, hard = F.col("line"), F.col("cls") != "FREE"
    df = numbered.withColumn("cls", line_class(line, p)).withColumn("hard", _last(hard, F.col("cls"), _before("line_no")))
    item = ~hard & line.rlike(p.item) & F.coalesce(F.col("hard").isin("ALINEA", "INCISO"), F.lit(False))
    df = df.withColumn("item", item)
    df = df.withColumn("note", ~hard & ~F.col("item") & line.rlike("(?iu)" + p.note))
    df = df.withColumn("free", ~hard & ~F.col("item") & ~F.col("note"))
    # Free lines since the last hard one: a running count less what it was there.
    df = df.withColumn("run", F.sum(F.col("free").cast("int")).over(_upto("line_no")))
    df = df.withColumn("nth", F.col("run") - F.coalesce(_last(hard, F.col("run"), _upto("line_no")), F.lit(0)))
    title = (F.col("nth") == 1) & (F.length("line") <= 120) & ~line.rlike("[.;:]$")
    kind = (
        F.when(hard, F.col("cls"))
        .when(F.col("item"), "ITEM")
        .when(F.col("note"), "OBSERVACAO")
        .when((F.col("hard") == "CAPITULO") & title, "TITULO_CAPITULO")
        .when(F.col("hard").isin("SECAO", "SUBSECAO") & title, "TITULO_SECAO")
        .when(F.col("hard") == "ARTIGO", "CAPUT")
        .otherwise("TEXTO")
    )
    return df.select("doc_id", "line_no", "position", kind.alias("type"), "line")


def _cued(pattern: str, line: Column) -> Column:
    """Whether a line may fit a pattern anywhere: a look for a few short texts instead of a try at each character."""
    low, cues = F.lower(line), CUES.get(pattern, ())
    # Two letters are their own lower case and yet equal i and s where case is ignored.
    return reduce(or_, (F.contains(low, F.lit(c)) for c in (*cues, "ı", "ſ"))) if cues else F.lit(True)


def tokens(numbered: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    """(doc_id, idx, type, text, position, line_no): the document token, then each line's own, its amendment mark and its citations.

    A line's tokens are one array, so the lines are read, classed and sorted once.
    """
    line = F.col("line")
    mark = F.when(_cued(p.amendment, line), F.regexp_extract("line", "(?iu)" + p.amendment, 1)).otherwise("")
    token = lambda kind, text: F.struct(kind.alias("type"), text.alias("text"))
    none = F.array().cast("array<struct<type: string, text: string>>")
    first = F.row_number().over(_upto("line_no")) == 1
    cited = F.when(_cued(p.citation, line), F.transform(F.regexp_extract_all("line", F.lit("(?iu)" + p.citation), 1), lambda c: token(F.lit("REFERENCIA_LEGAL"), c))).otherwise(none)
    every = F.concat(
        F.when(first, F.array(token(F.lit("DOCUMENT"), line))).otherwise(none),
        F.array(token(F.col("type"), line)),
        F.when(mark != "", F.array(token(F.lit("NOVA_REDACAO"), mark))).otherwise(none),
        cited,
    )
    df = main_tokens(numbered, p).withColumn("every", every)
    df = df.withColumn("base", F.coalesce(F.sum(F.size("every")).over(_before("line_no")), F.lit(0)))
    df = df.select("doc_id", "line_no", "position", "base", F.posexplode("every").alias("pos", "token"))
    return df.select("doc_id", (F.col("base") + F.col("pos")).cast("int").alias("idx"), "token.type", "token.text", "position", "line_no")


def tokens_of(toks: DataFrame, types: list[str]) -> DataFrame:
    """The listing of some types, in order within each document."""
    return toks.where(F.col("type").isin(*types)).sortWithinPartitions("doc_id", "idx")


def with_labels(toks: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    """Adds number, label and body of structural tokens, from the groups of their pattern; all in the token's own row."""
    ci, text = "(?iu)", F.col("text")
    by = {"CAPITULO": ci + p.chapter, "SECAO": ci + p.section, "SUBSECAO": ci + p.subsection, "ARTIGO": p.article, "PARAGRAFO": ci + p.paragraph, "INCISO": p.inciso, "ALINEA": p.alinea, "ITEM": p.item}
    number, body = F, F
    for name, pattern in by.items():
        number = number.when(F.col("type") == name, F.regexp_extract(text, pattern, 1))
        body = body.when(F.col("type") == name, trim(F.regexp_extract(text, pattern, 2)))
    df = toks.withColumns({"number": number, "body": body})
    n, sole = F.col("number"), (F.col("type") == "PARAGRAFO") & (F.col("number") == "")
    label = (
        F.when(F.col("type") == "CAPITULO", F.concat(F.lit("CAPÍTULO "), n))
        .when(F.col("type") == "SECAO", F.concat(F.lit("Seção "), n))
        .when(F.col("type") == "SUBSECAO", F.concat(F.lit("Subseção "), n))
        .when(F.col("type") == "ARTIGO", F.concat(F.lit("Art. "), n))
        .when(sole, F.lit("Parágrafo único"))
        .when(F.col("type") == "PARAGRAFO", F.concat(F.lit("§ "), n, F.lit("º")))
        .when(F.col("type") == "INCISO", n)
        .when(F.col("type") == "ALINEA", F.concat(n, F.lit(")")))
        .when(F.col("type") == "ITEM", F.concat(n, F.lit(".")))
    )
    own = F.col("type").isin("PARAGRAFO", "INCISO", "ALINEA", "ITEM")
    return df.withColumns({"label": label, "body": F.when(own & (F.col("body") == ""), text).otherwise(F.col("body")), "number": F.when(sole, "único").otherwise(n)})


def labels(toks: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    """(doc_id, idx, type, number, label, body) of structural tokens."""
    return with_labels(toks.where(F.col("type").isin(*DEPTH)), p).select("doc_id", "idx", "type", "number", "label", "body")


def with_parents(toks: DataFrame) -> DataFrame:
    """Adds depth, parent_idx and parent_type: the nearest structural token before with a smaller depth, else the root (-1, DOCUMENT)."""
    depth = F
    for name, d in DEPTH.items():
        depth = depth.when(F.col("type") == name, d)
    df = toks.withColumn("depth", depth)
    # The last token of each depth before this one; the parent of depth d is the latest of those below d.
    open_at = {d: F.last(F.when(F.col("depth") == d, F.struct("idx", "type")), ignorenulls=True).over(_before("idx")) for d in range(1, 8)}
    df = df.withColumns({f"__l{d}": c for d, c in open_at.items()})
    root = F.struct(F.lit(-1).alias("idx"), F.lit("DOCUMENT").alias("type"))
    latest = F
    for d in range(1, 9):
        latest = latest.when(F.col("depth") == d, F.greatest(root, *(F.coalesce(F.col(f"__l{k}"), root) for k in range(1, d))) if d > 1 else root)
    return df.withColumn("__up", latest).withColumns({"parent_idx": F.col("__up.idx"), "parent_type": F.col("__up.type")}).drop("__up", *(f"__l{d}" for d in range(1, 8)))


def nodes(toks: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    """The tree, one row per node: doc_id, idx, type, depth, parent_idx, parent_type, chapter_idx, section_idx, article_idx, kept, number, label, title, text, line_no.

    * Titles after a heading are appended to the chapter's or section's title, caput lines to
      the article's text (its caput), loose lines to the text of the last open node; before
      any node they are nodes of the root. Joined by one space.
    * Notes, amendment marks and citations are children of the last open node.
    * kept says what the law's structure holds: chapters, sections, articles, paragraphs
      under an article, incisos under an article or kept paragraph, alineas under a kept
      inciso, items under a kept alinea, and notes and citations right under an article.

    Everything is windows and one aggregate over doc_id: no exchange after that of the lines.
    """
    df = with_parents(with_labels(toks, p))
    kind, upto, before = F.col("type"), _upto("idx"), _before("idx")
    structural = F.col("depth").between(1, 7)
    df = df.withColumns({
        "top": _last(structural, F.struct("idx", "type"), upto),
        "chapter_idx": _last(kind == "CAPITULO", F.col("idx"), upto),
        "section_idx": _last(kind.isin("CAPITULO", "SECAO", "SUBSECAO"), F.struct("type", "idx"), upto),
        "article_idx": _last(kind == "ARTIGO", F.col("idx"), upto),
    })
    df = df.withColumn("section_idx", F.when(F.col("section_idx.type") != "CAPITULO", F.col("section_idx.idx")))
    beside = kind.isin("OBSERVACAO", "NOVA_REDACAO", "REFERENCIA_LEGAL")
    loose = (kind == "TEXTO") & F.col("top").isNull()
    df = df.withColumns({
        "parent_idx": F.when(beside, F.coalesce("top.idx", F.lit(-1))).when(loose, -1).otherwise(F.col("parent_idx")),
        "parent_type": F.when(beside, F.coalesce("top.type", F.lit("DOCUMENT"))).when(loose, "DOCUMENT").otherwise(F.col("parent_type")),
    })
    # What a level keeps depends on the level above it alone, whose last row is carried down.
    df = df.withColumn("kept", kind.isin("DOCUMENT", "CAPITULO", "SECAO", "SUBSECAO", "ARTIGO") | ((kind == "PARAGRAFO") | beside) & (F.col("parent_type") == "ARTIGO"))
    for name, parents in (("INCISO", ("PARAGRAFO",)), ("ALINEA", ("INCISO",)), ("ITEM", ("ALINEA",))):
        above = F.coalesce(_last(kind == parents[0], F.col("kept"), before), F.lit(False))
        fits = F.col("parent_type").isin(*parents) & above
        if name == "INCISO":
            fits = fits | (F.col("parent_type") == "ARTIGO")
        df = df.withColumn("kept", F.when(kind == name, fits).otherwise(F.col("kept")))
    # Each token belongs to a node: its own, or the one that its text is appended to.
    last_section = _last(kind.isin("SECAO", "SUBSECAO"), F.col("idx"), upto)
    owner = F.when(kind == "TITULO_CAPITULO", F.col("chapter_idx")).when(kind == "TITULO_SECAO", last_section).when(kind == "CAPUT", F.col("article_idx")).when(kind == "TEXTO", F.coalesce("top.idx", F.col("idx"))).otherwise(F.col("idx"))
    heading = kind.isin("CAPITULO", "SECAO", "SUBSECAO")
    title = F.when(heading, F.col("body")).when(kind.isin("TITULO_CAPITULO", "TITULO_SECAO"), F.col("text"))
    piece = F.when(kind.isin("ARTIGO", "PARAGRAFO", "INCISO", "ALINEA", "ITEM"), F.col("body")).when(kind.isin("CAPUT", "TEXTO", "DOCUMENT") | beside, F.col("text"))
    df = df.withColumns({"owner": owner, "title": title, "piece": piece})
    own = ["type", "depth", "parent_idx", "parent_type", "chapter_idx", "section_idx", "article_idx", "kept", "number", "label", "line_no"]
    listed = lambda c: F.array_sort(F.collect_list(F.when((F.col(c) != ""), F.struct("idx", F.col(c).alias("t")))))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), " ")
    grouped = df.groupBy("doc_id", F.col("owner").alias("node")).agg(F.first(F.when(F.col("idx") == F.col("owner"), F.struct(*own)), ignorenulls=True).alias("own"), listed("title").alias("titles"), listed("piece").alias("pieces"))
    return grouped.select("doc_id", F.col("node").alias("idx"), *(f"own.{c}" for c in own), joined(F.col("titles")).alias("title"), joined(F.col("pieces")).alias("text"))


def node_counts(tree: DataFrame) -> DataFrame:
    """(doc_id, type, n) of the tree's nodes; every article holds one CAPUT besides."""
    kinds = F.when(F.col("type") == "ARTIGO", F.array(F.lit("ARTIGO"), F.lit("CAPUT"))).otherwise(F.array("type"))
    return tree.select("doc_id", F.explode(kinds).alias("type")).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def _heading() -> Column:
    return F.concat_ws(" — ", F.nullif(F.col("label"), F.lit("")), F.nullif(F.col("title"), F.lit("")))


def _with_headings(tree: DataFrame) -> DataFrame:
    """Adds chapter and section: "label — title" of the open ones, the section the innermost."""
    upto, kind = _upto("idx"), F.col("type")
    return tree.withColumns({
        "chapter": F.coalesce(_last(kind == "CAPITULO", _heading(), upto), F.lit("")),
        "section": F.when(F.col("section_idx").isNotNull(), _last(kind.isin("SECAO", "SUBSECAO"), _heading(), upto)).otherwise(""),
    })


def articles_of(tree: DataFrame) -> DataFrame:
    """(doc_id, idx, number, label, chapter, section, caput) of every article, in document order."""
    df = _with_headings(tree)
    return df.where("type = 'ARTIGO'").select("doc_id", "idx", "number", "label", "chapter", "section", F.col("text").alias("caput"))


def articles(toks: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    return articles_of(nodes(toks, p))


def _body() -> Column:
    return F.when(F.col("type") == "NOVA_REDACAO", F.concat(F.lit("Nova redação: "), "text")).otherwise(F.col("text"))


def structure_of(tree: DataFrame) -> DataFrame:
    """(doc_id, idx, type, parent_idx, article_idx, label, body, ord) of what the law structure keeps in articles, notes and citations too.

    ord counts the kept rows of one type under one parent, from 0.
    """
    kept = tree.where(F.col("kept") & F.col("type").isin("ARTIGO", "PARAGRAFO", "INCISO", "ALINEA", "ITEM", "OBSERVACAO", "NOVA_REDACAO", "REFERENCIA_LEGAL"))
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "parent_idx", "type").orderBy("idx")) - 1
    return kept.select("doc_id", "idx", "type", "parent_idx", "article_idx", "label", _body().alias("body"), ord_.alias("ord"))


def structure(toks: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    return structure_of(nodes(toks, p))


def _line() -> Column:
    """A row's line in the full text of its article."""
    kind, label, body = F.col("type"), F.col("label"), F.col("body")
    return (
        F.when(kind == "INCISO", F.concat(label, F.lit(" - "), body))
        .when(kind.isin("ALINEA", "ITEM"), F.concat(label, F.lit(" "), body))
        .when(kind.isin("OBSERVACAO", "NOVA_REDACAO"), body)
        .otherwise(F.trim(F.concat(label, F.lit(" "), body)))
    )


def _joined_lines() -> Column:
    """The lines of a group of rows in document order, notes last."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("type").isin("OBSERVACAO", "NOVA_REDACAO").alias("note"), F.col("idx").alias("i"), _line().alias("line"))))
    return F.array_join(F.transform(listed, lambda x: x["line"]), "\n")


def full_texts(parts: DataFrame) -> DataFrame:
    """(doc_id, idx, full_text) of articles: "label caput", a line for each part in document order, then the notes."""
    return parts.where("type <> 'REFERENCIA_LEGAL'").groupBy("doc_id", F.col("article_idx").alias("idx")).agg(_joined_lines().alias("full_text"))


def articles_with_texts(tree: DataFrame) -> DataFrame:
    """(doc_id, idx, number, label, chapter, section, caput, title, full_text): `articles_of` and `full_texts` with the document's title, by one aggregate over the tree."""
    title = F.max(F.when(F.col("type") == "DOCUMENT", F.col("text"))).over(Window.partitionBy("doc_id"))
    parts = _with_headings(tree).withColumn("document_title", title).where(F.col("kept") & F.col("type").isin("ARTIGO", "PARAGRAFO", "INCISO", "ALINEA", "ITEM", "OBSERVACAO", "NOVA_REDACAO"))
    parts = parts.withColumn("body", _body())
    own = F.first(F.when(F.col("type") == "ARTIGO", F.struct("number", "label", "chapter", "section", F.col("text").alias("caput"), F.col("document_title").alias("title"))), ignorenulls=True)
    whole = parts.groupBy("doc_id", F.col("article_idx").alias("idx")).agg(own.alias("own"), _joined_lines().alias("full_text"))
    return whole.select("doc_id", "idx", "own.*", "full_text")


def _folded(df: DataFrame, name: str, kinds: tuple[str, ...], shape: Column) -> DataFrame:
    """The rows of some types as an array of their shapes in their parents' rows, in document order, by one aggregate over (doc_id, node)."""
    is_child = F.col("type").isin(*kinds)
    own = F.first(F.when(~is_child, F.struct(*df.columns[1:])), ignorenulls=True)
    child = F.array_sort(F.collect_list(F.when(is_child, F.struct(F.col("idx").alias("i"), shape.alias("child")))))
    grouped = df.groupBy("doc_id", F.when(is_child, F.col("parent_idx")).otherwise(F.col("idx")).alias("n")).agg(own.alias("own"), child.alias("children"))
    return grouped.where("own is not null").select("doc_id", "own.*", F.transform("children", lambda x: x["child"]).alias(name))


def _with_parts(df: DataFrame) -> DataFrame:
    """Articles with their paragraphs and incisos, alineas and items within these, from the kept rows (doc_id, idx, type, parent_idx, number, label, text, ...)."""
    pair = lambda a, b, *more: F.struct(F.col("number").alias(a), F.col("text").alias(b), *more)
    df = _folded(df, "itens", ("ITEM",), pair("numero", "texto"))
    df = _folded(df, "alineas", ("ALINEA",), pair("letra", "texto", "itens"))
    df = _folded(df, "incisos", ("INCISO",), pair("numero", "texto", "alineas"))
    df = _folded(df, "paragrafos", ("PARAGRAFO",), F.struct(F.col("label").alias("rotulo"), F.col("text").alias("texto"), "incisos"))
    return _folded(df, "observacoes", ("OBSERVACAO", "NOVA_REDACAO"), F.col("text"))


def articles_with_parts(tree: DataFrame) -> DataFrame:
    """(doc_id, idx, number, label, chapter, section, caput, full_text, paragrafos, incisos) of every article.

    The full text is that of `full_texts`: incisos of the article itself stand before its
    first paragraph, so its parts in their order are its lines. No join, and no exchange after
    that of the lines.
    """
    article = F.col("type") == "ARTIGO"
    df = _with_headings(tree).where(F.col("kept") & F.col("type").isin("ARTIGO", "PARAGRAFO", "INCISO", "ALINEA", "ITEM", "OBSERVACAO", "NOVA_REDACAO"))
    heading = [F.when(article, F.col(c)).alias(c) for c in ("chapter", "section")]
    df = _with_parts(df.select("doc_id", "idx", "type", "parent_idx", "number", "label", _body().alias("text"), *heading)).where(article)
    line = lambda a, between, b: F.concat(a, F.lit(between), b)
    alinea = lambda x: F.concat(F.array(line(x["letra"], ") ", x["texto"])), F.transform(x["itens"], lambda t: line(t["numero"], ". ", t["texto"])))
    inciso = lambda x: F.concat(F.array(line(x["numero"], " - ", x["texto"])), F.flatten(F.transform(x["alineas"], alinea)))
    paragraph = lambda x: F.concat(F.array(F.trim(line(x["rotulo"], " ", x["texto"]))), F.flatten(F.transform(x["incisos"], inciso)))
    lines = F.concat(F.array(F.trim(line(F.col("label"), " ", F.col("text")))), F.flatten(F.transform("incisos", inciso)), F.flatten(F.transform("paragrafos", paragraph)), "observacoes")
    return df.select("doc_id", "idx", "number", "label", "chapter", "section", F.col("text").alias("caput"), F.array_join(lines, "\n").alias("full_text"), "paragrafos", "incisos")


def chapters_of(tree: DataFrame) -> DataFrame:
    """(doc_id, idx, chapter_index, label, title): sections before any chapter stand in one without a name (idx -1), which comes first."""
    real = F.col("type") == "CAPITULO"
    # Only a document's first heading can be a section that stands for the chapter without a name.
    heads = tree.where("type in ('CAPITULO', 'SECAO', 'SUBSECAO')").select("doc_id", "idx", "type", "label", "title").withColumn("nth", F.row_number().over(_upto("idx")))
    found = heads.where(real | (F.col("nth") == 1)).withColumn("chapter_index", F.row_number().over(_upto("idx")) - 1)
    named = lambda c, other: F.when(real, F.col(c)).otherwise(other).alias(c)
    return found.select("doc_id", named("idx", -1), named("label", "(sem capítulo)"), named("title", ""), "chapter_index")


def sections_of(tree: DataFrame) -> DataFrame:
    """(doc_id, idx, section_index, chapter_idx, label, title, is_subsection), numbered through the document."""
    found = tree.where("type in ('SECAO', 'SUBSECAO')")
    return found.select("doc_id", "idx", (F.row_number().over(_upto("idx")) - 1).alias("section_index"), F.coalesce("chapter_idx", F.lit(-1)).alias("chapter_idx"), "label", "title", (F.col("type") == "SUBSECAO").alias("is_subsection"))


def article_links(tree: DataFrame, link_by_label: bool = False) -> DataFrame:
    """(doc_id, idx, chapter_idx, section_idx) of every article: the chapter and section it stands in, null where there is none.

    With link_by_label, those of the document that bear the same heading ("label — title"),
    the last one where it is repeated, as where links are looked up by a map of headings.
    """
    if not link_by_label:
        return tree.where("type = 'ARTIGO'").select("doc_id", "idx", "chapter_idx", "section_idx")
    heads = tree.where(F.col("type").isin("CAPITULO", "SECAO", "SUBSECAO")).withColumns({"heading": _heading(), "of": F.when(F.col("type") == "CAPITULO", "chapter").otherwise("section")})
    last = heads.where("heading <> ''").groupBy("doc_id", "of", "heading").agg(F.max("idx").alias("head"))
    named = lambda kind: last.where(F.col("of") == kind).select("doc_id", F.col("heading").alias(kind), F.col("head").alias(f"{kind}_idx"))
    found = articles_of(tree).join(named("chapter"), ["doc_id", "chapter"], "left").join(named("section"), ["doc_id", "section"], "left")
    return found.select("doc_id", "idx", "chapter_idx", "section_idx")


def paragraphs_of(tree: DataFrame) -> DataFrame:
    """(doc_id, idx, article_idx, paragraph_index, label, text)."""
    order = Window.partitionBy("doc_id", "article_idx").orderBy("idx")
    return tree.where("kept and type = 'PARAGRAFO'").select("doc_id", "idx", "article_idx", (F.row_number().over(order) - 1).alias("paragraph_index"), "label", "text")


def incisos_of(tree: DataFrame) -> DataFrame:
    """(doc_id, idx, article_idx, paragraph_idx, inciso_index, label, text): numbered on across an article and its paragraphs; one of the two parents is null."""
    order = Window.partitionBy("doc_id", "article_idx").orderBy("idx")
    found = tree.where("kept and type = 'INCISO'").withColumn("inciso_index", F.row_number().over(order) - 1)
    of = lambda kind: F.when(F.col("parent_type") == kind, F.col("parent_idx"))
    return found.select("doc_id", "idx", of("ARTIGO").alias("article_idx"), of("PARAGRAFO").alias("paragraph_idx"), "inciso_index", "label", "text")


def alineas_of(tree: DataFrame) -> DataFrame:
    """(doc_id, idx, inciso_idx, alinea_index, label, text, items): numbered within their inciso, their items as an array."""
    group = F.when(F.col("type") == "ITEM", F.col("parent_idx")).otherwise(F.col("idx"))
    own = F.first(F.when(F.col("type") == "ALINEA", F.struct("parent_idx", "number", "text")), ignorenulls=True)
    items = F.array_sort(F.collect_list(F.when(F.col("type") == "ITEM", F.struct("idx", "number", "text"))))
    rows = tree.where("kept and type in ('ALINEA', 'ITEM')").groupBy("doc_id", group.alias("node")).agg(own.alias("own"), items.alias("items"))
    order = Window.partitionBy("doc_id", "own.parent_idx").orderBy("node")
    return rows.select(
        "doc_id", F.col("node").alias("idx"), F.col("own.parent_idx").alias("inciso_idx"), (F.row_number().over(order) - 1).alias("alinea_index"), F.col("own.number").alias("label"), "own.text",
        F.transform("items", lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text"))).alias("items"),
    )


def law_documents(tree: DataFrame) -> DataFrame:
    """(doc_id, law): each document's whole structure as one nested struct: chapters, sections, articles and their parts.

    Level by level, from the items up, a level's rows are folded into their parents' rows by
    one aggregate over (doc_id, node): children are never joined to their parents.
    """
    parent = F.when(F.col("parent_idx") < 0, 0).otherwise(F.col("parent_idx"))
    text = F.when(F.col("type") == "NOVA_REDACAO", F.concat(F.lit("Nova redação: "), "text")).otherwise(F.col("text"))
    df = _with_parts(tree.where("kept").select("doc_id", "idx", "type", parent.alias("parent_idx"), "number", "label", "title", text.alias("text")))
    df = _folded(df, "referencias", ("REFERENCIA_LEGAL",), F.col("text"))
    df = _folded(df, "artigos", ("ARTIGO",), F.struct(F.col("number").alias("numero"), F.col("label").alias("rotulo"), F.col("text").alias("caput"), "paragrafos", "incisos", "observacoes", "referencias"))
    section = lambda *more: F.struct(F.col("label").alias("rotulo"), F.col("title").alias("titulo"), (F.col("type") == "SUBSECAO").alias("subsecao"), "artigos", *more)
    df = _folded(df, "subsecoes", ("SUBSECAO",), section())
    df = _folded(df, "secoes", ("SECAO",), section("subsecoes"))
    # A subsection right under a chapter or the document counts as one of its sections.
    bare = F.transform("subsecoes", lambda s: F.struct(s["rotulo"].alias("rotulo"), s["titulo"].alias("titulo"), s["subsecao"].alias("subsecao"), s["artigos"].alias("artigos"), F.slice("subsecoes", 1, 0).alias("subsecoes")))
    df = df.withColumn("secoes", F.concat(bare, "secoes"))
    chapter = lambda label, title, sections, arts: F.struct(label.alias("rotulo"), title.alias("titulo"), sections.alias("secoes"), arts.alias("artigos"))
    df = _folded(df, "capitulos", ("CAPITULO",), chapter(F.col("label"), F.col("title"), F.col("secoes"), F.col("artigos")))
    implicit = F.array(chapter(F.lit(""), F.lit(""), F.col("secoes"), F.slice("artigos", 1, 0)))
    every = F.concat(F.when(F.size("secoes") > 0, implicit).otherwise(F.slice("capitulos", 1, 0)), "capitulos")
    return df.where("type = 'DOCUMENT'").select("doc_id", F.struct(F.col("text").alias("titulo"), every.alias("capitulos"), F.col("artigos").alias("artigos")).alias("law"))


def law_trees(tree: DataFrame) -> DataFrame:
    """(doc_id, tree): each document's tree as one JSON text, nodes within nodes: id, type, label, number, title, text, startLine, children.

    Depth by depth from the items up, a depth's nodes are written out and put under their
    parents, whatever depth those have, by one aggregate over (doc_id, node): no join, and no
    exchange after that of the lines. Empty fields are left out.
    """
    # Notes, citations and loose lines have no depth of their own: they hold nothing and go first.
    depth = F.when(F.col("type") == "DOCUMENT", 0).otherwise(F.coalesce("depth", F.lit(9)))
    parent = F.when(F.col("parent_idx") < 0, F.lit(0)).otherwise(F.col("parent_idx"))
    df = tree.withColumns({"level": depth, "up": parent})
    optional = {name: F.nullif(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in (("number", "number"), ("title", "title"), ("text", "text"))}
    own = [F.col("idx").cast("string").alias("id"), "type", F.coalesce("label", F.lit("")).alias("label"), *optional.values(), F.col("line_no").alias("startLine")]
    none = F.array().cast("array<struct<idx:int,json:string>>")
    df = df.select("doc_id", "idx", "level", "up", F.to_json(F.struct(*own)).alias("head"), none.alias("children"))
    written = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"children":['), F.array_join(F.transform(F.array_sort("children"), lambda c: c["json"]), ","), F.lit("]}"))
    for level in range(9, 0, -1):
        goes = F.col("level") == level
        moved = F.collect_list(F.when(goes, F.struct("idx", written.alias("json"))))
        stays = F.first(F.when(~goes, F.struct("level", "up", "head", "children")), ignorenulls=True)
        grouped = df.groupBy("doc_id", F.when(goes, F.col("up")).otherwise(F.col("idx")).alias("idx")).agg(stays.alias("own"), moved.alias("more"))
        df = grouped.where("own is not null").select("doc_id", "idx", "own.level", "own.up", "own.head", F.concat("own.children", "more").alias("children"))
    return df.where("level = 0").select("doc_id", written.alias("tree"))
