"""Chunks of whole units under a token limit, and links from chunks and figures to articles."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from lexmill.config import Chunking
from lexmill.functions.text import count_tokens


def header(*parts: Column) -> Column:
    """"title > chapter > section > article" without the missing ones."""
    return F.concat_ws(" > ", *(F.nullif(p, F.lit("")) for p in parts))


def pack_units(tokens: Column, limit: Column, overlap: int) -> Column:
    """Positions (from 0) of the units of each part, by a greedy fold over their token counts.

    A part is closed when it holds something and the next unit would exceed the limit; the
    next part starts with the last `overlap` units. No units make one part without any.
    """
    start = F.struct(
        F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("now"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("k")
    )

    def step(s, t):
        closes = (F.size(s["now"]) > 0) & (s["sum"] + t > limit)
        tail = F.slice(s["now"], F.greatest(F.size(s["now"]) - overlap + 1, F.lit(1)), overlap) if overlap else F.array().cast("array<int>")
        carried = F.aggregate(tail, F.lit(0).cast("long"), lambda a, i: a + F.get(tokens, i))
        now = F.when(closes, tail).otherwise(s["now"])
        return F.struct(
            F.when(closes, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.concat(now, F.array(s["k"])).alias("now"),
            (F.when(closes, carried).otherwise(s["sum"]) + t).alias("sum"),
            (s["k"] + 1).alias("k"),
        )

    return F.aggregate(tokens, start, step, lambda s: F.concat(s["done"], F.array(s["now"])))


def _count_units(units: Column) -> Column:
    return F.transform(units, lambda u: count_tokens(u).cast("long"))


def chunks(articles: DataFrame, cfg: Chunking = Chunking(), counter: Callable[[Column], Column] = count_tokens, unit_counter: Callable[[Column], Column] = _count_units) -> DataFrame:
    """Chunks of articles (doc_id, idx, title, chapter, section, label, units array<string>).

    Returns doc_id, idx (of the article), part, total_parts, content, token_count,
    char_count and chunk_index, running over the document. Another tokenizer comes in as
    `text.token_counter` and `text.unit_counter`.
    """
    limit = max(cfg.least_limit, cfg.max_tokens)
    head = header(F.col("title"), F.col("chapter"), F.col("section"), F.col("label"))
    df = articles.withColumn("head", head)
    df = df.withColumns({"tokens": unit_counter(F.col("units")), "budget": F.greatest(F.lit(cfg.least_budget), F.lit(limit - cfg.reserve) - counter(F.col("head"))).cast("long")})
    df = df.withColumn("parts", pack_units(F.col("tokens"), F.col("budget"), cfg.overlap)).drop("tokens")
    part = df.select("doc_id", "idx", "head", "units", F.size("parts").alias("total_parts"), F.posexplode("parts").alias("p", "members"))
    body = F.array_join(F.transform("members", lambda i: F.get(F.col("units"), i)), "\n")
    mark = F.when(F.col("total_parts") > 1, F.concat(F.lit("\n[Parte "), F.col("p") + 1, F.lit("/"), F.col("total_parts"), F.lit("]"))).otherwise("")
    done = part.select("doc_id", "idx", (F.col("p") + 1).alias("part"), "total_parts", F.concat("head", mark, F.lit("\n\n"), body).alias("content"))
    order = Window.partitionBy("doc_id").orderBy("idx", "part")
    return done.withColumns({"token_count": counter(F.col("content")).cast("long"), "char_count": F.length("content").cast("long"), "chunk_index": F.row_number().over(order) - 1})


def link_by_number(chunk_rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds article_id by the article number of a chunk's document; of a repeated number the last article wins."""
    last = articles.groupBy("doc_id", "number").agg(F.max_by("article_id", "idx").alias("article_id"))
    return chunk_rows.join(last, ["doc_id", "number"], "left")


def offsets_to_pages(points: DataFrame, pages: DataFrame) -> DataFrame:
    """As-of join: the last page (document_id, page, start) that starts at or before each (document_id, point_id, offset)."""
    both = pages.select("document_id", F.col("start").alias("at"), F.lit(0).alias("side"), "page", F.lit(None).cast("string").alias("point_id")).unionByName(
        points.select("document_id", F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("page"), F.col("point_id").cast("string").alias("point_id"))
    )
    order = Window.partitionBy("document_id").orderBy("at", "side", "page")
    return both.withColumn("page", F.last("page", ignorenulls=True).over(order)).where("side = 1").select("document_id", "point_id", F.col("at").alias("offset"), "page")


def figures_to_articles(figures: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds article_id to figures (document_id, figure_id, page): the last article in document order on the figure's page or an earlier one.

    An as-of window over both, so a document's figures and articles are never paired.
    """
    kind = articles.schema["article_id"].dataType
    a = articles.where("page is not null").select("document_id", "page", F.lit(0).alias("side"), F.struct("article_index", "article_id").alias("a"), F.lit(None).cast(figures.schema["figure_id"].dataType).alias("figure_id"))
    none = F.lit(None).cast(a.schema["a"].dataType)
    f = figures.select("document_id", "page", F.lit(1).alias("side"), none.alias("a"), "figure_id")
    upto = Window.partitionBy("document_id").orderBy("page", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(f).withColumn("a", F.max("a").over(upto)).where("side = 1")
    return found.select("document_id", "figure_id", "page", F.col("a.article_id").cast(kind).alias("article_id"))


def figures_to_chunks(figures: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Adds chunk_id: the first part of the figure's article; of several such chunks (document_id, article_id, chunk_id, part, chunk_index) the last."""
    first = chunk_rows.where("part = 1 and article_id is not null").groupBy("document_id", "article_id").agg(F.max_by("chunk_id", "chunk_index").alias("chunk_id"))
    return figures.join(first, ["document_id", "article_id"], "left")


@F.pandas_udf(ArrayType(IntegerType()))
def article_offsets(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    """Where each article number of a text stands in it: searched from the end of the hit before; null, and no step forward, where there is none."""

    def one(text, wanted):
        at, out = 0, []
        for number in wanted if wanted is not None else []:
            hit = re.compile(rf"(?:Art\.?|Artigo)[\s\ufeff]*{re.escape(number)}(?![A-Za-z0-9_])", re.IGNORECASE).search(text or "", at)
            out.append(hit.start() if hit else None)
            at = hit.end() if hit else at
        return out

    return pd.Series([one(t, w) for t, w in zip(texts, numbers, strict=True)], dtype=object)


def locate_articles(documents: DataFrame, articles: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """(document_id, article_id, article_index, offset): each article (document_id, article_id, article_index, number) in its document's text.

    With figures (document_id), only documents that hold one are searched.
    """
    if figures is not None:
        documents = documents.join(figures.select("document_id").distinct(), "document_id", "left_semi")
    listed = articles.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("article_index", "article_id", "number"))).alias("a"))
    found = documents.select("document_id", "text").join(listed, "document_id")
    found = found.select("document_id", "a", article_offsets("text", F.col("a.number")).alias("at"))
    rows = found.select("document_id", F.explode(F.arrays_zip("a", "at")).alias("z"))
    return rows.select("document_id", "z.a.article_id", "z.a.article_index", F.col("z.at").alias("offset"))


def valid_boxes(figures: DataFrame, max_figures: int = 60, least_width: int = 60, least_height: int = 60) -> DataFrame:
    """Figures (document_id, page, ord, page_width, page_height, bbox in %) with usable boxes, in pixels.

    Corners are ordered and clamped to 0..100; sides under 1 % and boxes under the least
    pixels go; figure_index restarts on every page; the first max_figures of a document stay.
    """
    v = lambda k: F.get("bbox", F.lit(k))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    finite = F.forall("bbox", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = figures.where((F.size("bbox") == 4) & finite)
    df = df.withColumns({"x0": clamp(F.least(v(0), v(2))), "x1": clamp(F.greatest(v(0), v(2))), "y0": clamp(F.least(v(1), v(3))), "y1": clamp(F.greatest(v(1), v(3)))}).where("x1 - x0 >= 1 and y1 - y0 >= 1")
    df = df.withColumns({"width": F.floor((F.col("x1") - F.col("x0")) / 100 * F.col("page_width") + 0.5), "height": F.floor((F.col("y1") - F.col("y0")) / 100 * F.col("page_height") + 0.5)})
    df = df.where((F.col("width") >= least_width) & (F.col("height") >= least_height))
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "ord"))).where(F.col("__n") <= max_figures)
    return df.withColumn("figure_index", F.row_number().over(Window.partitionBy("document_id", "page").orderBy("ord")) - 1).select("document_id", "page", "figure_index", "width", "height")
