"""Documents in and out: registration, type, page text, page assembly, exports."""

from __future__ import annotations

import html as markup
import re
from collections.abc import Callable
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

# Endings and media types of the document types, first match wins.
TYPES = (
    ("PDF", (".pdf",), "application/pdf"),
    ("DOCX", (".docx",), "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("HTML", (".html", ".htm"), "text/html"),
    ("MARKDOWN", (".md", ".markdown"), None),
    ("TXT", (".txt",), "text/plain"),
)


def detect_type(name: Column, mime: Column, pasted: Column) -> Column:
    """Type by ending, then media type, TXT otherwise; PASTED for text without a file."""
    lower = F.lower(name)
    out = F.when(pasted.isNotNull() & name.isNull(), "PASTED")
    for kind, endings, media in TYPES:
        fits = F.lit(False)
        for e in endings:
            fits = fits | F.coalesce(lower.endswith(e), F.lit(False))
        if media:
            fits = fits | F.coalesce(mime == media, F.lit(False))
        out = out.when(fits, kind)
    return out.otherwise("TXT")


# How the text of each type is got; other types come with their pages.
ENGINES = {"PASTED": "pasted-text", "TXT": "utf8", "MARKDOWN": "markdown-passthrough", "HTML": "html-to-text"}


def register(files: DataFrame) -> DataFrame:
    """(document_id, name, type, size_bytes, status, engine, text) of uploads (document_id, name, mime, content, size_bytes, pasted)."""
    size = F.coalesce(F.octet_length("content"), F.col("size_bytes"), F.length("pasted"), F.lit(0)).cast("long")
    kind = detect_type(F.col("name"), F.col("mime"), F.col("pasted"))
    body = F.make_valid_utf8(F.col("content").cast("string"))  # what is no UTF-8 becomes U+FFFD
    text = F.when(kind == "PASTED", F.coalesce("pasted", F.lit(""))).when(kind.isin("TXT", "MARKDOWN"), body).when(kind == "HTML", html_to_text(body))
    engine = F
    for name, tag in ENGINES.items():
        engine = engine.when(kind == name, tag)
    return files.select("document_id", F.coalesce("name", F.lit("")).alias("name"), kind.alias("type"), size.alias("size_bytes"), F.lit("UPLOADED").alias("status"), engine.alias("engine"), text.alias("text"))


#: Elements whose tags stand for a line break.
BLOCKS = ("p", "div", "br", "li", "ul", "ol", "h[1-6]", "tr", "table", "article", "section", "header", "footer", "title", "body", "head", "html")
#: The rest of a tag: what stands in quotes ends no tag, and one left open goes to the end of the page.
_REST = r"""(?:"[^"]*"|'[^']*'|[^"'>]++)*+"""
_UNREAD = rf"(?is)<!--.*?(?:-->|\z)|<script\b{_REST}(?:>.*?(?:</script\s*>|\z)|.*\z)|<style\b{_REST}(?:>.*?(?:</style\s*>|\z)|.*\z)"
_TAG = rf"(?s)<(/?[A-Za-z][^\s>/\"']*){_REST}(?:>|[\"'].*\z|\z)"
_MENU = r"(?i)</?nav>"


def _outside_menus(html: Column) -> Column:
    """The text outside nav elements, which may hold others; one left open goes to the end of the page."""
    marks = F.regexp_extract_all(html, F.lit(_MENU), 0)
    pieces = F.split(html, _MENU)
    start = F.struct(F.lit(0).alias("depth"), F.element_at(pieces, 1).alias("text"))

    def step(s, x):
        depth = F.when(F.startswith(x["mark"], F.lit("</")), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"] + 1)
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(s["text"], x["piece"])).otherwise(s["text"]).alias("text"))

    after = F.zip_with(marks, F.slice(pieces, F.lit(2), F.size(marks)), lambda m, p: F.struct(m.alias("mark"), p.alias("piece")))
    return F.when(html.rlike(_MENU), F.aggregate(after, start, step, lambda s: s["text"])).otherwise(html)


#: References that pages are full of, decoded where the text lies; that of the sign itself goes last, so nothing is decoded twice.
_COMMON = {"quot": '"', "apos": "'", "#39": "'", "lt": "<", "gt": ">", "nbsp": " ", "middot": "·", "copy": "©", "amp": "&"}
_RARE = rf"&(?!(?:{'|'.join(_COMMON)});)"
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def _decoder(closed: bool) -> Callable[[Column], Column]:
    def one(m):
        if closed and not (m[0].endswith(";") and (m[0][1] == "#" or m[0][1:] in html5)):
            return m[0]
        return markup.unescape(m[0]).replace("\xa0", " ")

    @F.pandas_udf(StringType())
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _REFERENCE.sub(one, t))

    return decode


def decode_references(text: Column, closed: bool = False) -> Column:
    """Every character reference, named or numbered, as its character; a no-break space as a plain one.

    closed leaves those without their semicolon as they are, "&amp" like "&am". Only texts
    that hold others than the common references travel to Python.
    """
    native = reduce(lambda t, name: F.replace(t, F.lit(f"&{name};"), F.lit(_COMMON[name])), _COMMON, text)
    rare = text.rlike(_RARE + ("(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);" if closed else "[#A-Za-z]"))
    return F.coalesce(_decoder(closed)(F.when(rare, text)), native)


def html_to_text(html: Column, closed: bool = False) -> Column:
    """Text of a page: blocks on lines of their own, link text without its target, no scripts, styles, menus or images.

    closed: references without their semicolon, such as a cut title ends with, stay as written.
    """
    out = F.regexp_replace(html, _UNREAD, "")
    out = F.regexp_replace(out, _TAG, "<$1>")  # from here on no tag has attributes
    out = _outside_menus(F.regexp_replace(out, r"(?s)<![A-Za-z][^>]*>", ""))
    out = F.regexp_replace(out, rf"(?i)</?({'|'.join(BLOCKS)})>", "\n")
    out = F.regexp_replace(out, r"</?[A-Za-z][^\s>]*>", "")
    out = decode_references(out, closed)
    out = F.regexp_replace(out, r"[ \t]*\n[ \t\n]*", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def limit_pages(pages: DataFrame, max_pages: int) -> DataFrame:
    """The first pages of each document (document_id, page, text), with scanned and truncated flags."""
    n = F.max("page").over(Window.partitionBy("document_id"))
    counted = pages.withColumns({"truncated": n > max(1, max_pages), "scanned": F.length(F.trim(F.coalesce("text", F.lit("")))) < 20})
    return counted.where(F.col("page") <= max(1, max_pages))


def assemble_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One text per document, pages joined by a blank line, and each page's [start, end) in it."""
    before = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    offsets = pages.select("document_id", "page", start.alias("start"), (start + F.length("text")).alias("end"))
    listed = F.array_sort(F.collect_list(F.struct("page", "text")))
    texts = pages.groupBy("document_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("text"))
    return texts, offsets


# The exports by format, with the end of their file names.
EXPORTS = {"json": "estrutura", "tree": "arvore", "chunks": "chunks", "embeddings": "embeddings", "logs": "logs"}


def export_name(name: Column, kind: str) -> Column:
    """File name of an export: the name without its ending, runs of other than word characters and hyphens as one underscore."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"[^A-Za-z0-9_\-]+", "_")
    return F.concat(stem, F.lit(f"-{EXPORTS[kind]}.json"))


# The fields of the exported arrays, as (name in the export, column).
EXPORT_FIELDS = {
    "chunks": (
        ("index", "chunk_index"), ("content", "content"), ("tokenCount", "token_count"), ("charCount", "char_count"), ("part", "part"), ("totalParts", "total_parts"),
        ("originArticle", "origin_article"), ("originChapter", "origin_chapter"), ("originSection", "origin_section"), ("enrichment", "enrichment"),
    ),
    "embeddings": (
        ("chunkId", "chunk_id"), ("model", "model"), ("dimension", "dimension"), ("hash", "hash"), ("durationMs", "duration_ms"), ("indexed", "indexed"), ("indexedAt", "indexed_at"), ("metadata", "metadata"),
    ),
    "logs": (("id", "id"), ("documentId", "document_id"), ("step", "step"), ("level", "level"), ("message", "message"), ("meta", "meta"), ("createdAt", "created_at")),
}


def export_fields(kind: str, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """`export` of chunks, embeddings or logs with exactly their exported fields, nulls among them; a column that rows lack is null.

    Chunks come by index, logs by time, then id, embeddings by chunk.
    """
    column = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    order = {"chunks": ["chunk_index"], "embeddings": ["chunk_id"], "logs": ["created_at", "id"]}[kind]
    own = rows.select("document_id", *(column(c).alias(f"__{c}") for c in order), F.struct(*(column(c).alias(name) for name, c in EXPORT_FIELDS[kind])).alias("row"))
    named = documents.select("document_id", export_name(F.col("name"), kind).alias("file_name"))
    listed = F.array_sort(F.collect_list(F.struct(*(f"__{c}" for c in order), F.to_json("row", {"ignoreNullFields": "false"}).alias("json"))))
    bodies = own.groupBy("document_id").agg(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["json"]), ","), F.lit("]")).alias("body"))
    return named.join(bodies, "document_id", "left").withColumn("body", F.coalesce("body", F.lit("[]")))


def export(kind: str, documents: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """(document_id, file_name, body): one JSON text for each document (document_id, name) with rows in that order.

    rows carry document_id, the order and what is exported. An export of one value for a
    document, as of its law, has a single row and is an object; so is a tree, whose rows
    (document_id, tree) hold JSON already; the others are arrays, and empty for a document
    without rows.
    """
    fields = [c for c in rows.columns if c != "document_id" and not c.startswith("__")]
    own = F.struct(*fields)
    named = documents.select("document_id", export_name(F.col("name"), kind).alias("file_name"))
    if kind == "tree":
        return named.join(rows.select("document_id", F.col("tree").alias("body")), "document_id", "left").withColumn("body", F.coalesce("body", F.lit("null")))
    if kind == "json":
        return named.join(rows.select("document_id", F.to_json(own).alias("body")), "document_id", "left").withColumn("body", F.coalesce("body", F.lit("null")))
    listed = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), own.alias("row"))))
    bodies = rows.groupBy("document_id").agg(F.to_json(F.transform(listed, lambda x: x["row"])).alias("body"))
    return named.join(bodies, "document_id", "left").withColumn("body", F.coalesce("body", F.lit("[]")))


def write_exports(exports: DataFrame, path: str) -> None:
    """Exports as JSON lines, in one folder for each document."""
    exports.write.mode("overwrite").partitionBy("document_id").json(path)
