"""Repeated passages by recompression.

Rounds rename a text's words: a run of one symbol becomes a new symbol, and so does a pair
whose first symbol falls in the left and whose second in the right half of the alphabet.
Names are fingerprints of what they stand for, so every task gives the same run or pair
the same name in every text, and a round needs no exchange. What becomes of a symbol
depends on its neighbours only; the words that decide it are its context. A symbol whose
context lies inside a window is named alike wherever that window occurs.

So each window of `width` words is filed under one symbol that it decides by itself (the
one with the largest name), and windows in a row under one symbol form a stretch:

1. Stretches are shuffled by the fingerprint of their symbol's context. Where the whole
   stretch equals one of a smaller document, all its windows repeat.
2. Stretches that meet only different ones (the ends of passages) are compared window by
   window, among one representative of each distinct stretch.
3. Covered words are removed.

Ranges are equal if two independent 64-bit fingerprints of all their words are. A row that
repeats another of a smaller document in the same task is settled there, so that a passage
which most documents share does not gather in the task of its key.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm import membership
from lexmill.llm import textscan as ts
from lexmill.llm.store import Scratch

U64 = ts.U64
#: Two rounds: a symbol and its context then span about 8 words, which every window of 13 without long runs holds.
ROUNDS = 2
FAR = np.int64(1) << np.int64(60)
#: Of the second fingerprint that equal ranges must share.
CHECK = 0x2545F4914F6CDD1D
#: Rows that a task gathers to find copies among them before they are shuffled.
HELD = 1 << 17
CODES, SEPARATORS = ts.byte_codes(lower=False), ts.separators(white_space_only=True)


class Symbols(NamedTuple):
    """Symbols of a chunk in order: names, and the context [lo, hi) in words; a text's edge is FAR away."""

    name: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray


def _shifted(x: np.ndarray, by: int, edge) -> np.ndarray:
    out = np.full_like(x, edge)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def compress_round(s: Symbols, salt: int) -> Symbols:
    """One round: name the runs, then the pairs across the halves of the alphabet."""
    n = len(s.name)
    if not n:
        return s
    same_doc = np.zeros(n, dtype=bool)
    same_doc[1:] = s.doc[1:] == s.doc[:-1]
    repeats = np.zeros(n, dtype=bool)
    repeats[1:] = same_doc[1:] & (s.name[1:] == s.name[:-1])
    first = np.flatnonzero(~repeats)
    last = np.append(first[1:], n) - 1
    length = (last - first + 1).astype(U64)
    name = np.where(length > U64(1), ts.mix(s.name[first] * U64(0x9FB21C651E98DF25) + length + U64(salt)), s.name[first])
    doc = s.doc[first]
    # To see that a run ends, its neighbours must be known.
    before, after = s.doc[np.maximum(first - 1, 0)] == doc, s.doc[np.minimum(last + 1, n - 1)] == doc
    lo = np.where(before & (first > 0), s.lo[np.maximum(first - 1, 0)], -FAR)
    hi = np.where(after & (last < n - 1), s.hi[np.minimum(last + 1, n - 1)], FAR)
    left = (ts.mix(name + U64(salt)) & U64(1)) == U64(0)
    next_same = _shifted(doc, -1, -1) == doc
    joins = left & ~_shifted(left, -1, True) & next_same
    joined = _shifted(joins, 1, False)
    out = np.flatnonzero(~joined)
    pair = joins[out]
    other = np.minimum(out + 1, len(name) - 1)
    new = np.where(pair, ts.mix(name[out] * U64(0xE7037ED1A0B428DB) + ts.mix(name[other] + U64(salt))), name[out])
    # A pair is decided by both; a symbol alone by the neighbour it might have joined.
    prev_same = _shifted(doc, 1, -1)[out] == doc[out]
    new_lo = np.where(pair | left[out], lo[out], np.where(prev_same, np.minimum(lo[out], lo[np.maximum(out - 1, 0)]), -FAR))
    new_hi = np.where(pair | left[out], np.where(next_same[out], np.maximum(hi[out], hi[other]), FAR), hi[out])
    return Symbols(new, new_lo, new_hi, doc[out])


class Ranges:
    """Fingerprints of any range of words of a chunk; with another salt, of other ones."""

    def __init__(self, words: ts.Words, salt: int = 0):
        n = len(words.hashes)
        base, self.inverse = ts.powers(n + 1)
        self.sums, self.salt = np.zeros(n + 1, dtype=U64), U64(salt)
        np.cumsum((ts.mix(words.hashes ^ self.salt) if salt else words.hashes) * base[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return ts.mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F) + self.salt)


def stretches(words: ts.Words, ranges: Ranges, width: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, key, fingerprint of all their words) of the stretches of a chunk."""
    doc = words.doc()
    at = np.arange(len(doc))
    s = Symbols(words.hashes, at, at + 1, doc)
    for k in range(ROUNDS):
        s = compress_round(s, 0x51ED27 + k)
    end_of = words.first[1:]
    windows = at[at + width <= end_of[doc]] if len(doc) else at
    filed = np.full(len(doc), -1)
    inner = np.flatnonzero((s.lo >= 0) & (s.hi < FAR) & (s.hi - s.lo <= width))
    inner = inner[np.argsort(s.name[inner], kind="stable")]
    low = np.maximum(s.hi[inner] - width, words.first[s.doc[inner]])
    high = np.minimum(s.lo[inner], end_of[s.doc[inner]] - width)
    size = np.maximum(high - low + 1, 0)
    slot = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
    filed[slot] = np.repeat(inner, size)  # in the order of names: the largest stays
    own = filed[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (own[1:] < 0) | (np.diff(windows) != 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(windows)))
    start, symbol = windows[head], own[head]
    whole = ranges.of(start, start + count + width - 1)
    key = whole.copy()
    has = symbol >= 0
    key[has] = ranges.of(s.lo[symbol[has]], s.hi[symbol[has]])
    return start, count, key, whole


def _first_known(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Adds whether a smaller document among these rows has the same words; such rows need no other.

    columns are the key to shuffle by, the two fingerprints of the words, the document and
    more. Rows whose answer is known leave their key for one of their own, so that a
    passage of very many documents sends one row a task to its key, not one a document.
    """
    key, whole, check, doc = columns[:4]
    order = np.lexsort((doc, check, whole))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(whole[order]) != 0) | (np.diff(check[order]) != 0)
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    known = np.zeros(len(order), dtype=bool)
    known[order] = doc[order] > least
    spread = ts.mix(whole.view(U64) + ts.mix(doc.view(U64)) + np.arange(len(doc), dtype=U64)).view(np.int64)
    return [np.where(known, spread, key), *columns[1:], known]


def _gathered(parts, names: list[str]):
    """Record batches of the rows in parts (lists of columns), with what `_first_known` says of HELD or more at a time."""
    held, n = [], 0
    for columns in parts:
        held.append(columns)
        n += len(columns[0])
        if n >= HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _first_known([np.concatenate(c) for c in zip(*held, strict=True)])], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _first_known([np.concatenate(c) for c in zip(*held, strict=True)])], names=names)


def _file_windows(width: int):
    def parts(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, end, data, at in ts.chunks(batch.column(1)):
                words = ts.scan_words(data, at, CODES, SEPARATORS)
                start, count, key, whole = stretches(words, Ranges(words), width)
                check = Ranges(words, CHECK).of(start, start + count + width - 1)
                doc = words.doc()[start]
                yield [key.view(np.int64), whole.view(np.int64), check.view(np.int64), ids[row:end][doc], (start - words.first[doc]).astype(np.int32), count.astype(np.int32)]

    return lambda batches: _gathered(parts(batches), ["key", "whole", "check", "doc_id", "start", "count", "known"])


def _needed_texts(packed):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(membership.holds(packed.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return run


def _confirmed(words: ts.Words, ranges: Ranges, first: int, n: int, spans: pa.StructScalar, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of windows) of those listed stretches whose words are the claimed ones."""
    start = spans.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    count = spans.field("count").to_numpy(zero_copy_only=False).astype(np.int64)
    whole = spans.field("whole").to_numpy(zero_copy_only=False).view(U64)
    fits = np.flatnonzero(start + count + width - 1 <= n)
    start, count, whole = start[fits], count[fits], whole[fits]
    right = ranges.of(first + start, first + start + count + width - 1) == whole
    return start[right], count[right]


def _single_windows(width: int):
    """Fingerprints of every window of the listed stretches."""

    def parts(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for row, end, data, at in ts.chunks(batch.column(1)):
                words = ts.scan_words(data, at, CODES, SEPARATORS)
                ranges, checks = Ranges(words), Ranges(words, CHECK)
                for k in range(end - row):
                    first, n = words.first[k], words.first[k + 1] - words.first[k]
                    start, count = _confirmed(words, ranges, first, n, lists[row + k].values, width)
                    at_word = np.unique(np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum()))
                    whole, check = (r.of(first + at_word, first + at_word + width).view(np.int64) for r in (ranges, checks))
                    yield [whole, whole, check, np.full(len(whole), ids[row + k]), at_word.astype(np.int32)]

    return lambda batches: _gathered(parts(batches), ["key", "whole", "check", "doc_id", "start", "known"])


def _cover(n: int, start: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(width: int, keep_text: bool):
    """Finishes rows whose text is still there: words counted, covered ones removed."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            for row, end, data, at in ts.chunks(batch.column(1)):
                words = ts.scan_words(data, at, CODES, SEPARATORS)
                ranges, out = Ranges(words), ([], [], [], [])
                raw = data.tobytes()
                for k in range(end - row):
                    first, n = words.first[k], words.first[k + 1] - words.first[k]
                    gone = np.zeros(n, dtype=bool)
                    if lists[row + k].is_valid:
                        gone = _cover(n, *_confirmed(words, ranges, first, n, lists[row + k].values, width), width)
                    kept = np.flatnonzero(~gone) + first
                    digest = b" ".join([raw[a:b] for a, b in zip(words.start[kept].tolist(), words.end[kept].tolist(), strict=True)])
                    out[0].append(n)
                    out[1].append(int(gone.sum()))
                    out[2].append(hashlib.sha256(digest).hexdigest())
                    if keep_text:
                        whole = raw[at[k] : at[k + 1]]
                        out[3].append((_pieces(raw, words, kept) if gone.any() else whole).decode())
                columns = [batch.column(0).slice(row, end - row), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array(out[3], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _pieces(raw: bytes, words: ts.Words, kept: np.ndarray) -> bytes:
    """The kept words with the text between neighbours as it was, and one space where words went."""
    if not len(kept):
        return b""
    cut = np.flatnonzero(np.diff(kept) > 1)
    heads, tails = kept[np.append(0, cut + 1)], kept[np.append(cut, len(kept) - 1)]
    return b" ".join([raw[a:b] for a, b in zip(words.start[heads].tolist(), words.end[tails].tolist(), strict=True)])


def repeated_stretches(rows: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(doc_id, start, count, whole): stretches of windows that all start in a smaller document too."""
    spark = rows.sparkSession
    known = rows.where("doc_id is not null")
    filed = known.mapInArrow(_file_windows(width), "key long, whole long, check long, doc_id long, start int, count int, known boolean").repartition("key")
    same, key = Window.partitionBy("key", "whole", "check"), Window.partitionBy("key")
    judged = filed.withColumn("first_same", F.min("doc_id").over(same)).withColumns({"lo": F.min("whole").over(key), "hi": F.max("whole").over(key)})
    repeats = F.col("known") | (F.col("first_same") < F.col("doc_id"))
    found = judged.where(repeats | (F.col("lo") != F.col("hi"))).select("doc_id", "start", "count", "whole", repeats.alias("repeats"))
    found = scratch.save(found, "stretches")
    full = found.where("repeats").select("doc_id", "start", "count", "whole")

    ends = found.where("not repeats").select("doc_id", F.struct("start", "count", "whole").alias("s")).groupBy("doc_id").agg(F.collect_list("s").alias("spans"))
    ends = scratch.save(ends, "ends")
    needed = spark.sparkContext.broadcast(membership.build(ends.select("doc_id")))
    texts = known.mapInArrow(_needed_texts(needed), "doc_id long, text string").join(ends, "doc_id").select("doc_id", "text", "spans")
    single = texts.mapInArrow(_single_windows(width), "key long, whole long, check long, doc_id long, start int, known boolean").repartition("key")
    first = single.withColumn("first", F.min("doc_id").over(Window.partitionBy("key", "whole", "check"))).where("known or first < doc_id")
    return full.unionByName(first.select("doc_id", "start", F.lit(1).alias("count"), "whole"))


def repeat_lists(rows: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(doc_id, spans) of the documents that lose words; a list is bounded by its document."""
    found = repeated_stretches(rows, width, scratch)
    lists = scratch.save(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count", "whole")).alias("spans")), "lists")
    scratch.drop("stretches", "ends")
    return lists


def _free_name(columns: list[str]) -> str:
    name = "spans"
    while name in columns:
        name += "_"
    return name


def cut_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose texts have lost what `remove_repeats` removes.

    Texts that lose nothing are unchanged; in the others what lies between kept neighbours
    stays as it was, and one space stands where words went. A null text stays null; a row
    with a null id loses nothing; rows that repeat an id are each judged by their own text,
    and not against each other; an empty table gives an empty result; further columns,
    whatever their names, stay as they are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lists = repeat_lists(rows, width, Scratch(docs.sparkSession))
    # The documents' own columns travel as one struct, so none of their names can clash.
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    joined = whole.join(lists, "doc_id", "left").select("row.*", F.col("spans").alias(_free_name(docs.columns)))
    finish = _remove(width, True)

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            text, spans = batch.column(k), batch.column(batch.num_columns - 1)
            done = finish([pa.RecordBatch.from_arrays([pa.nulls(len(text)).cast(pa.int64()), text.cast(pa.string()), spans], names=["doc_id", "text", "spans"])])
            new = pa.chunked_array([d.column(4) for d in done], pa.string()).combine_chunks()
            new = new.chunk(0) if isinstance(new, pa.ChunkedArray) else new
            kept = pa.compute.if_else(text.is_valid(), new, pa.nulls(len(text), pa.string())).cast(batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([kept if j == k else c for j, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove each word covered by a window whose words also start in a document of a smaller id.

    A window is `width` words in a row of one text (runs of other than white space, case
    kept), judged on the input. Returns doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space), and kept_text on request, one row per input row.

    * null and empty texts have no words, and texts of fewer than `width` lose none;
    * rows that repeat a doc_id do not count as smaller than each other, each is judged by
      its own text; of copies the smallest doc_id keeps its words;
    * a row with a null doc_id loses nothing and takes nothing from others;
    * an empty table gives an empty result; further columns are ignored.

    Windows are told apart by two independent fingerprints of 64 bits each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lists = repeat_lists(rows, width, scratch)
    packed = spark.sparkContext.broadcast(membership.build(lists.select("doc_id")))
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    finish = _remove(width, keep_text)

    def ahead(batches):
        """Texts that lose nothing are finished where they are read; the others go on whole."""
        for batch in batches:
            ids = batch.column(0)
            waits = membership.holds(packed.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            go, stay = batch.filter(pa.array(waits)), batch.filter(pa.array(~waits))
            for done in finish([stay.append_column("spans", pa.nulls(stay.num_rows))]):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(done.num_rows, dtype=bool)), pa.nulls(done.num_rows).cast(pa.string()), *done.columns], names=["done", "text", *done.schema.names])
            none = [pa.nulls(go.num_rows).cast(t) for t in (pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(go.num_rows, dtype=bool)), go.column(1), go.column(0), *none], names=["done", "text", "doc_id", *[c.split()[0] for c in columns.split(", ")[1:]]])

    read = scratch.save(rows.mapInArrow(ahead, f"done boolean, text string, {columns}"), "read")
    rest = read.where("not done").select("doc_id", "text").join(lists, "doc_id", "left").select("doc_id", "text", "spans")
    return read.where("done").drop("done", "text").unionByName(rest.mapInArrow(finish, columns))
