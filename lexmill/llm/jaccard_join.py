"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts are sets of word shingles. Shingles are ordered from globally rare to globally
frequent; two similar sets must share at least l of the first n - ceil(t*n) + l shingles
of each, for every l. Each text picks its own l: where the frequencies say that its
prefix would meet many others, a longer prefix with more required matches is cheaper
than verifying what a single match lets through.

Steps, all linear in the input but the few pairs that pass the filters:

1. One pass hashes the texts: set size, a fingerprint of the set, and a frequency sketch
   of fixed size (`SKETCH_BITS`), summed in Spark. The sketch only fixes the order and
   the costs; a wrong count costs time, never a link.
2. Equal sets are one class. The classes' prefix shingles are shuffled by shingle.
3. In every list of a shingle, each class is first tried against the class that holds the
   shingle earliest, so a large group of near copies becomes one component in linear work.
4. What remains are pairs across components: the exact multi-match join with length and
   position filters, verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm import counts
from lexmill.llm import textscan as ts
from lexmill.llm.components import components
from lexmill.llm.store import Scratch

#: 2**20 counters: 8 MB, whatever the corpus.
SKETCH_BITS = 20
#: Bits of the filter that tells which sets verification needs: 1 MB; a full filter only lets more sets through.
NEEDED_BITS = 23
MAX_LEVEL = 8
#: In lists of more classes than this, pairs are met with their whole prefixes at hand instead of being counted.
LONG_LIST = 64
U64 = np.uint64
_SALT = U64(0xA5A5F00D12345677)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; a text of fewer words is one shingle."""
    codes, seps = ts.byte_codes(lower=True), ts.separators(white_space_only=True)
    for row, end, data, at in ts.chunks(column):
        words = ts.scan_words(data, at, codes, seps)
        hashes, first = ts.window_hashes(words, width)
        cut = np.searchsorted(first, words.first)
        n_words = np.diff(words.first)
        for k in range(end - row):
            if n_words[k] >= width:
                yield row + k, np.unique(hashes[cut[k] : cut[k + 1]])
            else:
                own = words.hashes[words.first[k] : words.first[k + 1]]
                whole = np.array([len(own)], dtype=U64)
                for h in own:
                    whole = ts.mix(whole * U64(0xC2B2AE3D27D4EB4F) + h)
                yield row + k, whole[: len(own)]


def set_class(shingles: np.ndarray) -> int:
    """A fingerprint that equal sets share, as a signed 64-bit number."""
    total = np.add.reduce(ts.mix(shingles ^ _SALT)) + U64(len(shingles))
    return int(ts.mix(np.array([total], dtype=U64)).view(np.int64)[0])


def _scan_signatures(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def scan(batches):
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            n, cls, seen = [], [], []
            for _, shingles in shingle_sets(batch.column(1), width):
                n.append(len(shingles))
                cls.append(set_class(shingles) if len(shingles) else None)
                seen.append(shingles)
            if seen:
                where = np.concatenate(seen) & U64((1 << SKETCH_BITS) - 1)
                sketch += np.bincount(where.astype(np.int64), minlength=len(sketch))
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema
            )
        if sketch.any():
            yield _sketch_rows(sketch, schema)

    return scan


def _sketch_rows(sketch: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    columns = dict(zip(("block", "counts"), counts.rows(sketch).columns, strict=True))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(counts.BLOCKS).cast(f.type)) for f in schema], schema=schema)


def prefix_length(n: int, percent: int) -> int:
    """Length of the one-match prefix: a partner shares at least ceil(t*n) shingles."""
    return n - ceil(percent * n / 100 - 1e-9) + 1


def ordered_prefix(shingles: np.ndarray, sketch: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The adaptive prefix of a set, rarest shingle first, and its number of required matches.

    The cost of level l is the number of list entries met, plus their share that passes
    the l matches times the cost of verifying a set of this size. `noise` is the sketch's
    mean: what other shingles add to a counter.
    """
    n = len(shingles)
    base = prefix_length(n, percent)
    count = sketch[(shingles & U64(len(sketch) - 1)).astype(np.int64)]
    order = np.argsort(count, kind="stable")[: base + MAX_LEVEL - 1]
    met = np.cumsum(np.maximum(0.0, count[order] - noise - 4 * noise**0.5 - 1))
    levels = np.arange(1, min(MAX_LEVEL, n - base + 1) + 1)
    cost = met[base + levels - 2] * (1 + n / 8 / levels)
    level = int(levels[np.argmin(cost)])
    return shingles[order[: base + level - 1]], level


def _scan_postings(width: int, percent: int, sketch):
    names = ["token", "cls", "n", "pos", "level"]

    def scan(batches):
        frequency, done = sketch.value, set()
        noise = float(frequency.mean())
        for batch in batches:
            tokens, rows = [], []
            for _, shingles in shingle_sets(batch.column(0), width):
                if not len(shingles) or (cls := set_class(shingles)) in done:
                    continue
                done.add(cls)
                prefix, level = ordered_prefix(shingles, frequency, noise, percent)
                tokens.append(prefix)
                rows.append((cls, len(shingles), level, len(prefix)))
            if len(done) > 1_000_000:  # only spares copies; forgetting them costs rows that the shuffle drops
                done = set()
            if rows:
                cls, n, level, size = (np.array(x) for x in zip(*rows, strict=True))
                pos = np.concatenate([np.arange(x, dtype=np.int32) for x in size])
                columns = [np.concatenate(tokens).view(np.int64), np.repeat(cls, size), np.repeat(n, size).astype(np.int32), pos, np.repeat(level, size).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return scan


def _scan_needed_sets(width: int, needed):
    def scan(batches):
        bits, done = needed.value, set()
        for batch in batches:
            out: tuple[list, list] = ([], [])
            doc_ids = batch.column(0).to_pylist()
            for row, shingles in shingle_sets(batch.column(1), width):
                if len(shingles) and doc_ids[row] is not None:
                    cls = set_class(shingles)
                    key = int(ts.mix(np.array([cls, doc_ids[row]], dtype=np.int64).view(U64)).sum() & U64((1 << NEEDED_BITS) - 1))
                    if bits[key >> 3] >> (key & 7) & 1 and (cls, doc_ids[row]) not in done:
                        done.add((cls, doc_ids[row]))
                        out[0].append(cls)
                        out[1].append(shingles.view(np.int64))
            if len(done) > 1_000_000:  # only spares rows that repeat an id: what comes twice is made one again after the join
                done = set()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["cls", "shingles"])

    return scan


def _mark_needed(batches):
    """Turns (cls, rep) rows into (byte of the filter, bits)."""
    for batch in batches:
        cls, rep = (batch.column(k).to_numpy(zero_copy_only=False).view(U64) for k in (0, 1))
        key = (ts.mix(cls) + ts.mix(rep)) & U64((1 << NEEDED_BITS) - 1)
        byte, bit = (key >> U64(3)).astype(np.int32), (U64(1) << (key & U64(7))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(byte), pa.array(bit)], names=["at", "bits"])


def _needed_filter(classes: DataFrame) -> np.ndarray:
    """A filter of fixed size over (cls, rep): at most 2**20 small rows reach the driver."""
    marks = classes.select("cls", "rep").mapInArrow(_mark_needed, "at int, bits int").groupBy("at").agg(F.bit_or("bits").cast("int").alias("bits"))
    packed = np.zeros((1 << NEEDED_BITS) // 8, dtype=np.uint8)
    found = marks.toArrow()
    packed[found["at"].to_numpy()] = found["bits"].to_numpy()
    return packed


def _meetings(rows: DataFrame, percent: int, *more: str, condition=None) -> DataFrame:
    """Classes of different groups in the list of one shingle, the smaller as a, that pass the filters there."""
    sides = [rows.select(F.col("token").alias(f"token_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "pos", "level", "group", *more))) for s in "ab"]
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cls_a") < F.col("cls_b")))
    on = (F.col("token_a") == F.col("token_b")) & (F.col("group_a") != F.col("group_b")) & smaller & _fits(percent, "a", "b")
    return sides[0].join(sides[1], on if condition is None else on & condition)


def _long_list_pairs(rows: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a shingle of a long list, each met once.

    In a long list most classes share many of each other's shingles, so to write a row for
    each would multiply the pairs. Here rows carry the prefix itself: a pair comes out at
    its first shared shingle of a long list only, and only if all it shares is enough.
    """
    listed = lambda: F.array_sort(F.collect_list(F.struct("pos", "token")))
    long = rows.groupBy("cls").agg(F.transform(listed(), lambda x: x["token"]).alias("long"))
    prefix = lists.join(long.select("cls"), "cls", "left_semi").groupBy("cls").agg(listed().alias("p"))
    prefix = prefix.select("cls", F.transform("p", lambda x: x["token"]).alias("tokens"), F.transform("p", lambda x: x["pos"]).alias("places"))
    carried = rows.join(long, "cls").join(prefix, "cls")
    shared = F.array_intersect("tokens_a", "tokens_b")
    last = F.element_at(shared, -1)
    after = lambda s: F.col(f"n_{s}") - 1 - F.element_at(f"places_{s}", F.array_position(f"tokens_{s}", last).cast("int"))
    condition = (
        (F.element_at(F.array_intersect("long_a", "long_b"), 1) == F.col("token_a"))
        & (F.size(shared) >= F.least("level_a", "level_b"))
        & (F.size(shared) + F.least(after("a"), after("b")) >= _overlap(percent, F.col("n_a"), F.col("n_b")))
    )
    return _meetings(carried, percent, "long", "tokens", "places", condition=condition).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))


def _sets_of(pairs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, scratch: Scratch, name: str) -> DataFrame:
    """Whole sets of the classes in these pairs, read from their representatives' texts; repeated rows may repeat a class."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    needed = rows.sparkSession.sparkContext.broadcast(_needed_filter(classes.join(named, "cls", "left_semi")))
    return scratch.save(rows.mapInArrow(_scan_needed_sets(width, needed), "cls long, shingles array<long>"), name)


def _overlap(percent: int, na, nb):
    """How many shingles similar sets of these sizes share at least."""
    return F.ceil((na + nb) * percent / (100 + percent) - 1e-9)


def _multi_match(percent: int, met: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough prefix shingles; one row per pair and shared shingle comes in.

    They need as many as both levels require; and those up to the last one shared, with
    all that follows it, must reach the overlap. A similar pair passes `_fits` at every
    shingle it shares, so none of its own is missing from the count.
    """
    counted = met.groupBy("a", "b").agg(
        F.count("*").alias("shared"),
        F.min(F.least("level_a", "level_b")).alias("required"),
        F.min(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1).alias("after"),
        F.min(_overlap(percent, F.col("n_a"), F.col("n_b"))).alias("overlap"),
    )
    return counted.where("shared >= required and shared + after >= overlap").select("a", "b")


def _fits(percent: int, a: str, b: str):
    """Length and position filters for a shared shingle of the sets a (the smaller) and b.

    With l required matches, the shingle must lie in the first n_a - o(n_a, n_a) + l of a
    and the first n_b - o(t*n_b, n_b) + l of b, where o(x, y) = t/(1+t)*(x+y); and what
    follows it on both sides, with what precedes it, must still allow the overlap.
    """
    na, nb, pa_, pb = F.col(f"n_{a}"), F.col(f"n_{b}"), F.col(f"pos_{a}"), F.col(f"pos_{b}")
    level = F.least(F.col(f"level_{a}"), F.col(f"level_{b}"))
    return (
        (na * 100 >= nb * percent)
        & (pa_ < na - _overlap(percent, na, na) + level)
        & (pb < nb - F.ceil(nb * percent / 100 - 1e-9) + level)
        & (F.least(pa_, pb) + F.least(na - pa_, nb - pb) >= _overlap(percent, na, nb))
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    sizes = F.size("sa") + F.size("sb")
    return both.withColumn("inter", inter).where(F.col("inter") * 100 >= (sizes - F.col("inter")) * percent).select("a", "b").distinct()


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Link texts whose shingle sets have a Jaccard similarity of at least percent / 100.

    Words are runs of other than white space with A-Z lowered; a text's set holds its
    distinct shingles of `width` words, or the whole sequence if it has fewer words.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links), class_id (equal sets share it; null without words).

    * null or empty texts have the empty set, are linked with nothing and keep their own id;
    * repeated rows and exact copies form one class; ties go to the smaller doc_id;
    * a null doc_id is never linked: its component_id is null;
    * an empty table gives an empty result; further columns are ignored;
    * very long texts are one set in one row; nothing is cut.

    Shingles are 64-bit fingerprints; two different shingles are taken for the same one
    with a chance of 2**-64 a pair.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    scanned = scratch.save(rows.mapInArrow(_scan_signatures(width), "doc_id long, n long, cls long, block int, counts binary"), "scan")
    sketch = spark.sparkContext.broadcast(counts.total(scanned.where("block is not null"), 1 << SKETCH_BITS))
    signatures = scanned.where("block is null").select("doc_id", "n", "cls")
    classes = signatures.where("doc_id is not null and cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"))

    # Lists of the classes that share a prefix shingle; a shingle of a single class is of no use.
    postings = rows.where("doc_id is not null").select("text").mapInArrow(_scan_postings(width, percent, sketch), "token long, cls long, n int, pos int, level int")
    by_token = postings.repartition("token").dropDuplicates(["token", "cls"])
    token = Window.partitionBy("token")
    listed = by_token.withColumns({"df": F.count("*").over(token), "lead": F.min(F.struct("pos", "n", "cls", "level")).over(token)})
    lists = scratch.save(listed.where("df > 1").drop("df"), "lists")

    # First each class against the one that holds the shingle earliest.
    me, lead = F.struct("n", "cls", "pos", "level"), F.struct("lead.n", "lead.cls", "lead.pos", "lead.level")
    ordered = lists.where("cls <> lead.cls").select(F.least(me, lead).alias("x"), F.greatest(me, lead).alias("y"))
    star = _multi_match(
        percent,
        ordered.select(
            *(F.col(f"x.{c}").alias(f"{c}_a") for c in ("cls", "n", "pos", "level")), *(F.col(f"y.{c}").alias(f"{c}_b") for c in ("cls", "n", "pos", "level"))
        )
        .where(_fits(percent, "a", "b"))
        .withColumnsRenamed({"cls_a": "a", "cls_b": "b"}),
    )
    star = scratch.save(star, "star")

    links = scratch.save(_verified(star, _sets_of(star, rows, classes, width, scratch, "sets-star"), percent), "links-star")
    scratch.drop("sets-star")
    first = scratch.save(components(links, scratch, "first").withColumnsRenamed({"node": "cls", "comp": "group"}), "groups")

    # Then the exact join across what these links have left apart.
    grouped = lists.drop("lead").join(first, "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    split = grouped.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("held")).where("lo <> hi").select("token", "held")
    across = scratch.save(grouped.join(split, "token"), "across")
    met = _meetings(across.where(F.col("held") <= LONG_LIST), percent)
    few = _multi_match(percent, met.withColumnsRenamed({"cls_a": "a", "cls_b": "b"}))
    many = _long_list_pairs(across.where(F.col("held") > LONG_LIST), lists, percent)
    pairs = few.unionByName(many).distinct().join(star, ["a", "b"], "left_anti")
    pairs = scratch.save(pairs, "pairs")
    more = _verified(pairs, _sets_of(pairs, rows, classes, width, scratch, "sets-across"), percent)
    all_links = scratch.save(links.unionByName(more), "links")
    scratch.drop("sets-across", "pairs", "across", "lists", "star", "links-star", "groups")
    groups = components(all_links, scratch, "all")

    labelled = classes.join(groups.withColumnsRenamed({"node": "cls", "comp": "group"}), "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    least = labelled.groupBy("group").agg(F.min("rep").alias("component_id"))
    component = labelled.join(least, "group").select("cls", "component_id")
    return signatures.join(component, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.col("cls").alias("class_id"),
    )


def near_duplicate_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that are the smallest doc_id of their component.

    Rows with a null doc_id, a null or an empty text stay, for they are linked with nothing;
    of rows that repeat a doc_id all stay or all go; an empty table gives an empty result,
    and further columns stay as they are.
    """
    parts = similarity_components(docs, id_col, text_col, width, percent)
    gone = parts.where("doc_id <> component_id").select("doc_id").distinct()
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    return whole.join(gone, "doc_id", "left_anti").select("row.*")
