"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each text is the set of its hashed character n-grams. On labelled texts the log ratio of
smoothed counts in toxic and other texts scales every n-gram, whichever side it speaks
for; n-grams with too little evidence are left out, and a logistic regression on the
scaled features gives the weights. Scoring is one pass over all whole texts with one
weight table of fixed size. The table is large, so that the many n-grams of a very long
text seldom fall on the place of another one that counts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import counts
from lexmill.llm import textscan as ts
from lexmill.llm.store import Scratch

#: Size of the hashed feature space, and the lengths of the n-grams in characters.
HASH_BITS, LENGTHS = 21, (4, 5, 6, 7)
SIZE = 1 << HASH_BITS
#: At most this many labelled rows are fitted on, one an id: those with the smallest hash of their id.
MAX_FIT_ROWS = 10_000
#: The least likelihood-ratio statistic of an n-gram that is kept, and the fewest texts that hold it.
LEAST_EVIDENCE, LEAST_TEXTS = 8.0, 5
#: A text is predicted toxic from this score on.
THRESHOLD = 0.7


class Model(NamedTuple):
    """weights[h] for the n-grams hashed to h (0: not used), and the bias."""

    weights: np.ndarray
    bias: float


def _folding() -> np.ndarray:
    """ASCII other than letters reads as one space, so that marks around a word do not matter."""
    table = np.arange(128, dtype=np.uint32)
    table[[c for c in range(128) if not chr(c).isalpha()]] = 32
    return table


def ngram_hashes(texts: list[str | None]):
    """Yields (first text, number of texts, [(hashes, text of each hash) by length]) for runs of texts of bounded size."""
    folding, at = _folding(), 0
    while at < len(texts):
        parts, size = [], 0
        while at + len(parts) < len(texts) and (not parts or size < ts.CHUNK_BYTES):
            parts.append(f" {(texts[at + len(parts)] or '').lower()} ")
            size += len(parts[-1])
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars = np.where(chars < 128, folding[np.minimum(chars, 127)], chars)
        lengths = np.array([len(p) for p in parts])
        ends = np.repeat(np.cumsum(lengths), lengths)
        owner = np.repeat(np.arange(len(parts)), lengths)
        code = (chars + np.uint32(1)) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        found = []
        h = code.copy()
        for n in range(2, max(LENGTHS) + 1):
            h = h[:-1] * np.uint32(0x85EBCA6B) + code[n - 1 :]
            if n in LENGTHS:
                inside = np.arange(len(h)) + n <= ends[: len(h)]
                mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) + np.uint32(n)
                found.append(((mixed >> np.uint32(32 - HASH_BITS))[inside], owner[: len(h)][inside]))
        yield at, len(parts), found
        at += len(parts)


def distinct_features(texts: list[str | None], used: np.ndarray | None = None):
    """(text, feature) of the distinct n-grams of each text, as two arrays; only those marked as used."""
    rows, features = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for first, n, found in ngram_hashes(texts):
        if used is not None:
            hits = [(hashes[hit], owner[hit]) for hashes, owner in found for hit in [np.flatnonzero(used[hashes])]]
            key = np.unique(np.concatenate([owner.astype(np.int64) * SIZE + hashes for hashes, owner in hits]))
            rows.append(first + key // SIZE)
            features.append(key % SIZE)
            continue
        cuts = [np.searchsorted(owner, np.arange(n + 1)) for _, owner in found]
        for k in range(n):
            features.append(np.unique(np.concatenate([hashes[cut[k] : cut[k + 1]] for (hashes, _), cut in zip(found, cuts, strict=True)])).astype(np.int64))
            rows.append(np.full(len(features[-1]), first + k))
    return np.concatenate(rows), np.concatenate(features)


def _count_classes(batches):
    """Texts of each label that hold a feature: two vectors, after the numbers of texts of each label."""
    sums = np.zeros((2, SIZE), dtype=np.int32)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, batch.num_rows, 200):
            rows, features = distinct_features(batch.column(0).slice(at, 200).to_pylist())
            for y in (0, 1):
                np.add.at(sums[y], features[label[at + rows] == y], 1)
    if sums.any():
        yield counts.rows(sums.ravel())


def _used_features(used):
    def run(batches):
        for batch in batches:
            rows, features = distinct_features(batch.column(0).to_pylist(), used.value)
            lists = np.split(features, np.searchsorted(rows, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))], names=["label", "features"])

    return run


def log_count_ratios(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """log P(f | toxic) / P(f | other) with smoothing in proportion to the classes: an unseen feature is neutral."""
    share = n_positive / (n_positive + n_negative)
    return np.log((positive + share) / (n_positive + share)) - np.log((negative + 1 - share) / (n_negative + 1 - share))


def evidence(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """The likelihood-ratio statistic of each feature against independence of the label."""
    total = n_positive + n_negative

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0.0)

    held = positive + negative
    return 2 * sum(
        part(seen, of * n / total)
        for seen, of, n in ((positive, held, n_positive), (negative, held, n_negative), (n_positive - positive, total - held, n_positive), (n_negative - negative, total - held, n_negative))
    )


def logistic_regression(blocks: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100, memory: int = 10):
    """Weights and bias for rows that list their features, each of which counts as its scale.

    A block is some rows: the features of all, one row after the other, and how many each
    has. A limited-memory quasi-Newton method; a step costs two passes over the blocks, so
    that nothing of the size of all of them is made besides.
    """
    theta = np.zeros(len(scale) + 1)
    theta[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    first = np.cumsum([0, *(len(sizes) for _, sizes in blocks)])

    def loss(theta):
        weight, value, slope = theta[:-1] * scale, ridge / 2 * theta[:-1] @ theta[:-1], np.append(ridge * theta[:-1], 0.0)
        for at, (columns, sizes) in zip(first, blocks, strict=False):
            ends = np.cumsum(sizes)
            sums = np.append(0.0, np.cumsum(weight[columns]))
            z, own = sums[ends] - sums[ends - sizes] + theta[-1], y[at : at + len(sizes)]
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - own
            value += np.logaddexp(0, z).sum() - own @ z
            slope[:-1] += np.bincount(columns, np.repeat(error, sizes), minlength=len(scale)) * scale
            slope[-1] += error.sum()
        return value, slope

    value, slope = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max() < 1e-3:
            break
        way, kept = -slope, []
        for moved, turned, factor in reversed(past):
            kept.append(moved @ way * factor)
            way = way - kept[-1] * turned
        way = way * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(slope).max()))
        for (moved, turned, factor), k in zip(past, reversed(kept), strict=True):
            way = way + (k - turned @ way * factor) * moved
        length = 1.0
        while True:
            new, (new_value, new_slope) = theta + length * way, loss(theta + length * way)
            if new_value <= value + 1e-4 * length * (slope @ way) or length < 1e-6:
                break
            length /= 2
        moved, turned = new - theta, new_slope - slope
        if moved @ turned > 1e-12:
            past = [*past[1 - memory :], (moved, turned, 1 / (moved @ turned))]
        theta, value, slope = new, new_value, new_slope
    return theta[:-1], theta[-1]


def informative(by_label: np.ndarray, n_positive: int, n_negative: int) -> tuple[np.ndarray, np.ndarray]:
    """(all features with enough evidence, their log-count ratios) from the counts of other and toxic texts, a slice at a time."""
    found = []
    for at in range(0, by_label.shape[1], 1 << 18):
        negative, positive = (by_label[y, at : at + (1 << 18)].astype(float) for y in (0, 1))
        strength = evidence(positive, negative, n_positive, n_negative)
        own = np.flatnonzero((positive + negative >= LEAST_TEXTS) & (strength > LEAST_EVIDENCE))
        found.append((own + at, log_count_ratios(positive[own], negative[own], n_positive, n_negative)))
    features, ratio = (np.concatenate(c) for c in zip(*found, strict=True))
    return features, ratio


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit on at most max_rows labelled texts, those with the smallest hash of their id.

    Of rows that repeat an id only one is used, the smallest by text, then label (a null text
    is the smallest, and shows nothing), so that the bound is one of rows. Rows with a null
    label or id are not used; without rows of both labels every score is the share of toxic
    rows (0.5 without any).
    """
    spark = labelled.sparkSession
    usable = labelled.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    usable = usable.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label"))
    chosen = usable.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_rows)
    sample = usable.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("text", "label")).alias("row")).select("row.text", "row.label")
    scratch = Scratch(spark)
    sample = scratch.save(sample, "sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return Model(np.zeros(SIZE, dtype=np.float32), float(np.log(share / (1 - share))))
    by_label = counts.total(sample.mapInArrow(_count_classes, counts.SCHEMA), 2 * SIZE).reshape(2, SIZE)
    kept, ratio = informative(by_label, n1, n0)
    del by_label
    used = np.zeros(SIZE, dtype=bool)
    used[kept] = True
    table = sample.mapInArrow(_used_features(spark.sparkContext.broadcast(used)), "label int, features array<int>").toArrow()
    scratch.drop("sample")
    place = np.zeros(SIZE, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    y, blocks = table["label"].to_numpy().astype(float), []
    for batch in table.to_batches(max_chunksize=500):
        listed = batch.column(batch.schema.get_field_index("features"))
        blocks.append((place[listed.flatten().to_numpy()], listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    del table, place
    w, bias = logistic_regression(blocks, ratio, y)
    weights = np.zeros(SIZE, dtype=np.float32)
    weights[kept] = w * ratio
    return Model(weights, float(bias))


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    rows, features = distinct_features(texts, model.weights != 0)
    total = np.bincount(rows, model.weights[features], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: whole texts; null and empty ones get the score of no evidence.

    Repeated rows repeat, a null id stays null, an empty table gives an empty result and
    further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(part.column(1).to_pylist(), shared.value))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score stays below the threshold.

    Null and empty texts have the score of no evidence; rows that repeat an id are judged by
    their own text; ids are not looked at; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                yield part.filter(pa.array(score_texts(texts, shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    """The rows that no model sees: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most max_rows labelled ids that may be learned from, one label an id.

    They are chosen by their ids alone, as `fit` does; the texts then meet a list of so
    many ids, which is small enough for every executor, and are not shuffled. Rows that
    repeat an id all come, and `fit` takes one; rows with a null id or label, and labels
    without a document, are left out; empty tables give an empty result.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    present = one.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
