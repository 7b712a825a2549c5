import hashlib
import random

from pyspark.sql import types as T

from lexmill.llm import substring_dedup
from tests.llm.brute import removed_words

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())])


def passages(seed=5):
    """Texts with shared passages of many lengths, runs, periods, copies and edge cases."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [[rnd.choice(vocabulary) for _ in range(n)] for n in (12, 13, 14, 20, 55, 90)] + [["a"] * 20, ["a", "b"] * 15, ["x", "y", "z"] * 12]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(rnd.randrange(5)):
            p = rnd.choice(shared)
            lo = rnd.randrange(len(p))
            parts += p if rnd.random() < 0.5 else p[lo : lo + rnd.randrange(1, 40)]
            parts += [rnd.choice(vocabulary) for _ in range(rnd.randrange(12))]
        rows.append(rnd.choice([" ", "\n", " \t"]).join(parts))
    rows += ["", None, "a", rows[3], rows[3], " ".join(["a"] * 300), " ".join(["a"] * 13), " ".join(["b", "a"] * 40)]
    rnd.shuffle(rows)
    out = list(enumerate(rows))
    return [*out, (7, rows[9]), (None, rows[3]), (None, None)]


def digest(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def test_removal_equals_brute_force(spark):
    rows = passages()
    want = sorted(((i, n, k, digest(w)) for i, n, k, w in removed_words(rows)), key=str)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = substring_dedup.remove_repeats(docs, keep_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    assert all(digest(r.kept_text.split()) == r.kept_sha256 for r in got)


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
