import random

from pyspark.sql import types as T

from lexmill.llm import jaccard_join
from tests.llm.brute import jaccard_components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType())])


def near_copies(seed=3):
    """Groups of copies with more and more edits, some unrelated texts and edge cases."""
    rnd = random.Random(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(300)]
    for group in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 20, 60, 150]))]
        for copy in range(15):
            words = list(base)
            for _ in range(copy // 3):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append(" ".join(words).upper() if copy == 7 else "\t ".join(words))
    rows += ["", None, "one", "one", "one two", "ONE\x0btwo", " \n ", "é É", "É é"]
    rnd.shuffle(rows)
    return list(enumerate(rows, start=5))


def test_components_equal_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    for width, percent in ((4, 85), (5, 80)):
        want = jaccard_components(rows, width, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(docs, width=width, percent=percent).collect()}
        assert got == want


def test_long_lists_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 3)
    rows = near_copies(seed=8)
    want = jaccard_components(rows, 4, 85)
    got = jaccard_join.similarity_components(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), width=4, percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_null_ids_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "x"), (2, "a b c d e f", None), (1, "a b c d e f", "y"), (1, "a b c d e f", "y")], SCHEMA)
    got = jaccard_join.similarity_components(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1), (1, 1), (2, 1), (None, None)]
    kept = jaccard_join.near_duplicate_representatives(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, None]
    assert jaccard_join.similarity_components(docs.limit(0)).count() == 0
