"""Empty tables, nulls, repeats, clashing columns and long texts, for every operator and every stage of the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import bpe, html_text, jaccard_join, license_scan, packing, pii, quality, substring_dedup, toxicity

#: Columns whose names the operators use themselves.
CLASHING = ("key", "whole", "n", "cls", "rank", "score", "spans", "__doc", "__spans", "__gone", "group", "label")
WORDS = "the of and to in is that house cat dog tree garden walks sees red blue".split()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    prose = [" ".join(rnd.choice(WORDS) for _ in range(n)) for n in (0, 3, 20, 60, 60, 200)]
    rows = [(i, t, "en") for i, t in enumerate([*prose, None, "", prose[4], "é" * 200_000, "x " * 50_000, "\n" * 1000])]
    rows += [(4, prose[4], "en"), (4, prose[5], None), (None, prose[5], "en"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, ("bad awful " if i % 2 else "nice kind ") + WORDS[i % len(WORDS)], i % 2) for i in range(200)]
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))


def test_the_bound_of_the_fit_is_one_of_rows(spark, monkeypatch):
    seen = []
    real = toxicity.informative
    monkeypatch.setattr(toxicity, "informative", lambda counts, n1, n0: seen.append(n1 + n0) or real(counts, n1, n0))
    rows = [(i % 7, f"{'bad awful' if i % 7 % 2 else 'nice kind'} {i}", i % 7 % 2) for i in range(400)] + [(None, "bad", 1), (8, None, 1), (9, "x", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    toxicity.fit(labelled, max_rows=5)
    toxicity.fit(labelled)
    assert seen == [5, 8]
    assert toxicity.fit(labelled.limit(0)).bias == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.training_rows(labelled, labels).select("doc_id", "label").distinct().collect()
    assert {tuple(r) for r in got} <= {(1, 1), (2, 0)}


def per_row(model):
    vocabularies = pytest.importorskip("public_tokenizers")
    path = vocabularies.path("word_bpe_49k.json")
    return {
        "op1": jaccard_join.similarity_components,
        "op3": substring_dedup.remove_repeats,
        "op4": lambda d: pii.span_digest(pii.find_personal_data(d)),
        "op5": quality.judge,
        "op6": lambda d: html_text.extract_table(d.withColumns({"page_id": F.col("doc_id"), "url": F.lit("u"), "html": F.col("text")})),
        "op7": lambda d: bpe.encode_table(d, path),
        "op9": license_scan.scan,
        "op10": lambda d: toxicity.score(d, model),
    }


def test_a_result_for_every_row_and_the_same_for_repeats(docs, model):
    n = docs.count()
    for name, run in per_row(model).items():
        got = run(docs).collect()
        assert len(got) == n, name
        ids = [r[0] for r in got]
        assert sorted(ids, key=str) == sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str), name


def test_empty_tables(docs, model):
    for name, run in per_row(model).items():
        assert run(docs.limit(0)).count() == 0, name
    assert packing.pack(docs.limit(0)).count() == 0


def test_repeated_rows_get_equal_results(docs, model):
    twice = docs.where("doc_id in (3, 5)").unionByName(docs.where("doc_id in (3, 5)"))
    for name, run in per_row(model).items():
        rows = [tuple(r) for r in run(twice).collect()]
        assert len(rows) == 4 and len(set(rows)) == 2, name


def test_packing_covers_repeats_nulls_and_long_texts(docs):
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows) == sum(len((r.text or "").split()) for r in docs.select("text").collect())
    bins = {}
    for r in rows:
        if r.bin is not None:
            bins.setdefault((r.bin_group, r.bin), []).append(r)
    for own in bins.values():
        assert sum(r.length for r in own) == own[0].bin_used <= own[0].bin_capacity
    again = packing.pack(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_stages_keep_rows_and_columns(docs, model):
    stages = {
        "toxicity": lambda d: toxicity.reject(d, model),
        "near duplicates": jaccard_join.near_duplicate_representatives,
        "substring dedup": substring_dedup.cut_repeats,
        "pii": pii.redact,
    }
    for name, stage in stages.items():
        got = stage(docs)
        assert got.columns == docs.columns, name
        assert stage(docs.limit(0)).count() == 0, name
        rows = got.collect()
        assert all(r.key == "key" and r["__spans"] == "__spans" for r in rows), name
        assert sum(r.doc_id is None for r in rows) == 2, name
        assert any(r.doc_id == 9 and r.text == "é" * 200_000 for r in rows), name


def test_the_pipeline_on_empty_and_odd_tables(spark, docs, tmp_path):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (77, None)], "doc_id long, toxic int")
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.where("false" if name == "none" else "true").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(got) == 0) == (name == "none")
