import random

import corpus_pipeline
from lexmill.llm import pii, toxicity
from tests.llm.brute import jaccard_components, removed_words


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rnd = random.Random(11)
    vocabulary = [f"term{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(400):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(8, 90))]
        if i % 7 == 0:
            words[3] = rnd.choice(["dreadfool", "nastymoron"])
        if i % 10 == 3:
            words[5:5] = passage.split()
        if i % 11 == 4:
            words.append("mail a.b@c.de or jo (at) example [dot] com")
        if i % 13 == 5:
            rows.append((len(rows), rows[-1][1], "en", "s", 0))
        rows.append((len(rows), " ".join(words), "en", "s", 0))
    rows += [(len(rows), "", "en", "s", 0), (len(rows) + 1, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int("dreadfool" in (t or "") or "nastymoron" in (t or ""))) for i, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))))
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert sum((scored[i] >= toxicity.THRESHOLD) == bool(y) for i, y in labels) >= 0.97 * len(labels)
    clean = [(i, t) for i, t, *_ in rows if scored[i] < toxicity.THRESHOLD]
    parts = jaccard_components(clean, 5, 80)
    single = [(i, t) for i, t in clean if parts[i][1] == i]
    assert len(single) < len(clean)
    want = {}
    for i, _, gone, kept in removed_words(single):
        text = " ".join(kept)
        base = pii.find(text)
        spans = sorted((a, b) for found in (base, pii.disguised(text, base)) for own in found.values() for a, b in own)
        for a, b in reversed(spans):
            text = f"{text[:a]}<x>{text[b:]}"
        want[i] = len(text.split())
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "substring dedup", "pii", "packing"]
