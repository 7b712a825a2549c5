"""Bucket tables and folders of files: what is written again, what a rerun and a changed file do."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.operators import index
from lexmill.sources import files
from lexmill.sources.tables import BucketTable
from lexmill.streaming import intake

SCHEMA = "id string, value long"


def written(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "t"), StructType.fromDDL(SCHEMA), "id", 16)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def test_only_touched_buckets_are_written(spark, table):
    everything = [(f"k{i}", i) for i in range(200)] + [(None, 7)]
    assert len(table.replace(rows(spark, everything))) == 16
    assert sorted(map(str, map(tuple, table.read().collect()))) == sorted(map(str, everything))
    before = written(table.path)
    touched = table.replace(rows(spark, [("k3", 1), ("k3", 2), ("k500", 5)]))
    changed = {d for d, names in written(table.path).items() if names != before[d]}
    assert changed == {f"bucket={b}" for b in touched} and len(touched) <= 2
    want = [p for p in everything if p[0] != "k3"] + [("k3", 1), ("k3", 2), ("k500", 5)]
    assert sorted(map(str, map(tuple, table.read().collect()))) == sorted(map(str, want))
    table.replace(rows(spark, [("k3", 1), ("k3", 2), ("k500", 5)]))  # a rerun leaves the same rows
    assert sorted(map(str, map(tuple, table.read().collect()))) == sorted(map(str, want))


def test_keys_go_and_empty_buckets_with_them(spark, table):
    table.replace(rows(spark, [("a", 1), ("b", 2), (None, 3)]))
    table.remove(spark.createDataFrame([("a",), (None,), ("unknown",)], "id string"))
    assert [tuple(r) for r in table.read().collect()] == [("b", 2)]
    assert len([d for d in written(table.path).values() if any(n.endswith(".parquet") for n in d)]) == 1
    assert table.replace(rows(spark, [])) == []
    table.remove(spark.createDataFrame([("b",)], "id string"))
    assert table.read().count() == 0


def test_stored_embeddings_are_upserted_and_cleared(spark, tmp_path):
    table = index.embeddings_table(spark, str(tmp_path / "e"))
    made = spark.createDataFrame([(f"c{i}", f"d{i % 4}", [float(i)], "m", f"h{i}", 1) for i in range(40)], "chunk_id string, document_id string, vector array<double>, model string, hash string, dimension int")
    index.store_embeddings(table, made)
    files_before = written(table.path)
    touched = index.store_embeddings(table, made.where("chunk_id = 'c7'").withColumn("hash", F.lit("new")))
    assert len(touched) == 1 and sum(files_before[d] != names for d, names in written(table.path).items()) == 1
    assert {r.chunk_id: r.hash for r in table.read().collect()} == {f"c{i}": "new" if i == 7 else f"h{i}" for i in range(40)}
    tokens = BucketTable(spark, str(tmp_path / "tokens"), StructType.fromDDL("document_id string, idx int"), "document_id")
    tokens.replace(spark.createDataFrame([(f"d{i}", k) for i in range(4) for k in range(3)], "document_id string, idx int"))
    rerun = spark.createDataFrame([("d1", "EMBEDDINGS"), ("d2", "TOKENIZATION")], "document_id string, step string")
    index.invalidate_stored({"tokens": tokens, "embeddings": table}, rerun)
    assert {r.document_id for r in tokens.read().collect()} == {"d0", "d1", "d3"} and {r.document_id for r in table.read().collect()} == {"d0", "d3"}
    index.cascade_delete_stored({"documents": tokens, "embeddings": table}, spark.createDataFrame([("d0",), ("x",)], "document_id string"))
    assert {r.document_id for r in tokens.read().collect()} == {"d1", "d3"} and {r.document_id for r in table.read().collect()} == {"d3"}


def test_bucketed_tables_are_compared_without_an_exchange(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(60)], "chunk_id string, content string")
    done = spark.createDataFrame([(f"c{i}", "m" if i % 5 else "old") for i in range(40)], "chunk_id string, model string").join(chunks, "chunk_id")
    done = done.withColumn("hash", F.sha2(F.when(F.col("chunk_id") == "c7", "changed").otherwise(F.col("content")), 256)).drop("content")
    index.bucketed_table(spark, "stored_chunks", str(tmp_path / "chunks"), "chunk_id string, hash string, content string", buckets=8)
    index.bucketed_table(spark, "stored_embeddings", str(tmp_path / "embeddings"), "chunk_id string, hash string, model string", buckets=8)
    index.write_bucketed(chunks.withColumn("hash", F.sha2("content", 256)), "stored_chunks", buckets=8)
    index.write_bucketed(done, "stored_embeddings", buckets=8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.pending_stored(spark.table("stored_chunks"), spark.table("stored_embeddings"), "m")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "content" not in plan
        want = {(r.chunk_id, r.hash, r.pending) for r in index.pending_embeddings(chunks, done, "m").collect()}
        assert {tuple(r) for r in found.collect()} == want and sum(p for _, _, p in want) == 29
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("stored_chunks", "stored_embeddings"):
            spark.sql(f"DROP TABLE {name}")


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return path


LAW = "LEI Nº 9.001\nArt. 1º Um.\nArt. 2º Dois.\n".encode()


def test_a_folder_of_mixed_files(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "lei a.txt", LAW)
    put(folder, "sub/b+c.HTML", b"<nav>x</nav><p>Art. 1 Oi</p>")
    put(folder, "bad.txt", b"Art. 1 \xff\xfe ol\xc3\xa1")
    put(folder, "scan.pdf", b"%PDF-1.4 \xff")
    put(folder, "empty.md", b"")
    got = {r.name: r for r in files.documents_of(files.list_files(spark, str(folder))).collect()}
    assert {n: (r.type, r.engine, r.size_bytes, r.error) for n, r in got.items()} == {
        "lei a.txt": ("TXT", "utf8", len(LAW), None), "b+c.HTML": ("HTML", "html-to-text", 28, None), "bad.txt": ("TXT", "utf8", 14, "bytes that are no UTF-8"),
        "scan.pdf": ("PDF", None, 10, "no text without pages: PDF"),
    }
    assert got["lei a.txt"].text == LAW.decode() and got["b+c.HTML"].text == "Art. 1 Oi" and got["bad.txt"].text == "Art. 1 �� olá"


def tables(spark, out):
    return {name: sorted(tuple(r) for r in t.read().select("document_id", *columns).collect()) for name, (t, columns) in intake.folder_tables(spark, out).items()}


def test_a_folder_is_kept_in_step(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    paths = [put(folder, f"{n}.txt", LAW.replace(b"9.001", str(n).encode())) for n in range(6)]
    put(folder, "scan.pdf", b"%PDF")
    assert intake.refresh_folder(spark, str(folder), out) == (7, 0)
    first = tables(spark, out)
    assert len(first["documents"]) == 7 and len({r[0] for r in first["chunks"]}) == 6 and len(first["chunks"]) == 12
    assert intake.refresh_folder(spark, str(folder), out) == (0, 0)
    assert tables(spark, out) == first
    time.sleep(0.05)
    paths[0].write_bytes(LAW + "Art. 3º Três.\n".encode())
    paths[1].unlink()
    assert intake.refresh_folder(spark, str(folder), out) == (1, 1)
    now = tables(spark, out)
    ids = {r.name: r.document_id for r in intake.folder_tables(spark, out)["documents"][0].read().collect()}
    assert "1.txt" not in ids and sum(r[0] == ids["0.txt"] for r in now["chunks"]) == 3
    other = lambda t, name: [r for r in t[name] if r[0] not in (ids["0.txt"], *({r[0] for r in first[name]} - set(ids.values())))]
    assert all(other(now, name) == other(first, name) for name in now)


def test_a_failed_refresh_is_done_again(spark, tmp_path, monkeypatch):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    put(folder, "a.txt", LAW)
    real = BucketTable.replace

    def fails(self, *args):
        if self.path.endswith("/documents"):
            raise RuntimeError("lost")
        return real(self, *args)

    monkeypatch.setattr(BucketTable, "replace", fails)
    with pytest.raises(RuntimeError):
        intake.refresh_folder(spark, str(folder), out)
    monkeypatch.setattr(BucketTable, "replace", real)
    assert intake.refresh_folder(spark, str(folder), out) == (1, 0)
    assert len(tables(spark, out)["chunks"]) == 2


def test_new_files_as_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    put(folder, "a.txt", LAW)
    for name in ("b.html", "c.txt"):
        intake.intake_files(spark, str(folder), out, str(tmp_path / "cp")).awaitTermination()
        put(folder, name, b"<p>Art. 1 Oi</p>" if name == "b.html" else LAW)
    intake.intake_files(spark, str(folder), out, str(tmp_path / "cp")).awaitTermination()
    assert {n: len({r[0] for r in t}) for n, t in tables(spark, out).items()} == {"documents": 3, "tokens": 3, "nodes": 3, "chunks": 3}
