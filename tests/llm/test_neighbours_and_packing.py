import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import neighbours, packing


def test_nearest_neighbours_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((1500, 16)) + 2 * rnd.standard_normal((8, 16))[rnd.integers(8, size=1500)]
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in np.float32(row)], "x") for i, row in enumerate(x)]
    rows += [(2000, None, "x"), (2001, [0.0] * 16, "x"), (2002, [float("nan")] * 16, "x"), (2020, [float("inf")] * 16, "x"), (None, rows[0][1], "x"), rows[5]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect()
    f = np.array([r[1] for r in rows[:1500]])
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    hits = 0
    for q in range(0, 1500, 20):
        sims = f @ f[q]
        sims[q] = -np.inf
        best = np.lexsort((np.arange(1500), -sims))[:20]
        found = sorted(by_query[q], key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        assert all(abs(r.score - sims[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(best.tolist()))
    assert len(by_query) == 75 and hits >= 0.95 * 75 * 20


def test_descent_finds_what_a_small_start_graph_lacks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ORDERS", 2)
    monkeypatch.setattr(neighbours, "BLOCK", 30)  # 1 % of the table
    x = np.random.default_rng(5).standard_normal((6000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).round(6)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 40 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    sims = x[::40] @ x.T
    sims[np.arange(150), np.arange(0, 6000, 40)] = -np.inf
    best = np.argsort(-sims, axis=1)[:, :20]
    assert sum(len(got[40 * q] & set(best[q].tolist())) for q in range(150)) >= 0.95 * 150 * 20


def test_a_group_of_near_copies_returns_k_rows(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    x = np.repeat(rnd.standard_normal((12, 16)) * 3, 15, axis=0) + 0.01 * rnd.standard_normal((180, 16))
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    for beam in (neighbours.BEAM, 8):  # with the smaller beam every query needs the exact pass
        monkeypatch.setattr(neighbours, "BEAM", beam)
        got = {}
        for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        for q in range(0, 180, 20):
            sims = x @ x[q]
            sims[q] = -np.inf
            assert [i for _, i in sorted(got[q])] == np.argsort(-sims)[:20].tolist()


def test_a_beam_too_narrow_grows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BEAM", 24)
    x = np.random.default_rng(11).standard_normal((2500, 32))
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    hits = 0
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect():
        sims = x @ x[r.query_id]
        sims[r.query_id] = -np.inf
        hits += sims[r.vec_id] >= np.sort(sims)[-20]
    assert hits >= 0.9 * 125 * 20


def test_shards_are_searched_whole_and_without_a_job_for_each_step(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 400, raising=False)
    x = np.random.default_rng(12).standard_normal((3000, 24))
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    spark.sparkContext.setJobGroup("shards", "")
    got = {}
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("shards"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sims = x[::20] @ x.T
    sims[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = np.argsort(-sims, axis=1)[:, :20]
    assert sum(len(got[20 * q] & set(best[q].tolist())) for q in range(150)) >= 0.95 * 150 * 20
    assert jobs < 80


def test_a_graph_and_its_walks_find_the_nearest_of_a_shard():
    rnd = np.random.default_rng(13)
    x = np.concatenate([rnd.standard_normal((2000, 16)), 9 + 0.01 * rnd.standard_normal((60, 16))]).astype(np.float32)
    links = neighbours.descend(x)
    assert links.shape == (2060, neighbours.DEGREE + neighbours.REVERSED) and links.min() >= 0 and links.max() <= 2060
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    best = np.argsort(-sims, axis=1)[:, :20]
    assert np.mean([len(set(links[i]) & set(best[i])) / 20 for i in range(2060)]) >= 0.95
    q = np.concatenate([rnd.standard_normal((50, 16)), x[2000:2010]]).astype(np.float32)
    node, sim = neighbours.walk(q, np.append(np.full(50, -1), np.arange(2000, 2010)), x, links, neighbours.sorted_orders(x), 64)
    assert (np.diff(sim, axis=1) <= 0).all() and all(len(set(row)) == 64 for row in node.tolist())
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(node[i]) & set(best[i])) / 20 for i in range(60)]) >= 0.95


def test_few_and_no_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 0.5), (2, 2, 0.0)]
    assert neighbours.nearest_neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_two_tight_clusters_fill_each_others_lists(spark):
    rnd = np.random.default_rng(8)
    x = np.repeat(rnd.standard_normal((2, 8)), 13, axis=0) + 0.001 * rnd.standard_normal((26, 8))
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect()
    for q in (0, 20):
        sims = x @ x[q]
        sims[q] = -np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == np.argsort(-sims)[:20].tolist()


def test_shorter_vectors_count_as_filled_up_with_zeros(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, [0.0, 1.0, 5.0]), (3, [])], "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(table, F.col("vec_id") == 0).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 3.0), (2, 2, 2.0)]


@pytest.mark.parametrize("capacities", [(8, 16), (5,), (4, 8, 32)])
def test_best_fit_holds_and_downsizes(capacities):
    rnd = np.random.default_rng(1)
    lengths = sorted((int(x) for x in rnd.integers(1, max(capacities) + 1, 400)), reverse=True)
    where, offset, used, size = packing.best_fit(lengths, capacities, 1)
    for b in range(len(used)):
        own = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if where[i] == b)
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False))
        assert sum(n for _, n in own) == used[b] <= size[b] and size[b] == min(c for c in capacities if c >= used[b])
    assert sum(used) == sum(lengths) and sum(used) >= 0.9 * sum(size)


def plain_best_fit(lengths, capacities):
    """The rule said plainly: the open bin with the least room left, else the size of least cost for what can be put into it."""
    bins, cost = [], {c: packing.sequence_cost(c) for c in capacities}  # [capacity, used]
    for i, n in enumerate(lengths):
        fits = [(c - u - n, k) for k, (c, u) in enumerate(bins) if c - u >= n]
        if fits:
            k = min(fits)[1]
        else:
            def filled(c):
                put, room = n, c - n
                for m in lengths[i + 1 :]:
                    if m <= room:
                        put, room = put + m, room - m
                return put

            bins.append([min((c for c in capacities if c >= n), key=lambda c: (cost[c] / filled(c), c)), 0])
            k = len(bins) - 1
        bins[k][1] += n
    return bins


def test_best_fit_equals_the_plain_rule():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        capacities = (64, 128, 256)
        lengths = sorted((int(x) for x in rnd.integers(1, 257, 80)), reverse=True)
        want = plain_best_fit(lengths, capacities)
        _, _, used, size = packing.best_fit(lengths, capacities)
        # Which of several equally full bins takes an item is free; what they hold then is not.
        assert sorted(used) == sorted(u for _, u in want)
        assert sorted(size) == sorted(min(c for c in capacities if c >= u) for _, u in want)


def test_several_sizes_are_opened():
    rnd = np.random.default_rng(4)
    lengths = sorted((int(x) for x in np.minimum(4096, rnd.lognormal(5.5, 1.0, 5000) + 1)), reverse=True)
    _, _, used, size = packing.best_fit(lengths)
    assert len(set(size)) == 4 and sum(used) >= 0.97 * sum(size)
    cost = sum(map(packing.sequence_cost, size))
    assert cost < min(sum(map(packing.sequence_cost, packing.best_fit(lengths, (c,))[3])) for c in (4096,))


def test_pack_covers_every_text(spark):
    texts = ["a b c", None, "", "x " * 9000, "y " * 4096, "z"] * 3
    docs = spark.createDataFrame([(i if i != 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bin string")
    got = packing.pack(docs).collect()
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        own = sorted(per[i if i != 5 else None], key=lambda r: r.piece)
        assert sum(r.length for r in own) == len((t or "").split())
        assert [r.start for r in own] == [4096 * k for k in range(len(own))]
        assert all((r.bin is None) == (r.length == 0) for r in own)
    assert packing.pack(docs.limit(0)).count() == 0
