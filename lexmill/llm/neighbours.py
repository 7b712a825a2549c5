"""Approximate nearest neighbours: graphs by NN-descent, and greedy search on them.

The vectors are dealt by a hash to shards of bounded size, whatever the size of the table.
Each shard gets a graph of its own, made by one task where its vectors lie: it starts from
blocks of vectors that random hyperplanes sort next to each other, and each round joins
every node's neighbours with each other: who shares a neighbour is likely to be near. Only
pairs with an entry that is new since the last round are measured. A query walks the graph
of every shard: it expands those of the nearest nodes of its beam that are not yet expanded
and keeps the nearest seen, until all of them are. The best of all shards are its own.

Vectors travel once to their shard; rounds and walks move nothing between tasks.
Equal vectors are one node, so copies neither fill the lists of others nor make hubs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm.store import Scratch

#: Neighbours a node keeps, and reverse neighbours that a round joins besides (the method's sample, new ones first, drawn anew each round).
DEGREE, REVERSED = 40, 20
#: Sorted orders that a graph starts from, and vectors in a block of one: only a start, whatever the size of the table.
ORDERS, BLOCK = 8, 128
#: The rounds end when one changes no more than this share of the list entries.
LEAST_CHANGE = 0.01
#: Nodes of a shard, on average at most.
SHARD = 16_384
#: Nodes that a walk keeps at first; the nearest 7/8 of them are expanded, so many at a time, and it ends when they all are.
BEAM, AT_ONCE = 128, 8
#: A walk starts from the best of so many nodes drawn, and so many about its place in each sorted order.
DRAWN, ABOUT = 512, 16
#: So many queries are compared with every node. While their walks have found less than this share of their nearest nodes, the beam grows by half.
MEASURED, LEAST_RECALL = 64, 0.95
#: Vectors in a block of the exact pass; bits of a sorted order; candidates that a task holds before it keeps the best of each node; queries that walk together; numbers in a gathered array.
EXACT_BLOCK, PLANES, HELD, TOGETHER, GATHERED = 1024, 24, 1 << 21, 128, 1 << 21


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as doubles) without null, zero or non-finite vectors; shorter ones are filled up with zeros."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    longest = v.agg(F.max(F.size("vector"))).first()[0] or 0
    return v.select("vec_id", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("vector"))).alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of packed vectors as floats."""
    rows = [v.as_buffer() for v in column]
    return np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), -1)


def _packed(batches):
    """Vectors as bytes of single floats: the graph needs no more, and results are scored on the originals."""
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["id", "vector"])


def _sides(x: np.ndarray, k: int) -> np.ndarray:
    """The place of vectors in a sorted order: their sides of its planes."""
    r = np.random.default_rng(7919 + k).standard_normal((x.shape[1], PLANES)).astype(np.float32)
    return ((x @ r > 0) * (1 << np.arange(PLANES - 1, -1, -1))).sum(axis=1)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    return np.append(np.ones(min(len(values), 1), dtype=bool), values[1:] != values[:-1])


def _turns(values: np.ndarray) -> np.ndarray:
    """The place of each of sorted values among its equals."""
    first = np.flatnonzero(_firsts(values))
    return np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))


def _falling(sim: np.ndarray) -> np.ndarray:
    """Integers under 2**32 that sort single floats from the largest to the smallest."""
    bits = sim.view(np.int32).astype(np.int64)
    return np.where(bits < 0, bits & 0x7FFFFFFF, -1 - bits) + (1 << 31)


class Lists:
    """The DEGREE nearest of each node of a shard among all that were added; fresh are those that came since `settle`."""

    def __init__(self, n: int):
        self.n, self.parts, self.held = n, [], 0
        self.nbr, self.sim = np.full((n, DEGREE), -1, dtype=np.int32), np.full((n, DEGREE), -np.inf, dtype=np.float32)
        self.fresh = np.zeros((n, DEGREE), dtype=bool)

    def settle(self) -> None:
        self.fresh[:] = False

    def add(self, node: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> None:
        self.parts.append((node.astype(np.int64) * self.n + nbr, sim))
        self.held += len(node)
        if self.held > HELD:
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        node, place = np.nonzero(self.nbr >= 0)
        known = node * self.n + self.nbr[node, place]
        pair, sim = (np.concatenate(c) for c in zip((known, self.sim[node, place]), *self.parts, strict=True))
        added = np.arange(len(pair)) >= len(known)
        fresh = np.append(self.fresh[node, place], added[len(known) :])
        self.parts, self.held = [], 0
        order = np.argsort(pair * 2 + added)  # what a list holds is met first and stays as it is
        order = order[_firsts(pair[order])]
        node, nbr = np.divmod(pair[order], self.n)
        sim, fresh = sim[order], fresh[order]
        order = np.argsort(node << 32 | _falling(sim))
        node, nbr, sim, fresh = node[order], nbr[order], sim[order], fresh[order]
        place = _turns(node)
        best = place < DEGREE
        node, place = node[best], place[best]
        self.nbr[node, place], self.sim[node, place], self.fresh[node, place] = nbr[best], sim[best], fresh[best]


def sorted_orders(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places sorted, nodes in that order) of each sorted order."""
    codes = [_sides(x, k) for k in range(ORDERS)]
    return [(code[order], order) for code, order in zip(codes, (np.argsort(code, kind="stable") for code in codes), strict=True)]


def _start(x: np.ndarray, lists: Lists) -> None:
    """Cuts each sorted order into blocks and finds the nearest inside each."""
    for _, order in sorted_orders(x):
        for a in range(0, len(order), BLOCK):
            # a short rest goes with the block before it
            own = order[max(0, len(order) - BLOCK) :] if a + BLOCK > len(order) else order[a : a + BLOCK]
            sims = x[own] @ x[own].T
            np.fill_diagonal(sims, -np.inf)
            n = min(DEGREE, len(own) - 1)
            top = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n else np.zeros((len(own), 0), dtype=np.int64)
            lists.add(np.repeat(own, n), own[top].ravel(), np.take_along_axis(sims, top, axis=1).ravel())
    lists.merge()


def _links(lists: Lists, draw: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, fresh) about each node: its list, and REVERSED of the nodes that have it in theirs; -1 fills up."""
    node, place = np.nonzero(lists.nbr >= 0)
    center, fresh = lists.nbr[node, place], lists.fresh[node, place]
    order = np.argsort((center.astype(np.int64) << 33) | (~fresh).astype(np.int64) << 32 | np.random.default_rng(draw).integers(1 << 32, size=len(node)))
    node, center, fresh = node[order], center[order], fresh[order]
    turn = _turns(center)
    taken = turn < REVERSED
    back, new = np.full((lists.n, REVERSED), -1, dtype=np.int32), np.zeros((lists.n, REVERSED), dtype=bool)
    back[center[taken], turn[taken]], new[center[taken], turn[taken]] = node[taken], fresh[taken]
    return np.concatenate([lists.nbr, back], axis=1), np.concatenate([lists.fresh, new], axis=1)


def _join_neighbours(x: np.ndarray, lists: Lists, draw: int) -> None:
    """Members of each node's neighbourhood against each other, if one of the two is new there; what betters a member's own list comes into it."""
    members, fresh = _links(lists, draw)
    lists.settle()
    centers = np.flatnonzero(fresh.any(axis=1))
    size = max(1, GATHERED // (members.shape[1] * max(members.shape[1], x.shape[1])))
    for a in range(0, len(centers), size):
        own, new = members[centers[a : a + size]], fresh[centers[a : a + size]]
        near = x[own]
        sims = near @ near.transpose(0, 2, 1)
        there = own >= 0
        worst = np.where(there, lists.sim[own, DEGREE - 1], np.inf)
        better = (sims > worst[:, :, None]) & (new[:, :, None] | new[:, None, :]) & there[:, None, :] & (own[:, :, None] != own[:, None, :])
        c, i, j = np.nonzero(better)
        lists.add(own[c, i], own[c, j], sims[c, i, j])
    lists.merge()


def descend(x: np.ndarray) -> np.ndarray:
    """The graph of a shard's vectors: the places of each one's DEGREE nearest and of REVERSED that it is near to; their number fills up."""
    lists, draw = Lists(len(x)), 0
    _start(x, lists)
    lists.fresh = lists.nbr >= 0
    while lists.fresh.sum() > LEAST_CHANGE * (lists.nbr >= 0).sum() or not draw:
        draw += 1
        _join_neighbours(x, lists, draw)
    links = _links(lists, 0)[0]
    return np.where(links < 0, len(x), links).astype(np.int32)


def walk(q: np.ndarray, entry: np.ndarray, x: np.ndarray, links: np.ndarray, orders: list[tuple[np.ndarray, np.ndarray]], beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, inner products) of the nodes that queries hold at the end of their walks, the nearest first; -1 fills up. entry is a query's own place, -1 where it has none here."""
    n, rows = len(x), np.arange(len(q))
    seen = np.zeros((len(q), n + 1), dtype=bool)  # the last column takes what fills up
    seen[:, n] = True
    beam = min(beam, n)
    node, sim, done = np.full((len(q), beam), -1, dtype=np.int64), np.full((len(q), beam), -np.inf, dtype=np.float32), np.ones((len(q), beam), dtype=bool)

    def meet(near: np.ndarray, node, sim, done):
        """The beams with what is met for the first time."""
        flat = (rows[:, None] * (n + 1) + near).ravel()
        flat = np.sort(flat[~seen.ravel()[flat]])
        flat = flat[_firsts(flat)]
        seen.ravel()[flat] = True
        row, place = np.divmod(flat, n + 1)
        new = np.concatenate([np.einsum("ij,ij->i", q[row[a : a + size]], x[place[a : a + size]]) for a in range(0, max(len(row), 1), size)])
        turn = _turns(row)
        width = int(turn.max(initial=-1)) + 1
        more, theirs = np.full((len(q), width), -1, dtype=np.int64), np.full((len(q), width), -np.inf, dtype=np.float32)
        more[row, turn], theirs[row, turn] = place, new
        node, sim, done = np.concatenate([node, more], axis=1), np.concatenate([sim, theirs], axis=1), np.concatenate([done, more < 0], axis=1)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        return (np.take_along_axis(c, order, axis=1) for c in (node, sim, done))

    size = max(1, GATHERED // x.shape[1])
    start = [np.where(entry < 0, n, entry)[:, None], np.broadcast_to(np.random.default_rng(0).permutation(n)[:DRAWN], (len(q), min(DRAWN, n)))]
    for k, (code, order) in enumerate(orders):
        at = np.searchsorted(code, _sides(q, k))[:, None] + np.arange(-(ABOUT // 2), ABOUT // 2)
        start.append(order[np.clip(at, 0, n - 1)])
    node, sim, done = meet(np.concatenate(start, axis=1), node, sim, done)
    while True:
        opened = ~done & (np.arange(beam) < max(1, beam * 7 // 8))
        opened &= opened.cumsum(axis=1) <= AT_ONCE
        if not opened.any():
            return node, sim
        done = done | opened
        place = np.where(opened, node, -1)
        place = np.take_along_axis(place, np.argsort(~opened, axis=1, kind="stable")[:, :AT_ONCE], axis=1)
        near = np.where(place[:, :, None] < 0, n, links[place])
        node, sim, done = meet(near.reshape(len(q), -1), node, sim, done)


def _graphs(batches):
    """One row for each shard of rows (shard, id, vector) in its order: ids, vectors and links as bytes."""
    shard, ids, parts = None, [], []

    def made():
        x = np.concatenate(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([descend(x).tobytes()], pa.binary())],
            names=["shard", "ids", "vectors", "links"],
        )

    for batch in batches:
        of, own, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)) if batch.num_rows else None
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if shard is not None and of[a] != shard:
                yield made()
                ids, parts = [], []
            shard = of[a]
            ids.append(own[a:b])
            parts.append(x[a:b])
    if shard is not None:
        yield made()


def build_graphs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(shard, ids, vectors, links): a graph for each shard of the packed nodes (id, vector)."""
    shards = max(1, -(-nodes.count() // SHARD))
    dealt = nodes.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "vector")
    placed = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "id")
    return scratch.save(placed.mapInArrow(_graphs, "shard int, ids binary, vectors binary, links binary"), "graphs")


def _walks(beam: int, kept: int):
    """The nearest that queries find in each shard, over its graph and then its queries."""

    def run(batches):
        graph = None
        for batch in batches:
            starts = [k for k, g in enumerate(batch.column("ids")) if g.is_valid]
            for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if a in starts and b > a:
                    row = {c: batch.column(c)[a].as_buffer() for c in ("ids", "vectors", "links")}
                    ids = np.frombuffer(row["ids"], dtype=np.int64)
                    x = np.frombuffer(row["vectors"], dtype=np.float32).reshape(len(ids), -1)
                    graph = (x, np.frombuffer(row["links"], dtype=np.int32).reshape(len(ids), -1), sorted_orders(x))
                    a += 1
                for c in range(a, b, TOGETHER):
                    own = batch.slice(c, min(TOGETHER, b - c))
                    query, entry = (own.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("query_id", "entry"))
                    at = np.minimum(np.searchsorted(ids, entry), len(ids) - 1)
                    node, sim = walk(_matrix(own.column("vector")), np.where(ids[at] == entry, at, -1), *graph, beam)
                    row, turn = np.nonzero(node[:, :kept] >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(query[row]), pa.array(ids[node[row, turn]]), pa.array(sim[row, turn])], names=["query_id", "id", "sim"])

    return run


def walked(queries: DataFrame, graphs: DataFrame, beam: int, kept: int) -> DataFrame:
    """(query_id, id, sim): the nearest nodes that the packed queries (query_id, entry, vector) find in all graphs."""
    numbers = graphs.select("shard")
    index = graphs.select("shard", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("entry"), F.lit(None).cast("binary").alias("vector"), "ids", "vectors", "links")
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "vectors", "links")]
    asked = queries.crossJoin(numbers).select("shard", "query_id", "entry", "vector", *none)
    every = index.unionByName(asked).repartitionByRange(max(1, numbers.count()), "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())
    found = every.mapInArrow(_walks(beam, kept), "query_id long, id long, sim float")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= kept).drop("rank")


def found_share(beams: DataFrame, truth: DataFrame) -> float:
    """The share of the pairs (query_id, id) of the truth that the beams hold."""
    row = truth.join(beams.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0


def search(queries: DataFrame, graphs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, id, sim): what the packed queries (query_id, entry, vector) find, 2 k + 8 each: single floats rank them so far, doubles will.

    truth holds the k nearest nodes (query_id, id) of some queries, whose walks settle the
    beam of all: it grows until they have found LEAST_RECALL of them.
    """
    beam, kept, largest = BEAM, 2 * k + 8, (graphs.agg(F.max(F.length("ids"))).first()[0] or 0) // 8
    measured = queries.join(truth.select("query_id").distinct(), "query_id", "left_semi")
    while beam < largest and found_share(walked(measured, graphs, beam, kept), truth) < LEAST_RECALL:
        beam += beam // 2
    return walked(queries, graphs, beam, kept)


def exact_pass(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(query_id, id): the k nearest nodes (id, vector) of each query (query_id, query) and more, by blocks against blocks."""

    def blocks(df: DataFrame, key: str, vector: str, n: int) -> DataFrame:
        dealt = df.groupBy(F.pmod(F.xxhash64(key), F.lit(-(-n // EXACT_BLOCK)))).agg(F.collect_list(F.struct(key, vector)).alias("rows"))
        return dealt.select(F.col(f"rows.{key}").alias(key), F.flatten(f"rows.{vector}").alias(vector))

    def run(batches):
        for batch in batches:
            for ids, x, others, y in zip(*(batch.column(c) for c in range(4)), strict=True):
                ids, others = ids.values.to_numpy(), others.values.to_numpy()
                sims = x.values.to_numpy().reshape(len(ids), -1) @ y.values.to_numpy().reshape(len(others), -1).T
                n = min(k, len(others))
                top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                found = (np.repeat(ids, n), others[top].ravel(), np.take_along_axis(sims, top, axis=1).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "id", "sim"])

    pairs = blocks(queries, "query_id", "query", queries.count()).crossJoin(blocks(nodes, "id", "vector", nodes.count()))
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    found = pairs.mapInArrow(run, "query_id long, id long, sim double").withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "id")


def nearest_neighbours(vectors: DataFrame, query_filter: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query row among all other rows, by largest inner product.

    query_filter selects the queries by vec_id. Every usable row is indexed. Returns
    query_id, rank (from 1), vec_id, score (the inner product in doubles), nearest first,
    ties to the smaller vec_id; all candidates where there are fewer than k. A query whose
    walk finds fewer gets an exact pass over all nodes.

    * null, zero or non-finite vectors and null ids take no part;
    * vectors shorter than the longest count as filled up with zeros;
    * equal vectors are one node; of its members the k + 1 smallest ids can matter to a query, and do;
    * of rows that repeat a vec_id, equal ones count once;
    * an empty table gives an empty result; further columns are ignored.

    The beam follows the table: walks take wider ones while the MEASURED queries, which are
    compared with every node, show that they miss too much.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = usable_vectors(vectors, id_col, vector_col).select("vec_id", "vector")
    rows = rows.distinct()
    least = rows.groupBy("vector").agg(F.min("vec_id").alias("id"))  # copies shrink to one row a task before they meet
    members = scratch.save(rows.join(least, "vector").select("id", "vec_id", "vector"), "members")
    reps = members.where("id = vec_id").select("id", "vector")
    nodes = scratch.save(reps.mapInArrow(_packed, "id long, vector binary"), "nodes")
    queries = members.where(query_filter).select(F.col("vec_id").alias("query_id"), F.col("id").alias("entry"), F.col("vector").alias("query"))
    queries = scratch.save(queries, "asked")
    asked = scratch.save(queries.select("query_id", "entry", F.col("entry").alias("id")).join(nodes, "id").select("query_id", "entry", "vector"), "queries")
    measured = queries.select("query_id", "query").orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED)
    truth = scratch.save(exact_pass(measured, reps, k), "truth")
    beams = search(asked, build_graphs(nodes, scratch), truth, k)
    few = members.select("id", "vec_id").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    size = F.least(F.lit(k), F.lit(members.select("vec_id").distinct().count() - 1))
    found = beams.select("query_id", "id").join(few, "id").where("vec_id <> query_id").select("query_id", "id", "vec_id").distinct()
    found = scratch.save(found, "found")
    held = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
    short = scratch.save(queries.join(held, "query_id", "left").where(F.coalesce("n", F.lit(0)) < size).select("query_id", "query"), "short")
    if not short.isEmpty():
        # a walk that saw too little: such queries are compared with every node
        more = exact_pass(short, reps, k + 1).join(few, "id").where("vec_id <> query_id").select("query_id", "id", "vec_id")
        found = scratch.save(found.join(short, "query_id", "left_anti").unionByName(more), "completed")
    near = found.join(reps, "id").join(queries.select("query_id", "query"), "query_id")
    scored = near.select("query_id", "vec_id", inner_product(F.col("query"), F.col("vector")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
