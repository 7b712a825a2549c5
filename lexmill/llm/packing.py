"""Variable-capacity best-fit packing of texts into training sequences of several permitted lengths.

A sequence costs a fixed amount, its length, and attention, which grows with the square
of it; so long sequences pay only for what needs them. Items are packed longest first. An
item goes into the open bin that it leaves the least room in; if none holds it, a bin is
opened of the size that costs least for each token that the item and the items still to
come can put into it. At the end every bin is cut down to the smallest size that holds it.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths; what a sequence costs besides its tokens; the length whose attention costs as much as its tokens.
CAPACITIES, BIN_COST, ATTENTION = (512, 1024, 2048, 4096), 16, 65_536
#: About so many items are packed together; one such group leaves few bins unfilled. A longer one (rows that repeat) is packed in parts.
GROUP_ITEMS, GROUP_MOST = 20_000, 80_000
COLUMNS = "doc_id long, piece int, start long, length int, bin_group int, bin int, bin_offset int, bin_capacity int, bin_used int"


def sequence_cost(capacity: int, bin_cost: int = BIN_COST, attention: int = ATTENTION) -> float:
    return bin_cost + capacity + capacity * capacity / attention


def _fill(room: int, ascending: list[int], end: int) -> int:
    """What the items before `end` (in ascending order, each once) can put into a room, longest first."""
    put = 0
    while end and room:
        end = min(end, bisect_left(ascending, room + 1, 0, end))
        if not end:
            break
        end -= 1
        put += ascending[end]
        room -= ascending[end]
    return put


def best_fit(lengths: list[int], capacities=CAPACITIES, bin_cost: int = BIN_COST, attention: int = ATTENTION):
    """Bins of items given longest first: (bin of each item, offset in it, used and capacity of each bin)."""
    room: list[list[int]] = [[] for _ in range(max(capacities) + 1)]  # bins by the room they have left
    rooms: list[int] = []  # the values of room that have bins, ascending
    used: list[int] = []
    where, offset = [], []
    ordered, ascending = sorted(capacities), lengths[::-1]
    cost = {c: sequence_cost(c, bin_cost, attention) for c in ordered}
    for i, n in enumerate(lengths):
        k = bisect_left(rooms, n)
        if k < len(rooms):
            left = rooms[k]
            b = room[left].pop()
            if not room[left]:
                del rooms[k]
        else:
            to_come = len(lengths) - i - 1
            size = min((c for c in ordered if c >= n), key=lambda c: (cost[c] / (n + _fill(c - n, ascending, to_come)), c))
            b, left = len(used), size
            used.append(0)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        left -= n
        if left:
            if not room[left]:
                insort(rooms, left)
            room[left].append(b)
    return where, offset, used, [ordered[bisect_left(ordered, u)] for u in used]


def _pack_groups(capacities, bin_cost):
    """Packs each run of rows of one group; rows come sorted by group and longest first."""
    schema = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("bin_group", pa.int32()), ("bin", pa.int32()), ("bin_offset", pa.int32()), ("bin_capacity", pa.int32()), ("bin_used", pa.int32())]

    def packed(held: list[pa.RecordBatch], first: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(held)
        where, offset, used, size = best_fit(table["length"].to_pylist(), capacities, bin_cost)
        b = np.array(where)
        columns = [*(table[c] for c in ("doc_id", "piece", "start", "length", "bin_group")), b + first, offset, np.array(size)[b], np.array(used)[b]]
        done = pa.table([pa.array(c) if not isinstance(c, pa.ChunkedArray) else c for c in columns], names=[n for n, _ in schema]).cast(pa.schema(schema))
        return done.combine_chunks().to_batches()[0], first + len(used)

    def run(batches):
        held, rows, first = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(batch.schema.get_field_index("bin_group")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                other = held and held[0].column("bin_group")[0] != batch.column("bin_group")[a]
                if held and (other or rows >= GROUP_MOST):
                    done, first = packed(held, first)
                    yield done
                    held, rows, first = [], 0, 0 if other else first
                held.append(batch.slice(a, b - a))
                rows += b - a
        if held:
            yield packed(held, first)[0]

    return run


def word_count(text):
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), ""))


def pack(docs: DataFrame, length=None, id_col: str = "doc_id", text_col: str = "text", capacities=CAPACITIES, bin_cost: int = BIN_COST) -> DataFrame:
    """Place every text, whole or in pieces of the longest capacity, into bins.

    `length` is a column with the tokens of a text (by default its words). Returns one row
    per piece: doc_id, piece (from 0), start and length in tokens, bin_group and bin (which
    name the sequence), bin_offset, bin_capacity and bin_used.

    * texts without tokens (null, empty) are one row of length 0 without a bin;
    * texts longer than the longest capacity are cut, never shortened; the pieces cover them;
    * repeated rows and null ids are items of their own; ties in length go by doc_id;
    * an empty table gives an empty result; further columns are ignored.

    Items are dealt to groups by a hash of their own id, text and piece, so a task that
    runs again makes the same bins, each group is packed in bounded memory and time, and
    the number of groups grows with the table.
    """
    longest = max(capacities)
    n = (word_count(F.col(text_col)) if length is None else length).cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(n, F.lit(0)).alias("n"), F.xxhash64(id_col, text_col).alias("own"))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / longest) - 1).cast("long"))))
    items = pieces.select("own", "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("length"))
    total = sized.agg(F.sum(F.ceil(F.col("n") / longest))).first()[0] or 0
    groups = max(1, -(-int(total) // GROUP_ITEMS))
    full = items.where("length > 0").withColumn("bin_group", F.pmod(F.xxhash64("own", "piece"), F.lit(groups)).cast("int")).drop("own")
    ordered = full.repartition(groups, "bin_group").sortWithinPartitions("bin_group", F.desc("length"), "doc_id", "piece")
    none = [F.lit(None).cast("int").alias(c) for c in ("bin_group", "bin", "bin_offset", "bin_capacity", "bin_used")]
    return ordered.mapInArrow(_pack_groups(tuple(capacities), bin_cost), COLUMNS).unionByName(items.where("length = 0").drop("own").select("*", *none))
