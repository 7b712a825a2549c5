"""Sums of fixed-size count vectors over all tasks, added up in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 16
SCHEMA = "block int, counts binary"


def packed(counts: np.ndarray) -> list[bytes]:
    """A vector as BLOCKS compressed blocks; its length is a multiple of BLOCKS."""
    return [pa.compress(x.astype(np.int64).tobytes(), codec="zstd", asbytes=True) for x in np.split(counts, BLOCKS)]


def _unpacked(block: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(block, decompressed_size=size * 8, codec="zstd", asbytes=True), dtype=np.int64)


def rows(counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(packed(counts), pa.binary())], names=["block", "counts"])


def _adder(size: int):
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + _unpacked(counts, size)
        if sums:
            done = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(done, pa.binary())], names=["block", "counts"])

    return add


def total(partial: DataFrame, length: int) -> np.ndarray:
    """The sum of all (block, counts) rows: two rounds of adding in tasks, then BLOCKS rows to the driver."""
    add = _adder(length // BLOCKS)
    salted = partial.select("block", "counts").withColumn("salt", F.spark_partition_id() % 64)
    once = salted.repartition("block", "salt").select("block", "counts").mapInArrow(add, SCHEMA)
    out = np.zeros(length, dtype=np.int64)
    size = length // BLOCKS
    for block, counts in once.repartition("block").mapInArrow(add, SCHEMA).collect():
        out[block * size : (block + 1) * size] = _unpacked(counts, size)
    return out
