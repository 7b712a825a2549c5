"""A filter of fixed size over 64-bit ids, to spare a shuffle what it will not need.

It may let through more than was put in, and does so the fuller it is; whoever uses it
joins on the ids afterwards, so it changes costs alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import textscan as ts

#: 2**23 bits, 1 MB: the driver gets at most 2**20 rows of one byte each.
BITS = 23
_MASK = ts.U64((1 << BITS) - 1)


def _slots(ids: np.ndarray) -> np.ndarray:
    return ts.mix(ids.view(ts.U64)) & _MASK


def _mark(batches):
    for batch in batches:
        slot = np.unique(_slots(batch.column(0).drop_null().to_numpy(zero_copy_only=False)))
        bits = np.left_shift(1, (slot & ts.U64(7)).astype(np.int32), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array((slot >> ts.U64(3)).astype(np.int32)), pa.array(bits)], names=["at", "bits"])


def build(ids: DataFrame) -> np.ndarray:
    """The filter over the one long column of ids."""
    found = ids.mapInArrow(_mark, "at int, bits int").groupBy("at").agg(F.bit_or("bits").cast("int").alias("bits")).toArrow()
    packed = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    packed[found["at"].to_numpy()] = found["bits"].to_numpy()
    return packed


def holds(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of these int64 ids may be among those put in."""
    slot = _slots(np.ascontiguousarray(ids, dtype=np.int64))
    return (packed[(slot >> ts.U64(3)).astype(np.int64)] >> (slot & ts.U64(7)).astype(np.uint8)) & 1 == 1
