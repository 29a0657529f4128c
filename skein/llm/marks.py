"""Tables of marks: which keys of a scan may be asked for, in a size that does not depend on their number.

A table has a mark for every key asked for, and by chance for others, the more the fuller it is. It
only keeps rows out of a shuffle; the join that follows decides. A full table keeps nothing out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)


def id_slots(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.int64).view(np.uint64) * _STEP) >> np.uint64(40)).astype(np.int64) % SLOTS


def _slots(batches: Iterator[pa.RecordBatch], slots: Callable[[pa.Array], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots(batch.column(0))), pa.int64())], ["slot"])


def marks(keys: DataFrame, slots: Callable[[pa.Array], np.ndarray]) -> Broadcast:
    """The table of the keys (one column), as a bit for each of SLOTS slots; at most SLOTS / 32 rows come to the driver."""
    words = keys.mapInArrow(partial(_slots, slots=slots), "slot bigint").groupBy(F.expr("slot div 32").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 AS int))")).alias("bits"))
    table = np.zeros(SLOTS // 32, np.uint32)
    for r in words.collect():
        table[r["at"]] = r["bits"]
    return keys.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def marked(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
