"""Bloom filters of fixed size: they keep every member and few others, whatever the data's size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, tidy

#: log2 of the number of bits of a filter of ids.
ID_BITS = 24
_CHUNKS = 64


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(values.view(np.uint64))
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def build(values: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of a filter of the first column of ``values`` (longs); merged by chunks, so a task holds one filter."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            for at in _places(np.asarray(batch.column(0), dtype=np.int64), bits):
                np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        packed = held.reshape(_CHUNKS, -1)
        used = [i for i in range(_CHUNKS) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[i].tobytes() for i in used], pa.binary())], names=["chunk", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    whole = np.zeros((_CHUNKS, (1 << bits) // 8 // _CHUNKS), np.uint8)
    for chunk, part in values.mapInArrow(tidy(fill), "chunk int, bits binary").groupBy("chunk").applyInArrow(merge, "chunk int, bits binary").collect():
        whole[chunk] = np.frombuffer(part, np.uint8)
    return whole.ravel()


def test(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be a member."""
    bits = (len(packed) * 8).bit_length() - 1
    found = np.ones(len(values), bool)
    for at in _places(values, bits):
        found &= (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def member_filter(ids: DataFrame, bits: int = ID_BITS):
    """A test for a long column: true for all ``ids``, and for few others."""
    held = ids.sparkSession.sparkContext.broadcast(build(ids, bits))

    @F.pandas_udf("boolean")
    def may_hold(values: pd.Series) -> pd.Series:
        return pd.Series(test(held.value, values.fillna(0).to_numpy(dtype=np.int64)))

    return may_hold
