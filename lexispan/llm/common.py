"""Helpers that the operators of this subpackage share.

Everything an executor writes for others goes below ``spark.checkpoint.dir``; the
session's setting is used as it is, and only a session in one process without one (a
test) gets a folder of its own.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

SPACES = b" \t\n\x0b\x0c\r"
WORD_SQL = r"[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors see."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lexispan-")
        found = _OWN[app]
    return found if re.match(r"\w+:", found) else "file://" + found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so a lost executor repeats no earlier stage, and lets later
    scans prune columns.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run: Callable) -> Callable:
    """A function of Arrow batches whose worker gives freed memory back when it ends; an idle worker then holds little."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped


def file_system(uri: str):
    """pyarrow file system and path of a URI in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of ``column``; a longer single row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        block = np.concatenate(([0], np.cumsum(sizes)[:-1])) // most
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def gathered(blocks: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of consecutive blocks with about ``most`` bytes together."""
    held, size = [], 0
    for block in blocks:
        if held and size + block.nbytes > most:
            yield held
            held, size = [], 0
        held.append(block)
        size += block.nbytes
    if held:
        yield held


class Texts:
    """A string column whose values become Python strings anew each time they are walked."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __iter__(self) -> Iterator[str | None]:
        return iter(self.column.to_pylist())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row bounds (len + 1); null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return starts, np.append(starts[1:], len(keys))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
