"""Searches of query vectors against shards of all rows.

A row's shard follows from its id, and the number of shards from the table alone.  Every
shard meets all queries: its rows come first in a task, its index is built once, and the
queries stream past it.  Few shards are repeated for groups of queries, so that
small tables use more than one task.  Each shard returns its best rows for each query, and
these lists are merged.  Vectors of different lengths count as padded with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

#: Rows and bytes (as doubles) of a shard, at most (about); cells that small tables make; queries searched at once.
SHARD_ROWS, SHARD_BYTES, CELLS, QUERIES = 1 << 16, 64 << 20, 16, 64


def usable(vectors: DataFrame, id_column: str, vector_column: str, zero_too: bool) -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part: not null, no null or non-finite component; zero vectors only if ``zero_too``."""
    x = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).alias("vec_id"), x.alias("vector")).where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    return rows if zero_too else rows.where(F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    lengths = np.asarray(column.value_lengths())
    dim = int(lengths.max(initial=0))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    matrix = np.zeros((len(lengths), dim))
    matrix[np.arange(dim) < lengths[:, None]] = flat
    return matrix


def _widened(matrix: np.ndarray, dim: int) -> np.ndarray:
    return matrix if matrix.shape[1] >= dim else np.pad(matrix, ((0, 0), (0, dim - matrix.shape[1])))


def search(rows: DataFrame, is_query: Column, k: int, index: Callable[[np.ndarray, np.ndarray], Callable], score_type: str) -> DataFrame:
    """``k`` best rows for each query: query_id, rank, vec_id, score; ties to the smaller vec_id.

    ``index(ids, vectors)`` takes a shard in order of id and returns a function of some
    (query_ids, queries), which returns (query_id, vec_id, score) arrays with at least the
    best ``k`` rows for each.  Queries may be longer than the shard's vectors.
    """
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    shards = max(1, -(-n // max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * max(1, dim or 1))))))
    groups = max(1, CELLS // shards)
    numbered = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    every = rows.select("vec_id", "vector", numbered(shards, 1).alias("s"), spread(groups).alias("g"), F.lit(False).alias("asks"))
    asked = rows.where(is_query).select("vec_id", "vector", spread(shards).alias("s"), numbered(groups, 2).alias("g"), F.lit(True).alias("asks"))
    cells = every.union(asked).repartition(shards * groups, "s", "g").sortWithinPartitions("s", "g", "asks", "vec_id")
    kind = pa.int64() if score_type == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, answer = None, [], None
        for batch in batches:
            s, g, asks = (np.asarray(batch.column(c)) for c in ("s", "g", "asks"))
            cuts = np.flatnonzero((np.diff(s) != 0) | (np.diff(g) != 0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if cell != (s[a], g[a]):
                    cell, held, answer = (s[a], g[a]), [], None
                ids, matrix = np.asarray(batch.column("vec_id"))[a:b], _matrix(batch.column("vector").slice(a, b - a))
                if not asks[a]:
                    held.append((ids, matrix))
                    continue
                if answer is None:
                    if not held:
                        continue
                    wide = max(m.shape[1] for _, m in held)
                    answer = index(np.concatenate([i for i, _ in held]), np.concatenate([_widened(m, wide) for _, m in held]))
                    held = []
                matrix = _widened(matrix, wide)
                for i in range(0, len(ids), QUERIES):
                    found = answer(ids[i : i + QUERIES], matrix[i : i + QUERIES])
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], kind)], names=["query_id", "vec_id", "score"])

    best = cells.mapInArrow(tidy(run), f"query_id long, vec_id long, score {score_type}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id, best first."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))
