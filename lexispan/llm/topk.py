"""Exact top-k inner products by MaxScore.

Each dimension and sign is a term; its posting list holds the rows whose component has that
sign, block by block of rows, and its score bound for a query is the query's component
times the largest in the list.  Terms are ordered by bound.  Those whose bounds together
do not exceed the k-th best score so far are non-essential: a row in none but their lists
cannot enter.  Within a block the essential lists are traversed; the other terms are
probed only for rows whose score so far plus the bounds left is still competitive, those
first which can only lower it.  After each block the threshold rises to the k-th best score,
and more terms become non-essential.  Shards' lists are merged; the result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, search, usable

#: Rows of a block; probed terms between two prunings.
BLOCK, PROBES = 4096, 8


class Postings:
    """Posting lists of one shard, for ``k`` best rows a query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.by_term = np.ascontiguousarray(vectors.T)
        self.most = float(np.abs(self.by_term).max(initial=0)) * max(1, len(self.by_term))
        self.high, self.low = np.maximum(self.by_term.max(axis=1), 0), np.maximum(-self.by_term.min(axis=1), 0)
        self.blocks = range(0, len(ids), BLOCK)
        #: By block, sign (0: positive) and dimension: rows in the block, and their components.
        self.lists = [[[(at := np.flatnonzero(test(x)).astype(np.int32), x[at]) for x in self.by_term[:, a : a + BLOCK]] for test in (lambda x: x > 0, lambda x: x < 0)] for a in self.blocks]

    def best(self, query_id: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best rows but ``query_id``'s own."""
        if float(np.abs(q).max(initial=0)) * self.most >= 1 << 53:  # sums of doubles would not be exact
            own = np.flatnonzero(self.ids != query_id)
            scores = (self.by_term[:, own].astype(object).T @ q.astype(object)) if len(own) else np.zeros(0)
            top = best_of(self.ids[own], scores.astype(np.int64), self.k)
            return self.ids[own][top], scores.astype(np.int64)[top]
        bounds = np.where(q > 0, q * self.high, -q * self.low)
        terms = np.argsort(-bounds, kind="stable")
        terms = terms[q[terms] != 0]
        left = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)  # bounds of the terms from each place on
        top_ids, top_scores, least = np.zeros(0, np.int64), np.zeros(0), None
        for a, lists in zip(self.blocks, self.lists):
            ids = self.ids[a : a + BLOCK]
            essential = len(terms) if least is None else int(np.searchsorted(-left, -least, side="left"))
            scores, touched = np.zeros(len(ids)), np.zeros(len(ids), bool)
            for d in terms[:essential].tolist():
                rows, components = lists[0 if q[d] > 0 else 1][d]
                scores[rows] += q[d] * components
                touched[rows] = True
            # later rows of the same score have larger ids, so only higher ones enter
            live = np.arange(len(ids)) if least is None else np.flatnonzero(touched & (scores + left[essential] > least))
            block = self.by_term[:, a : a + BLOCK]
            partial = scores[live]
            for i, d in enumerate(terms.tolist()):
                x = block[d, live]
                partial = partial + q[d] * ((np.minimum(x, 0) if q[d] > 0 else np.maximum(x, 0)) if i < essential else x)
                if least is not None and i % PROBES == PROBES - 1:
                    keep = partial + left[max(i + 1, essential)] > least
                    live, partial = live[keep], partial[keep]
            other = ids[live] != query_id
            live, partial = live[other], partial[other]
            top_ids, top_scores = np.concatenate((top_ids, ids[live])), np.concatenate((top_scores, partial))
            top = best_of(top_ids, top_scores, self.k)
            top_ids, top_scores = top_ids[top], top_scores[top]
            least = top_scores[-1] if len(top_scores) == self.k else None
        return top_ids, top_scores.astype(np.int64)


def top_k(vectors: DataFrame, k: int, every: int, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of every ``every``-th id with all other rows.

    Components become floor(scale * x).  Null vectors, ids or components and non-finite
    components take no part; zero vectors do.  A row that repeats a query's id is the
    query's own and no candidate of it; a repeated query is asked as often.  An empty
    table has no result; other columns are ignored.
    """
    rows = usable(vectors, id_column, vector_column, zero_too=True)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))

    def index(ids, matrix):
        held = Postings(ids, matrix, k)

        def answer(query_ids, queries):
            found = [held.best(i, q[: matrix.shape[1]]) for i, q in zip(query_ids.tolist(), queries)]
            return np.repeat(query_ids, [len(x) for x, _ in found]), np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

        return answer

    return search(rows, F.col("vec_id") % every == 0, k, index, "long")


def op5_max_score(spark, sf_dir: str) -> DataFrame:
    """Five best for every 50th vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 5, 50)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
