"""Approximate nearest neighbours by collision-counting hashing.

Each shard indexes all of its rows by single projections onto seeded Gaussian
directions, and keeps for each direction a bitmap of the rows below every edge between
two buckets.  A query opens a window around its own projection in every direction: the
rows in it are the difference of two bitmaps.  Collisions are counted for 64 rows at once by
adders over the bits of the windows, for many queries in step; virtual rehashing widens a
query's windows by ``GROW``.  A window's half-width is a radius: a row at that distance lies
in it with probability erf(1 / sqrt(2)).  Rows that collide as often as all but a few rows at
the radius do are verified: their exact inner product is computed.  A query ends when ``k``
verified rows lie within the radius, or all rows are verified; there is no cap on what
is verified.  The first radius is about that of the ``k``-th row, told from the best of
``SAMPLE`` rows of the shard; all rows are indexed.

Largest inner product is nearest distance after a row gets one more component that
brings all norms to the largest norm, and the query is scaled to it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, search, usable

#: Directions; standard deviations below the mean count that rows at the radius may have; least radius, in norms, and its growth.
DIRECTIONS, BELOW, START, GROW = 192, 1.0, 0.8, 1.05
#: Buckets of a direction, from -SPREAD to SPREAD norms (the outer ones are open); rows counted in step; rows of a shard that tell the first radius.
BUCKETS, SPREAD, BLOCK, SAMPLE = 32, 3.2, 1 << 14, 1 << 12


class _Counter:
    """Sums of bits for many places at once: one array a binary digit, summed by carry-save adders."""

    def __init__(self):
        self.held: list[list[np.ndarray]] = []

    def add(self, x: np.ndarray, digit: int = 0) -> None:
        while True:
            while digit >= len(self.held):
                self.held.append([])
            own = self.held[digit]
            own.append(x)
            if len(own) < 3:
                return
            a, b, c = own
            u = a ^ b
            a &= b
            np.bitwise_and(u, c, out=b)
            u ^= c
            a |= b
            own[:] = [u]
            x, digit = a, digit + 1

    def digit(self, wanted: int) -> np.ndarray | None:
        """A digit of the sums, to be read last."""
        for i in range(wanted):
            if i < len(self.held) and len(self.held[i]) == 2:
                self.add(self.held[i][0] & self.held[i][1], i + 1)
        own = self.held[wanted] if wanted < len(self.held) else []
        return None if not own else own[0] if len(own) == 1 else own[0] ^ own[1]


class ShardIndex:
    """Bitmaps of the rows of one shard by their projections."""

    def __init__(self, vectors: np.ndarray, norm: float, seed: int, directions: int = DIRECTIONS):
        self.vectors, self.norm = vectors, norm
        n = len(vectors)
        lift = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
        self.axes = np.random.default_rng(seed).standard_normal((directions, vectors.shape[1] + 1))
        #: By block of rows: direction, edge (the first: no row, the last: all), words of 64 rows.
        self.below = []
        for a in range(0, n, BLOCK):
            part = self.axes[:, :-1] @ vectors[a : a + BLOCK].T + self.axes[:, -1:] * lift[a : a + BLOCK]
            row = np.arange(part.shape[1])
            size, bit = -(-len(row) // 64) * 8, (1 << (row & 7)).astype(float)
            bits = np.empty((directions, BUCKETS + 1, size), np.uint8)
            for held, values in zip(bits, part):
                # a row lies below the edge behind its bucket and all later ones
                edge = np.clip(np.ceil(self._edges(values)), 1, BUCKETS).astype(np.int64)
                own = np.bincount(edge * size + (row >> 3), bit, held.size).astype(np.uint8).reshape(held.shape)
                np.bitwise_or.accumulate(own, axis=0, out=held)
            self.below.append(bits.view(np.uint64))
        p = math.erf(1 / math.sqrt(2))
        self.threshold = max(1, math.floor(directions * p - BELOW * math.sqrt(directions * p * (1 - p))))
        self.sample = np.unique(np.linspace(0, n - 1, min(n, SAMPLE)).astype(np.int64))
        self.sampled = vectors[self.sample]

    def _edges(self, values: np.ndarray) -> np.ndarray:
        """Values in steps of the edges: 1 at the first edge between two buckets, BUCKETS - 1 at the last."""
        return (values / (SPREAD * self.norm) + 1) * ((BUCKETS - 2) / 2) + 1

    def _window(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest edges of the windows, by direction and query; beyond the outer ones no row and all rows lie below."""
        return tuple(np.clip(np.rint(self._edges((at + r[:, None]).T)), 0, BUCKETS).astype(np.int64) for r in (-radius, radius))

    def _colliding(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bits of the rows that collide often enough, for each query; from edges by direction and query."""
        directions, digits = len(low), len(low).bit_length()
        bias = (1 << digits) - self.threshold  # with it, enough collisions carry into the digit past the count's
        out = []
        for bits in self.below:
            count = _Counter()
            for d in range(digits):
                if bias >> d & 1:
                    count.add(np.full((low.shape[1], bits.shape[2]), np.iinfo(np.uint64).max), d)
            for i in range(directions):
                window = bits[i].take(high[i], axis=0)
                window ^= bits[i].take(low[i], axis=0)
                count.add(window)
            enough = count.digit(digits)
            out.append(np.zeros((low.shape[1], bits.shape[2]), np.uint64) if enough is None else enough)
        return np.concatenate(out, axis=1)

    def _first_radius(self, queries: np.ndarray, k: int, own: list[np.ndarray], scale: np.ndarray) -> np.ndarray:
        """About the radius of the ``k``-th row for each query, by the sample."""
        scores = queries @ self.sampled.T
        best = np.empty(len(queries))
        for i, (x, o) in enumerate(zip(scores, own)):
            at = np.searchsorted(self.sample, o)
            hit = at < len(self.sample)
            hit[hit] = self.sample[at[hit]] == o[hit]
            x[at[hit]] = -np.inf
            left = len(x) - int(hit.sum())
            rank = min(left, -(-k * left // max(1, len(self.vectors) - len(o))))
            best[i] = np.partition(x, len(x) - rank)[len(x) - rank] if rank else np.inf
        return np.maximum(START * self.norm, np.sqrt(np.maximum(0, 2 * (self.norm * self.norm - scale * best))))

    def candidates_of(self, queries: np.ndarray, k: int, own: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places of the rows verified, without its ``own``, and their inner products with it."""
        n, words = len(self.vectors), sum(b.shape[2] for b in self.below)
        scale = self.norm / np.sqrt((queries * queries).sum(axis=1))
        at = (queries * scale[:, None]) @ self.axes[:, :-1].T
        radius = self._first_radius(queries, k, own, scale)
        # blocks but the last fill whole words, so a row's bit is at its place
        done = np.zeros((len(queries), words * 8), np.uint8)
        for bits, o in zip(done, own):
            np.bitwise_or.at(bits, o >> 3, (1 << (o & 7)).astype(np.uint8))
        found: list[list[np.ndarray]] = [[] for _ in queries]
        scores: list[list[np.ndarray]] = [[] for _ in queries]
        open_ = np.arange(len(queries))
        while len(open_):
            now = self._colliding(*self._window(at[open_], radius[open_])).view(np.uint8)
            new = now & ~done[open_]
            done[open_] |= now
            on = []
            for i, bits in zip(open_.tolist(), new):
                places = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
                found[i].append(places)
                scores[i].append(np.einsum("ij,j->i", self.vectors[places], queries[i]))
                # the inner product of a row at the radius
                least = (self.norm * self.norm - radius[i] * radius[i] / 2) / scale[i]
                if sum(int((x >= least).sum()) for x in scores[i]) < k and sum(map(len, found[i])) < n - len(own[i]):
                    on.append(i)
            open_ = np.array(on, np.int64)
            radius[open_] *= GROW
        return [(np.concatenate(p), np.concatenate(s)) for p, s in zip(found, scores)]

    def candidates(self, query: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``candidates_of`` for one query."""
        return self.candidates_of(query[None], k, [own])[0]


def nearest(vectors: DataFrame, k: int, every: int, seed: int = 42, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """About the ``k`` largest inner products of every ``every``-th id with all other rows, scored exactly.

    Null and zero vectors, null ids, and vectors with null or non-finite components
    take no part.  Fewer than ``k`` candidates are all returned.  Rows that repeat a
    query's id are its own and no candidates; a repeated query is asked as often.  An
    empty table has no result; other columns are ignored.
    """
    rows = usable(vectors, id_column, vector_column, zero_too=False)
    norm = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 1.0

    def index(ids, matrix):
        held = ShardIndex(matrix, norm, seed)

        def answer(query_ids, queries):
            queries = queries[:, : matrix.shape[1]]
            own = [np.flatnonzero(ids == i) for i in query_ids.tolist()]
            # a query without a component in common with the shard scores 0 with every row
            asked = queries.any(axis=1)
            verified = iter(held.candidates_of(queries[asked], k, [o for o, x in zip(own, asked) if x]))
            out = []
            for query_id, o, x in zip(query_ids.tolist(), own, asked):
                if x:
                    places, scores = next(verified)
                else:
                    places = np.delete(np.arange(len(ids)), o)
                    scores = np.zeros(len(places))
                top = best_of(ids[places], scores, k)
                out.append((np.full(len(top), query_id), ids[places[top]], scores[top]))
            return tuple(np.concatenate(x) for x in zip(*out))

        return answer

    return search(rows, F.col("vec_id") % every == 0, k, index, "double")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """Twenty nearest of every 20th vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20, 20)
