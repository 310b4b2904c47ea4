"""Topics by non-negative matrix factorisation, and principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import text_blocks
from .words import WIDE, mapped, stops, words_of

#: A round that lowers the squared error by less than this share of the first one is the last.
TOLERANCE = 1e-5
#: Rounds that find the singular vectors of the start, and vectors beyond the topics that they carry.
POWER, SPARE = 7, 10


def _content(block: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words without stopwords in order, of two letters or numbers at least and in lower case: codes, distinct words, text of each."""
    codes, words, at = words_of(block.column("text"))
    content = ~stops(words)[codes]
    return codes[content].astype(np.int64), words, np.repeat(np.arange(block.num_rows), np.diff(at))[content]


def _counts(key: np.ndarray, row: np.ndarray, rows: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, all below ``most``, the rows that have each and how often it stands."""
    names = None
    if most * rows >= WIDE:
        names, key = np.unique(key, return_inverse=True)
    own, n = np.unique(key * rows + row, return_counts=True)
    key = own // rows
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key = key[begins]
    return key if names is None else names[key], np.diff(np.concatenate((begins, [len(own)]))), np.add.reduceat(n, begins)


def _words_of(block: pa.RecordBatch) -> Iterator[dict]:
    codes, words, row = _content(block)
    if len(codes):
        key, df, total = _counts(codes, row, block.num_rows, len(words))
        yield {"term": words.take(pa.array(key)), "df": df, "total": total}


def _pairs_of(block: pa.RecordBatch, common: pa.Array) -> Iterator[dict]:
    codes, words, row = _content(block)
    own, d = pc.fill_null(pc.index_in(words, value_set=common), -1).to_numpy().astype(np.int64)[codes], len(common)
    first = np.flatnonzero((row[:-1] == row[1:]) & (own[:-1] >= 0) & (own[1:] >= 0))
    if len(first):
        key, df, total = _counts(own[first] * d + own[first + 1], row[first], block.num_rows, d * d)
        yield {"term": pc.binary_join_element_wise(common.take(pa.array(key // d)), common.take(pa.array(key % d)), pa.scalar(" ", pa.large_string())), "df": df, "total": total}


def vocabulary(docs: DataFrame, features: int, least_df: int, most_df: float) -> tuple[list[str], np.ndarray]:
    """The commonest words and pairs of neighbouring words within the document frequencies, sorted, and their idf.

    A pair stands no oftener than its rarer word: one with a word below the last place that words alone
    would fill has no place, and is not counted.
    """
    n_docs = docs.count()

    def counted(of) -> DataFrame:
        found = mapped(docs.select("text"), of, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        return found.withColumn("fits", (F.col("df") >= least_df) & (F.col("df") <= most_df * n_docs))

    def top(counts: DataFrame) -> list:
        return counts.where("fits").orderBy(F.desc("total"), "term").limit(features).collect()

    words = counted(_words_of).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = top(words)
        last = max(least_df, rows[-1]["total"]) if len(rows) == features else least_df
        common = pa.array(sorted(r["term"] for r in words.where(F.col("total") >= last).select("term").collect()), pa.large_string())
    finally:
        words.unpersist()
    sent = docs.sparkSession.sparkContext.broadcast(common)
    rows += top(counted(lambda block: _pairs_of(block, sent.value)))
    sent.unpersist()
    found = sorted((r["term"], r["df"]) for r in sorted(rows, key=lambda r: (-r["total"], r["term"]))[:features])
    return [t for t, _ in found], np.log((1 + n_docs) / (1 + np.array([n for _, n in found], float))) + 1


class Places:
    """Places of words and pairs of words among the terms."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        self.words = pa.array(sorted({w for t in split for w in t}), pa.large_string())
        at = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.size = len(at)
        self.single, pairs = np.full(self.size + 1, -1), {}
        for i, t in enumerate(split):
            if len(t) == 1:
                self.single[at[t[0]]] = i
            else:
                pairs[at[t[0]] * self.size + at[t[1]]] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.pairs = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def of(self, codes: np.ndarray, words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of all words and pairs that are terms."""
        own = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)[codes]
        place = self.single[own]
        first = np.flatnonzero((row[:-1] == row[1:]) & (own[:-1] >= 0) & (own[1:] >= 0)) if len(self.keys) else np.zeros(0, np.int64)
        key = own[first] * self.size + own[first + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key if len(self.keys) else np.zeros(0, bool)
        return np.concatenate((row[place >= 0], row[first[hit]])), np.concatenate((place[place >= 0], self.pairs[at[hit]]))


def weights(docs: DataFrame, terms: list[str], idf: np.ndarray) -> DataFrame:
    """Blocks of documents: sizes (terms of each), terms and w (their places and sublinear tf-idf, rows of norm 1), as bytes."""
    given = docs.sparkSession.sparkContext.broadcast((terms, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, scale = given.value
        places = Places(terms)
        for block in text_blocks(batches):
            row, place = places.of(*_content(block))
            key, tf = np.unique(row * len(terms) + place, return_counts=True)
            row, at = key // len(terms), (key % len(terms)).astype(np.int32)
            sizes = np.bincount(row, minlength=block.num_rows).astype(np.int32)
            w = (1 + np.log(tf.astype(float))) * scale[at]
            w /= np.sqrt(np.bincount(row, w * w, len(sizes)))[row]
            yield pa.RecordBatch.from_pydict({"sizes": [sizes.tobytes()], "terms": [at.tobytes()], "w": [w.astype(np.float32).tobytes()]}, pa.schema([(c, pa.binary()) for c in ("sizes", "terms", "w")]))

    return docs.select("text").mapInArrow(run, "sizes binary, terms binary, w binary")


class Rows:
    """A block's matrix, documents by terms."""

    def __init__(self, sizes: bytes, terms: bytes, w: bytes, n_terms: int):
        self.sizes, self.terms, self.w, self.n_terms = np.frombuffer(sizes, np.int32), np.frombuffer(terms, np.int32).astype(np.intp), np.frombuffer(w, np.float32).astype(float), n_terms
        self.some = np.flatnonzero(self.sizes)
        self.begins = (np.cumsum(self.sizes) - self.sizes)[self.some]

    def times(self, m: np.ndarray) -> np.ndarray:
        """Transposed product with (vectors, terms): (vectors, documents)."""
        out = np.zeros((len(m), len(self.sizes)))
        for own, v in zip(out, m):
            if len(self.some):
                own[self.some] = np.add.reduceat(v.take(self.terms) * self.w, self.begins)
        return out

    def across(self, m: np.ndarray) -> np.ndarray:
        """(vectors, documents) times the block: (vectors, terms)."""
        return np.array([np.bincount(self.terms, np.repeat(v, self.sizes) * self.w, self.n_terms) for v in m])


def shares(a: np.ndarray, gram: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Non-negative least squares, W of (topics, documents) from H X' and H H', by coordinate descent."""
    w = np.zeros_like(a)
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(gram.diagonal() > 0):
            new = np.maximum(0, w[j] + (a[j] - gram[j] @ w) / gram[j, j])
            moved += np.abs(new - w[j]).sum()
            w[j] = new
        if moved <= 1e-3 * w.sum():
            break
    return w


def factorise(docs: DataFrame, topics: int = 15, features: int = 5000, rounds: int = 500, seed: int = 42) -> tuple[list[str], np.ndarray]:
    """Terms and the topic-term matrix H of the tf-idf of words and word pairs.

    H starts from singular vectors (nndsvda).  Each round solves the documents' weights for
    H on the executors and H for the weights on the driver, until the error falls no
    further; only sums of size (topics + SPARE) * features reach the driver.
    """
    terms, idf = vocabulary(docs, features, 5, 0.95)
    n = len(terms)
    if not n:
        return terms, np.zeros((topics, 0))
    # few tasks, as each sends its sums to the driver
    rows = weights(docs, terms, idf).coalesce(max(8, 2 * docs.sparkSession.sparkContext.defaultParallelism)).persist(StorageLevel.MEMORY_AND_DISK)

    def summed(of, *given: np.ndarray) -> list[np.ndarray]:
        """Sums over all blocks of the arrays that ``of(block, *given)`` has."""
        sent = docs.sparkSession.sparkContext.broadcast(given)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for r in batch.to_pylist():
                    own = of(Rows(r["sizes"], r["terms"], r["w"], n), *sent.value)
                    total = own if total is None else [x + y for x, y in zip(total, own)]
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": [[x.tobytes() for x in total]]}, pa.schema([("sums", pa.list_(pa.binary()))]))

        total = None
        for p in rows.mapInArrow(run, "sums array<binary>").collect():
            own = [np.frombuffer(x) for x in p["sums"]]
            total = own if total is None else [x + y for x, y in zip(total, own)]
        sent.unpersist()
        return total

    try:
        kept = min(topics, n)
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, topics + SPARE))))[0]
        for _ in range(POWER):
            q = np.linalg.qr(summed(lambda x, v: [x.across(x.times(v))], q.T)[0].reshape(q.shape[::-1]).T)[0]
        gram = summed(lambda x, v: [(y := x.times(v)) @ y.T], q.T)[0].reshape(q.shape[1], -1)
        values, turned = np.linalg.eigh(gram)
        s = np.sqrt(np.maximum(values[::-1][:kept], 0))
        v = (q @ turned[:, ::-1][:, :kept]).T
        up, down, weight, square, n_docs = summed(lambda x, v: [((y := x.times(v)).clip(0) ** 2).sum(1), ((-y).clip(0) ** 2).sum(1), np.array([x.w.sum()]), np.array([(x.w**2).sum()]), np.array([float(len(x.sizes))])], v)
        h = np.zeros((topics, n))
        for j in range(kept):
            positive, negative = v[j].clip(0), (-v[j]).clip(0)
            side, u = (positive, up[j]) if np.linalg.norm(positive) ** 2 * up[j] >= np.linalg.norm(negative) ** 2 * down[j] else (negative, down[j])
            if j == 0:
                h[0] = np.sqrt(s[0]) * np.abs(v[0])
            elif s[j] > 0 and (size := np.linalg.norm(side)):
                h[j] = np.sqrt(s[j] * (np.sqrt(u) / s[j]) * size) * side / size
        h[h < 1e-6] = weight[0] / (n_docs[0] * n)
        before = first = np.inf
        for _ in range(rounds):
            top, both = summed(lambda x, h: [x.across(w := shares(x.times(h), h @ h.T)), w @ w.T], h)
            top, both = top.reshape(h.shape), both.reshape(topics, topics)
            error = square[0] - 2 * (top * h).sum() + (both * (h @ h.T)).sum()
            first = error if first == np.inf else first
            if before - error <= TOLERANCE * first:
                break
            before = error
            for _ in range(10):
                for j in np.flatnonzero(both.diagonal() > 0):
                    h[j] = np.maximum(0, h[j] + (top[j] - both[j] @ h) / both[j, j])
    finally:
        rows.unpersist()
    return terms, h


def top_words(docs: DataFrame, topics: int = 15, words: int = 12) -> DataFrame:
    terms, h = factorise(docs, topics)
    rows = [(int(i), ", ".join(terms[j] for j in np.argsort(-row, kind="stable")[:words] if j < len(terms))) for i, row in enumerate(h)]
    return docs.sparkSession.createDataFrame(rows, "topic_id int, top_words string")


def pca(vectors: DataFrame, k: int) -> DataFrame:
    """Centred principal components of all vectors; signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="x").fit(rows).transform(rows)
    found = PCA(k=k, inputCol="x", outputCol="pc").fit(centred).transform(centred).withColumn("pc", vector_to_array("pc"))
    return found.select("vec_id", *(F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)))
