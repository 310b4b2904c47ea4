"""Language identification by word-first backoff.

A known word scores its log frequency in each language.  An unseen word falls back to
the longest character n-gram length at which any of its n-grams is known, down to
single letters.  A text's score for a language is the sum over all its words; the
prediction is the best language and the score its posterior under equal priors.

The model is counted from labelled texts only: of each language the documents whose
seeded hash falls under a rate that draws ``SAMPLE_DOCS`` of them (the documented bound of
the fit), and of these the commonest words and n-grams, ``WORDS`` and ``GRAMS`` for each
language and length.  All labels are learned.  The model grows with the number of
languages only, not with the corpus; it keeps what a language has counted and no zeros,
and is shipped to the workers.  Prediction covers every text as a whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_blocks, tidy

SAMPLE_DOCS = 1500
WORDS = 20_000
GRAMS = 8_000
LENGTHS = (5, 4, 3, 2, 1)
#: Scores (words times languages) that a worker keeps.
CACHE_SCORES = 1 << 20
#: Cost of an unknown word or n-gram, as a count.
SMOOTH = 0.5

_words = re.compile(r"[^\W\d_]+").findall


class Table:
    """Log frequencies of items in each language, as differences to those of an item that it never counted."""

    def __init__(self, items: list[str], starts: np.ndarray, langs: np.ndarray, above: np.ndarray, base: np.ndarray):
        self.packed = items, starts, langs, above, base
        self.place = {x: i for i, x in enumerate(items)}
        self.starts, self.langs, self.above, self.base = starts, langs, above, base

    @classmethod
    def of(cls, counts: dict[str, dict[str, int]], langs: Sequence[str]) -> "Table":
        number = {x: i for i, x in enumerate(langs)}
        starts = np.concatenate(([0], np.cumsum([len(c) for c in counts.values()], dtype=np.int64))).astype(np.int64)
        at = np.array([number[x] for c in counts.values() for x in c], np.int32)
        n = np.array([x for c in counts.values() for x in c.values()], np.float64)
        base = np.log(SMOOTH / (np.bincount(at, n, len(langs)) + SMOOTH * (len(counts) + 1)))
        return cls(list(counts), starts, at, np.log((n + SMOOTH) / SMOOTH).astype(np.float32), base)

    def sums(self, rows: np.ndarray, places: np.ndarray, n_rows: int) -> np.ndarray:
        """Sums over the items at ``places`` for each row, as differences to the base."""
        n = self.starts[places + 1] - self.starts[places]
        at = np.repeat(self.starts[places] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        size = len(self.base)
        return np.bincount(np.repeat(rows, n) * size + self.langs[at], self.above[at], n_rows * size).reshape(n_rows, size)


class LanguageModel:
    """Log frequencies of words and n-grams in each language."""

    def __init__(self, langs: Sequence[str], words: Table, grams: dict[int, Table]):
        """``grams``: tables by length."""
        self.langs, self.words = list(langs), words
        self.grams = dict(sorted(grams.items(), reverse=True))
        self._reset()

    @classmethod
    def counted(cls, langs: Sequence[str], words: dict[str, dict[str, int]], grams: dict[int, dict[str, dict[str, int]]]) -> "LanguageModel":
        """From counts by item and language."""
        langs = sorted(langs)
        return cls(langs, Table.of(words, langs), {n: Table.of(g, langs) for n, g in grams.items()})

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.most = max(1000, CACHE_SCORES // max(1, len(self.langs)))
        self.table = np.zeros((1 << 10, len(self.langs)))

    def words_scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each lower-case word: of the word itself, else the mean of its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        get = self.words.place.get
        places = np.array([get(w, -1) for w in words], np.int64)
        hit = np.flatnonzero(places >= 0)
        out[hit] = self.words.base + self.words.sums(np.arange(len(hit)), places[hit], len(hit))
        left = np.flatnonzero(places < 0).tolist()
        for n, known in self.grams.items():
            get = known.place.get
            found, rows, held, still = [], [], [], []
            for i in left:
                padded = f" {words[i]} "
                own = [g for j in range(len(padded) - n + 1) if (g := get(padded[j : j + n])) is not None]
                if own:
                    rows += [len(found)] * len(own)
                    held += own
                    found.append((i, len(own)))
                else:
                    still.append(i)
            if found:
                at, many = np.array(found).T
                mean = known.base + known.sums(np.array(rows), np.array(held), len(at)) / many[:, None]
                out[at] = mean * np.maximum(1, -(-many // n))[:, None]
            left = still
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior for each text; ``und`` and 0 for null or a text without letters, or if nothing was learned."""
        split = [_words(t.lower()) if t and self.langs else [] for t in texts]
        fresh = set().union(*split).difference(self.rows)
        if len(self.rows) + len(fresh) > self.most:
            self._reset()
            fresh = set().union(*split)
        new = list(fresh)
        n = len(self.rows)
        self.rows.update(zip(new, range(n, n + len(new))))
        if n + len(new) > len(self.table):
            self.table = np.concatenate((self.table[:n], np.zeros((n + 2 * len(new), len(self.langs)))))
        for i in range(0, len(new), 1 << 14):
            self.table[n + i : n + i + (1 << 14)][: len(new) - i] = self.words_scores(new[i : i + (1 << 14)])
        out = []
        for words in split:
            if not words:
                out.append(("und", 0.0))
                continue
            found = self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
            out.append((self.langs[int(found.argmax())], float(1 / np.exp(found - found.max()).sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """``predict_all`` for one text."""
        return self.predict_all([text])[0]


def _counts(rows: list) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, item, n in rows:
        out[item][lang] = n
    return out


def _pieces(word: Column, n: int) -> Column:
    """All n-grams of a word; a shorter word itself."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))


def _commonest(counts: DataFrame, by: list[str], item: str, most: int) -> DataFrame:
    """Rows (by, item, n) of the ``most`` items of largest n for each ``by``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), item))
    return counts.withColumn("place", place).where(F.col("place") <= most).drop("place")


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, words: int = WORDS, grams: int = GRAMS) -> LanguageModel:
    """Model from rows (doc_id, text, lang); null texts and labels teach nothing.

    The counts run distributed over the sample; what reaches the driver is bounded by
    languages * (words + lengths * grams) rows.  Ties among words and n-grams go to the
    smaller one; rows that repeat count each.  From an empty table nothing is learned.
    """
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    # one row a language, as a table of known size: Spark broadcasts it if that allows
    rates = stage(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).select("lang", (F.lit(float(sample_docs)) / F.col("docs")).alias("rate")), "language-rates")
    draw = (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))
    sample = usable.withColumn("draw", draw).join(rates, "lang").where("draw < rate")
    each = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        langs = [r[0] for r in each.select("lang").distinct().orderBy("lang").collect()]
        by_word = _commonest(each.select("lang", "word", "n"), ["lang"], "word", words).collect()
        padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
        at = F.array(*[F.struct(F.lit(n).alias("k"), _pieces(padded, n).alias("grams")) for n in LENGTHS])
        cut = each.select("lang", "n", F.explode(at).alias("c")).select("lang", "n", "c.k", F.explode("c.grams").alias("gram")).where(F.length("gram") == F.col("k"))
        grams_n = cut.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
        by_gram = _commonest(grams_n, ["lang", "k"], "gram", grams).collect()
    finally:
        each.unpersist()
    return LanguageModel.counted(langs, _counts(by_word), {n: _counts([(r["lang"], r["gram"], r["n"]) for r in by_gram if r["k"] == n]) for n in LENGTHS})


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score; texts are read whole.

    Columns of ``docs`` by these names give way.  A null text, and one without a letter, is
    ``und`` with score 0; ties go to the language that is first in order.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.langs, model.words.packed, {n: g.packed for n, g in model.grams.items()}))
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words, grams = held.value
        own = LanguageModel(langs, Table(*words), {n: Table(*g) for n, g in grams.items()})
        for block in text_blocks(batches):
            found = own.predict_all(block.column("text").to_pylist())
            columns = [block.column(i) for i in range(len(names))] + [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(column: str = "doc_id"):
    """Whether a document is kept from training."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
