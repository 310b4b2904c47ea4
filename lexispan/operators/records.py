"""Raw article records to rows: dates, labels, word counts, categories, encodings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import exists
from .html import extract_text

LEAST_WORDS, MOST_WORDS = 50, 15_000
#: Characters of a text that are encoded.
ENCODED_CHARS = 4096
# Labels of each article type, in order of precedence.
TYPES = [
    ("letter", ["letters", "letter", "community"]),
    ("editorial", ["editorial", "editorials"]),
    ("op-ed", ["op-ed", "op-eds", "oped"]),
    ("column", ["column", "columnists", "columnist"]),
    ("opinion", ["opinion", "opinions"]),
    ("news", ["news", "university", "local", "national", "world"]),
]


def safe_div(n: Column, d: Column, default: float = 0.0) -> Column:
    """n / d, or the default where d is 0."""
    return F.when(d == 0, F.lit(default)).otherwise(F.try_divide(n.cast("double"), d.cast("double")))


def parsed_date(iso: Column, strict: bool = False) -> Column:
    """Date of the first ten characters; what is none is null, or an error in strict mode."""
    head = F.substring(iso, 1, 10)
    found = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("Cannot parse date: "), F.coalesce(iso, F.lit("null")))).cast("date")) if strict else found


def url_date(url: Column) -> Column:
    """yyyy-mm-dd of a dated URL, else null."""
    pattern = r"/(\d{4})/(\d{2})/(\d{2})/"
    return F.when(url.rlike(pattern), F.concat_ws("-", *(F.regexp_extract(url, pattern, i) for i in (1, 2, 3))))


def url_id(url: Column) -> Column:
    """The MD5 of a URL as a number modulo 10 ** 10."""
    digest = F.md5(url.cast("binary"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.conv(F.substring(digest, i, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: (a * 65536 + x) % 10_000_000_000)


def normalized(text: Column) -> Column:
    """Runs of white space of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def article_type(labels: Column) -> Column:
    """Type by the first kind that has a label in the array, whatever its case."""
    lower = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(x))
    found = F.lit("other")
    for name, words in reversed(TYPES):
        found = F.when(F.coalesce(F.arrays_overlap(lower, F.array(*map(F.lit, words))), F.lit(False)), F.lit(name)).otherwise(found)
    return found


def build_rows(raw: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows of articles from raw records and (id, slug); without a date, or too short or long, a record is left out."""
    known = categories.where("slug is not null").groupBy("id").agg(F.min("slug").alias("slug")).select(F.col("id").alias("category_id"), "slug")
    listed = raw.select("id", F.posexplode("category_ids").alias("pos", "category_id")).distinct().join(known, "category_id")
    slugs = listed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "slug"))), lambda x: x["slug"]).alias("slugs"))
    rows = raw.join(slugs, "id", "left").withColumns({"day": parsed_date(F.col("date")), "text": extract_text("content_html")}).where("day is not null")
    rows = rows.withColumn("word_count", F.regexp_count("text", F.lit(r"(?U)\S+")).cast("int")).where(F.col("word_count").between(LEAST_WORDS, MOST_WORDS))
    none = F.array().cast("array<string>")
    names, slugs = F.coalesce("category_names", none), F.coalesce("slugs", none)
    shown = F.when(F.size(names) > 0, names).otherwise(slugs)
    return rows.select(
        F.col("id").alias("article_id"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.col("day").alias("date"), F.year("day").alias("year"), F.month("day").alias("month"), F.quarter("day").alias("quarter"),
        "author_id", "author_name", F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise(F.coalesce("corpus", F.lit("unknown"))).alias("category"), article_type(F.concat(names, slugs)).alias("article_type"),
        "corpus", "url", "text", "word_count", F.length("text").alias("char_count"), F.sha2("text", 256).alias("text_hash"), "collection_method",
    )


def hashing_encoder(texts: list[str], dim: int = 384, seed: int = 42) -> np.ndarray:
    """Words hashed to signed places: an encoder that needs no model."""
    import zlib

    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        for word in text.lower().split():
            h = zlib.crc32(f"{seed}:{word}".encode())
            row[h % dim] += 1 if h >> 31 else -1
    return out


def encode_new(articles: DataFrame, path: str, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder, batch: int = 64) -> int:
    """Append unit vectors of the articles that the table at ``path`` lacks; number of new rows.

    ``encoder`` gives a row for each of up to ``batch`` texts, cut to ``ENCODED_CHARS``.
    """
    spark = articles.sparkSession
    todo = articles.select(F.col("article_id").cast("string").alias("article_id"), "year", "corpus", "article_type", F.substring(F.coalesce("text", F.lit("")), 1, ENCODED_CHARS).alias("text"))
    before = 0
    if exists(spark, path):
        done = spark.read.parquet(path).select("article_id")
        before = done.count()
        todo = todo.join(done, "article_id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                found = np.asarray(encoder(part["text"].tolist()), dtype=float)
                norms = np.linalg.norm(found, axis=1, keepdims=True)
                yield part.drop(columns="text").assign(embedding=list((found / np.where(norms > 0, norms, 1)).astype(np.float32)))

    todo.mapInPandas(run, "article_id string, year int, corpus string, article_type string, embedding array<float>").write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before
