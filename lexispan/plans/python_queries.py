"""Queries that need Python on the executors; none is expressible in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import html, inference, topics


def html_clean(spark, sf_dir: str) -> DataFrame:
    """Article text of every page."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.extract_text("html").alias("text"))


def bootstrap_ci(spark, sf_dir: str) -> DataFrame:
    """Effect of quality on length with its bootstrap interval, by language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    values = docs.join(labels, "doc_id").selectExpr("lang AS metric", "quality AS g", "doc_id AS id", "CAST(n_chars AS DOUBLE) AS v")
    return inference.compare_groups(values)


def nmf_topics(spark, sf_dir: str) -> DataFrame:
    """Top words of the topics of all documents."""
    return topics.top_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def pca_2d(spark, sf_dir: str) -> DataFrame:
    """Two principal components of all vectors."""
    return topics.pca(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 2)


QUERIES = {"html_clean": html_clean, "bootstrap_ci": bootstrap_ci, "nmf_topics": nmf_topics, "pca_2d": pca_2d}
