"""Files that come in and go out as tables: JSON lines, CSV, category maps, embeddings.

Scans take a schema, so that no pass over the data infers one.  A missing path reads as
an empty table.  Writers that replace a table stage it beside the old one and swap.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = "id long, slug string, name string"
RAW_ARTICLES = (
    "id long, title string, date string, modified string, url string, author_id long, author_name string, category_ids array<long>, "
    "category_names array<string>, tag_ids array<long>, content_html string, excerpt_html string, corpus string, source string, collection_method string"
)


def _handle(spark: SparkSession, path: str):
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path in any store that Spark reads is there."""
    found, system = _handle(spark, path)
    return system.exists(found)


def load_jsonl(spark: SparkSession, path: str, schema: str = RAW_ARTICLES) -> DataFrame:
    """One row a line; blank and malformed lines are left out, and a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def existing_ids(spark: SparkSession, path: str, schema: str = RAW_ARTICLES) -> DataFrame:
    """Distinct ids already in a JSON-lines file."""
    return load_jsonl(spark, path, schema).select("id").where("id is not null").distinct()


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; an empty field is null, and a missing file an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def category_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, slug) of a JSON array of categories; empty if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], CATEGORIES).select("id", "slug")
    return spark.read.schema(CATEGORIES).option("multiLine", True).json(path).where("id is not null").select("id", "slug")


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none."""
    return spark.read.parquet(path) if exists(spark, path) else None


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines; characters beyond ASCII stay as they are."""
    rows.write.mode("append").json(path)


def append_failures(rows: DataFrame, path: str, reason: str) -> None:
    """Append rows that could not be used, each with its reason and time."""
    append_jsonl(rows.withColumns({"reason": F.lit(reason), "at": F.current_timestamp()}), path)


def write_table(rows: DataFrame, path: str) -> None:
    """Replace a Parquet table, also by rows that were read from it: staged beside it, then swapped."""
    spark = rows.sparkSession
    mark = uuid.uuid4().hex
    staged, old = f"{path.rstrip('/')}.{mark}.new", f"{path.rstrip('/')}.{mark}.old"
    rows.write.parquet(staged)
    target, system = _handle(spark, path)
    new, aside = _handle(spark, staged)[0], _handle(spark, old)[0]
    if system.exists(target) and not system.rename(target, aside):
        raise OSError(f"{path} cannot be moved aside")
    if not system.rename(new, target):
        raise OSError(f"{staged} cannot be moved to {path}")
    system.delete(aside, True)


def write_csv(rows: DataFrame, path: str) -> None:
    """Replace a folder of CSV files with headers."""
    rows.write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)
