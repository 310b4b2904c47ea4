"""A pretraining corpus from ``documents``: language, near copies, repeats, mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm import bpe, jaccard, language, mixing, substrings
from lexispan.llm.common import stage
from lexispan.llm.filters import member_filter

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language is less certain than this is rejected.
LEAST_SCORE = 0.5
#: What a text with words holds.
WORD = r"[^\x20\x09-\x0D]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or of uncertain language go.  ``lang`` becomes the prediction."""
    model = language.fit(docs)
    found = language.predict(docs.select(*COLUMNS), model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group that 5-word shingles link at a similarity of 0.75.

    Rows are judged one by one, whether their id is null (last in its group) or repeated;
    of rows equal in all columns one stays.
    """
    docs = docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()).withColumn("hash", F.xxhash64("text"))
    docs = stage(docs.withColumn("worded", F.coalesce(F.col("text").rlike(WORD), F.lit(False))), "copies-input")
    parts = jaccard.jaccard_components(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    # ids alone meet in the joins; texts are shuffled only where the filter says that they may go
    ids = docs.where("worded").select("row", "doc_id", "hash")
    first = ids.join(parts, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "row")).alias("x")).select("x.row")
    gone = stage(ids.select("row").join(first, "row", "left_anti"), "copies-gone")
    may_go = member_filter(gone)(F.col("row"))
    worded = docs.where("worded")
    kept = worded.where(~may_go).unionByName(worded.where(may_go).join(gone, "row", "left_anti")).select(*COLUMNS)
    return kept.unionByName(docs.where("not worded").select(*COLUMNS).dropDuplicates())


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur more than once; bytes of characters cut in two go too, and texts left without words."""
    left = substrings.remove_repeats(docs.select(F.struct("doc_id", "lang", "source").alias("key"), "text"), whole_chars=True)
    return left.select("key.doc_id", F.col("kept").alias("text"), "key.lang", "key.source", F.length("kept").cast("long").alias("n_chars")).where(F.col("text").rlike(WORD)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix, as often as it takes each; ids may be null or repeated."""
    docs = stage(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "mix-input")
    mixed = mixing.mix(docs, keep=["row"]).where("taken > 0").select("row", F.expr("taken div size").alias("times"))
    repeated = docs.join(mixed, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return repeated.select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    import public_tokenizers as tokenizers

    return bpe.encode_column(docs.select("doc_id", "text"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{i}")
    return docs


#: Learning, suffix arrays and the merges are not expressible in SQL; tests/llm compares each later stage with a brute-force version.
ORACLE_SQL = None
