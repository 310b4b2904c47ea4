"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge (a, b).

    Every step rewires edges towards smaller ids and is written to the shared folder; the
    driver sees counts only.  Edges with a null end are ignored; a loop (a, a) makes no
    component.  The result is a table in the shared folder.
    """
    now = stage(edges.select("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
        large = both.join(lows, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), "low")
        small = large.join(lows, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        new = stage(small, "edges")
        mark = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
        same = mark(new) == mark(now)
        drop(now)
        now = new
        if same:
            break
    found = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    out = stage(found.union(found.select(F.col("component").alias("id"), "component").distinct()), "components")
    drop(now)
    return out
