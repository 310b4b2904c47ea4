"""Mixing sources to target word budgets by exact token length.

A document's size is its number of words.  Each source gets a word budget (a share of
all words by weight, stopped at a multiple of the source's own size).  Whole passes
over the source come first; for the rest the documents are counted by exact size, a
proportional number of each size is planned, and a bounded-knapsack program over the
sizes fits what remains of the budget.  The planned number of each size is then taken
in seeded order.

Counts are kept by (source, size, slot) with a seeded slot for each document, so that
no window holds more than one slot of a size, however many documents share it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Budgets up to this many words are fitted exactly.
DP_WORDS = 1 << 16
#: Documents of one slot, about, were all of one size and source; there are 64 slots at least.
SLOT_DOCS = 1 << 16


def subset_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that the sum comes as near to ``budget`` from below as can be found.

    ``sizes`` are distinct and positive.  A proportional share of each size is taken
    first; then the largest sizes fill up until the rest is below ``DP_WORDS``; then the
    program over (size, number left) closes the rest.  All sizes take part, so no
    document that is left is as small as what is missing.
    """
    order = np.argsort(sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((sizes * counts).sum())
    budget = max(0, min(int(budget), total))
    taken = counts.copy() if budget == total else np.minimum(counts, np.floor(counts * (budget / max(total, 1))).astype(np.int64))
    rest = budget - int((sizes * taken).sum())
    for i in range(len(sizes) - 1, -1, -1):
        if rest <= DP_WORDS:
            break
        more = min(int(counts[i] - taken[i]), (rest - DP_WORDS // 2) // int(sizes[i]))
        if more > 0:
            taken[i] += more
            rest -= more * int(sizes[i])
    use = [i for i in range(len(sizes)) if counts[i] > taken[i] and sizes[i] <= rest]
    mask = (1 << (rest + 1)) - 1
    reach, steps = 1, []  # bit s: the sum s can be made
    made_by = np.zeros(rest + 1, np.int64)  # the first step that makes a sum
    for i in use:
        left, power = int(counts[i] - taken[i]), 1
        left = min(left, rest // int(sizes[i]))
        while left > 0 and not reach >> rest & 1:
            n = min(power, left)
            fresh = reach << (n * int(sizes[i])) & mask & ~reach
            if fresh:
                bits = np.frombuffer(fresh.to_bytes(rest // 8 + 1, "little"), np.uint8)
                made_by[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(steps)
                steps.append((i, n))
                reach |= fresh
            left -= n
            power *= 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    while at:
        i, n = steps[made_by[at]]
        at -= n * int(sizes[i])
        taken[i] += n
    out = np.empty_like(taken)
    out[order] = taken
    return out


def budgets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Word budget of each (source, source_size): shares of ``share`` of all words by weight.

    Sources by code point, null last, take the weights in turn.  A budget stops at
    ``most`` times the source's size and the excess goes to the others by weight, until
    none is above: with sources ordered by size per weight, all before some place are
    full and the others get one common rate.  One row a source meets in one window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    full = weighed.withColumn("full", F.col("source_size") * F.lit(float(most)))
    by_rate = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    past = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_rate.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rated = (
        full.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("rate", (F.col("total") - F.coalesce(F.sum("full").over(past), F.lit(0.0))) / F.sum("weight").over(ahead))
        .withColumn("rate", F.max(F.when(F.col("rate") * F.col("weight") <= F.col("full"), F.col("rate"))).over(everything))
    )
    return rated.select("source", "source_size", F.least("full", F.coalesce(F.col("rate") * F.col("weight"), F.col("full"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """Words that a mix takes from each document.

    Returns doc_id, the columns ``keep``, size, source_size, target and taken (words, repeats counted: 0, size
    or 2 * size ...; at most ``most`` rounded up times the size).  A null text has size
    0; a null source is a source.  Rows that repeat a doc_id count each for themselves.
    Reruns agree: order is by a seeded hash, then doc_id.
    """
    sized = docs.select("doc_id", *keep, "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"))
    sized = stage(sized, "mix-sizes")
    slots = 1 << max(6, (sized.count() // SLOT_DOCS).bit_length())
    sized = sized.withColumn("slot", F.pmod("order", F.lit(slots)).cast("int"))
    target = stage(budgets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        source_size, goal = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        passes = int(goal // source_size) if source_size else 0
        budget = int(round(goal - passes * source_size))
        return pd.DataFrame({"source": frame["source"], "size": frame["size"], "passes": passes, "extra": subset_counts(frame["size"].to_numpy(), frame["n"].to_numpy(), budget)})

    slotted = sized.where("size > 0").groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("n"))
    lengths = slotted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    same = lengths["source"].eqNullSafe(target["source"])
    # one row a source: a hint is not needed, Spark broadcasts it if its size allows
    planned = lengths.join(target, same).select(lengths["source"], "size", "n", "source_size", "target")
    extra = planned.groupBy("source").applyInPandas(fit, "source string, size long, passes long, extra long")
    upto = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    a, b = slotted.alias("a"), extra.alias("b")
    shares = (
        a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")))
        .select("a.source", "a.size", "a.slot", "n", "passes", "extra")
        .withColumn("extra", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.coalesce(F.sum("n").over(upto), F.lit(0)))))
        .drop("n")
    )
    place = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("order", "doc_id"))
    d, s = sized.withColumn("place", place).alias("d"), shares.alias("s")
    chosen = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.size") == F.col("s.size")) & (F.col("d.slot") == F.col("s.slot")), "left")
    t = target.alias("t")
    return (
        chosen.join(t, F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", *keep, "d.size", "source_size", "target", (F.col("d.size") * F.coalesce(F.col("passes") + (F.col("place") <= F.col("extra")).cast("long"), F.lit(0))).alias("taken"))
    )


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
