"""N-gram Jaccard join by grouped prefix filtering.

A document's set is its distinct word shingles.  Documents with equal sets are one item.
A set's prefix, in an order that puts shingles in many documents last, must share a
shingle with the prefix of every set similar enough.  Items with equal prefix and size
form a group and go through the index as one; a run is the list of groups that share a
prefix shingle.  Runs of one item are dropped.  Small runs make their pairs of groups,
each once for all its shingles; of large runs each group is paired with one group, that
which is the first in most of its runs; pairs are expanded to items and filtered by size and by parity signatures (each element
of the symmetric difference flips at most one bit, so no link is lost).  Pairs of long
sets, which fill these signatures, are filtered once more by wide ones, with about a bit
for each shingle.  What passes is verified on the sets themselves.

Only components are asked for, so a second round takes only the large runs that still
hold several components, and verifies all candidates between components in them, in
cells of bounded size.  Copies and dense groups of near copies therefore never make all
pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, runs, stage, text_blocks, tidy
from .filters import member_filter
from .graph import components
from .shingles import shingle_sets

#: Bits of a signature; shingles of the candidate pairs verified in one cell; items of a run compared in one cell.
BITS, CELL_SHINGLES, CELL_ITEMS = 512, 1 << 20, 4096
#: Most bits of a wide signature, which sets of more than BITS shingles have.
MOST_WIDE = 1 << 16
#: Runs of up to so many groups make all their pairs of like size at once.
SMALL = 8
#: A group's low bits hold its sets' size, up to this.
_SIZES = 0xFFFF
#: Counters of the order's sketch for each document, and their number's bounds (powers of two).
PER_DOC, LEAST_BITS, MOST_BITS = 4, 14, 24
_CHUNK = 1 << 14
#: Rows a task dedupes by digest before it forgets.
_SEEN = 1 << 20


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for block in text_blocks(batches):
        yield block, shingle_sets(block.column("text"), size)


def _order(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Class of every counter of a fixed-size count sketch of all documents' shingles: 0, or the log2 of how far it exceeds twice the mean."""
    n = docs.count()
    bits = min(max((PER_DOC * n).bit_length(), LEAST_BITS), MOST_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.int64)
        for _, sets in _sets(batches, size):
            held += np.bincount((np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if held.any():
            parts = held.astype("<u4").reshape(-1, _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<u4").astype(np.uint64) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.astype("<u8").tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(tidy(count), "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    total = np.zeros((1 << bits) // _CHUNK * _CHUNK, np.uint64)
    for chunk, counts in parts:
        total[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(counts, "<u8")
    over = total // np.uint64(max(1, 2 * int(total.mean())))
    return np.where(over > 0, np.log2(np.maximum(over, 1)).astype(np.uint8) + 1, 0).astype(np.uint8), bits


def _signature(held: np.ndarray, bits: int = BITS) -> bytes:
    odd = np.bincount((held >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def item_table(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document that has a set: doc_id, n, digest, group, prefix and signatures (the wide one null for short sets).

    Within a task, all but one of the documents with equal sets go without prefix, and
    those with null doc_id, which link with nothing.
    """
    classes, bits = _order(docs, size)
    held_classes = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held_classes.value
        seen: set[bytes] = set()
        for block, sets in _sets(batches, size):
            ids, rows = block.column("doc_id").to_pylist(), []
            for doc_id, held in zip(ids, sets):
                n = len(held)
                digest = hashlib.md5(held.tobytes()).digest()
                if not n or doc_id is None or digest in seen:
                    rows.append((doc_id, n, digest if n and doc_id is not None else None, None, None, None, None))
                    continue
                if len(seen) > _SEEN:
                    seen.clear()
                seen.add(digest)
                length = n - (percent * n + 99) // 100 + 1
                ranked = held[np.argsort(order[(held >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")]
                prefix = ranked[:length].view(np.int64)
                name = int.from_bytes(hashlib.md5(prefix.tobytes() + n.to_bytes(8, "little")).digest()[:8], "little", signed=True)
                group = name & ~_SIZES | min(n, _SIZES)
                wide = _signature(held, min(1 << (n - 1).bit_length(), MOST_WIDE)) if n > BITS else None
                rows.append((doc_id, n, digest, group, prefix, _signature(held), wide))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n", "digest", "grp", "prefix", "signature", "wide"])

    out = stage(docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, digest binary, grp long, prefix array<long>, signature binary, wide binary"), "jaccard-sets")
    held_classes.destroy()
    return out


def _like(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes in two groups' low bits allow a link."""
    x, y = a & _SIZES, b & _SIZES
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _shared(percent: int):
    """Of a partition's (token, grp) rows the pairs of groups in small runs (first 0), those with the first group in larger runs (first: number of runs), and the rows of larger runs (without second group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("token", pa.int64()), ("grp", pa.int64())]))
        token, group = (np.asarray(table.column(c)) for c in ("token", "grp"))
        order = np.lexsort((group, token))
        token, group = token[order], group[order]
        fresh = np.append(True, (token[1:] != token[:-1]) | (group[1:] != group[:-1]))[: len(token)]
        token, group = token[fresh], group[fresh]
        firsts, lasts = runs(token)
        many = np.repeat(lasts - firsts, lasts - firsts)
        left = np.repeat(lasts, lasts - firsts) - np.arange(len(token)) - 1  # rows after this one in its run
        pairs = []
        for d in range(1, SMALL):
            at = np.flatnonzero((many <= SMALL) & (left >= d))
            at = at[_like(group[at], group[at + d], percent)]
            pairs.append(np.stack([group[at], group[at + d], token[at], np.zeros(len(at), np.int64)]))
        lead = np.repeat(firsts, lasts - firsts)
        at = np.flatnonzero((many > SMALL) & (lead < np.arange(len(token))))
        at = at[_like(group[lead[at]], group[at], percent)]
        pairs.append(np.stack([group[lead[at]], group[at], token[at], np.ones(len(at), np.int64)]))
        a, b, t, first = np.concatenate(pairs, axis=1)
        order = np.lexsort((t, b, a, first))
        a, b, t, first = a[order], b[order], t[order], first[order]
        begins = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (first[1:] != first[:-1]))[: len(a)])
        first = np.add.reduceat(first, begins) if len(begins) else first
        a, b, t = a[begins], b[begins], t[begins]
        big = many > SMALL
        none = pa.array([None] * int(big.sum()), pa.int64())
        columns = [pa.array(np.concatenate((t, token[big]))), pa.array(np.concatenate((a, group[big]))), pa.concat_arrays([pa.array(b), none]), pa.concat_arrays([pa.array(first), none])]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "grp", "other", "first"])

    return run


def _candidates(percent: int):
    """Pairs (token, a, b, weight) between components in one partition's cells; rows (token, item, n, signature, component, block) of one block are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        token, item, n, component, block = (np.asarray(table.column(c)) for c in ("token", "item", "n", "component", "block"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint64).reshape(len(token), BITS // 64)
        order = np.lexsort((item, n, token))
        token, item, n, component, block, signature = (x[order] for x in (token, item, n, component, block, signature))
        for a, b in zip(*runs(token)):
            if (component[a:b] == component[a]).all():
                continue
            sizes, out = n[a:b], []
            for i in range(a + 1, b):
                # only smaller or equal sets, large enough
                other = np.arange(a + np.searchsorted(sizes[: i - a], -(-percent * n[i] // 100)), i)
                other = other[(component[other] != component[i]) & (block[other] != block[i])]
                apart = np.bitwise_count(signature[other] ^ signature[i]).sum(axis=1)
                total = n[other] + n[i]
                # |A ^ B| is at most total - 2 * least overlap
                close = apart <= total - 2 * -(-percent * total // (100 + percent))
                other = other[close]
                out.append(np.stack((np.minimum(item[other], item[i]), np.maximum(item[other], item[i]), total[close])))
            x, y, weight = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), token[a])), pa.array(x), pa.array(y), pa.array(weight)], names=["token", "a", "b", "weight"])

    return run


def _close(percent: int):
    """Whether sizes and signatures of two sets allow a link."""

    @F.pandas_udf("boolean")
    def close(nx: pd.Series, sx: pd.Series, ny: pd.Series, sy: pd.Series) -> pd.Series:
        if not len(nx):
            return pd.Series([], dtype=bool)
        bits = [np.frombuffer(b"".join(s), np.uint64).reshape(len(s), BITS // 64) for s in (sx, sy)]
        total = (nx + ny).to_numpy()
        apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1)
        like = 100 * np.minimum(nx, ny).to_numpy() >= percent * np.maximum(nx, ny).to_numpy()
        return pd.Series(like & (apart <= total - 2 * -(-percent * total // (100 + percent))))

    return close


def _folded(wide: bytes, n_bytes: int) -> np.ndarray:
    """The wide signature that the set would have with fewer bits."""
    out = np.frombuffer(wide, np.uint64)
    while out.nbytes > n_bytes:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _alike(percent: int):
    """Whether wide signatures allow a link between sets of ``total`` shingles together."""

    @F.pandas_udf("boolean")
    def alike(wide_a: pd.Series, wide_b: pd.Series, total: pd.Series) -> pd.Series:
        out = np.zeros(len(total), bool)
        for i, (x, y, n) in enumerate(zip(wide_a, wide_b, total)):
            least = min(len(x), len(y))
            apart = int(np.bitwise_count(_folded(x, least) ^ _folded(y, least)).sum())
            out[i] = apart <= n - 2 * -(-percent * n // (100 + percent))
        return pd.Series(out)

    return alike


def _verified(docs: DataFrame, items: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) among pairs (token, a, b, weight): sets that are similar enough; each cell gets the texts of its pairs once."""
    once = stage(pairs.groupBy("a", "b").agg(F.min("token").alias("token"), F.min("weight").alias("weight")), "jaccard-pairs")
    # the smaller set of a pair that can link has at least this share of both sizes
    long = F.col("weight") * percent > BITS * (100 + percent)
    wide = lambda c: items.where("wide is not null").select(F.col("item").alias(c), F.col("wide").alias(f"wide_{c}"))
    tested = once.where(long).join(wide("a"), "a").join(wide("b"), "b").where(_alike(percent)("wide_a", "wide_b", "weight"))
    pairs, once = once, stage(once.where(~long).unionByName(tested.select(*once.columns)), "jaccard-alike")
    drop(pairs)
    many = once.groupBy("token").agg(F.ceil(F.sqrt(F.sum("weight") / F.lit(float(CELL_SHINGLES)))).cast("int").alias("split"))
    split = lambda c: F.pmod(F.xxhash64(c), F.col("split"))
    celled = stage(once.join(many, "token").select("a", "b", F.xxhash64("token", split("a"), split("b")).alias("cell")), "jaccard-cells")
    drop(once)
    needed = celled.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = celled.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = docs.select("doc_id", "text").where(member_filter(ids)(F.col("doc_id"))).join(needed, "doc_id")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("doc_id").to_pylist()
        sets = dict(zip(ids, (s for c in left.column("text").chunks for s in shingle_sets(c, size))))
        out = []
        for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist()):
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    links = stage(texts.groupBy("at").cogroup(celled.groupBy("cell")).applyInArrow(check, "a long, b long"), "jaccard-links")
    drop(celled)
    return links


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents link if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable.  A null text has an empty set and
    links with nothing.  A null doc_id takes no part in links and is its own (null)
    component.  Rows that repeat a doc_id are expected to have one text; each is returned.
    """
    full = item_table(docs, size, percent)
    items = full.where("grp is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "grp", "signature", "wide")).alias("x")).select("digest", F.col("x.doc_id").alias("item"), "x.n", "x.grp", "x.signature", "x.wide")
    items = stage(items, "jaccard-items")
    tokens = full.where("grp is not null and doc_id is not null").select(F.explode("prefix").alias("token"), "grp")
    shared = stage(tokens.repartition("token").mapInArrow(tidy(_shared(percent)), "token long, grp long, other long, first long"), "jaccard-runs")
    held = stage(full.select("doc_id", "n", "digest"), "jaccard-held")
    drop(full)
    crowded = items.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.min("item").alias("first")).where("m > 1")
    x = items.select("grp", F.col("item").alias("x"), F.col("n").alias("nx"), F.col("signature").alias("sx"))
    y = items.select(F.col("grp").alias("other"), F.col("item").alias("y"), F.col("n").alias("ny"), F.col("signature").alias("sy"))
    # pairs of small runs, and for each group of large ones its commonest first
    led = shared.where("first > 0").groupBy("grp", "other").agg(F.min("token").alias("token"), F.sum("first").alias("first"))
    led = led.groupBy("other").agg(F.max(F.struct("first", "grp", "token")).alias("x")).select("x.grp", "other", "x.token")
    between = shared.where("first = 0").select("grp", "other", "token").union(led).groupBy("grp", "other").agg(F.min("token").alias("token")).join(x, "grp").join(y, "other")
    # groups of several items: all pairs of few, else those with the first
    inside = crowded.select("grp", F.col("grp").alias("other"), F.col("grp").alias("token"), F.when(F.col("m") > SMALL, F.col("first")).alias("only")).join(x, "grp").where("only is null or x = only").drop("only").join(y, "other").where("x != y")
    close = between.unionByName(inside).where(_close(percent)("nx", "sx", "ny", "sy"))
    links = _verified(docs, items, close.select("token", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("nx") + F.col("ny")).alias("weight")), size, percent)
    first = components(links)
    # runs that still hold several components
    labelled = stage(items.join(first, F.col("item") == F.col("id"), "left").select("digest", "item", "n", "grp", "signature", F.coalesce("component", "item").alias("component")), "jaccard-labelled")
    drop(first)
    large = shared.where("other is null").select("token", "grp").union(labelled.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SMALL).select(F.col("grp").alias("token"), "grp"))
    ends = labelled.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"))
    mixed = large.join(ends, "grp").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("m").alias("m")).where("low != high").select("token", F.ceil(F.col("m") / F.lit(float(CELL_ITEMS))).cast("int").alias("split"))
    rows = large.join(mixed, "token").join(labelled, "grp").withColumn("own", F.pmod(F.xxhash64("item"), F.col("split")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    block = F.when(F.col("own") != F.col("with"), F.col("own").cast("long")).otherwise(F.col("item"))
    rows = rows.select(F.xxhash64("token", F.least("own", "with"), F.greatest("own", "with")).alias("token"), "item", "n", "component", block.alias("block"), "signature")
    more = _verified(docs, items, rows.repartition("token").mapInArrow(tidy(_candidates(percent)), "token long, a long, b long, weight long"), size, percent)
    # only components are joined in the second round
    of = lambda c: labelled.select(F.col("item").alias(c), F.col("component").alias(f"{c}_component"))
    parts = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    drop(items, shared, links, more)
    # documents of equal sets: the smallest doc_id of each set, then its component
    same = held.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    low = labelled.join(same, "digest").join(parts.withColumnRenamed("component", "whole"), F.col("component") == F.col("id"), "left").select("digest", "least", F.coalesce("whole", "component").alias("component"))
    lowest = low.groupBy("component").agg(F.min("least").alias("component_id"))
    low = low.join(lowest, "component").select("digest", "component_id")
    return held.join(low, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Shingle counts and components of all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
