"""Removal of long byte strings that occur more than once, by suffix arrays.

Every string of ``length`` bytes has an anchor: its least-hashed piece of ``PIECE``
bytes, leftmost of equals.  Equal strings have equal anchors, so strings are
judged among those of one anchor only.  Anchors that occur once are set aside (exactly,
by a shuffle of their hashes; a filter of fixed size carries the others back to the
texts).  The strings of one anchor place are contiguous; the text they cover is its
context.  Equal contexts are collapsed before they are shuffled; the contexts of an
anchor that differ meet in a shard, whose suffix array is built by induced sorting, and
permuted common prefixes with the neighbours in it tell which strings repeat.

Where an anchor has more contexts than a shard holds, each is cut into ``LEVELS`` parts
by the strings' distance from the anchor.  All strings of a part hold the bytes around
the anchor that its outermost strings share, its core; equal strings lie in parts of equal
core, so anchor and core deal the parts into shards of their own.  At the last level a
part is one string, and equal ones are collapsed before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters
from .common import drop, gathered, mix64, runs, stage, text_blocks, tidy, utf8
from .shingles import _INVERSE, _P, powers
from .suffixes import same_prefix, suffix_array

PIECE = 40
#: Bytes of contexts in one suffix array; places between sampled common prefixes; parts of the contexts of crowded anchors.
SHARD_BYTES, SAMPLE, LEVELS = 1 << 20, 16, (4, 1 << 30)
#: Bytes of texts whose anchors are found at once, and of their places handled in the cache of a core.
SEGMENT, STEP = 1 << 20, 1 << 14
#: Low bits of a hash that give way to its place when hashes are compared.
PLACE_BITS = np.uint64(20)
#: log2 bits of the filter of repeated anchors, and contexts a task keeps to collapse at once.
ANCHOR_BITS, CORPUS_BYTES = 26, 6 << 20


#: Powers for a step's bytes and pieces, made once.
_powers = lru_cache(8)(powers)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``PIECE`` bytes from each place on (shorter data: none)."""
    if len(data) < PIECE:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data)), out=sums[1:])
    n = len(data) - PIECE + 1
    return mix64((sums[PIECE:] - sums[:n]) * _powers(_INVERSE, n))


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least hash (but for its low bits) in each window of ``width``."""
    least = hashes >> PLACE_BITS << PLACE_BITS
    least |= np.arange(len(hashes), dtype=np.uint64)
    done = 1
    while done < width:  # minima of windows twice as wide
        more = min(done, width - done)
        least = np.minimum(least[:-more], least[more:])
        done += more
    return (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int32)


def contexts_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, anchor place, first string, last string) of each run of strings with one anchor, text by text; ``bounds`` of the texts in ``data``."""
    found = [np.zeros((5, 0), np.int64)]
    k = 0
    while k < len(bounds) - 1:
        # texts that fill a segment, or one text in several segments
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + SEGMENT, side="right")) - 1)
        for start in range(int(bounds[k]), int(bounds[end]) - length + 1, SEGMENT):
            part = data[start : min(int(bounds[end]), start + SEGMENT + length - 1)]
            n = len(part) - length + 1
            hashes, at = np.empty(len(part) - PIECE + 1, np.uint64), np.empty(n, np.int32)
            for i in range(0, n, STEP):
                own = piece_hashes(part[i : i + STEP + length - 1])
                hashes[i : i + len(own)] = own
                at[i : i + STEP] = _least(own, length - PIECE + 1) + i
            # strings that would cross texts have none
            for a, b in zip(bounds[k:end].tolist(), bounds[k + 1 : end + 1].tolist()):
                at[max(a, b - length + 1, start) - start : max(b, start) - start] = -1
            firsts, lasts = runs(at)
            own = at[firsts] >= 0
            first, last = firsts[own], lasts[own] - 1
            text = np.searchsorted(bounds, first + start, side="right") - 1
            shift = start - bounds[text]
            found.append(np.stack((text, hashes[at[first]].view(np.int64), at[first] + shift, first + shift, last + shift)))
        k = end
    return tuple(np.concatenate(found, axis=1))


def contexts(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``contexts_of`` for one text, without its number."""
    return contexts_of(data, np.array([0, len(data)]), length)[1:]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    for block in text_blocks(batches):
        data, bounds = utf8(block.column("text"))
        yield block, data, bounds


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in _texts(batches):
            # two of a kind tell as much as many
            values, counts = np.unique(contexts_of(data, bounds, length)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.minimum(counts, 2))], names=["anchor", "n"])

    return run


def repeated_strings(blobs: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct byte strings a mask of its places where a string of ``length`` bytes begins that also begins elsewhere in them."""
    sizes = np.array([len(x) + 1 for x in blobs])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    text = np.zeros(int(sizes.sum()) + 1, np.int32)
    raw = np.frombuffer(b"\0".join(blobs) + b"\0\0", np.uint8)
    text[:] = raw
    text += 2
    text[starts + sizes - 1] = 1  # between blobs
    text[-1] = 0
    order = suffix_array(text, 258)
    n_valid = np.maximum(sizes - length, 0)  # places in a blob where a string begins
    valid = np.zeros(len(text), bool)
    end = np.zeros(len(text), np.int32)
    for s, n, size in zip(starts.tolist(), n_valid.tolist(), sizes.tolist()):
        valid[s : s + n] = True
        end[s : s + size] = s + n
    order = order[valid[order]]
    before = np.full(len(text), -1, np.int32)
    before[order[1:]] = order[:-1]
    repeated = np.zeros(len(text), bool)
    # permuted: in text order, a common prefix of length + d at a place is one of length at the next d places
    asked = np.flatnonzero(before >= 0)
    wide = asked[(asked % SAMPLE == 0) & (asked + SAMPLE < end[asked]) & (before[asked] + SAMPLE < end[before[asked]])]
    wide = wide[same_prefix(raw, wide, before[wide], length + SAMPLE)]
    for d in range(SAMPLE + 1):
        repeated[wide + d] = True
        repeated[before[wide] + d] = True
    left = asked[~(repeated[asked] & repeated[before[asked]])]
    left = left[same_prefix(raw, left, before[left], length)]
    repeated[left] = True
    repeated[before[left]] = True
    return [repeated[s : s + n] for s, n in zip(starts.tolist(), n_valid.tolist())]


def _judged(length: int):
    """Rows (anchor, digest, blob, n) of a partition, in order of anchor, to (digest, ranges of repeated strings)."""

    def flush(groups: list[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, bytes]]:
        for (digest, _), mask in zip(groups, repeated_strings([b for _, b in groups], length)):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
            if len(edge):
                yield digest, edge.astype("<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        size, anchor = 0, None
        own: dict[bytes, list] = {}
        out: list[tuple[bytes, bytes]] = []

        def close() -> None:
            """Settle one anchor's contexts: a lone one by its count, several by the next suffix array."""
            nonlocal held, size
            own_bytes = sum(len(blob) for blob, _ in own.values())
            if held and size + own_bytes > SHARD_BYTES:
                out.extend(flush(held))
                held, size = [], 0
            for digest, (blob, n) in own.items():
                if n > 1:
                    out.append((digest, np.array([0, len(blob) - length + 1], "<i4").tobytes()))
            if len(own) > 1 and any(n == 1 for _, n in own.values()):
                once = {d for d, (_, n) in own.items() if n == 1}
                held.extend((d if d in once else b"", blob) for d, (blob, _) in own.items())
                size += own_bytes
            own.clear()

        def result() -> pa.RecordBatch:
            rows = [x for x in out if x[0]]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([r for _, r in rows], pa.binary())], names=["digest", "ranges"])

        for batch in batches:
            for a, digest, blob, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "blob", "n"))):
                if a != anchor:
                    close()
                    anchor = a
                if digest in own:
                    own[digest][1] += n
                else:
                    own[digest] = [blob, n]
            yield result()
        close()
        if held:
            out.extend(flush(held))
        yield result()

    return run


def _parts(length: int, n_parts: int):
    """Rows (anchor, at, digest, blob, n) to parts (whole, shift, and the same columns); at: the anchor's place in the blob."""
    n_offsets = length - PIECE + 1
    width = -(-n_offsets // min(n_parts, n_offsets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, at, digest, blob, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "at", "digest", "blob", "n"))):
                # the string from place i on has its anchor at - i bytes behind its begin
                for k in range((at - len(blob) + length) // width, at // width + 1):
                    first, last = max(0, at - (k + 1) * width + 1), min(len(blob) - length, at - k * width)
                    core = blob[at - k * width : at - (k + 1) * width + 1 + length]
                    key = hashlib.md5(anchor.to_bytes(8, "little", signed=True) + bytes([k]) + core).digest()[:8]
                    own = blob[first : last + length]
                    rows.append((digest, first, int.from_bytes(key, "little", signed=True), at - first, hashlib.md5(own).digest(), own, n, len(own)))
            columns = list(zip(*rows)) or [()] * 8
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["whole", "shift", "anchor", "at", "digest", "blob", "n", "size"])

    return run


def _repeats(contexts: DataFrame, length: int, levels: Sequence[int] = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """(digest, shift, ranges) of the strings that repeat, from (anchor, at, digest, blob, n, size); and the tables staged for it."""
    judged = lambda rows: rows.select("anchor", "digest", "blob", "n").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(_judged(length)), "digest binary, ranges binary").select("digest", F.lit(0).alias("shift"), "ranges")
    if not levels:  # every anchor stands for one string
        return judged(contexts), []
    crowded = stage(contexts.groupBy("anchor").agg(F.sum("size").alias("size")).where(F.col("size") > SHARD_BYTES).select("anchor"), "repeat-crowded")
    if crowded.isEmpty():
        return judged(contexts), [crowded]
    whole = contexts.join(crowded, "anchor", "left_semi").groupBy("anchor", "at", "digest", "blob").agg(F.sum("n").alias("n"))
    parts = stage(whole.mapInArrow(tidy(_parts(length, levels[0])), "whole binary, shift int, anchor long, at int, digest binary, blob binary, n long, size int"), "repeat-parts")
    inner, staged = _repeats(parts, length, levels[1:])
    back = parts.select("digest", "whole", F.col("shift").alias("outer")).join(inner, "digest").select(F.col("whole").alias("digest"), (F.col("shift") + F.col("outer")).alias("shift"), "ranges")
    return judged(contexts.join(crowded, "anchor", "left_anti")).union(back), [crowded, parts, *staged]


def _rest(data: np.ndarray, spans: list | None, length: int) -> tuple[int, int, int, bytes]:
    """n_bytes, n_removed, n_spans and the bytes left of one text."""
    if not spans:
        return len(data), 0, 0, data.tobytes()
    ranges = [np.frombuffer(span["ranges"], "<i4") for span in spans]
    both = np.concatenate(ranges) + np.repeat(np.array([span["first"] for span in spans], np.int64), [len(x) for x in ranges])
    steps = np.bincount(both[::2], minlength=len(data) + 1) - np.bincount(both[1::2] + length - 1, minlength=len(data) + 1)
    gone = np.cumsum(steps)[:-1] > 0
    return len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), data[~gone].tobytes()


def _pruned(length: int, clean=None, whole_chars: bool = False):
    """Rows (key, text, spans) to what is left of each text; or, with a packed filter, those of (key, text, row, twin) that lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            if clean is None:
                spans = block.column("spans").to_pylist()
            else:
                block = block.filter(pa.array(~filters.test(clean.value, np.asarray(block.column("row")))))
                spans = [None] * block.num_rows
            if not block.num_rows:
                continue
            data, bounds = utf8(block.column("text"))
            rows = [_rest(data[a:b], own, length) for a, b, own in zip(bounds[:-1].tolist(), bounds[1:].tolist(), spans)]
            columns = list(zip(*rows))
            if whole_chars:
                columns[3] = [x.decode("utf-8", "ignore") for x in columns[3]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if whole_chars else pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, whole_chars: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (bytes left) of every row of (key, text).

    Removed is each byte covered by a string of ``length`` bytes that begins anywhere else
    too, the same text included; strings never cross texts and are judged on the input.
    A null text is empty; other columns are ignored.  Keys may be null or repeat: each row
    is returned, and rows equal in key and text are copies of one another.  With
    ``whole_chars`` kept is a string, without the bytes of characters cut in two.
    """
    spark = docs.sparkSession
    # 128 bits stand for a row
    texts = docs.select("key", "text").withColumns({"row": F.xxhash64("key", "text"), "twin": F.xxhash64(F.lit(1), "text", "key")})
    counted = texts.select("text").mapInArrow(tidy(_anchors(length)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    known = spark.sparkContext.broadcast(filters.build(counted.where("n > 1").select("anchor"), ANCHOR_BITS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for corpus in gathered(text_blocks(batches), CORPUS_BYTES):
            places: list[tuple[bytes, int, int, int]] = []
            blobs: dict[bytes, list] = {}
            for block in corpus:
                data, bounds = utf8(block.column("text"))
                whole, rows, twins, begins = data.tobytes(), block.column("row").to_pylist(), block.column("twin").to_pylist(), bounds.tolist()
                found = contexts_of(data, bounds, length)
                keep = filters.test(known.value, found[1])
                for text, anchor, at, first, last in zip(*(x[keep].tolist() for x in found)):
                    blob = whole[begins[text] + first : begins[text] + last + length]
                    digest = hashlib.md5(blob).digest()
                    places.append((digest, rows[text], twins[text], first))
                    if digest in blobs:
                        blobs[digest][3] += 1
                    else:
                        blobs[digest] = [anchor, at - first, blob, 1, len(blob)]
            n, m = len(places), len(blobs)
            left, right = list(zip(*places)) or [()] * 4, list(zip(*blobs.values())) or [()] * 5
            none_m, none_n = [None] * m, [None] * n
            columns = [(pa.binary(), [*left[0], *blobs]), *zip((pa.int64(), pa.int64(), pa.int32()), ([*c, *none_m] for c in left[1:])), *zip((pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32()), ([*none_n, *c] for c in right))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for k, c in columns], names=["digest", "row", "twin", "first", "anchor", "at", "blob", "n", "size"])

    found = stage(texts.select("row", "twin", "text").mapInArrow(tidy(cut), "digest binary, row long, twin long, first int, anchor long, at int, blob binary, n long, size int"), "repeat-contexts")
    known.destroy()
    repeats, staged = _repeats(found.where("anchor is not null").select("anchor", "at", "digest", "blob", "n", "size"), length)
    repeats = stage(repeats, "repeat-ranges")
    drop(*staged)
    spans = found.where("row is not null").select("digest", "row", "twin", "first").join(repeats, "digest")
    spans = stage(spans.groupBy("row", "twin").agg(F.collect_list(F.struct((F.col("first") + F.col("shift")).alias("first"), "ranges")).alias("spans")), "repeat-spans")
    drop(found, repeats)
    # only texts that may lose something are shuffled
    may = spark.sparkContext.broadcast(filters.build(spans.select("row"), filters.ID_BITS))

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(filters.test(may.value, np.asarray(batch.column("row")))))

    key = docs.schema["key"].dataType.simpleString()
    out = f"key {key}, n_bytes long, n_removed long, n_spans long, kept {'string' if whole_chars else 'binary'}"
    dirty = texts.mapInArrow(tidy(hit), f"key {key}, text string, row long, twin long").join(spans, ["row", "twin"], "left").select("key", "text", "spans")
    return texts.mapInArrow(tidy(_pruned(length, may, whole_chars)), out).union(dirty.mapInArrow(tidy(_pruned(length, None, whole_chars)), out))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    left = remove_repeats(docs)
    return left.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
