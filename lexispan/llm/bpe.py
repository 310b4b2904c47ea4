"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words (pattern matches) of a block of texts form a small corpus of
symbol chains.  An inverted index leads from the rank of a mergeable pair to the
positions where such a pair stands; ranks are replayed lowest first over the whole
corpus, and each merge touches only the two neighbours of the merged place.  Words
never influence one another, so replaying per block gives the ids that one replay
over the entire corpus would, and no word has to be shuffled.  A task keeps the
ids of earlier parts up to a bound (``parts.CACHE_PARTS``).

A null text counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Texts, gathered, runs, text_blocks, tidy
from .parts import PartEncoder

#: UTF-8 bytes of text that one replay covers.
CORPUS_BYTES = 2 << 20
#: From so many places on, a merge is applied to all of them at once.
MANY = 24


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Table:
    """Open-addressing table from pair codes to ranks, looked up for whole arrays."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        keys, values = np.full(1 << self.bits, -2, np.int64), np.full(1 << self.bits, -1, np.int64)
        codes, ranks = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slots = self._slot(codes)
        while len(codes):
            free = keys[slots] == -2
            keys[slots[free]] = codes[free]  # of several for one slot, the last stays
            placed = keys[slots] == codes
            values[slots[placed]] = ranks[placed]
            codes, ranks, slots = codes[~placed], ranks[~placed], (slots[~placed] + 1) & ((1 << self.bits) - 1)
        self.keys, self.values = keys, values

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Rank of each code, -1 where the pair makes no token."""
        slots = self._slot(codes)
        held = self.keys[slots]
        out = np.where(held == codes, self.values[slots], -1)
        open_ = np.flatnonzero((held != codes) & (held != -2))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[open_]]
            hit = held == codes[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (held != -2)]
        return out


class MergeReplay:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: Rank of the token that a pair (left << 32 | right) makes.
        self.pair_ranks = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.table = _Table(self.pair_ranks)
        self.parts = PartEncoder(self.encode_strings)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed as little-endian unsigned 32-bit integers.

        A merge can open a pair of lower or equal rank in its word; such words are
        then replayed place by place, leftmost first, so the ids are those of
        merging each word's lowest, leftmost pair again and again.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = int(ends[-1]) if len(words) else 0
        if not total:
            return [b""] * len(words)
        # the same memory, for single places and for whole lists of places
        sym_, nxt_, prv_ = (array("q", bytes(8 * total)) for _ in range(3))
        sym, nxt, prv = (np.frombuffer(x, np.int64) for x in (sym_, nxt_, prv_))
        sym[:] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        nxt[:] = np.arange(1, total + 1)
        nxt[ends[lengths > 0] - 1] = -1
        prv[:] = np.arange(-1, total - 1)
        prv[starts[lengths > 0]] = -1
        word = np.repeat(np.arange(len(words)), lengths)

        singles: dict[int, list[int]] = {}
        many: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        pair_ranks, ranks_of = self.pair_ranks, self.table.find
        small = len(self.tokens) < 1 << 16
        marked = np.zeros(len(words), bool)

        def index(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks.astype(np.uint16) if small else ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            firsts, lasts = runs(ranks)
            for r, i, j in zip(ranks[firsts].tolist(), firsts.tolist(), lasts.tolist()):
                if r in many:
                    many[r].append(at[i:j])
                else:
                    many[r] = [at[i:j]]
                    if r not in singles:
                        heappush(heap, r)

        left = np.flatnonzero(nxt >= 0)
        if len(left):
            found = ranks_of(sym[left] << 32 | sym[left + 1])
            index(left[found >= 0], found[found >= 0])
        while heap:
            rank = heappop(heap)
            held, lists = singles.pop(rank, []), many.pop(rank, [])
            if len(held) + sum(map(len, lists)) >= MANY:
                at = np.sort(np.concatenate([*lists, np.array(held, np.int64)]))
                at = at[np.append(True, at[1:] != at[:-1])]
                at = at[(sym[at] >= 0) & (nxt[at] >= 0)]
                at = at[ranks_of(sym[at] << 32 | sym[nxt[at]]) == rank]
                if not len(at):
                    continue
                after = nxt[at]
                past = nxt[after]
                ahead = prv[at]
                new_right = ranks_of(np.where(past >= 0, rank << 32 | sym[past], -1))
                new_left = ranks_of(np.where(ahead >= 0, sym[ahead] << 32 | rank, -1))
                # places that touch one another, or that open a lower pair, go one by one
                odd = (new_right >= 0) & (new_right <= rank) | (new_left >= 0) & (new_left <= rank)
                close = at[1:] <= np.maximum(after, past)[:-1]
                odd[1:] |= close
                odd[:-1] |= close
                held = []
                if odd.any():
                    hit = word[at[odd]]
                    marked[hit] = True
                    odd = marked[word[at]]
                    marked[hit] = False
                    held = at[odd].tolist()
                    at, after, past, ahead, new_right, new_left = (x[~odd] for x in (at, after, past, ahead, new_right, new_left))
                sym[at] = rank
                sym[after] = -1
                nxt[at] = past
                prv[past[past >= 0]] = at[past >= 0]
                found = np.concatenate((new_right, new_left))
                index(np.concatenate((at, ahead))[found >= 0], found[found >= 0])
            else:
                held = sorted({*held, *(p for x in lists for p in x.tolist())})
            for i, p in enumerate(held):
                a = sym_[p]
                q = nxt_[p]
                if a < 0 or q < 0 or pair_ranks.get(a << 32 | sym_[q]) != rank:
                    continue
                sym_[p] = rank
                sym_[q] = -1
                nxt_[p] = r = nxt_[q]
                o = prv_[p]
                lower = False
                if r >= 0:
                    prv_[r] = p
                    new = pair_ranks.get(rank << 32 | sym_[r])
                    if new is not None:
                        if new in singles:
                            singles[new].append(p)
                        else:
                            if new not in many:
                                heappush(heap, new)
                            singles[new] = [p]
                        lower = new <= rank
                if o >= 0:
                    new = pair_ranks.get(sym_[o] << 32 | rank)
                    if new is not None:
                        if new in singles:
                            singles[new].append(o)
                        else:
                            if new not in many:
                                heappush(heap, new)
                            singles[new] = [o]
                        lower = lower or new <= rank
                if lower:  # the pair of lower rank goes first
                    rest = held[i + 1 :]
                    if rest:
                        if rank not in singles and rank not in many:
                            heappush(heap, rank)
                        singles.setdefault(rank, []).extend(rest)
                    break
        alive = sym >= 0
        counts = np.concatenate(([0], np.cumsum(alive)))
        packed = sym[alive].astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(counts[starts].tolist(), counts[ends].tolist())]

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        """Packed ids of each string: words that are whole tokens directly, the others by one replay."""
        find, ranks = self.find, self.ranks
        split = [find(s) for s in strings]
        words = {w: ranks.get(w.encode()) for w in {w for each in split for w in each}}
        hard = [w for w, r in words.items() if r is None]
        ids = {w: r.to_bytes(4, "little") for w, r in words.items() if r is not None}
        ids.update(zip(hard, self.replay([w.encode() for w in hard])))
        return [b"".join(map(ids.__getitem__, each)) for each in split]

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        return next(self.parts.encode([texts]))

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def replayer(path: str, pattern: str) -> MergeReplay:
    """A replayer of a rank file; each task has its own, so that idle workers hold neither ranks nor parts."""
    return MergeReplay(load_ranks(path), pattern)


def encode_column(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode ``text_column``, decode the ids again, and return a row per document.

    Columns: the id, ``n_tokens``, ``ids`` (packed little-endian, null unless
    ``keep_ids``), ``ids_sha256`` and ``decoded_sha256``.  The decoded bytes of
    every document equal its UTF-8 text, which the caller can check by the digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(path, pattern)
        try:
            for corpus in gathered(text_blocks(batches), CORPUS_BYTES):
                for block, ids in zip(corpus, coder.parts.encode([Texts(x.column("text")) for x in corpus])):
                    yield pa.RecordBatch.from_arrays(
                        [
                            block.column("doc_id"),
                            pa.array([len(x) // 4 for x in ids], pa.int64()),
                            pa.array(ids if keep_ids else [None] * len(ids), pa.binary()),
                            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                            pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string()),
                        ],
                        names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                    )
        finally:
            del coder.parts  # it refers back to the replayer, which would stay until a collection

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return slim.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string").withColumnRenamed("doc_id", id_column)


def op4_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes, as digests."""
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_column(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, keep_ids=False).drop("ids")
