"""Token ids in binary files of patched frame-of-reference blocks.

File format (all integers little-endian)::

    "LXPF0001"
    block*            see pack_block
    u64 * n_blocks    offset of each block's first byte in the file (index of block starts)
    (i64, u32) * n    id of each document (null: the smallest i64) and its number of ids
    u64 n_blocks, u64 n_documents, u64 n_ids, "LXPF0001"

A block holds up to ``BLOCK`` ids: count, minimum, packed width, number of exceptions;
the differences to the minimum packed at the width that ``PERCENTILE`` of them fit
in; then the exceptions' positions (u16) and the bits of theirs above that width (u32).
Writers stream blocks out, so a task holds one corpus block and never a whole file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import Texts, file_system, gathered, new_folder, text_blocks, tidy
from .parts import PartEncoder

MAGIC = b"LXPF0001"
BLOCK = 8192
PERCENTILE = 95
CORPUS_BYTES = 6 << 20
#: Parts whose ids a writer keeps between corpora, and parts that the library gets as one string.
CACHE_PARTS, JOINED = 1_500_000, 128
_HEAD = struct.Struct("<IIBxH")
_TAIL = struct.Struct("<QQQ8s")
_NULL_ID = -(1 << 63)


def pack_block(ids: np.ndarray) -> bytes:
    """One block of up to ``BLOCK`` ids."""
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    width = int(np.partition(rest, k := (len(rest) - 1) * PERCENTILE // 100)[k]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return _HEAD.pack(len(ids), low, width, len(over)) + packed + over.astype("<u2").tobytes() + (rest[over] >> np.uint32(min(width, 31))).astype("<u4").tobytes()


def unpack_block(data: bytes | memoryview) -> tuple[np.ndarray, int]:
    """Ids of the block that ``data`` begins with, and its length in bytes."""
    count, low, width, n_over = _HEAD.unpack_from(data)
    at = _HEAD.size
    n_bytes = (count * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n_bytes, at), count=count * width, bitorder="little").reshape(count, width)
    full = np.zeros((count, 32), np.uint8)
    full[:, :width] = bits
    out = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    at += n_bytes
    over = np.frombuffer(data, "<u2", n_over, at)
    at += 2 * n_over
    out[over] |= np.frombuffer(data, "<u4", n_over, at) << np.uint32(min(width, 31))
    return out + np.uint32(low), at + 4 * n_over


class TokenFileWriter:
    """Appends documents' ids to an open binary stream."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        self.starts: list[int] = []
        self.doc_ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.rest = np.zeros(0, np.uint32)
        self.n_ids = 0
        stream.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        block = pack_block(ids)
        self.starts.append(self.at)
        self.stream.write(block)
        self.at += len(block)

    def append(self, doc_ids: np.ndarray, ids: list[bytes]) -> None:
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.doc_ids.append(doc_ids)
        self.counts.append(counts)
        self.n_ids += int(counts.sum())
        values = np.concatenate((self.rest, np.frombuffer(b"".join(ids), "<u4")))
        whole = len(values) - len(values) % BLOCK
        for a in range(0, whole, BLOCK):
            self._put(values[a : a + BLOCK])
        self.rest = values[whole:]

    def close(self) -> tuple[int, int]:
        """Write the rest and the index; documents and ids in the file."""
        if len(self.rest):
            self._put(self.rest)
        docs = np.empty(sum(map(len, self.counts)), dtype=[("id", "<i8"), ("n", "<u4")])
        docs["id"], docs["n"] = np.concatenate([np.zeros(0, np.int64), *self.doc_ids]), np.concatenate([np.zeros(0, np.int64), *self.counts])
        self.stream.write(np.array(self.starts, "<u8").tobytes())
        self.stream.write(docs.tobytes())
        self.stream.write(_TAIL.pack(len(self.starts), len(docs), self.n_ids, MAGIC))
        return len(docs), self.n_ids


class TokenFileReader:
    """Random and sequential access to a token file by its index."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n_blocks, n_docs, self.n_ids, magic = _TAIL.unpack(file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token file")
        at = size - _TAIL.size - 12 * n_docs - 8 * n_blocks
        index = file.read_at(8 * n_blocks + 12 * n_docs, at)
        self.starts = np.append(np.frombuffer(index, "<u8", n_blocks), np.uint64(at)).astype(np.int64)
        docs = np.frombuffer(index, [("id", "<i8"), ("n", "<u4")], n_docs, 8 * n_blocks)
        self.doc_ids, self.counts = docs["id"].astype(np.int64), docs["n"].astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file; only the blocks that hold them are read."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        data = self.file.read_at(int(self.starts[last + 1] - self.starts[first]), int(self.starts[first]))
        out, at = [], 0
        for _ in range(first, last + 1):
            ids, used = unpack_block(memoryview(data)[at:])
            out.append(ids)
            at += used
        return np.concatenate(out)[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document numbers, their bounds and their ids, about ``most`` ids at a time."""
        groups = self.offsets[:-1] // most
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.counts)]):
            if b > a:
                yield np.arange(a, b), self.offsets[a : b + 1] - self.offsets[a], self.ids(int(self.offsets[a]), int(self.offsets[b]))


_ENCODERS: dict[str, PartEncoder] = {}


def library_encoder(path: str) -> PartEncoder:
    """Encoder by the tokenizers library; one for each worker process and file.

    The file must split with the byte-level pattern and add no prefix space; strings of
    special tokens in a text are ordinary text.  A part that is a space and then begins and
    ends with other characters is a run of whole matches wherever it follows another
    such part, so many are encoded as one string; each character of a token stands for a
    byte, and the parts' lengths in bytes say where one's ids end.
    """
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        encode = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            n_bytes[i] = len(token)

        def one_by_one(strings: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for a in range(0, len(strings), 512) for e in encode(strings[a : a + 512], add_special_tokens=False)]

        def together(strings: list[str]) -> list[bytes]:
            whole = "".join(strings)
            ids = np.array(encode([whole], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(list(map(len, strings if whole.isascii() else map(str.encode, strings))))
            if len(ids) and ids.max() < len(n_bytes):
                reached = np.cumsum(n_bytes[ids])
                cuts = np.searchsorted(reached, ends)
                if reached[-1] == ends[-1] and (reached[cuts] == ends).all():
                    packed, cuts = ids.tobytes(), (4 * (cuts + 1)).tolist()
                    return [packed[i:j] for i, j in zip([0, *cuts], cuts)]
            return one_by_one(strings)  # tokens that are not bytes one for one

        def resolve(strings: list[str]) -> list[bytes]:
            joined = [s[:1] == " " and 1 < len(s) < 200 and not (s[1].isspace() or s[-1].isspace()) for s in strings]
            many = [s for s, j in zip(strings, joined) if j]
            parts = iter([x for a in range(0, len(many), JOINED) for x in together(many[a : a + JOINED])])
            alone = iter(one_by_one([s for s, j in zip(strings, joined) if not j]))
            return [next(parts) if j else next(alone) for j in joined]

        _ENCODERS[path] = PartEncoder(resolve, CACHE_PARTS)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_column: str = "doc_id", text_column: str = "text") -> list[tuple[int, str, int, int]]:
    """Write the ids of all documents, in ascending id order, as files below ``folder``.

    Rows are dealt by ranges of the id, null first, equal ids ordered by text; one file
    a range.  A file is written under a task attempt's own name and then renamed, so a
    repeated task leaves the same file.  Returns (range number, path, documents, ids)
    of each file; this manifest has a row a file, not a row a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        system, root = file_system(folder)
        path = f"{root}/part-{part:06d}.lxpf"
        writer = None
        for corpus in gathered(text_blocks(batches), CORPUS_BYTES):
            if writer is None:
                system.create_dir(root)
                stream = system.open_output_stream(temporary := f"{path}.{uuid.uuid4().hex}")
                writer = TokenFileWriter(stream)
            for block, ids in zip(corpus, encoder.encode([Texts(x.column("text")) for x in corpus])):
                writer.append(np.asarray(pc.fill_null(block.column("doc_id"), _NULL_ID)), [x + end for x in ids])
        if writer is not None:
            n_docs, n_ids = writer.close()
            stream.close()
            system.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([os.path.basename(path)]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "name", "n_docs", "n_ids"])

    slim = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(tuple(r) for r in ordered.mapInArrow(tidy(run), "part long, name string, n_docs long, n_ids long").collect())


def read_token_files(spark: SparkSession, folder: str, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens and ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                with system.open_input_file(f"{root}/{name}") as file:
                    reader = TokenFileReader(file)
                    for rows, bounds, ids in reader.documents():
                        packed = memoryview(ids.astype("<u4").tobytes())
                        crcs = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                        held = reader.doc_ids[rows]
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64(), mask=held == _NULL_ID), pa.array(base + reader.offsets[rows], pa.int64()), pa.array(reader.counts[rows], pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    base, files = 0, []
    for part, name, _, n_ids in manifest:
        files.append((part, name, base))
        base += n_ids
    listed = spark.createDataFrame(files, "part long, name string, base long")
    if len(files) > 1:
        listed = listed.repartition(len(files))
    return listed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Write all documents' ids, each with end id 2, and read them back."""
    import public_tokenizers as tokenizers

    folder = new_folder(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(spark, folder, write_token_files(docs, tokenizers.path("byte_bpe_50k.json"), 2, folder))
