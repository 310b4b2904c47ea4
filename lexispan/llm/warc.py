"""WARC archives with dictionary-compressed records.

Each task writes files of its own rows.  A file begins with a skippable frame
(magic 0x184D2A5D) that holds a Zstandard dictionary built from the file's first records
(compressed if that is smaller), and then has one Zstandard frame a record, so a
record can be read alone.  A payload that an earlier page has, and that is long
enough, becomes a revisit record without body.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, new_folder, text_blocks, tidy

SKIPPABLE = 0x184D2A5D
#: Payloads from so many bytes on are stored once.
LEAST_BYTES = 100
#: Bytes of records that a dictionary is built from, its size, and the size of a file.
SAMPLE_BYTES, DICTIONARY_BYTES, FILE_BYTES = 1 << 20, 32 << 10, 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_READ = 1 << 20


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record of an HTTP response or of a revisit to one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": uri(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((url or "about:blank").split()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": uri(refers_to), "X-Refers-To-Page-Id": str(refers_to)}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; checks its lengths."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-length"] = next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length")).decode()
    return fields, payload


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves (raw content) where too few are there to train on."""
    import zstandard

    size = sum(map(len, samples))
    if len(samples) >= 16 and size > 4 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, steps=1).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


class WarcWriter:
    """One file: dictionary frame, then records."""

    def __init__(self, stream, samples: list[bytes]):
        import zstandard

        words = dictionary(samples)
        packed = zstandard.ZstdCompressor(level=19).compress(words)
        held = packed if len(packed) < len(words) else words
        self.stream = stream
        self.n_bytes = stream.write(struct.pack("<II", SKIPPABLE, len(held)) + held) or 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdCompressor(level=LEVEL)

    def write(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.n_bytes += len(frame)
        self.stream.write(frame)


def read_records(file) -> Iterator[bytes]:
    """Records of a file, read in pieces."""
    import zstandard

    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    words = file.read(size)
    if words[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
        words = zstandard.ZstdDecompressor().decompress(words)
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        rest = rest or file.read(_READ)
        if not rest:
            return
        frame, out = context.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = file.read(_READ)
            if not rest:
                raise ValueError("a cut frame")
        yield b"".join(out)


def write_archives(pages: DataFrame, folder: str) -> list[str]:
    """Write a record for each row of (page_id, url, html) below ``folder``; names of the files.

    Of the records with equal payloads of at least ``LEAST_BYTES`` bytes the smallest page_id
    is the response (every row, if rows repeat it) and the others revisit it.  A null
    page is an empty payload; a null page_id is never referred to.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("long", F.octet_length("html") >= LEAST_BYTES)
    firsts = rows.where("long").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    known = rows.where("long").join(firsts.select("digest", "first"), "digest", "left")
    known = known.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")
    # small payloads, the empty one above all, may be in very many rows: they stay where they are
    known = known.unionByName(rows.where("not long").withColumn("refers_to", F.lit(None).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        task = uuid.uuid4().hex[:12]
        writer, held, size, names = None, [], 0, []

        def begin() -> None:
            nonlocal writer, held, size
            system.create_dir(root)
            names.append(f"{task}-{len(names):05d}.warc.zst")
            writer = WarcWriter(system.open_output_stream(f"{root}/{names[-1]}"), held)
            for x in held:
                writer.write(x)
            held, size = [], 0

        for block in text_blocks(batches, "html"):
            for row in zip(*(block.column(x).to_pylist() for x in ("page_id", "url", "html", "digest", "refers_to"))):
                data = record(row[0], row[1], row[2].encode(), row[3], row[4], row[4] is not None)
                if writer is None:
                    held.append(data)
                    size += len(data)
                    if size >= SAMPLE_BYTES:
                        begin()
                else:
                    writer.write(data)
                    if writer.n_bytes >= FILE_BYTES:
                        writer.stream.close()
                        writer = None
        if held:
            begin()
        if writer is not None:
            writer.stream.close()
        if names:  # only files that a finished task names are part of the archive
            yield pa.RecordBatch.from_arrays([pa.array(names)], names=["name"])

    return sorted(r[0] for r in known.mapInArrow(tidy(run), "name string").collect())


def read_archives(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from the payload read and held against its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with system.open_input_stream(f"{root}/{name}") as file:
                    for data in read_records(file):
                        head, payload = parse(data)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['X-Page-Id']} differs from its digest")
                        to_int = lambda x: int(x) if x else None
                        rows.append((to_int(head["X-Page-Id"]), int(head["http-length"]), digest, head["WARC-Type"], to_int(head.get("X-Refers-To-Page-Id"))))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    listed = spark.createDataFrame([(x,) for x in names], "name string")
    if len(names) > 1:
        listed = listed.repartition(len(names))
    return listed.mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all pages and read the archives back."""
    folder = new_folder(spark, "warc")
    return read_archives(spark, folder, write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder))


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
