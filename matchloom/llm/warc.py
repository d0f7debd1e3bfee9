"""WARC archives compressed with Zstandard: one frame per record, dictionary in a leading skippable frame.

Archives are written and read only through Spark's data sources, so any
storage that Spark reaches will do.  The text sink ends every row with a
newline; each record frame is followed by the head of a one-byte skippable
frame whose payload is that newline, which keeps the files valid Zstandard
streams.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import ensure_checkpoint_dir, id_sample

DICT_MAGIC = 0x184D2A5D
#: A skippable frame of one byte; the byte is the newline that the sink adds.
NEWLINE_FRAME = struct.pack("<II", 0x184D2A50, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"


def train_dictionary(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample: int = 256, sample_bytes: int = 8192, size: int = 16384) -> bytes:
    """Compression dictionary from at most ``sample`` pages (lowest hash of the id), ``sample_bytes`` of each; empty if they are too few."""
    ids = id_sample(pages.select(page_id), page_id, sample)
    picked = pages.select(page_id, html).join(F.broadcast(ids.distinct()), page_id).filter(F.length(html) > 0)
    rows = picked.select(F.xxhash64(page_id).alias("h"), F.substring(html, 1, sample_bytes).alias("t")).orderBy("h", "t").limit(sample).collect()
    try:
        return zstd.train_dictionary(size, [r["t"].encode() for r in rows]).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) has an empty block."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{url}')}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """Values of READ_SCHEMA; ``error`` says what is wrong with a malformed record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    url, kind = fields.get("warc-target-uri"), fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    length, size = number("content-length"), number("x-payload-length")
    payload, error = rest[: length or 0], None
    if not lines[0].startswith("WARC/1.") or not mark:
        error = "no WARC header"
    elif kind not in ("response", "revisit") or "warc-record-id" not in fields or "warc-date" not in fields:
        error = "a mandatory field is missing"
    elif length is None or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        error = "the block differs from Content-Length"
    elif kind == "response" and (size != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        error = "the payload differs from its digest"
    elif kind == "revisit" and (length or number("x-refers-to-page-id") is None):
        error = "a revisit with a block or without a target"
    return number("x-page-id"), url, size, digest, kind, number("x-refers-to-page-id"), payload if kind == "response" else None, error


def frames(data: bytes) -> Iterator[bytes]:
    """Records of one archive, each decoded from its own frame."""
    view, at, dictionary = memoryview(data), 0, None
    while at < len(data):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICT_MAGIC and at == 0:
                raw = bytes(view[8 : 8 + size])
                if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                    raw = zstd.ZstdDecompressor().decompress(raw)
                dictionary = zstd.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        one, parts = zstd.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
        while not one.eof:
            piece = view[at : at + 65536]
            if not len(piece):
                raise ValueError("the archive ends within a frame")
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> None:
    """Write one archive per partition under ``path``; no rows, no archive.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one
    with the largest ``page_id`` is the response, the others revisit it; rows
    repeated with that same identifier are responses too, as are rows without
    one.  Null html counts as empty.  Payloads are shuffled by (page, digest),
    so that a payload shared by a third of all pages stays spread out; only
    identifiers and digests are grouped by payload.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    ids = rows.filter(F.octet_length("html") >= min_revisit_bytes).select("page_id", "digest")
    shared = ids.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).filter("n > 1 and refers_to is not null").drop("n")
    revisits = ids.join(shared.hint("merge"), "digest").filter(F.col("page_id") < F.col("refers_to")).distinct()
    dictionary = train_dictionary(pages, page_id, html)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstd.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        lead = dictionary_frame(dictionary) if dictionary else b""
        for b in batches:
            out = []
            for p, u, h, r in zip(*(b.column(i).to_pylist() for i in range(4))):
                out.append(lead + press.compress(record(p, u, h.encode(), r, date)) + NEWLINE_FRAME)
                lead = b""
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    joined = rows.join(revisits.hint("shuffle_hash"), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    joined.mapInArrow(pack, "frame binary").select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record, in READ_SCHEMA; malformed records carry an ``error`` and do not stop the job."""
    import pyspark.sql.types as T

    names = [f.name for f in T._parse_datatype_string(READ_SCHEMA).fields]

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        for b in batches:
            for k in range(b.num_rows):
                out, held = [], 0
                for raw in frames(b.column(0)[k].as_py()):
                    row = parse_record(raw)
                    held += len(raw) if with_payload else 200
                    out.append(row if with_payload else (*row[:6], None, row[7]))
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(unpack, READ_SCHEMA)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared checkpoint folder and read them back; a record that cannot be read fails the job."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_revisit_bytes=min_revisit_bytes)
    read = read_archives(spark, path, with_payload=False).drop("payload")
    failed = F.raise_error(F.concat(F.lit("malformed record: "), F.col("error")))
    return read.withColumn("page_id", F.when(F.col("error").isNotNull(), failed.cast("long")).otherwise(F.col("page_id"))).drop("error")


