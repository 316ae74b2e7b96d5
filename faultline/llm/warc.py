"""WARC archives with records compressed one by one under a shared Zstandard dictionary.

An archive is a file of Zstandard frames: first a skippable frame that holds the dictionary, then a warcinfo record, then a frame
for each record. The dictionary is trained on pieces of a bounded sample of the records that are archived. Frames are written by
Spark's own writer, so a task that is lost or run twice leaves no half archive, and any store that Spark writes to will do. The
writer puts ``MARK`` behind each row, which is itself an empty skippable frame: to a Zstandard reader it is nothing, and to
Spark's reader it is where records end, so one archive may be read by many tasks, each holding a record at a time.

Of records with equal payloads one is a response, the others are revisits, which hold the digest and no payload. Which one is
decided on digests and ids; payloads are moved at most once, to be joined with the digests that repeat.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace

#: Fixed by the formats: what dictionary frames and empty skippable frames begin with.
DICTIONARY = struct.pack("<I", 0x184D2A5D)
MARK = struct.pack("<II", 0x184D2A50, 0)
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: Bounds of the sample that the dictionary is trained on, and of the dictionary.
SAMPLE_RECORDS, PIECE_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 112_640
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HTML = "text/html; charset=UTF-8"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _uri(url: str | None) -> str | None:
    """A URL on one line: control characters are written as %XX."""
    return None if url is None else "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def _named(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}/{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    """A response, or a revisit of the record of page ``first``, which has the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {HTML}\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _named(page, f"revisit/{digest}/{url}" if revisit else digest)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", _named(first, digest) if revisit else None),
        ("X-Page-Id", None if page is None else str(page)), ("X-Refers-To-Page-Id", str(first) if revisit and first is not None else None), ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def information(date: str) -> bytes:
    block = b"software: faultline\r\nformat: WARC File Format 1.1\r\n"
    return _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _named(None, "warcinfo")), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


class Frames:
    """Compresses records under a dictionary, and never into bytes that hold MARK."""

    def __init__(self, dictionary: bytes):
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **known)

    def __call__(self, data: bytes) -> bytes:
        frame = self.compressor.compress(data)
        if MARK not in frame or len(data) < 2:
            return frame
        # frames of the halves are read as one stream; the mark can't reach over their border, as no frame begins like its tail
        return self(data[: len(data) // 2]) + self(data[len(data) // 2 :])


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICTIONARY + struct.pack("<I", len(dictionary)) + dictionary


@lru_cache(maxsize=2)
def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def unpacked(data: bytes, dictionary: bytes) -> bytes:
    """The content of some frames one behind the other; skippable frames are left out, but for a dictionary, which is used."""
    out: list[bytes] = []
    while len(data) >= 4:
        (magic,) = struct.unpack_from("<I", data)
        if magic in SKIPPABLE:
            (size,) = struct.unpack_from("<I", data, 4)
            if magic == SKIPPABLE[-3]:
                dictionary = data[8 : 8 + size]
                if dictionary[:4] == zstandard.FRAME_HEADER:  # it may be compressed itself
                    dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
            data = data[8 + size :]
            continue
        reader = _decompressor(dictionary).decompressobj()
        out.append(reader.decompress(data))
        data = reader.unused_data
    return b"".join(out)


def records(stream: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of a stream."""
    at = 0
    while at < len(stream):
        end = stream.index(b"\r\n\r\n", at)
        lines = stream[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, stream[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _trained(most: int):
    """The dictionary of all rows (piece), at most ``most`` bytes; empty where there is too little to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [p for batch in batches for p in batch.column(0).to_pylist() if p and MARK not in p]
        try:
            dictionary = zstandard.train_dictionary(min(most, sum(map(len, pieces)) // 8), pieces, level=LEVEL).as_bytes()
        except (zstandard.ZstdError, ValueError):
            dictionary = b""
        yield pa.RecordBatch.from_arrays([pa.array([b"" if MARK in dictionary else dictionary], pa.binary())], ["dictionary"])

    return run


def _archived(dictionary: bytes, date: str):
    """Of rows (page, url, payload, size, digest, first, revisit): the archive of the partition, a row for each frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames, begun = Frames(dictionary), False
        for batch in batches:
            rows, size = [], 0
            if batch.num_rows and not begun:
                rows, begun = [dictionary_frame(dictionary), frames(information(date))], True
            for k in range(batch.num_rows):
                page, url, payload, length, digest, first, revisit = (batch.column(c)[k] for c in range(7))
                rows.append(frames(record(page.as_py(), url.as_py(), payload.as_py() or b"", length.as_py(), digest.as_py(), first.as_py(), revisit.as_py(), date)))
                size += len(rows[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])

    return run


def _read(dictionary: bytes):
    """Of rows (frames): RECORD. Payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for fields, block in records(unpacked(batch.column(0)[k].as_py(), dictionary)):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"record {fields['WARC-Record-ID']} isn't what its digest says")
                    number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                    size = number("X-Payload-Length") if payload is None else len(payload)
                    rows.append({"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _keyed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    return rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))


def _sample(rows: DataFrame, distinct: int) -> DataFrame:
    """(piece) of about SAMPLE_RECORDS distinct records: those of the least digests; of each one piece, from a place its hash picks."""
    share = min(1.0, SAMPLE_RECORDS / max(distinct, 1))
    at = F.pmod(F.xxhash64(F.lit("piece"), "digest"), F.greatest(F.col("size") - PIECE_BYTES, F.lit(0)) + 1).cast("int")
    # digests are spread evenly: the least 32 bits tell the share
    few = rows.where(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") < int(share * 2**32))
    return few.select("digest", F.substring("payload", at + 1, F.lit(PIECE_BYTES)).alias("piece")).groupBy("digest").agg(F.first("piece").alias("piece")).select("piece")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a record for each row of ``pages`` to archives in the folder ``path``, one for each partition.

    The payload is ``html`` in UTF-8 (null: none). Of rows with equal payloads of ``least`` bytes or more, that of the least
    (key, url), nulls last, is a response and the others revisit it; rows with shorter payloads are all responses. Rows that are
    equal in all three columns are as many records, one of which may be the response. A null url leaves its field out. A longer
    text is one frame, held whole in memory. An empty table gives archives without records; other columns are left out.
    """
    spark = pages.sparkSession
    space = Workspace(spark, "warc")
    rows = _keyed(pages, key, url, html)
    order: list[Column] = [F.col("page").isNull(), F.col("page"), F.col("url").isNull(), F.col("url")]
    same = rows.groupBy("digest", "size", "page", "url").agg(F.count("*").alias("n"))
    first = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    digests = same.groupBy("digest").agg(F.sum("n").alias("rows"), F.min("size").alias("size"), F.min(F.struct(first.alias("order"), "page", "url", "n")).alias("first"))
    digests = space.write(digests.select("digest", "rows", "size", "first.page", "first.url", "first.n"), "digests")
    pieces = _sample(rows, digests.count())
    dictionary = bytes(space.write(pieces.coalesce(1).mapInArrow(_trained(DICTIONARY_BYTES), "dictionary binary"), "dictionary").first()[0])
    repeated = digests.where(f"rows > 1 AND size >= {least}").select("digest", F.col("page").alias("first"), F.col("url").alias("first_url"), "n")
    repeated = space.write(repeated, "repeated")
    known = rows.join(repeated, "digest", "left")
    is_first = F.col("page").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    names = ["page", "url", "payload", "size", "digest", "first", "revisit"]
    revisit = F.col("n").isNotNull() & ~is_first
    record_of = lambda df, again: df.select("page", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest", F.when(again, F.col("first")).alias("first"), again.alias("revisit")).select(*names)
    archived = record_of(known.where(F.col("n").isNull() | (F.col("n") == 1) | ~is_first), revisit)
    if repeated.where("n > 1").limit(1).count():
        # rows that are equal throughout: one response, the others from their number
        twins = known.where(is_first & (F.col("n") > 1)).groupBy("digest", "size", "page", "url", "first").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
        archived = archived.union(record_of(twins, F.lit(False)))
        others = twins.drop("payload").withColumn("copy", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n")))).withColumn("payload", F.lit(None).cast("binary"))
        archived = archived.union(record_of(others, F.lit(True)))
    frames = archived.mapInArrow(_archived(dictionary, date), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", MARK.decode()).text(path)
    space.remove("digests", "dictionary", "repeated")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """RECORD of the responses and revisits in the archives of one run of ``write_archives``, in any number of tasks; a payload that
    isn't what its digest says is an error. An archive of another writer, which has no marks between its records, is read as well,
    by one task and as a whole, with the dictionary that it begins with."""
    frames = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("value").cast("binary").alias("frame"))
    begins = (F.substring("frame", 1, 4) == F.lit(DICTIONARY)) & (F.octet_length("frame") <= 8 + DICTIONARY_BYTES)
    found = frames.where(begins).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("archives of several runs: read each folder by itself")
    dictionary = bytes(found[0][0])[8:] if found else b""
    return frames.mapInArrow(_read(dictionary), RECORD)
