"""WARC archives of records that are compressed one by one with a shared Zstandard dictionary.

An archive starts with a skippable frame that holds the dictionary, built from the archive's own records: a trained one,
or, where the records are too few or too uniform to train on, some of their content. Every record follows as a frame of
its own. Of pages with equal payloads the one with the smallest id is stored as a response, the
others as revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.llm.common import new_folder, saved, table

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit one if ``first`` names the page that holds the payload."""
    name = lambda x: f"<urn:x-page:{'null' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url or "urn:x-page:unknown")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    lines += [] if first is None else [f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int, sample_bytes: int = 1 << 21, piece: int = 1 << 14) -> bytes:
    """A dictionary for an archive of these records: of ``size`` bytes, or a sixteenth of a small archive.

    It is trained on about ``sample_bytes`` in pieces of up to ``piece`` bytes, spread evenly over whole records. Where
    the pieces are too few or too uniform for the trainer, the last of them are the dictionary as they are. An archive
    below 128 bytes has none.
    """
    pieces = [r[at : at + piece] for r in records for at in range(0, len(r), piece)]
    total = sum(map(len, pieces))
    samples, room = pieces[:: max(1, total // sample_bytes)], min(size, total // 16)
    if room < 8:
        return b""
    if room >= 1024 and len(samples) >= 8:
        try:
            return zstandard.train_dictionary(room, samples, d=8, k=256).as_bytes()
        except zstandard.ZstdError as e:  # the trainer's refusal of uniform samples; anything else goes on
            if "train" not in str(e):
                raise
    return b"".join(samples)[-room:]


def archive(records: list[bytes], level: int = 9, dict_size: int = 1 << 16) -> bytes:
    shared = dictionary(records, dict_size)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdCompressor(level=level)
    return b"".join([struct.pack("<II", SKIPPABLE, len(shared)), shared, *map(packer.compress, records)])


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, read with the dictionary that it carries."""
    kind, size = struct.unpack_from("<II", data)
    if kind != SKIPPABLE:
        raise ValueError("the archive doesn't start with a dictionary frame")
    shared = data[8 : 8 + size]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdDecompressor()
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(view[at : at + 16384]))
            at = min(at + 16384, len(data)) - len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    of = lambda key: None if fields.get(key) in (None, "<urn:x-page:null>") else int(fields[key][12:-1])
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what was written")
    return {"page_id": of("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": of("WARC-Refers-To")}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = 1 << 24) -> DataFrame:
    """Write pages to ``folder`` (shared by all executors) and return the manifest (path, records, bytes).

    A null payload counts as empty, a null url as unknown. Payloads below ``min_bytes`` are never revisits. Of equal
    payloads the rows with the smallest id are responses, repeated rows of that id too; rows without id are revisits if
    another row has one. Ids are taken as long integers, what is none counts as null. An archive holds about
    ``archive_bytes`` of records, an empty table makes none. A task that runs again writes the same archives under the
    same names.
    """
    named = pages.select(F.col(id_col).try_cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    named = named.withColumn("digest", F.sha2("payload", 256))
    repeated = named.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    repeated = saved(repeated.select("digest", "first"), "repeated-payloads")
    rows = named.join(repeated, "digest", "left").select("page_id", "url", "payload", F.when(F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("first"))
    rows = rows.sortWithinPartitions("page_id", "url", F.sha1("payload"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            data, to = archive(held), f"{root}/part-{part:05d}-{number:05d}.warc.zst"
            own = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(data)
            store.move(own, to)
            return pd.DataFrame({"path": [to], "records": [len(held)], "bytes": [len(data)]})

        for pdf in batches:
            for x in pdf.itertuples(index=False):
                i, first = (None if pd.isna(v) else int(v) for v in (x.page_id, x.first))
                held.append(record(i, x.url, bytes(x.payload), first))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return saved(rows.mapInPandas(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives in ``folder``: page_id, url, payload (null for revisits) and the headers' digest columns."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                held = []
                for raw in frames(bytes(data)):
                    held.append(parse(raw))
                    if len(held) == 512:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    return files.mapInPandas(run, PARSED)


def _rows(held: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(held).astype({"page_id": "Int64", "refers_to": "Int64"})


def op5_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    if not write_archives(pages, folder).agg(F.sum("records")).first()[0]:
        return spark.createDataFrame([], PARSED).drop("url", "payload")
    return read_archives(spark, folder).drop("url", "payload")


#: SHA-1 in base32, five bits a sign, is spelled out of the hex digest.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER)
    + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER)
    + CAST(substr(bits, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""
