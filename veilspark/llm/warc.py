"""WARC archives with revisit resolution.

Headers (page, address, payload digest and size) are shuffled by digest; of equal payloads of at least a given
size the record with the largest page_id is the response, and the others are joined to it as revisits.
Archives are then written with fresh headers: payloads once, revisits without. Payloads travel once, reduced to
one for each digest before the shuffle. Each task writes one archive of gzip members under a name of its own and
renames it when complete, so a task that is run again leaves nothing half-written to be read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, map_arrow, materialize, new_dir, slices

NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, digest string, size long, refers_to long, refers_url string, payload binary, copy int"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records to write, as RECORD; payload is null for revisits. pages: page_id, url, html.

    Null html is an empty payload. Null page_ids sort below all others; records that share a page_id are told
    apart by `copy`, and all but one of equal payloads revisit. Payloads under min_bytes are all responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    large, small = rows.where(F.col("size") >= min_bytes), rows.where(F.col("size") < min_bytes)
    headers = materialize(large.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url"), F.max("size").alias("size")), "warc-headers")
    first = large.groupBy("digest").agg(F.max("page_id").alias("page_id"), F.max_by(F.struct("url", "payload", "size"), F.struct("page_id", F.col("url"))).alias("r"))
    responses = first.select("page_id", "r.url", "digest", "r.size", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"), "r.payload", F.lit(0).alias("copy"))
    originals = headers.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("o")).select("digest", F.col("o.page_id").alias("refers_to"), F.col("o.url").alias("refers_url"))
    again = headers.join(originals, "digest").withColumn("from", F.when(F.col("page_id") == F.col("refers_to"), 1).otherwise(0)).where(F.col("n") > F.col("from"))
    revisits = again.select("page_id", "url", "digest", "size", "refers_to", "refers_url", F.lit(None).cast("binary").alias("payload"), F.explode(F.sequence(F.col("from"), F.col("n").cast("int") - 1)).alias("copy"))
    rest = small.select("page_id", "url", "digest", "size", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"), "payload", F.lit(0).alias("copy"))
    out = responses.unionByName(revisits)
    return out.unionByName(rest) if min_bytes > 0 else out


def record_id(page_id: int, copy: int) -> str:
    return f"<urn:x-page:{'null' if page_id == NO_ID else page_id}:{copy}>"


def page_of(value: str) -> int | None:
    word = re.fullmatch(r"<urn:x-page:(null|-?\d+):\d+>", value)[1]
    return None if word == "null" else int(word)


def record(r: dict, date: str) -> bytes:
    """One WARC record with fresh headers."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"]) or "urn:x-unknown"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['size']}\r\n\r\n".encode()
    revisit = r["payload"] is None
    block = http if revisit else http + r["payload"]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(r['page_id'], r['copy'])}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base32(r['digest'])}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        refers_url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["refers_url"]) or "urn:x-unknown"
        head[6:6] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(r['refers_to'], 0)}", f"WARC-Refers-To-Target-URI: {refers_url}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str) -> DataFrame:
    """path and number of records of each archive written to folder, one for each task that has records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (b := next(batches, None)) is None:
            return
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name, n, date = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        with store.open_output_stream(f"{name}.part", compression=None) as out:
            while b is not None:
                for part in slices(b, 6):
                    for r in part.to_pylist():
                        out.write(gzip.compress(record(r, date), 6, mtime=0))
                        n += 1
                b = next(batches, None)
        store.move(f"{name}.part", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["path", "records"])

    return map_arrow(records, run, "path string, records long")


def members(stream: io.RawIOBase) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked; one is held at a time."""
    rest = b""
    while rest or (rest := stream.read(1 << 16)):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest and not (rest := stream.read(1 << 16)):
                raise EOFError("an archive ends within a record")
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Fields of one record; digests are checked against the bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if fields["warc-block-digest"] != "sha1:" + base32(hashlib.sha1(block).hexdigest()):
        raise ValueError("a block differs from its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\ncontent-length: (\d+)", http)[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest != base32(hashlib.sha1(payload).hexdigest())):
        raise ValueError("a payload differs from its headers")
    return {"page_id": page_of(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def read(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of archives (path, in the store of folder); with their payloads if asked for."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as f:
                    for data in members(f):
                        rows.append(parse(data))
                        if len(rows) == 1000:
                            yield pack(rows)
                            rows = []
                yield pack(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return map_arrow(archives.select("path"), run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes an archive record per row of pages (page_id, url, html), reads the archives back and returns what they say.

    An empty table gives no archives and an empty result. Other columns are not looked at.
    """
    folder = new_dir(pages.sparkSession, "warc")
    archives = materialize(write(resolve(pages, min_bytes), folder), "warc-archives")
    return read(archives.repartition(max(1, archives.count())), folder)
