"""WARC archives: one gzip member per record, written and read record by record."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Compressed bytes that the reader asks for at a time.
READ = 1 << 18
#: Records of less payload are always written in full.
LEAST_REVISIT = 100
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_uri(uri: str, write: bool = False):
    """A stream of a file in any store that pyarrow knows by its URI; a bare path is local."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)
    if write:
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_stream(path, compression=None)


def move_uri(old: str, new: str) -> None:
    """Rename a file within its store."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(old) if ":/" in old else (fs.LocalFileSystem(), old)
    store.move(path, fs.FileSystem.from_uri(new)[1] if ":/" in new else new)


def record(kind: bytes, headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """One record as a gzip member. Header values keep to one line."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, *(k + b": " + b" ".join(v.split()) for k, v in headers), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(), b"Content-Length: %d" % len(block)]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(b"\r\n".join([*lines, b"", b""]) + block + b"\r\n\r\n") + squeeze.flush()


class BadRecord(ValueError):
    """An archive that breaks off or whose framing or digest is wrong."""


def members(stream, size: int = READ) -> Iterator[bytes]:
    """The contents of each gzip member of a stream, inflated as its bytes come."""
    held = b""
    while held or (held := stream.read(size)):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not held and not (held := stream.read(size)):
                raise BadRecord("the last member is cut off")
            try:
                parts.append(inflate.decompress(held))
            except zlib.error as e:
                raise BadRecord(str(e)) from e
            held = inflate.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Headers (names in lower case) and block of one record, with its length and digests verified."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not sep or not first.startswith(b"WARC/"):
        raise BadRecord("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
    n = int(headers.get(b"content-length", b"-1"))
    if n < 0 or rest[n:] != b"\r\n\r\n":
        raise BadRecord("the content length does not fit")
    block = rest[:n]
    said = headers.get(b"warc-block-digest")
    if said and said != b"sha256:" + hashlib.sha256(block).hexdigest().encode():
        raise BadRecord("the block digest does not fit")
    if headers.get(b"warc-type") == b"response":
        said = headers.get(b"warc-payload-digest")
        if said and said != b"sha256:" + hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest().encode():
            raise BadRecord("the payload digest does not fit")
    return headers, block


def read_records(stream) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """All records of an archive in order; one is in memory at a time."""
    for member in members(stream):
        yield parse(member)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, date: str | None = None) -> DataFrame:
    """Write every row as a record below ``folder``; (path, records), a table of the finished files.

    Of rows whose payloads (UTF-8, null being empty) are equal and of ``least`` bytes or more, the
    one with the smallest id is a response and the others are revisits of it, in the same or
    other files; all others are responses. Null ids come after all others and cannot be referred
    to: rows of an equal payload that all have null ids are all responses. Equal ids: all rows
    with the smallest id are responses. A file is written under a name of its task's attempt and
    renamed when whole; only files in the returned table, which is stored, count.
    """
    data = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).alias("id"), F.length(data).alias("n"), F.sha2(data, 256).alias("digest"))
    firsts = slim.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL").select("digest", "first")
    of = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), data.alias("payload"), F.sha2(data, 256).alias("digest"))
    firsts = stored(firsts.select("digest", F.col("first").cast("string").alias("first")), "firsts")
    joined = of.join(firsts, "digest", "left").select("id", "url", "payload", "digest", "first")
    stamp = (date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}"
        count, out = 0, open_uri(f"{name}.part", write=True)
        with out:
            out.write(record(b"warcinfo", [(b"WARC-Record-ID", _urn(name)), (b"WARC-Date", stamp), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for batch in batches:
                for doc, url, payload, digest, first in zip(*batch.columns, strict=True):
                    doc, payload, digest, first = doc.as_py(), payload.as_py(), digest.as_py().encode(), first.as_py()
                    headers = [(b"WARC-Record-ID", _urn(f"{name}/{count}")), (b"WARC-Date", stamp), (b"WARC-Target-URI", (url.as_py() or "").encode("utf-8", "surrogatepass")), (b"Content-Type", b"application/http; msgtype=response"), (b"WARC-Payload-Digest", b"sha256:" + digest)]
                    if doc is not None:
                        headers.append((b"Page-Identifier", doc.encode()))
                    block = HTTP % len(payload)
                    if first is not None and first != doc:
                        headers += [(b"WARC-Profile", REVISIT_PROFILE), (b"Refers-To-Page", first.encode())]
                        out.write(record(b"revisit", headers, block))
                    else:
                        out.write(record(b"response", headers, block + payload))
                    count += 1
        move_uri(f"{name}.part", f"{name}.warc.gz")
        yield pa.RecordBatch.from_pydict({"path": [f"{name}.warc.gz"], "records": [count]})

    return stored(joined.mapInArrow(run, "path string, records long"), "archives")


def _urn(name: str) -> bytes:
    return b"<" + uuid.uuid5(uuid.NAMESPACE_URL, name).urn.encode() + b">"


def read(archives: DataFrame) -> DataFrame:
    """The response and revisit records of the files in column ``path``, one file to a task.

    (id string, url, record_type, payload binary, null for revisits, payload_bytes,
    payload_digest, refers_to string). Archives are read as streams, a record at a time; a cut or
    altered one fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_uri(path) as stream:
                    for headers, block in read_records(stream):
                        kind = headers[b"warc-type"].decode()
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x.split(b":")[1] for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")))
                        if kind == "response" and length != len(payload):
                            raise BadRecord("the payload's length does not fit")
                        text = {k: headers[k].decode("utf-8", "surrogatepass") for k in (b"page-identifier", b"warc-target-uri", b"refers-to-page") if k in headers}
                        rows.append((text.get(b"page-identifier"), text.get(b"warc-target-uri"), kind, payload if kind == "response" else None, length, headers[b"warc-payload-digest"].removeprefix(b"sha256:").decode(), text.get(b"refers-to-page")))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = archives.select("path")
    n = max(1, files.count())
    return files.repartition(n).mapInArrow(run, "id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 9 over all of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = read(write(pages, fresh_path(spark, "warc")))
    digest = F.when(F.col("payload").isNull(), F.col("payload_digest")).otherwise(F.sha2("payload", 256))
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))
