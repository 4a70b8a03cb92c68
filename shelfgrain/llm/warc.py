"""Deterministic sharded WARC writer, and the reader of its archives.

Pages are cut into ranges of their ids at exact positions, so the same pages give the same shards
whatever the cluster.  A task sorts the records of its shards, rolls to a new file when the
compressed size passes a limit, writes under a temporary name and renames the finished file.  Names and
contents depend on the pages alone, so a repeated task leaves the same file.  A manifest, a table that
Spark commits after all tasks, names the files; only those count.

Of pages with equal payloads of at least ``least`` bytes, the one with the smallest id is written in
full; the others are revisit records with headers only.  Lengths and digests are made anew.

Defined cases: a null payload is an empty one; null ids sort last, and a revisit of a
page without id has no ``refers_to``; rows equal in id, URL and payload are all written in full; white space and control
characters in URLs are percent-encoded, a null URL is left out; an empty table gives an empty manifest; columns
other than id, URL and payload are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package, stage, work_path
from .common import as_bytes, lookup, positioned

SHARD_BYTES = 256 << 20
LEAST_SHARDS, MOST_SHARDS = 64, 8192   # their bounds go out to the tasks; beyond, shards grow
FILE_BYTES = 1 << 30                   # compressed
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id} {digest}'.encode()).digest()[:16], version=5)}>"


def clean_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: dict | None) -> bytes:
    """One WARC record as a gzip member; ``first`` is the page a revisit refers to."""
    block = HTTP % len(payload) + (b"" if first else payload)
    heads = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        heads.append(("WARC-Target-URI", clean_url(url)))
    heads.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if not first:
        heads.append(("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block).digest())}"))
    else:
        heads += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first["page_id"], digest))]
        if first["url"] is not None:
            heads.append(("WARC-Refers-To-Target-URI", clean_url(first["url"])))
        if first["page_id"] is not None:
            heads.append(("X-Refers-To-Page-Id", str(first["page_id"])))
    if page_id is not None:
        heads.append(("X-Page-Id", str(page_id)))
    heads += [("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n"
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n") + made.flush()


def sort_tuple(page_id: int | None, digest: str) -> tuple:
    return (page_id is None, page_id if page_id is not None else 0, digest)


def at_place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:]) if ":" in folder \
        else (pa.fs.LocalFileSystem(), folder)


def write_warc(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, payload as binary) below ``folder``; the manifest (file, records, bytes, sha1)."""
    spark = pages.sparkSession
    ship_package(spark)
    pages = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    digest = F.sha1("payload")
    narrow = stage(pages.select(F.col("page_id").isNull().alias("no_id"), "page_id", "url", digest.alias("digest"),
                                F.octet_length("payload").cast("long").alias("size")), "payloads")
    equal = stage(narrow.filter(F.col("size") >= least).groupBy("digest").agg(
        F.min(F.struct("no_id", "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "equal")
    rows, size = narrow.agg(F.count(F.lit(1)), F.sum("size")).first()
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, math.ceil((size or 0) / SHARD_BYTES)))
    width = max(1, math.ceil(rows / shards))
    placed = positioned(narrow.select("no_id", "page_id", "digest"), ["no_id", "page_id", "digest"], "order")
    bounds = sorted(sort_tuple(r["page_id"], r["digest"]) for r in
                    placed.filter((F.col("_position") > 1) & ((F.col("_position") - 1) % width == 0)).collect())

    def archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, member = [], []
            payloads = as_bytes(batch.column(2))
            others = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())
            for k, (page_id, url, hexed, first) in enumerate(others):
                shard.append(bisect.bisect_right(bounds, sort_tuple(page_id, hexed)))
                revisit = first is not None and (first["page_id"], first["url"]) != (page_id, url)
                member.append(record(page_id, url, payloads[k].as_py(), base32_sha1(bytes.fromhex(hexed)), first if revisit else None))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column(0), batch.column(1), batch.column(3), pa.array(member, pa.binary())],
                                             names=["shard", "page_id", "url", "digest", "member"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    made = lookup(pages.withColumn("digest", digest), equal, "digest").select("page_id", "url", "payload", "digest", "first")
    members = made.mapInArrow(archive, f"shard int, page_id {id_type}, url string, digest string, member binary")
    ordered = members.repartition(shards, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "url")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = at_place(folder)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int, int, str]] = []
        shard = part = records = size = 0
        out = temporary = check = None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None
                name = f"part-{shard:05d}-{part:05d}.warc.gz"
                if fs.get_file_info(f"{root}/{name}").type == pa.fs.FileType.NotFound:
                    fs.move(temporary, f"{root}/{name}")
                else:  # an earlier attempt finished the same file
                    fs.delete_file(temporary)
                done.append((name, records, size, check.hexdigest()))

        for batch in batches:
            for at, member in zip(batch.column(0).to_pylist(), batch.column(4)):
                member = member.as_py()
                if out is None or at != shard or size + len(member) > file_bytes:
                    close()
                    shard, part = at, part + 1 if done and at == shard else 0
                    records = size = 0
                    check, temporary = hashlib.sha1(), f"{root}/.{at:05d}-{part:05d}-{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(temporary, compression=None)
                out.write(member)
                check.update(member)
                records, size = records + 1, size + len(member)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), pa.string()))] if done else
                                         [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())], names=["file", "records", "bytes", "sha1"])

    manifest = ordered.mapInArrow(write, "file string, records long, bytes long, sha1 string")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(unpack.decompress(chunk))
            chunk = b""
            if unpack.eof:
                yield b"".join(parts)
                chunk, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse_record(raw: bytes) -> dict:
    """Headers and payload of a record; raises if lengths or digests disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        size = len(payload)
        if base32_sha1(hashlib.sha1(payload).digest()) != digest or size != int(fields["X-Payload-Length"]):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload": payload if fields["WARC-Type"] == "response" else None,
            "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id")}


READ = {"page_id": "long", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}


def read_warc(manifest: DataFrame, folder: str, columns: tuple[str, ...] = tuple(READ)) -> DataFrame:
    """The records of the files named in ``manifest``, one task per few files, a record in memory at a time."""
    ship_package(manifest.sparkSession)
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[READ[c]]) for c in columns], names=list(columns))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = at_place(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in members(iter(lambda: stream.read(READ_BYTES), b"")):
                        rows.append(parse_record(raw))
                        size += len(raw)
                        if size > 8 * READ_BYTES or len(rows) == 5000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(tasks, "file").mapInArrow(read, ", ".join(f"{c} {READ[c]}" for c in columns))


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Digest of the archives of ``pages``: written to the shared folder, read back, one row per record."""
    folder = work_path(pages.sparkSession, "warc")
    manifest = write_warc(pages.select("page_id", "url", F.col("html").cast("binary").alias("payload")), folder, least)
    return read_warc(manifest, folder, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
