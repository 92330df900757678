"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id (then by digests of payload and url) and cut into
shards where the running total of their bytes passes a multiple of the shard size, so
the shards follow from the set of records alone, however its ids are spread, and one id
with many pages is cut as well.  The bounds of the shards, at most MOST_SHARDS keys, go
to every task.  A task writes its shard's files under temporary names, rolls them by
compressed size, and renames each when it is whole; a second attempt writes the same
bytes to the same name.  The manifest (one row per file) is committed last: readers
take files from it alone.  Digests, lengths and record ids are computed anew from the
payload.

Files go through pyarrow's file systems, so the folder may be any that pyarrow
opens (file, hdfs, s3, gs); it must be shared by all executors.

Defined results: null html is an empty payload; equal payloads of at least
`min_bytes` bytes have one response, the largest page_id (rows that share that id
are all responses), and revisits; a null page_id comes back as null and is a
revisit if any equal payload has an id; equal rows are equal records; null urls become
an urn; control characters in urls are percent-encoded; a payload of any length is one
record; an empty table makes an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import _text as tx

#: Shards of 1/64 of all payloads within these limits, however many that makes up to MOST_SHARDS; files roll at 1/8 of a shard.
LEAST_SHARD, LARGEST_SHARD, MOST_SHARDS = 16 << 20, 1 << 30, 1 << 16
HEAD_BYTES = 512  # of a record, about
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard long, sequence int, records long, bytes long, sha256 string, first_page long, last_page long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string"


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:].replace("//", "/", 1) if uri.startswith("file://") else uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record_key(page_id, digest, url):
    """Text in the order of the records: page_id (null first), digest of the payload, digest of the url."""
    number = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(number, F.lit("")), F.lit(":"), digest, F.left(F.sha1(F.coalesce(url, F.lit(""))), F.lit(8)))


def shard_bounds(narrow: DataFrame, shard_bytes: int) -> list[str]:
    """Keys at which shards begin, but for the first one; narrow(key, size)."""

    def running(batches):
        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            sums = total + np.cumsum(batch.column(1).to_numpy(zero_copy_only=False) + HEAD_BYTES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums), pa.array(np.full(len(sums), part))], ["key", "size", "total", "part"])
            total = int(sums[-1]) if len(sums) else total

    ordered = narrow.select("key", F.col("size").cast("long")).repartitionByRange(tx.buckets(narrow), "key").sortWithinPartitions("key")
    table = tx.written(ordered.mapInArrow(running, "key string, size long, total long, part long"), "ordered")
    before, offsets = 0, []
    for r in table.groupBy("part").agg(F.max("total").alias("total")).orderBy("part").collect():  # one row a partition
        offsets.append((r.part, before))
        before += r.total
    shard_bytes = max(shard_bytes, -(-before // MOST_SHARDS))
    starts = table.join(F.broadcast(narrow.sparkSession.createDataFrame(offsets, "part long, before long")), "part") if offsets else table.withColumn("before", F.lit(0))
    end = F.col("before") + F.col("total")
    begin = end - F.col("size") - HEAD_BYTES
    # A record that passes a multiple of the shard size is the first of a shard.
    first = starts.filter((F.floor(begin / shard_bytes) < F.floor(end / shard_bytes)) & (begin > 0)).select("key").distinct()
    bounds = sorted(r.key for r in first.collect())
    tx.discard(table)
    return bounds


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record, headers and digests made anew; a revisit keeps the HTTP head only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    head.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class _Roller:
    """Writes gzip members to files that roll at a size; whole files get their final names."""

    def __init__(self, folder: str, roll: int):
        self.fs, self.root = _file_system(folder)
        self.roll, self.file = roll, None

    def add(self, shard: int, page_id, record: bytes):
        if self.file is not None and (self.shard != shard or self.size >= self.roll):
            yield self.close()
        if self.file is None:
            self.sequence = self.sequence + 1 if getattr(self, "shard", None) == shard else 0
            self.shard, self.size, self.records, self.first = shard, 0, 0, page_id
            self.name, self.digest = f"shard-{shard:08d}-{self.sequence:05d}.warc.gz", hashlib.sha256()
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.file = self.fs.open_output_stream(self.temporary)
        coder = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = coder.compress(record) + coder.flush()
        self.file.write(data)
        self.digest.update(data)
        self.size, self.records, self.last = self.size + len(data), self.records + 1, page_id

    def close(self) -> tuple:
        self.file.close()
        self.file = None
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        return self.name, self.shard, self.sequence, self.records, self.size, self.digest.hexdigest(), self.first, self.last


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int | None = None, shard_bytes: int | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages(page_id, url, html) to `folder`; returns the manifest."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    key = record_key(F.col("page_id"), F.col("digest"), F.col("url"))
    narrow = tx.written(rows.select("page_id", "url", F.sha1("payload").alias("digest"), F.length("payload").alias("size")).select("page_id", "digest", "size", key.alias("key")), "payloads")
    response = narrow.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"))
    revisits = narrow.join(response, ["digest", "size"]).filter("refers_to is not null and not page_id <=> refers_to")
    revisits = tx.written(revisits.select(F.col("page_id").alias("rid"), F.col("digest").alias("rdigest"), "refers_to").distinct(), "revisits")

    payloads = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shard_bytes = shard_bytes or min(max(payloads // 64, LEAST_SHARD), LARGEST_SHARD)
    roll_bytes = roll_bytes or shard_bytes // 8
    known = spark.sparkContext.broadcast(shard_bounds(narrow, shard_bytes))
    tx.discard(narrow)

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(known.value, k) for k in keys], dtype="int32")

    placed = rows.withColumn("digest", F.sha1("payload"))
    placed = placed.join(revisits, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left").withColumn("key", key).withColumn("shard", shard_of("key"))
    ordered = placed.select("shard", "page_id", "url", "payload", "refers_to", "key").repartitionById(len(known.value) + 1, "shard").sortWithinPartitions("key", "url").drop("key")

    def run(batches):
        roller = _Roller(folder, roll_bytes)
        done: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                done += roller.add(r["shard"], r["page_id"], warc_record(r["page_id"], r["url"], r["payload"], r["refers_to"], date))
        if roller.file is not None:
            done.append(roller.close())
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        columns = [pa.array([d[i] for d in done], types[x.split()[1]]) for i, x in enumerate(MANIFEST.split(", "))]
        yield pa.RecordBatch.from_arrays(columns, names)

    files, root = _file_system(folder)
    files.create_dir(f"{root}/_temporary", recursive=True)
    ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    files.delete_dir(f"{root}/_temporary")
    with files.open_output_stream(f"{root}/_SUCCESS") as f:
        f.write(json.dumps({"format": "WARC/1.1", "min_bytes": min_bytes, "roll_bytes": roll_bytes}).encode())
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _members(stream, size: int = 1 << 20):
    """The decompressed gzip members of a stream, one at a time."""
    coder, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(size)
        if not data:
            break
        out.append(coder.decompress(data))
        data = coder.unused_data
        if coder.eof:
            yield b"".join(out)
            coder, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("truncated archive")


def parse_record(record: bytes) -> dict:
    """Headers, and the HTTP head and payload of the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")))
    return fields | {"http_length": length, "payload": payload}


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all files of the manifest; response payloads are checked against their digests."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    n = max(1, manifest.count())

    def run(batches):
        fs, root = _file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        r = parse_record(member)
                        digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = r["WARC-Type"]
                        if kind == "response" and (len(r["payload"]) != r["http_length"] or base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        page, refers = r["X-Page"], r.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, r["WARC-Target-URI"], kind, r["http_length"], digest, int(refers) if refers else None, r["payload"] if with_payload and kind == "response" else None, name))
                        size += len(r["payload"]) * with_payload + 200
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    return manifest.select("file").repartition(n, "file").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], [c for c, _ in fields])


def round_trip(pages: DataFrame, min_bytes: int = 0, **options) -> DataFrame:
    """Write the pages, read the archives back: the digest columns per page."""
    folder = tx.scratch(pages.sparkSession, "warc")
    write_warc(pages, folder, min_bytes, **options)
    return read_warc(pages.sparkSession, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file")
