"""WARC archives written as deterministic shards, and read back.

Records are range-sorted by page id: an exact histogram of bytes over equal ranges of
ids gives the shards, and a range heavier than a shard is split by hash. What a shard
holds, and its order, depends on the rows alone. One task writes a shard record by
record, each a gzip member of its own, and rolls to the next file once the compressed
size reaches the bound; headers, record ids and digests are made from the rows.

Files get temporary names with the attempt's number in them. Every finished file is a
row of the task's result; only those rows, written as a manifest, are committed: their
files are renamed, so that a task run twice leaves one copy. The archive is what the
manifest lists.

Records whose payload equals an earlier one's (by page id) of at least `revisit_bytes`
are revisit records: headers with the digest and a reference, no payload.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.plans.sizing import broadcast_if_bounded, materialize

FILE_BYTES = 16 << 20
SHARD_BYTES = 64 << 20
REVISIT_BYTES = 100
RANGES = 4096
_PIECE = 1 << 15
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, temporary string, shard long, records long, bytes long, sha256 string"


def _file_system(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    clean = ((k, " ".join(v.split())) for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean).encode() + b"\r\n"


def _record(row: dict, date: str) -> bytes:
    """One record with its headers. Fields of our own carry what the standard has no name for."""
    payload = (row["html"] or "").encode()
    digest = hashlib.sha256(payload).hexdigest()
    revisit = row["refers_to"] is not None
    body = b"" if revisit else payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{row['page_id']}|{row['url']}|{digest}|{row['copy']}")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}"),
        ("WARC-Profile", _PROFILE if revisit else None),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
        ("X-Page-Id", None if row["page_id"] is None else str(row["page_id"])),
        ("X-Payload-Length", str(len(payload))),
        ("X-Refers-To-Page-Id", None if not revisit else str(row["refers_to"])),
    ]
    return _header(fields) + body + b"\r\n\r\n"


def _shards(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """rows with shard long: ranges of page ids of about shard_bytes, the heavy ones split by hash."""
    span = rows.agg(F.min("page_id").alias("a"), F.max("page_id").alias("b")).first()
    low, high = (span.a or 0), (span.b or 0)
    width = max(1, -(-(high - low + 1) // RANGES))
    cut = F.coalesce(F.floor((F.col("page_id") - low) / width), F.lit(RANGES)).cast("long")
    marked = rows.withColumn("cut", cut)
    heights = {r.cut: r.n for r in marked.groupBy("cut").agg(F.sum(F.octet_length(F.coalesce("html", F.lit(""))) + 600).alias("n")).collect()}
    shard, filled, table = 0, 0, []
    for i in sorted(heights):
        parts = -(-heights[i] // shard_bytes)
        if filled and filled + heights[i] > shard_bytes:
            shard, filled = shard + 1, 0
        table.append((i, shard, parts))
        filled += heights[i]
        if parts > 1:
            shard, filled = shard + parts, 0
    known = rows.sparkSession.createDataFrame(table or [(0, 0, 1)], "cut long, base long, parts long")
    return marked.join(F.broadcast(known), "cut").withColumn(
        "shard", F.col("base") + F.pmod(F.xxhash64("page_id", "url", "digest"), F.col("parts"))
    ).drop("cut", "base", "parts")


def mark_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest and refers_to: the first page of an equal payload, null for responses."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"))
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= revisit_bytes
    groups = rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    several = materialize(groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), "payloads")
    joined = rows.join(broadcast_if_bounded(several), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archive(
    pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES,
    shard_bytes: int = SHARD_BYTES, revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """Write pages (page_id long, url, html) as .warc.gz files under path and return the manifest.

    path must be a folder that the driver and all executors share. The same rows give
    the same bytes under the same names. A null html is an empty payload; a null url or
    id leaves out its header; pages without an id are written last and revisit the
    first page with one, if any. Rows that repeat the first id of their payload are
    responses. An empty table gives no file and an empty manifest.
    """
    spark = pages.sparkSession
    rows = _shards(mark_revisits(pages, revisit_bytes), shard_bytes)
    n_shards = rows.agg(F.max("shard")).first()[0]
    # Cut by shard, not by row: a task may get several shards, a shard is never in two tasks.
    dealt = rows.repartitionByRange(max(1, (n_shards or 0) + 1), "shard").sortWithinPartitions("shard", "page_id", "url", "digest")
    manifest = materialize(
        dealt.select("shard", "page_id", "url", "html", "refers_to").mapInArrow(_writer(path, date, file_bytes), _MANIFEST),
        "manifest",
    )
    files, _ = _file_system(path)
    for row in manifest.select("file", "temporary").toLocalIterator():
        files.move(_file_system(row.temporary)[1], _file_system(f"{path}/{row.file}")[1])
    final = manifest.select("file", "shard", "records", "bytes", "sha256")
    final.orderBy("file").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _writer(path: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _file_system(path)
        files.create_dir(folder, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        done, out, shard, number, last, copy = [], None, None, 0, None, 0

        def finish() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done[-1]["sha256"] = digest.hexdigest()
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    finish()
                    shard, number = row["shard"], 0
                key = (row["shard"], row["page_id"], row["url"], row["html"])
                copy = copy + 1 if key == last else 0
                last = key
                member = gzip.compress(_record(row | {"copy": copy}, date), 6, mtime=0)
                if out is not None and done[-1]["bytes"] + len(member) > file_bytes:
                    finish()
                if out is None:
                    name = f"part-{shard:06d}-{number:05d}.warc.gz"
                    number += 1
                    out = files.open_output_stream(f"{folder}/.{name}.{attempt}", compression=None)
                    digest = hashlib.sha256()
                    done.append({"file": name, "temporary": f"{path}/.{name}.{attempt}", "shard": shard, "records": 0, "bytes": 0})
                out.write(member)
                digest.update(member)
                done[-1]["records"] += 1
                done[-1]["bytes"] += len(member)
        finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([
                ("file", pa.string()), ("temporary", pa.string()), ("shard", pa.int64()), ("records", pa.int64()),
                ("bytes", pa.int64()), ("sha256", pa.string()),
            ]))

    return run


_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()),
])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, file.

    Bytes and digest of a response are worked out from its payload and must agree with
    its headers; those of a revisit are the headers' own. A file that differs from the
    manifest, or a damaged record, fails the job.
    """
    manifest = spark.read.parquet(f"{path}/manifest").select("file", "sha256")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(path)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(broadcast_if_bounded(manifest), "file")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, sha256 in zip(*(batch.column(c) for c in ("file", "content", "sha256"))):
                content = content.as_py()
                if hashlib.sha256(content).hexdigest() != sha256.as_py():
                    raise ValueError(f"{file} is not what the manifest lists")
                rows, held = [], 0
                for record in _members(content):
                    rows.append(_parsed(record) | {"file": file.as_py()})
                    held += len(record)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return named.mapInArrow(
        parse,
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string",
    )


def _members(content: bytes) -> Iterator[bytes]:
    view, at = memoryview(content), 0
    while at < len(view):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if at >= len(view):
                raise ValueError("a record is cut short")
            parts.append(unzip.decompress(view[at : at + _PIECE]))
            at = min(at + _PIECE, len(view))
        at -= len(unzip.unused_data)
        yield b"".join(parts)


def _parsed(record: bytes) -> dict:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(fields["X-Payload-Length"])
    if kind == "response":
        if len(body) != size or hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload": body if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"),
    }
