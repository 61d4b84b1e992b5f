"""Which tokens of a document occur in other documents, without a row per token.

Tokens are 64-bit hashes. A task packs the tokens of a batch of documents into one
binary row per bucket of hashes, with the documents' ids run-length coded beside them.
Buckets are shuffled, not tokens; the task that gets a bucket sorts its tokens in numpy
and compares neighbours. A frequent token is a long run of one bucket, which is a small
part of what a task holds, since every document spreads its tokens over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from earshot.llm import textbytes as tb
from earshot.llm.frames import runs_by_key

PACKED = "key int, tokens binary, extra binary, ids binary, sizes binary, runs binary"
_NAMES = ["key", "tokens", "extra", "ids", "sizes", "runs"]


def buckets_of(spark: SparkSession) -> int:
    """Buckets to deal tokens into: some for every shuffle partition."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(tokens: np.ndarray, of: np.ndarray, extra: np.ndarray, ids: np.ndarray, sizes: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """One row per bucket. of: each token's document, ascending; extra: an array of one more item per token."""
    if not len(tokens):
        return None
    bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, tokens, of, extra = bucket[order], tokens[order], of[order], extra[order]
    edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    rows: list[list] = [[], [], [], [], [], []]
    for a, b in zip(edges[:-1], edges[1:]):
        part = of[a:b]
        heads = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        docs = part[heads]
        runs = np.diff(np.append(heads, b - a)).astype(np.uint32)
        values = (int(bucket[a]), tokens[a:b], extra[a:b], ids[docs].astype(np.int64), sizes[docs].astype(np.int32), runs)
        for column, v in zip(rows, values):
            column.append(v if isinstance(v, int) else v.tobytes())
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=_NAMES)


@dataclass
class Bucket:
    """All tokens of one bucket, sorted by token and document."""

    tokens: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    extra: np.ndarray
    shared: np.ndarray  # whether the token occurs in another document too
    first: np.ndarray  # the smallest document it occurs in
    count: np.ndarray  # how often it occurs


def _bucket(rows: pa.Table, extra_kind) -> Bucket:
    read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)])
    tokens, runs = read("tokens", np.uint64), read("runs", np.uint32)
    ids, sizes, extra = np.repeat(read("ids", np.int64), runs), np.repeat(read("sizes", np.int32), runs), read("extra", extra_kind)
    order = np.argsort(tokens, kind="stable")
    tokens, ids, sizes, extra = tokens[order], ids[order], sizes[order], extra[order]
    heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    lengths = np.diff(np.append(heads, len(tokens)))
    low, high = np.minimum.reduceat(ids, heads), np.maximum.reduceat(ids, heads)
    return Bucket(tokens, ids, sizes, extra, np.repeat(low != high, lengths), np.repeat(low, lengths), np.repeat(lengths, lengths))


SCATTERED = "key int, ids binary, a binary, b binary"


def scatter(ids: np.ndarray, a: np.ndarray, b: np.ndarray, groups: int) -> pa.RecordBatch:
    """Figures of documents, packed again: one row per group of documents, by hash of the id."""
    group = ((tb.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)
    order = np.lexsort((ids, group))
    group, ids, a, b = group[order], ids[order], a[order], b[order]
    edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
    spans = list(zip(edges[:-1], edges[1:]))
    packed = [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (ids.astype(np.int64), a, b)]
    return pa.RecordBatch.from_arrays([pa.array(group[edges[:-1]]), *packed], names=["key", "ids", "a", "b"])


def gather(scattered: DataFrame, groups: int, kinds: tuple, work, schema: str) -> DataFrame:
    """work(ids, a, b) as rows of schema, for every group of documents, with each document's figures side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_by_key(batches):
            ids, a, b = (
                np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)])
                for name, kind in zip(("ids", "a", "b"), (np.int64, *kinds))
            )
            order = np.argsort(ids, kind="stable")
            yield work(ids[order], a[order], b[order])

    return scattered.repartition(groups, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def shared_tokens(packed: DataFrame, buckets: int, extra_kind, work, schema: str) -> DataFrame:
    """work(bucket) as rows of schema, for every bucket of packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_by_key(batches):
            out = work(_bucket(rows, extra_kind))
            if out is not None:
                yield out

    return packed.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(run, schema)
