"""Pairs of near-equal embeddings, counted per vector, and their connected components.

Equal vectors are one class first, with a count. Random hyperplanes give each class a
code of sign bits in each of several tables; classes that share a code meet in a
bucket. Bits follow the size of the largest label, so that buckets stay small; the
number of tables follows from the bits, the threshold and the recall asked for. Within
buckets every pair is verified by its cosine in double precision. A pair that meets in
several tables counts in the first where it does.

A bucket of any size is cut into blocks, and each pair of blocks is a tile of its own:
no task gets a bucket whole, and no pair is left out. Tiles give counts per class and a
spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.components import connected_components
from earshot.llm.frames import runs_by_key
from earshot.plans.sizing import broadcast_if_bounded, materialize

THRESHOLD = 0.98
RECALL = 0.9999
BLOCK = 256
BUCKET = 64


def _planes(dimensions: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, tables * bits))


def _tables_for(threshold: float, bits: int, recall: float) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _coder(tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        weigh = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = batch.column("embedding")
            codes = []
            for v in vectors:
                v = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if len(v) not in known:
                    known[len(v)] = _planes(len(v), tables, bits, seed)
                codes.append((((v @ known[len(v)]) >= 0).reshape(tables, bits) @ weigh).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codes, pa.list_(pa.int32()))], names=[*batch.schema.names, "codes"]
            )

    return run


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the matrix links."""
    seen, edges = np.zeros(len(linked), bool), []
    for i in range(len(linked)):
        if seen[i] or not linked[i].any():
            continue
        seen[i] = True
        front = np.array([i])
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[new] = True
            edges.extend((i, j) for j in new.tolist())
            front = new
    return edges


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs_by_key(batches):
            out = _verify(tile, threshold)
            if out is not None:
                yield out

    return run


def _verify(tile: pa.Table, threshold: float) -> pa.RecordBatch | None:
    block = tile.column("block").to_numpy()
    if len(block) < 2:
        return None
    ids, n = tile.column("rep").to_numpy(), tile.column("n").to_numpy()
    x, codes = _matrix(tile.column("embedding"), np.float64), _matrix(tile.column("codes"), np.int32)
    norm = np.sqrt((x * x).sum(axis=1))
    linked = (x @ x.T) / np.outer(norm, norm) >= threshold
    np.fill_diagonal(linked, False)
    if tile.column("across")[0].as_py():
        linked &= block[:, None] != block[None, :]  # what shares a block meets in that block's own tile
    if not linked.any():
        return None
    table = int(tile.column("t")[0].as_py())
    a, b = np.nonzero(np.triu(linked))
    new = np.ones(len(a), bool)
    for t in range(table):
        new &= codes[a, t] != codes[b, t]
    links = np.bincount(a[new], weights=n[b[new]], minlength=len(ids)) + np.bincount(b[new], weights=n[a[new]], minlength=len(ids))
    some = np.flatnonzero(links)
    edges = _forest(linked)
    nodes = np.concatenate([ids[some], ids[[e[0] for e in edges]] if edges else ids[:0]])
    others = [None] * len(some) + [int(ids[e[1]]) for e in edges]
    counts = np.concatenate([links[some].astype(np.int64), np.zeros(len(edges), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts), pa.array(others, pa.int64())], names=["node", "links", "other"])


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 17, block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links long, component_id long and kept boolean of every row.

    Rows link when their labels are equal, their vectors of one length and the cosine is
    at least the threshold. A vector that is null, empty, zero or has a null or
    non-finite component, and one with a null label or id, links with nothing: no links,
    a component of its own id, kept. Repeated rows link with each other; rows that share
    an id are one node. Each linked pair is found with a chance of `recall` at least; none
    below the threshold is. component_id is the smallest id reachable; kept are the
    rows whose own id it is.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    sound = F.expr("""vec_id is not null and label is not null and embedding is not null and size(embedding) > 0
        and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))
        and exists(embedding, x -> x <> 0)""")
    twins = ["label", "h1", "h2"]
    marked = rows.filter(F.coalesce(sound, F.lit(False))).withColumns({
        "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), F.reverse("embedding"))
    })
    classes = materialize(
        marked.groupBy(*twins).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")),
        "vectors",
    )
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = min(30, max(4, math.ceil(math.log2(max(1, most / BUCKET)))))
    tables = _tables_for(threshold, bits, recall)
    narrow = classes.select("label", "rep", "n", "embedding")
    coded = materialize(
        narrow.mapInArrow(_coder(tables, bits, seed), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in narrow.schema)}, codes array<int>"),
        "codes",
    )
    bucket = ["label", "dim", "t", "code"]
    spread = coded.select("*", F.size("embedding").alias("dim"), F.posexplode("codes").alias("t", "code"))
    sizes = spread.groupBy(*bucket).agg(F.count("*").alias("m")).filter("m > 1")
    blocks = sizes.select(*bucket, F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    placed = spread.join(broadcast_if_bounded(materialize(blocks, "buckets")), bucket).withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("blocks")).cast("int")
    )
    tiled = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64(*bucket, F.least("block", "with"), F.greatest("block", "with"))
    across = F.col("block") != F.col("with")
    dealt = tiled.select(key.alias("key"), across.alias("across"), "t", "block", "rep", "n", "embedding", "codes").repartition("key").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(_verifier(threshold), "node long, links long, other long"), "links")
    links = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("other is not null"), "node", "other")
    figures = classes.select(*twins, "rep", "n").join(links, "rep", "left").join(
        parts.select(F.col("node").alias("rep"), "component"), "rep", "left"
    ).select(*twins, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    known = marked.select("vec_id", *twins).join(figures, twins).select("vec_id", "links", "component")
    rest = rows.filter(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return known.unionByName(rest).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").cast("long").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"),
    )
