"""Small helpers that the operators here share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def append_columns(
    df: DataFrame, source: str, fields: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """df with further columns that work makes of one column, a batch at a time.

    Columns of these names are replaced.
    """
    kept = without(df, *[f.name for f in fields if f.name.lower() != source.lower()])
    at = [c.lower() for c in kept.columns].index(source.lower())
    schema = T.StructType([*kept.schema.fields, *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(at))], names=names)

    return kept.mapInArrow(run, schema)


def runs_by_key(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.Table]:
    """One table per run of equal keys, from batches sorted by key; a run may span batches."""
    open_run: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if open_run and open_run[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(open_run)
            open_run = []
        for a, b in zip(edges[:-1], edges[1:]):
            open_run.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(open_run)
                open_run = []
    if open_run:
        yield pa.Table.from_batches(open_run)
