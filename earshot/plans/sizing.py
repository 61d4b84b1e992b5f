"""Size checks before anything is broadcast, and where durable scratch files go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast table of this many short rows stays near 100 MB in an executor.
MAX_BROADCAST_ROWS = 500_000


def broadcast_if_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a dimension only after counting it; a larger one joins by shuffle.

    The count stops at the bound, and the shuffle join is left to adaptive execution,
    which splits skewed partitions.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    return F.broadcast(df)


def broadcast_counted(df: DataFrame, n_rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if n_rows, its size or a bound on it, allows that."""
    return F.broadcast(df) if n_rows <= max_rows else df


def broadcast_slices(df: DataFrame, n_rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> list[DataFrame]:
    """df as broadcast parts of at most about max_rows rows each.

    For a table joined to text: a part per pass over the text is cheaper than
    shuffling every token of it, and the union of the passes is exact.
    """
    parts = max(1, -(-n_rows // max_rows))
    if parts == 1:
        return [F.broadcast(df)]
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    return [F.broadcast(df.filter(part == i)) for i in range(parts)]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for checkpoints or intermediate tables.

    On a cluster it lies in the shared folder named by spark.checkpoint.dir. Only a
    local session without that setting gets a temporary folder of its own machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="earshot-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """df written out once and read back.

    For results several later branches read: without it each of them would compute the
    whole history again. The files are in the shared folder, so a lost executor costs
    nothing that was written. rows_per_file is for rows of megabytes: a file's rows are held
    together by its writer and by its readers, so no file gets more than that many.
    """
    path = scratch_dir(df.sparkSession, label)
    (df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """df written out in buckets by key, and read back: joins and groupings by key need not move it again.

    df should be partitioned by key in as many parts as there are shuffle partitions; then
    each task writes one bucket, and nothing is moved for that either. The files are in the
    shared folder; the catalog only lends its name for the writing.
    """
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", scratch_dir(spark, label)).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    kept = spark.table(name)
    kept.schema  # The plan now holds the files themselves.
    spark.sql(f"DROP TABLE {name}")
    return kept
