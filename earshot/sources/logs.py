"""Reading utterances and trace lines; writing verdicts, events and usage."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earshot import schemas
from earshot.functions.text import utc_date
from earshot.operators import events as ev
from earshot.operators import usage as metering
from earshot.plans.sizing import broadcast_if_bounded, materialize

FILES_PER_TRIGGER = 64
# A compressed file is read by one task, so none may hold too much.
RECORDS_PER_FILE = 50_000


def read_utterances(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType = schemas.UTTERANCES,
    **options: str,
) -> DataFrame:
    """Transcripts at rest. The schema is given, never inferred from the data."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def write_utterances(utterances: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """schemas.UTTERANCES as JSON lines, compressed: the same text may be said many times over."""
    options = {
        "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": str(RECORDS_PER_FILE), **options,
    }
    utterances.select(*[f.name for f in schemas.UTTERANCES.fields]).write.mode(mode).options(**options).json(path)


def stream_utterances(
    spark: SparkSession, path: str | None = None, fmt: str = "parquet",
    schema: StructType | None = schemas.UTTERANCES, **options: str,
) -> DataFrame:
    """Transcripts as they arrive: files of a folder, or any other streaming source."""
    if path:
        # Bounds what a micro-batch, and one key's part of it, may hold.
        options = {"maxFilesPerTrigger": str(FILES_PER_TRIGGER), **options}
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def parse_traces(lines: DataFrame, column: str = "value") -> DataFrame:
    """schemas.TRACES from log lines; lines of any other kind are left out."""
    marker = "request_trace "
    fields = F.expr(f"str_to_map(substring_index({column}, '{marker}', -1), ' ', '=')")

    def value(name: str, kind):
        return F.nullif(F.col("kv")[name], F.lit("None")).cast(kind).alias(name)

    return (
        lines.filter(F.col(column).contains(marker))
        .select(fields.alias("kv"))
        .select(*[value(f.name, f.dataType) for f in schemas.TRACES.fields])
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return parse_traces(spark.read.text(path))


def verdict_json(verdicts: DataFrame) -> DataFrame:
    """(request_id, verdict) with the response body a client of the service reads."""
    body = F.struct(
        "request_id", "transcript", "language", "matches", "severity", "confidence"
    )
    return verdicts.select("request_id", F.to_json(body).alias("verdict"))


def write_verdicts(verdicts: DataFrame, path: str, flat: bool = False, mode: str = "append") -> None:
    """Nested, one row per utterance; or flat, one row per match."""
    out = verdicts
    if flat:
        out = verdicts.withColumn("m", F.explode_outer("matches")).select(
            *[c for c in verdicts.columns if c != "matches"],
            *[F.col(f"m.{f.name}").alias(f"match_{f.name}") for f in schemas.MATCH.fields],
        )
    out.write.mode(mode).parquet(path)


#: Beside the days of an event table, in a folder its readers pass over: a hash of every event's key.
KEYS = "_keys"


def append_events(events: DataFrame, path: str, horizon_days: int | None = None) -> None:
    """Append the events whose (tenant, request) the table does not hold yet, on whatever day.

    The table lies by day, with a sketch of each day's keys beside it: eight bytes an
    event. A batch is held against the sketches, and only days whose sketch has one of
    its keys are read, which are its own when it is delivered again and hardly any
    otherwise. Keys are written before their events, so an append that died half way
    makes the next one look into a day in vain, and no more. horizon_days searches so
    many days around the batch's own only.
    """
    spark = events.sparkSession
    batch = materialize(events.dropDuplicates(list(ev.EVENT_KEY)).withColumn("event_date", utc_date(F.col("occurred_at"))), "batch")
    fresh = batch
    if _exists(spark, path):
        held = spark.read.schema(
            StructType([*schemas.FLAGGED_EVENTS.fields]).add("event_date", "date")
        ).parquet(path)
        if horizon_days is not None:
            bounds = batch.agg(
                F.date_sub(F.min("event_date"), horizon_days), F.date_add(F.max("event_date"), horizon_days),
            ).first()
            held = held.filter(F.col("event_date").between(*map(F.lit, bounds)))
        elif (days := days_that_may_hold(batch, path)) is not None:
            held = held.filter(F.col("event_date").isin(days))
        fresh = materialize(batch.join(held.select(*ev.EVENT_KEY), list(ev.EVENT_KEY), "left_anti"), "fresh")
    _by_day(_keys_of(fresh)).write.mode("append").partitionBy("event_date").parquet(f"{path}/{KEYS}")
    _by_day(fresh).write.mode("append").partitionBy("event_date").parquet(path)


def _by_day(rows: DataFrame) -> DataFrame:
    """rows laid out for a table of days: else every task opens a file, and its buffers, for every day it has.

    Adaptive execution splits a day that is too large for one task.
    """
    return rows.hint("rebalance", F.col("event_date"))


def _keys_of(events: DataFrame) -> DataFrame:
    return events.select("event_date", F.xxhash64(*ev.EVENT_KEY).alias("key_hash"))


def days_that_may_hold(batch: DataFrame, path: str) -> list[date] | None:
    """The days of an event table on which some event of batch may be; None if the table has no sketches."""
    spark = batch.sparkSession
    if not _exists(spark, f"{path}/{KEYS}"):
        return None
    sketches = spark.read.schema("key_hash long, event_date date").parquet(f"{path}/{KEYS}")
    asked = broadcast_if_bounded(_keys_of(batch).select("key_hash"))
    # A row per day at most.
    return [r["event_date"] for r in sketches.join(asked, "key_hash", "left_semi").select("event_date").distinct().collect()]


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def write_usage(snapshot: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON line per server."""
    metering.usage_entry_json(snapshot).select("entry").write.mode(mode).text(path)
