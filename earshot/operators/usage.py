"""Metering: what each server asked for, what came of it, how much audio it took.

requests counts requests, flagged and severities count finished utterances, and
audio_seconds counts decoded audio. They do not divide into each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot import domains

SERVER = ("tenant_key", "server_id")


def metered(requests: DataFrame, count_replays: bool = True) -> DataFrame:
    """Requests that reach the counters.

    Refusals for malformed metadata never do. A replay counts again as a request and,
    if finished, as a severity; count_replays=False leaves it out altogether.
    """
    kept = requests.filter(~F.col("outcome").isin(*domains.UNMETERED_OUTCOMES))
    return kept if count_replays else kept.filter(~_flag("is_replay", kept))


def _flag(name: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _finished(df: DataFrame) -> Column:
    return (F.col("outcome") == "success") & ~F.coalesce("partial", F.lit(False))


def _samples(df: DataFrame) -> Column:
    decoded = (F.col("outcome") == "success") & ~_flag("is_replay", df)
    return F.coalesce(F.sum(F.when(decoded, F.col("samples_16k"))), F.lit(0))


def _flagged(df: DataFrame) -> Column:
    return F.count_if(_finished(df) & (F.col("severity") > 0))


def server_totals(requests: DataFrame, keys: Sequence[str] = SERVER) -> DataFrame:
    """requests, flagged and audio_seconds per server; no tenant is a tenant of its own."""
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        _flagged(requests).alias("flagged"),
        F.floor(_samples(requests) / domains.SAMPLES_PER_SECOND).alias("audio_seconds"),
    )


def outcome_histogram(requests: DataFrame, keys: Sequence[str] = SERVER) -> DataFrame:
    return requests.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("n"))


def severity_histogram(requests: DataFrame, keys: Sequence[str] = SERVER) -> DataFrame:
    """Verdict severities, 0 included, of finished utterances only."""
    finished = requests.filter(_finished(requests) & F.col("severity").isNotNull())
    return finished.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("n"))


def _as_map(counts: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(counts)))


def usage(requests: DataFrame, keys: Sequence[str] = SERVER) -> DataFrame:
    """The whole snapshot, maps and all, in one shuffle of the log.

    Counted first by everything the maps are keyed on, so that only a few rows per
    server are left to gather.
    """
    finished = _finished(requests)
    fine = requests.groupBy(
        *keys, "outcome", F.when(finished, F.col("severity")).alias("level")
    ).agg(F.count(F.lit(1)).alias("n"), _samples(requests).alias("samples"))
    cube = fine.groupBy(*keys, "outcome").agg(
        F.sum("n").alias("n"),
        F.sum("samples").alias("samples"),
        F.sum(F.when(F.col("level") > 0, F.col("n")).otherwise(0)).alias("flagged"),
        F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "n"))).alias("levels"),
    )
    return cube.groupBy(*keys).agg(
        F.sum("n").alias("requests"),
        F.sum("flagged").alias("flagged"),
        _as_map(F.struct("outcome", "n")).alias("outcomes"),
        # Only one outcome, success, has severities, so no level comes twice.
        F.map_from_entries(F.array_sort(F.flatten(F.collect_list("levels")))).alias("severities"),
        F.floor(F.sum("samples") / domains.SAMPLES_PER_SECOND).alias("audio_seconds"),
    )


# --- feeds over time ---------------------------------------------------------------


def usage_intervals(
    requests: DataFrame, keys: Sequence[str] = SERVER, interval: str = domains.USAGE_INTERVAL,
    occurred_at: str = "occurred_at",
) -> DataFrame:
    """Counts per interval; batch, or streaming after a watermark."""
    return requests.groupBy(F.window(occurred_at, interval), *keys).agg(
        F.count(F.lit(1)).alias("requests"),
        _flagged(requests).alias("flagged"),
        _samples(requests).alias("samples"),
    ).select(F.col("window.end").alias("reported_at"), *keys, "requests", "flagged", "samples")


def histogram_intervals(
    requests: DataFrame, column: str, keys: Sequence[str] = SERVER,
    interval: str = domains.USAGE_INTERVAL, occurred_at: str = "occurred_at",
) -> DataFrame:
    """Outcomes or severities per interval and server, as rows (column, n).

    A severity counts only where it is of a finished utterance.
    """
    if column == "severity":
        requests = requests.filter(_finished(requests) & F.col("severity").isNotNull())
    counted = requests.groupBy(F.window(occurred_at, interval), *keys, column).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(F.col("window.end").alias("reported_at"), *keys, column, "n")


def cumulative_snapshots(intervals: DataFrame, keys: Sequence[str] = SERVER) -> DataFrame:
    """Running totals at every interval in which something happened.

    The window runs over intervals, not requests, so a busy server is no larger in it
    than a quiet one.
    """
    so_far = Window.partitionBy(*keys).orderBy("reported_at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return intervals.select(
        "reported_at", *keys,
        F.sum("requests").over(so_far).alias("requests"),
        F.sum("flagged").over(so_far).alias("flagged"),
        F.floor(F.sum("samples").over(so_far) / domains.SAMPLES_PER_SECOND).alias("audio_seconds"),
    )


def cumulative_maps(
    histogram: DataFrame, column: str, intervals: DataFrame, values: Sequence, keys: Sequence[str] = SERVER
) -> DataFrame:
    """reported_at, keys and a map of value to its running count, at every report of a server.

    histogram is histogram_intervals(column); values are those the column may have, a
    short list. Every report gets a row of nothing for each of them, so that counts carry
    on where nothing new happened; a value not seen yet is not in the map.
    """
    nothing = intervals.select("reported_at", *keys, F.explode(F.array(*map(F.lit, values))).alias(column), F.lit(0).cast("long").alias("n"))
    counted = histogram.select("reported_at", *keys, column, "n").unionByName(nothing)
    per = counted.groupBy("reported_at", *keys, column).agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy(*keys, column).orderBy("reported_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = per.select("reported_at", *keys, column, F.sum("n").over(so_far).alias("n"))
    entries = F.collect_list(F.when(F.col("n") > 0, F.struct(column, "n")))
    return running.groupBy("reported_at", *keys).agg(F.map_from_entries(F.array_sort(entries)).alias("counts"))


def snapshot_deltas(
    snapshots: DataFrame, counters: Sequence[str] = ("requests", "flagged", "audio_seconds"),
    keys: Sequence[str] = SERVER,
) -> DataFrame:
    """What was added between reports. A counter that fell was restarted: all of it is new."""
    order = Window.partitionBy(*keys).orderBy("reported_at")

    def delta(counter: str) -> Column:
        before = F.lag(counter).over(order)
        now = F.col(counter)
        return F.when(before.isNull() | (now < before), now).otherwise(now - before).alias(counter)

    return snapshots.select("reported_at", *keys, *map(delta, counters))


def usage_entry_json(snapshot: DataFrame) -> DataFrame:
    """(server_id, tenant_key, entry): the JSON each server's report holds.

    Identifiers and counts only. A missing tenant is left out, keys are sorted, and
    severity levels are strings as JSON wants them.
    """
    entry = F.struct(
        "server_id", "tenant_key", "requests", "outcomes",
        F.transform_keys("severities", lambda level, _: level.cast("string")).alias("severities"),
        "audio_seconds",
    )
    return snapshot.select("server_id", "tenant_key", F.to_json(entry).alias("entry"))


# --- traces ------------------------------------------------------------------------


def latency_summary(traces: DataFrame, exact: bool = False) -> DataFrame:
    """Count, mean, p50 and p95 of total_ms per outcome.

    The exact percentile keeps every distinct value, which milliseconds bound; the
    sketch is for logs where even that is too much.
    """
    return _latencies(traces, "total_ms", ["outcome"], exact)


STAGES = ("decode_ms", "stt_ms", "rules_ms", "classifier_ms", "serialize_ms", "total_ms")


def stage_latencies(traces: DataFrame, exact: bool = False) -> DataFrame:
    """The same per outcome and stage of the work; stages a request did not reach do not count."""
    each = F.array(*[F.struct(F.lit(s.removesuffix("_ms")).alias("stage"), F.col(s).alias("ms")) for s in STAGES])
    timed = traces.select("outcome", F.inline(each)).filter("ms IS NOT NULL")
    return _latencies(timed, "ms", ["outcome", "stage"], exact)


def _latencies(times: DataFrame, column: str, keys: Sequence[str], exact: bool) -> DataFrame:
    at = F.percentile if exact else F.percentile_approx
    return times.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(column).alias("mean_ms"),
        at(column, F.lit(0.5)).alias("p50_ms"),
        at(column, F.lit(0.95)).alias("p95_ms"),
    )
