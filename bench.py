"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to a sink that keeps nothing, once to warm up and then twice; the
better time counts. Rates are per second of that time.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogue import feeds, inputs  # noqa: E402
from catalogue.registry import ship_package  # noqa: E402
from earshot.operators import match, request_log, usage, verdict  # noqa: E402
from earshot.plans.sizing import scratch_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.openCostInBytes", "65536")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread_tables(spark: SparkSession) -> str:
    """The tables as the many files a large table has, made before the clock starts.

    Each test table is one file of one row group, which one task would read alone.
    """
    folder = scratch_dir(spark, "bench-tables")
    for name in ("documents", "conversations", "events"):
        table = inputs.table(spark, SF_DIR, name)
        table.repartition(2 * int(CPUS)).write.parquet(f"{folder}/{name}.parquet")
    return folder


def cases(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    packs = inputs.neutral_packs(spark)
    docs = inputs.documents(spark, sf)
    talk = inputs.conversations(spark, sf)
    log = inputs.event_log(spark, sf)
    limited = log.select("event_id", "tenant_key", "server_id", "occurred_at", F.lit(3).alias("lim"))
    every = docs.withColumn("run_packs", F.array(*map(F.lit, inputs.INSTALLED)))
    # One pack of about 500 of a language's words.
    first = docs.withColumn("run_packs", F.array(F.concat("lang", F.lit("-s0000"))))
    found = match.match_texts(docs, packs, ["doc_id"])
    turn = ["conv_id", "turn"]
    return {
        "normalize": docs.select("doc_id", "norm"),
        "match_exact": match.match_texts(docs, packs.with_types("exact"), ["doc_id"]),
        "match_exact_fuzzy": match.match_texts(docs, packs.with_types("exact", "fuzzy"), ["doc_id"]),
        "match_full": found,
        "match_full_all_packs": match.match_texts(every, packs, ["doc_id"]),
        "match_word_packs": match.match_texts(first, inputs.word_packs(spark, sf), ["doc_id"]),
        "verdicts_documents": verdict.verdicts(docs, found, ["doc_id"]),
        "verdicts_conversations": verdict.verdicts(talk, match.match_texts(talk, packs, turn), turn),
        "flagged_events": feeds.feed(spark, sf),
        "usage": usage.usage(log),
        "usage_snapshots": usage.cumulative_snapshots(usage.usage_intervals(log)),
        "rate_limit": request_log.rate_limit(
            limited, ["tenant_key", "server_id"], "lim", tie=["event_id"], window_seconds=86_400
        ),
        "replays": request_log.mark_replays(inputs.replay_log(spark, sf), ["scope", "request_id"]),
    }


def best_of(df: DataFrame, runs: int = 2) -> float:
    times = []
    for _ in range(runs + 1):
        started = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - started)
    return round(min(times[1:]), 3)


def main() -> None:
    spark = session()
    ship_package(spark)
    queries = {name: best_of(df) for name, df in cases(spark, spread_tables(spark)).items()}
    n_docs, n_chars = inputs.table(spark, SF_DIR, "documents").agg(F.count(F.lit(1)), F.sum("n_chars")).first()
    n_events = inputs.table(spark, SF_DIR, "events").count()
    full = queries["match_full"]
    rates = {
        "match_full_docs_per_s": round(n_docs / full),
        "match_full_chars_per_s": round(n_chars / full),
        "match_exact_chars_per_s": round(n_chars / queries["match_exact"]),
        # The published figure is 650 microseconds for one pack on 879 characters.
        "match_full_us_per_pack_and_879_chars": round(full * 1e6 * 879 / n_chars, 2),
        "all_packs_us_per_pack_and_879_chars": round(
            queries["match_full_all_packs"] * 1e6 * 879 / n_chars / len(inputs.INSTALLED), 2
        ),
        "usage_rows_per_s": round(n_events / queries["usage"]),
        "rate_limit_rows_per_s": round(n_events / queries["rate_limit"]),
    }
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "rates": rates, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
