import json
import random

from conftest import rule
from pyspark.sql import functions as F

from earshot import schemas
from earshot.operators import events as ev
from earshot.operators import usage
from earshot.sources import logs


def requests(spark, rows):
    return spark.createDataFrame(
        rows, "tenant_key string, server_id string, outcome string, partial boolean, severity int, samples_16k long, is_replay boolean")


def test_one_server_name_two_tenants_and_none(spark):
    rows = [("a", "s", "success", False, 0, 0, False), ("b", "s", "success", False, 2, 0, False), (None, "s", "success", False, 0, 0, False)]
    got = usage.usage(requests(spark, rows)).collect()
    assert {(r.tenant_key, r.server_id): r.flagged for r in got} == {("a", "s"): 0, ("b", "s"): 1, (None, "s"): 0}


def test_counters_count_different_things(spark):
    rows = [
        ("a", "s", "success", True, 3, 15_999, False),   # an early window: audio, no incident
        ("a", "s", "success", False, 3, 1, False),
        ("a", "s", "success", False, 3, 50_000, True),   # a replay: request and severity again, no audio
        ("a", "s", "rate_limited", None, None, None, False),
        ("a", "s", "invalid_language", None, None, None, False),
    ]
    df = requests(spark, rows)
    got = usage.usage(usage.metered(df)).first()
    assert (got.requests, got.flagged, got.audio_seconds) == (4, 2, 1)
    assert got.outcomes == {"rate_limited": 1, "success": 3} and got.severities == {3: 2}
    once = usage.usage(usage.metered(df, count_replays=False)).first()
    assert (once.requests, once.flagged, once.severities) == (3, 1, {3: 1})
    totals = usage.server_totals(usage.metered(df)).first()
    assert (totals.requests, totals.flagged, totals.audio_seconds) == (4, 2, 1)


def test_payload_shape(spark):
    rows = [("a", "s", "success", False, 2, 32_000, False), (None, "t", "unauthorized", None, None, None, False)]
    got = {r.server_id: json.loads(r.entry) for r in usage.usage_entry_json(usage.usage(requests(spark, rows))).collect()}
    assert got["s"] == {"server_id": "s", "tenant_key": "a", "requests": 1, "outcomes": {"success": 1}, "severities": {"2": 1}, "audio_seconds": 2}
    assert got["t"] == {"server_id": "t", "requests": 1, "outcomes": {"unauthorized": 1}, "severities": {}, "audio_seconds": 0}


def test_deltas_survive_a_restart(spark):
    df = spark.createDataFrame([(i, "a", "s", v) for i, v in enumerate([5, 9, 2, 2])], "reported_at int, tenant_key string, server_id string, requests long")
    got = [r.requests for r in usage.snapshot_deltas(df, ["requests"]).orderBy("reported_at").collect()]
    assert got == [5, 4, 2, 0]


def verdict_rows(spark, rows):
    schema = "tenant_key string, server_id string, request_id string, player_id string, occurred_at timestamp, partial boolean, transcript string, matches array<struct<rule_id string, category string, severity int, matched_text string, context_required boolean>>"
    at = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678' AS t").first().t
    return spark.createDataFrame([(t, "s", r, "p", at, p, text, m) for t, r, p, text, m in rows], schema)


def match_of(rule_id, severity, review=False, text="w"):
    return (rule_id, "spam", severity, text, review)


def test_events(spark):
    rows = [
        ("t", "r1", False, "x" * 1200, [match_of("a", 1), match_of("b", 3, True, "y" * 300), match_of("c", 3)]),
        ("t", "r2", False, "clean", []), ("t", "r3", True, "window", [match_of("a", 1)]), (None, "r4", False, "selfhost", [match_of("a", 1)]),
    ]
    got = ev.flagged_events(verdict_rows(spark, rows)).collect()
    assert [r.request_id for r in got] == ["r1"]
    event = got[0].asDict()
    assert set(event) == {f.name for f in schemas.FLAGGED_EVENTS.fields}
    assert (event["rule_id"], event["severity"], event["rule_count"]) == ("b", 3, 3)
    assert len(event["transcript"]) == 1000 and len(event["matched_text"]) == 200
    body = json.loads(ev.event_json(ev.flagged_events(verdict_rows(spark, rows))).first().event)
    assert body["occurred_at"] == "2024-01-02T03:04:05.678Z" and body["player_uuid"] == "p"


def test_top_match_breaks_ties_by_report_order(spark):
    df = spark.createDataFrame([(1, 0, 1, 5, "late", 2), (1, 0, 1, 2, "first", 2), (1, 1, 1, 0, "other pack", 2), (1, 0, 2, 0, "second pass", 2)],
                               "id int, pack_ord int, pass int, rule_ord int, rule_id string, severity int")
    df = df.withColumn("category", F.lit("spam")).withColumn("matched_text", F.lit("w")).withColumn("context_required", F.lit(False))
    assert tuple(ev.top_match(df, ["id"]).select("rule_id", "rule_count").first()) == ("first", 4)


def test_batches_number_a_hot_tenant_across_slots(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else "t", f"r{i:05d}", rng.randrange(0, 200_000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "tenant_key string, request_id string, s long").withColumn("occurred_at", F.timestamp_seconds("s"))
    got = {r.request_id: r.event_batch for r in ev.batch_events(df, 200).collect()}
    for tenant in ("hot", "t"):
        ordered = sorted((s, r) for t, r, s in rows if t == tenant)
        assert [got[r] for _, r in ordered] == [i // 200 for i in range(len(ordered))]


def test_newest(spark):
    df = spark.range(50).select(F.lit("t").alias("tenant_key"), F.format_string("r%03d", "id").alias("request_id"), F.timestamp_seconds("id").alias("occurred_at"))
    assert {r.request_id for r in ev.newest_events(df, 3).collect()} == {"r047", "r048", "r049"}


def test_event_table_is_idempotent(spark, tmp_path):
    rows = [("t", f"r{i}", False, "text", [match_of("a", 1)]) for i in range(5)]
    events, path = ev.flagged_events(verdict_rows(spark, rows)), str(tmp_path / "events")
    logs.append_events(events.limit(2), path)
    logs.append_events(events.unionByName(events), path)
    logs.append_events(events, path, horizon_days=2)
    assert spark.read.parquet(path).count() == 5


def test_an_event_is_filed_once_whatever_its_day(spark, tmp_path):
    rows = [("t", f"r{i}", False, "text", [match_of("a", 1)]) for i in range(6)]
    events, path = ev.flagged_events(verdict_rows(spark, rows)), str(tmp_path / "events")
    late = events.withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 40 days"))
    logs.append_events(events.filter("request_id < 'r3'"), path)
    logs.append_events(late.filter("request_id < 'r4'"), path)
    table = spark.read.parquet(path)
    assert sorted(r.request_id for r in table.collect()) == ["r0", "r1", "r2", "r3"]
    assert table.select("event_date").distinct().count() == 2
    # Only the days that may hold one of the batch are read.
    with_date = lambda df: df.withColumn("event_date", F.to_date("occurred_at"))
    first, second = sorted(r.event_date for r in table.select("event_date").distinct().collect())
    assert logs.days_that_may_hold(with_date(events.filter("request_id = 'r1'")), path) == [first]
    assert logs.days_that_may_hold(with_date(late.filter("request_id = 'r3'")), path) == [second]
    assert logs.days_that_may_hold(with_date(late.filter("request_id = 'r5'")), path) == []
    # An explicit horizon searches the batch's own days, and files r0 again.
    logs.append_events(late.filter("request_id = 'r0'"), path, horizon_days=0)
    assert spark.read.parquet(path).count() == 5


def test_an_append_writes_a_day_from_one_task_not_from_all(spark, tmp_path):
    rows = [("t", f"r{i:03d}", False, "text", [match_of("a", 1)]) for i in range(200)]
    spread = F.expr("make_interval(0, 0, 0, cast(substr(request_id, 2) as int) % 10)")
    events, path = ev.flagged_events(verdict_rows(spark, rows)), tmp_path / "events"
    events = events.withColumn("occurred_at", F.col("occurred_at") + spread)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # As many tasks as partitions, like a large batch.
    try:
        logs.append_events(events, str(path))
    finally:
        spark.conf.set(key, before)
    table = spark.read.parquet(str(path))
    assert table.count() == 200 and table.select("event_date").distinct().count() == 10
    assert len(list(path.glob("event_date=*/*.parquet"))) == 10
    assert len(list(path.glob(f"{logs.KEYS}/event_date=*/*.parquet"))) == 10


def test_keys_written_without_their_events_do_no_harm(spark, tmp_path):
    rows = [("t", f"r{i}", False, "text", [match_of("a", 1)]) for i in range(3)]
    events, path = ev.flagged_events(verdict_rows(spark, rows)), str(tmp_path / "events")
    logs.append_events(events.filter("request_id = 'r0'"), path)
    dated = events.withColumn("event_date", F.to_date("occurred_at"))
    logs._keys_of(dated).write.mode("append").partitionBy("event_date").parquet(f"{path}/{logs.KEYS}")
    logs.append_events(events, path)
    assert spark.read.parquet(path).count() == 3
    assert "key_hash" not in spark.read.parquet(path).columns


def test_tables_without_sketches_are_searched_whole(spark, tmp_path):
    rows = [("t", f"r{i}", False, "text", [match_of("a", 1)]) for i in range(3)]
    events, path = ev.flagged_events(verdict_rows(spark, rows)), str(tmp_path / "events")
    events.withColumn("event_date", F.to_date("occurred_at")).write.partitionBy("event_date").parquet(path)
    logs.append_events(events.withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 9 days")), path)
    assert spark.read.parquet(path).count() == 3


def test_traces(spark):
    lines = spark.createDataFrame([
        ("12:00 INFO request_trace request_id=r1 outcome=success total_ms=214 decode_ms=3 stt_ms=198 rules_ms=1 classifier_ms=0 serialize_ms=1",),
        ("12:00 INFO request_trace request_id=r2 outcome=internal_error total_ms=9 decode_ms=None stt_ms=None rules_ms=None classifier_ms=None serialize_ms=None",),
        ("12:00 INFO request_stage request_id=r1 stage=stt state=started duration_ms=None",),
    ], "value string")
    got = {r.request_id: r for r in logs.parse_traces(lines).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].stt_ms == 198 and got["r2"].stt_ms is None and got["r2"].total_ms == 9
    summary = {r.outcome: r for r in usage.latency_summary(logs.parse_traces(lines)).collect()}
    assert summary["success"].n == 1 and summary["success"].p95_ms == 214


def test_utterances_are_written_compressed_and_read_back_whole(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    # No text twice: what is saved is not for copies.
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(300)) for _ in range(40)]
    rows = [(f"r{i}", None, "s", "p", None, "en", None, text, i % 2 == 0, i) for i, text in enumerate([*texts, "", None])]
    monkeypatch.setattr(logs, "RECORDS_PER_FILE", 5)
    logs.write_utterances(spark.createDataFrame(rows, schemas.UTTERANCES).coalesce(1), str(tmp_path / "in"))
    files = list((tmp_path / "in").glob("part-*"))
    assert len(files) == 9
    assert sum(f.stat().st_size for f in files) < 0.7 * sum(map(len, texts))
    read = logs.read_utterances(spark, str(tmp_path / "in"), "json")
    assert sorted(map(tuple, read.collect())) == sorted(rows)


def test_sources_and_sinks_round_trip(spark, packs, tmp_path):
    from earshot.operators import match, verdict

    row = ("r1", None, "s", "p", None, "en", None, "the attion", False, 5)
    spark.createDataFrame([row], schemas.UTTERANCES).write.json(str(tmp_path / "in"))
    read = logs.read_utterances(spark, str(tmp_path / "in"), "json")
    assert read.schema == schemas.UTTERANCES and tuple(read.first()) == row
    ready = read.select("request_id", F.col("text").alias("norm"), F.array("language_spec").alias("run_packs"), F.col("language_spec").alias("verdict_language"))
    out = verdict.verdicts(ready, match.match_texts(ready, packs, ["request_id"]), ["request_id"])
    body = json.loads(logs.verdict_json(out).first().verdict)
    assert body == {"request_id": "r1", "transcript": "the attion", "language": "en", "severity": 1, "confidence": 1.0, "matches": [
        {"rule_id": "en.spam.attion", "category": "spam", "severity": 1, "matched_text": "attion", "context_required": False}]}
    logs.write_verdicts(out, str(tmp_path / "out"), flat=True)
    assert spark.read.parquet(str(tmp_path / "out")).first().match_rule_id == "en.spam.attion"
    assert rule
