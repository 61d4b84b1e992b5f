import random

import pytest
from pyspark.sql import functions as F
from test_request_log import rate_model, replay_model

from earshot import schemas
from earshot.sources import logs
from earshot.streaming import jobs, processors


# Second zero itself would be late: the first watermark stands there.
START = 1_700_000_000


def batches(spark, rows, schema, path, parts):
    """Rows as files that arrive one per micro-batch."""
    for i in range(parts):
        chunk = rows[i * len(rows) // parts:(i + 1) * len(rows) // parts]
        spark.createDataFrame(chunk, schema).withColumn("occurred_at", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(path)
    typed = spark.createDataFrame([], schema).withColumn("occurred_at", F.timestamp_micros("us")).schema
    return logs.stream_utterances(spark, path, schema=typed, maxFilesPerTrigger="1", latestFirst="false")


def run(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    jobs.to_table(stream, out, str(tmp_path / "ck")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_replays(spark, tmp_path, parts):
    rng = random.Random(9)
    rows = sorted(
        ((rng.choice(["hot", "a", "b"]), (START + rng.randrange(0, 900)) * 10**6, i, rng.choice(["d1", "d1", "d2"]), rng.random() > 0.2) for i in range(300)),
        key=lambda r: (r[1], r[2]))
    stream = batches(spark, rows, "k string, us long, row_id long, digest string, remembered boolean", str(tmp_path / "in"), parts)
    got = run(spark, processors.stream_replays(stream, ["k"], watermark="1 hour"), tmp_path).collect()
    assert {r.row_id: (r.is_replay, r.is_conflict) for r in got} == replay_model(rows, 120)


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_rate_limit(spark, tmp_path, parts):
    rng = random.Random(4)
    rows = sorted(((rng.choice(["hot", "hot", "a"]), (START + rng.randrange(0, 600)) * 10**6, i, 4) for i in range(300)), key=lambda r: (r[1], r[2]))
    stream = batches(spark, rows, "k string, us long, id long, lim int", str(tmp_path / "in"), parts)
    got = run(spark, processors.stream_rate_limit(stream, ["k"], "lim", tie="id", watermark="1 hour"), tmp_path).collect()
    assert {r.id: (r.rate_limited, r.retry_after_s) for r in got} == rate_model(rows, 60)


# A row far in the future, of another key, lets all before it out.
FLUSH = (START + 1_000_000) * 10**6


@pytest.mark.parametrize("parts", [1, 5])
def test_shuffled_replays_by_event_time_are_those_of_a_batch(spark, tmp_path, parts):
    rng = random.Random(19)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), (START + rng.randrange(0, 900)) * 10**6 + rng.randrange(3), i, rng.choice(["d1", "d1", "d2"]), rng.random() > 0.2) for i in range(400)]
    want = replay_model(rows, 120)
    rng.shuffle(rows)
    stream = batches(spark, [*rows, ("end", FLUSH, -1, "d", True)], "k string, us long, row_id long, digest string, remembered boolean", str(tmp_path / "in"), parts)
    got = run(spark, processors.stream_replays(stream, ["k"], watermark="1 hour", by_event_time=True), tmp_path).collect()
    assert len(got) == len(rows) and {r.row_id: (r.is_replay, r.is_conflict) for r in got} == want


@pytest.mark.parametrize("parts", [1, 5])
def test_shuffled_rate_limits_by_event_time_are_those_of_a_batch(spark, tmp_path, parts):
    rng = random.Random(14)
    rows = [(rng.choice(["hot", "hot", "a"]), (START + rng.randrange(0, 600)) * 10**6 + rng.randrange(3), i, rng.choice([4, 4, 4, None])) for i in range(500)]
    want = rate_model(rows, 60)
    rng.shuffle(rows)
    stream = batches(spark, [*rows, ("end", FLUSH, -1, 4)], "k string, us long, id long, lim int", str(tmp_path / "in"), parts)
    got = run(spark, processors.stream_rate_limit(stream, ["k"], "lim", tie="id", watermark="1 hour", by_event_time=True), tmp_path).collect()
    assert len(got) == len(rows) and {r.id: (r.rate_limited, r.retry_after_s) for r in got} == want


def test_a_key_that_fills_a_batch_is_taken_in_parts(spark, tmp_path):
    """Rows wait in parts of the Arrow batch size, and leave a slot at a time; nothing is left behind."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [("hot", (START + i % 300) * 10**6, i, 4) for i in range(1200)]
        stream = batches(spark, [*rows, ("end", FLUSH, -1, 4), ("end", FLUSH + 10**12, -2, 4)], "k string, us long, id long, lim int", str(tmp_path / "in"), 2)
        got = run(spark, processors.stream_rate_limit(stream, ["k"], "lim", tie="id", watermark="10 minutes", by_event_time=True), tmp_path).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {r.id: (r.rate_limited, r.retry_after_s) for r in got if r.id >= 0} == rate_model(rows, 60)
    for name in ("waiting", "parts"):
        held = spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck"))
        assert {r.key.k for r in held.select("key").collect()} <= {"end"}
    assert spark.read.format("statestore").option("stateVarName", "window").load(str(tmp_path / "ck")).filter("key.k = 'hot'").count() == 0


def test_retention_equals_the_batch_view_at_every_trigger(spark, tmp_path):
    from earshot.operators import events as ev

    rng = random.Random(8)
    rows = [(rng.choice(["t1", "t1", "t2"]), (START + rng.randrange(0, 500)) * 10**6, f"r{i}") for i in range(240)]
    stream = batches(spark, rows, "tenant_key string, us long, request_id string", str(tmp_path / "in"), 4)
    jobs.retention_view(stream, str(tmp_path / "view"), n=15, checkpoint=str(tmp_path / "ck")).awaitTermination()
    plain = lambda df: sorted((x.tenant_key, x.dropped, [tuple(e)[:2] for e in x.events]) for x in df.collect())
    for trigger in range(4):
        so_far = spark.createDataFrame(rows[: (trigger + 1) * 60], "tenant_key string, us long, request_id string").withColumn("occurred_at", F.timestamp_micros("us"))
        assert plain(jobs.retained(spark, str(tmp_path / "view"), trigger=trigger)) == plain(ev.retained_events(so_far, n=15))
    assert [x[1] for x in plain(jobs.retained(spark, str(tmp_path / "view")))] == [len([r for r in rows if r[0] == t]) - 15 for t in ("t1", "t2")]


def test_state_leaves_with_the_watermark(spark, tmp_path):
    """Once time has moved on, a key that fell silent holds no state."""
    rows = [("old", START * 10**6, 1, "d", True), ("new", (START + 10_000) * 10**6, 2, "d", True), ("newer", (START + 20_000) * 10**6, 3, "d", True)]
    stream = batches(spark, rows, "k string, us long, row_id long, digest string, remembered boolean", str(tmp_path / "in"), 3)
    query = jobs.to_table(processors.stream_replays(stream, ["k"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert query.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    held = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "ck"))
    assert {r.key.k for r in held.select("key").collect()} == {"newer"}


def test_moderation_stream_equals_batch(spark, packs, tmp_path):
    from earshot.functions import text as tx
    from earshot.operators import match, verdict

    texts = [(f"r{i}", t) for i, t in enumerate(["attion of the", "Nicht!", "", "k y s aaa", "eranor thing"] * 4)]
    for i in range(3):
        part = texts[i::3]
        spark.createDataFrame(part, "request_id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))

    def routed(df):
        return df.withColumn("run_packs", F.array(*map(F.lit, packs.languages))).withColumn("verdict_language", F.lit("en"))

    stream = logs.stream_utterances(spark, str(tmp_path / "in"), schema=df.schema, maxFilesPerTrigger="1")
    jobs.moderate_stream(routed(stream), packs, str(tmp_path / "out"), checkpoint=str(tmp_path / "ck")).awaitTermination()
    got = {r.request_id: (r.transcript, r.severity, r.matches) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    normal = routed(df).withColumn("norm", tx.normalize(F.col("text"))).drop("text")
    want = verdict.verdicts(normal, match.match_texts(normal, packs, ["request_id"]), ["request_id"])
    assert got == {r.request_id: (r.transcript, r.severity, r.matches) for r in want.collect()} and len(got) == 20


def test_event_feed_files_each_event_once(spark, tmp_path):
    rows = [("t", "s", f"r{i % 5}", "p", None, "en.a", "spam", 1, 1, "w", "text") for i in range(10)]
    df = spark.createDataFrame(rows, schemas.FLAGGED_EVENTS).withColumn("occurred_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    for part in (df.limit(5), df):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for attempt in ("ck1", "ck2"):  # a second checkpoint is a full redelivery
        stream = logs.stream_utterances(spark, str(tmp_path / "in"), schema=df.schema, maxFilesPerTrigger="1")
        jobs.event_feed(stream, str(tmp_path / "out"), str(tmp_path / attempt)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_usage_stream_equals_batch(spark, tmp_path):
    from earshot.operators import usage

    rng = random.Random(2)
    rows = [((START + rng.randrange(0, 600)) * 10**6, rng.choice(["a", None]), "s", "success", False, rng.randrange(4), 16_000) for _ in range(200)]
    rows.append(((START + 10_000) * 10**6, "a", "s", "success", False, 0, 0))
    schema = "us long, tenant_key string, server_id string, outcome string, partial boolean, severity int, samples_16k long"
    stream = batches(spark, sorted(rows, key=lambda r: r[0]), schema, str(tmp_path / "in"), 3)
    got = run(spark, jobs.usage_stream(stream), tmp_path)
    want = usage.usage_intervals(spark.read.parquet(str(tmp_path / "in"))).filter(f"reported_at < timestamp_seconds({START + 9000})")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_request_path_survives_several_batches(spark):
    """Outcomes of the two-stream path do not depend on how requests fall into micro-batches."""
    import __spark_entry__ as entry

    got = {r.row_id: (r.outcome, r.is_replay) for r in entry.queries()["t6_stream_requests"](spark, "/root/testdata/sf0.001").collect()}
    want = {r.row_id: (r.outcome, r.is_replay) for r in entry.queries()["request_outcomes"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and {o for o, _ in want.values()} >= {"rate_limited", "request_id_reused", "success"}


def test_documents_in_parts_are_streamed(spark, tmp_path):
    from catalogue import streams

    texts = [(i, "nicht so" if i % 2 else "gut", "de") for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = streams.stream_moderation(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.severity) for r in got) == [(i, 3 if i % 2 else 0) for i in range(40)]


@pytest.mark.parametrize("by_event_time", [False, True])
def test_ids_of_a_scope_share_the_state_of_a_bucket(spark, tmp_path, by_event_time):
    """Answers are those of a batch, and the state store holds a row for each bucket, not for each id."""
    rng = random.Random(27)
    rows = [
        (rng.choice(["s1", "s2"]), f"id{rng.randrange(600)}", (START + rng.randrange(0, 900)) * 10**6, i, rng.choice(["d1", "d1", "d2", None]), rng.random() > 0.2, rng.choice([None, 2**53 + 2 * i + 1]))
        for i in range(3000)
    ]
    want = replay_model([((s, d), us, i, digest, remembered) for s, d, us, i, digest, remembered, _ in rows], 120)
    rows.sort(key=lambda r: (r[2], r[3]))
    if by_event_time:
        rng.shuffle(rows)
        rows += [("end", "end", FLUSH, -1, "d", True, None)]
    stream = batches(spark, rows, "scope string, id string, us long, row_id long, digest string, remembered boolean, n long", str(tmp_path / "in"), 3)
    got = run(spark, processors.stream_replays(stream, ["scope", "id"], watermark="1 hour", by_event_time=by_event_time), tmp_path).collect()
    assert len(got) == 3000 and {r.row_id: (r.is_replay, r.is_conflict) for r in got} == want
    assert {r.row_id: r.n for r in got} == {r[3]: r[6] for r in rows if r[3] >= 0}
    held = spark.read.format("statestore").option("stateVarName", "parts" if by_event_time else "entry").load(str(tmp_path / "ck"))
    assert held.filter("key.scope <> 'end'").count() <= (0 if by_event_time else 2 * 64)
    if by_event_time:
        first = spark.read.format("statestore").option("stateVarName", "parts").option("batchId", 0).load(str(tmp_path / "ck"))
        assert 0 < first.count() <= 2 * 64


def test_openings_are_those_of_each_id_alone():
    import numpy as np

    from earshot.operators.request_log import opening_step

    rng = np.random.default_rng(5)
    ids = np.sort(rng.integers(0, 40, 4000))
    ids[3000:] = 40
    times = np.concatenate([np.sort(rng.integers(0, 2000, n)) for n in np.bincount(ids)])
    candidates, last = rng.random(4000) > 0.3, np.where(np.arange(41) % 3, 50, processors._NEVER)
    want, left = np.zeros(4000, dtype=bool), last.copy()
    for i in range(41):
        mine = np.flatnonzero((ids == i) & candidates)
        left[i], (want[mine],) = opening_step(20)(int(last[i]), times[mine])
    assert (processors.openings(ids, times, candidates, last, 20) == want).all() and (last == left).all()


def test_the_feed_is_worked_out_once(spark, monkeypatch):
    """What a task writes as a file of the stream is read from a table, not worked out by that one task."""
    from catalogue import streams

    seen = {}
    real = streams._as_stream
    monkeypatch.setattr(streams, "_as_stream", lambda spark, df, label: seen.setdefault(label, df) is None or real(spark, df, label))
    got = streams.stream_events(spark, "/root/testdata/sf0.001")
    assert "Join" not in seen["event-log"]._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() > 0 and got.filter("n <> 1").isEmpty()
