import math
import random
import uuid
from collections import deque

import pytest
from pyspark.sql import functions as F

from earshot.operators import request_log, route


def rate_model(rows, window):
    """rows (key, micros, tie, limit), one by one as a server would take them."""
    passed, out = {}, {}
    for key, at, tie, limit in sorted(rows, key=lambda r: (r[1], r[2])):
        if limit is None:
            out[tie] = (False, None)
            continue
        queue = passed.setdefault(key, deque())
        while queue and at - queue[0] >= window * 10**6:
            queue.popleft()
        if len(queue) >= limit:
            out[tie] = (True, math.ceil(max(1.0, window - (at - queue[0]) / 10**6)))
        else:
            queue.append(at)
            out[tie] = (False, None)
    return out


@pytest.mark.parametrize("seed, gap", [(1, 3), (2, 12), (3, 40), (4, 0.2)])
def test_rate_limit_matches_the_model(spark, seed, gap):
    rng = random.Random(seed)
    rows, clock = [], {}
    for i in range(1500):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        clock[key] = clock.get(key, 0) + int(rng.expovariate(1 / gap) * 10**6)
        if rng.random() < 0.02:
            clock[key] += rng.choice([60, 59, 61, 200]) * 10**6
        rows.append((key, clock[key], i, {"hot": 5, "a": 2, "b": None, None: 3}[key]))
    df = spark.createDataFrame(rows, "k string, us long, id long, lim int").withColumn("occurred_at", F.timestamp_micros("us"))
    got = request_log.rate_limit(df, ["k"], "lim", tie=["id"]).collect()
    assert {r.id: (r.rate_limited, r.retry_after_s) for r in got} == rate_model(rows, 60)


@pytest.mark.parametrize("seed, gap, rounds", [(5, 0.4, 8), (6, 3, 8), (7, 0.05, 8), (8, 0.4, 0), (9, 0.4, 1)])
def test_saturated_servers_in_segments_match_the_model(spark, monkeypatch, seed, gap, rounds):
    """Few rows a segment; with no rounds of repair the rest of a stretch is one run."""
    monkeypatch.setattr(request_log.settled_segments, "__defaults__", (rounds,))
    rng = random.Random(seed)
    rows, clock = [], {}
    for i in range(4000):
        key = rng.choice(["hot"] * 12 + ["a", None])
        clock[key] = clock.get(key, 0) + int(rng.expovariate(1 / gap) * 10**6)
        rows.append((key, clock[key], i + 2**60, {"hot": 5, "a": 2, None: 3}[key]))
    df = spark.createDataFrame(rows, "k string, us long, id long, lim int").withColumn("occurred_at", F.timestamp_micros("us"))
    got = request_log.rate_limit(df, ["k"], "lim", tie=["id"], segment_rows=150).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.rate_limited, r.retry_after_s) for r in got} == rate_model(rows, 60)


def test_a_clock_that_never_forgets_is_still_right(spark):
    """One request a second under one a minute: each segment's answers hang on all before it."""
    rows = [("hot", i * 10**6, i, 1) for i in range(2500)]
    df = spark.createDataFrame(rows, "k string, us long, id long, lim int").withColumn("occurred_at", F.timestamp_micros("us"))
    got = request_log.rate_limit(df, ["k"], "lim", tie=["id"], window_seconds=61, segment_rows=97).collect()
    assert {r.id: (r.rate_limited, r.retry_after_s) for r in got} == rate_model(rows, 61)


def test_one_saturated_server_is_the_work_of_several_tasks(spark):
    """A third of the log is one server's, and all of that one stretch; it settles in a round or two."""
    r = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"s{i}", int(i * 20_000 + r.random() * 20_000), i, 50) for i in range(60_000)]
    df = spark.createDataFrame(rows, "k string, us long, id long, lim int").withColumn("occurred_at", F.timestamp_micros("us"))
    slot = F.floor(F.col("us") / 5_000_000).cast("long")
    found = request_log.crowded_stretches(df, ["k"], "lim", slot, segment_rows=2_000)
    per = found.groupBy("stretch", "segment").agg(F.min("slot").alias("a"), F.max("slot").alias("b")).orderBy("segment").collect()
    assert len(per) == 10 and all(x.b < y.a for x, y in zip(per, per[1:]))
    rows = df.withColumn("slot", slot).join(found, ["k", "slot"]).withColumns({"stretch_id": F.lit("one"), "at_micros": F.col("us")})
    starts, runs = request_log.settled_segments(rows.select("stretch_id", "segment", "at_micros", "lim", "id"), "lim", ["id"], 60 * 10**6)
    assert starts.count() == runs.filter("run = segment").count() == 10


def test_calm_servers_are_never_read_in_order(spark):
    """Ten requests a second all day under a limit of 700 a minute: no stretch at all."""
    df = spark.range(36_000).select(F.lit("hot").alias("k"), (F.col("id") * 100_000).alias("us"), F.lit(700).alias("lim"))
    slot = F.floor(F.col("us") / 5_000_000).cast("long")
    assert request_log.crowded_stretches(df, ["k"], "lim", slot).count() == 0


def replay_model(rows, ttl):
    entries, out = {}, {}
    for key, at, tie, digest, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        held = entries.get(key)
        if held and at - held[0] < ttl * 10**6:
            out[tie] = (held[1] == digest, held[1] != digest)
            continue
        out[tie] = (False, False)
        entries.pop(key, None)
        if ok:
            entries[key] = (at, digest)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replays_match_the_model(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1200):
        key = rng.choice(["hot"] * 8 + [f"k{n}" for n in range(30)])
        at = rng.randrange(0, 40_000) * 100_000 if key == "hot" else rng.choice([0, 60, 119, 120, 121, 240, 400]) * 10**6
        rows.append((key, at, i, rng.choice(["d1"] * 3 + ["d2"]), rng.random() > 0.2))
    df = spark.createDataFrame(rows, "k string, us long, row_id long, digest string, ok boolean").withColumn(
        "occurred_at", F.timestamp_micros("us"))
    got = request_log.mark_replays(df, ["k"], remembered=F.col("ok")).collect()
    want = replay_model(rows, 120)
    assert {r.row_id: (r.is_replay, r.is_conflict) for r in got} == want


def test_first_minutes(spark):
    """Known cases: inside, at and after the end of an entry; a failed request opens none."""
    rows = [(0, 1, "x", True), (119, 2, "x", True), (119, 3, "y", True), (120, 4, "y", True), (239, 5, "x", True), (300, 6, "x", False)]
    df = spark.createDataFrame(rows, "s int, row_id int, digest string, ok boolean").select(
        F.lit("k").alias("k"), F.timestamp_seconds("s").alias("occurred_at"), "row_id", "digest", "ok")
    got = {r.row_id: (r.is_replay, r.is_conflict) for r in request_log.mark_replays(df, ["k"], remembered=F.col("ok")).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, False), 5: (False, True), 6: (False, False)}


def values(spark, column, items):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_uuid_checks(spark):
    u = "0d0f6c1e-6a1d-4a2f-9b71-2f4a5f9c1234"
    forms = [u, u.upper(), f"{{{u}}}", f"urn:uuid:{u}", u.replace("-", ""), u[:-1], "x" * 32, "", None, u + "0", f"{u}\n"]

    def python(form):
        try:
            return uuid.UUID(form)
        except (ValueError, AttributeError, TypeError):
            return None

    assert values(spark, route.is_any_uuid, forms) == [python(f) is not None for f in forms]
    assert values(spark, route.is_canonical_uuid, forms) == [python(f) is not None and str(python(f)) == f for f in forms]


def test_spec_preroll_partial(spark):
    many = ",".join(f"a{chr(97 + i)}" for i in range(26))
    specs = ["auto", "en", "en,de", "pt-BR", "en,en", "", ",", "en,", "EN", many, many[:-3], "auto,en", None]
    assert values(spark, route.is_language_spec, specs) == [
        True, True, True, True, False, False, False, False, False, False, True, False, False]
    rolls = ["0", "960", " 3 ", "+3", "1_2", "-3", "4", "x", "", None, "384000", "384003", "9" * 30]
    assert values(spark, route.is_preroll, rolls) == [True, True, True, True, True, False, False, False, False, False, True, False, False]
    assert values(spark, route.partial_flag, [None, "0", " 1 ", "1", "yes", ""]) == [False, False, True, True, None, None]


def test_pack_choice(spark):
    rows = [("en,xx,de", None, None), ("auto", None, None), ("auto", None, "de"), ("auto", None, "fi"), ("auto", ["en"], None), ("de", ["en"], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, spec string, licensed array<string>, heard string")
    entitled = route.entitled_languages(("de", "en"), F.col("licensed"))
    run = route.languages_to_run(route.requested_languages(F.col("spec")), entitled, F.col("heard"))
    got = [r[0] for r in df.orderBy("i").select(run).collect()]
    assert got == [["en", "de"], ["de", "en"], ["de"], [], ["en"], []]


def test_single_language_model_always_heard_it(spark):
    df = spark.createDataFrame([("fr",), (None,), ("",), ("auto",)], "d string")
    one = [r[0] for r in df.select(route.heard_language(F.col("d"), ("en",))).collect()]
    two = [r[0] for r in df.select(route.heard_language(F.col("d"), ("en", "fr"))).collect()]
    assert one == ["en"] * 4 and two == ["fr", None, None, None]


def test_a_saturated_server_with_a_third_of_the_log(spark):
    """Far more refused than passed: the scan skips from one free place to the next."""
    hot = [("hot", 10**15 + i * 5_000, i, 7) for i in range(60_000)]
    rest = [(f"s{i % 500}", 10**15 + i * 700_000, 100_000 + i, 7) for i in range(2_000)]
    df = spark.createDataFrame(hot + rest, "k string, us long, id long, lim int").withColumn(
        "occurred_at", F.timestamp_micros("us"))
    got = request_log.rate_limit(df, ["k"], "lim", tie=["id"]).collect()
    assert {r.id: (r.rate_limited, r.retry_after_s) for r in got} == rate_model(hot + rest, 60)


def test_limits_may_differ_within_a_server(spark):
    rng = random.Random(8)
    rows = [("s", 10**15 + i * 2 * 10**6, i, rng.choice([2, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, us long, id long, lim int").withColumn(
        "occurred_at", F.timestamp_micros("us"))
    got = request_log.rate_limit(df, ["k"], "lim", tie=["id"]).collect()
    assert {r.id: (r.rate_limited, r.retry_after_s) for r in got} == rate_model(rows, 60)


def test_one_id_copied_all_day(spark):
    rows = [("hot", 10**15 + i * 40_000, i, "d", True) for i in range(30_000)] + [(f"k{i}", 10**15 + i, 50_000 + i, "d", True) for i in range(1_000)]
    df = spark.createDataFrame(rows, "k string, us long, row_id long, digest string, ok boolean").withColumn(
        "occurred_at", F.timestamp_micros("us"))
    got = request_log.mark_replays(df, ["k"]).collect()
    assert {r.row_id: (r.is_replay, r.is_conflict) for r in got} == replay_model(rows, 120)
