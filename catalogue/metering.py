"""A and W: usage, its feeds, traces and rule statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs
from catalogue.inputs import CATEGORY_OF, FUZZY_OF, REVIEW_OF, SEVERITY_OF, WORDS_SQL
from catalogue.matching import DOC_MATCHES, doc_matches
from catalogue.registry import query
from earshot.operators import events as ev
from earshot.operators import packqa, usage

LOG = f"log AS ({inputs.event_log_sql()})"
FLAGGED = "count(*) FILTER (outcome = 'success' AND NOT partial AND severity > 0)"
SAMPLES = "coalesce(sum(samples_16k) FILTER (outcome = 'success'), 0)"


@query("a1_usage_totals", f"""WITH {LOG}
SELECT tenant_key, server_id, count(*) AS requests, {FLAGGED} AS flagged, floor({SAMPLES} / 16000)::BIGINT AS audio_seconds
FROM log GROUP BY tenant_key, server_id""")
def totals(spark, sf):
    return usage.server_totals(inputs.event_log(spark, sf))


@query("a2_outcomes", f"WITH {LOG} SELECT tenant_key, server_id, outcome, count(*) AS n FROM log GROUP BY ALL")
def outcomes(spark, sf):
    return usage.outcome_histogram(inputs.event_log(spark, sf))


@query("a3_severities", f"""WITH {LOG} SELECT tenant_key, server_id, severity, count(*) AS n FROM log
WHERE outcome = 'success' AND NOT partial AND severity IS NOT NULL GROUP BY ALL""")
def severities(spark, sf):
    return usage.severity_histogram(inputs.event_log(spark, sf))


@query("a4_audio_seconds", f"""WITH {LOG} SELECT server_id, floor({SAMPLES} / 16000)::BIGINT AS audio_seconds FROM log GROUP BY server_id""")
def audio_seconds(spark, sf):
    return usage.server_totals(inputs.event_log(spark, sf), ["server_id"]).select("server_id", "audio_seconds")


@query("a5_flagged", f"WITH {LOG} SELECT tenant_key, {FLAGGED} AS flagged FROM log GROUP BY tenant_key")
def flagged(spark, sf):
    return usage.server_totals(inputs.event_log(spark, sf), ["tenant_key"]).select("tenant_key", "flagged")


@query("usage_snapshot", f"""WITH {LOG},
o AS (SELECT tenant_key, server_id, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS outcomes
  FROM (SELECT tenant_key, server_id, outcome, count(*) AS n FROM log GROUP BY ALL) GROUP BY ALL),
s AS (SELECT tenant_key, server_id, string_agg(severity || '=' || n, ',' ORDER BY severity) AS severities
  FROM (SELECT tenant_key, server_id, severity, count(*) AS n FROM log
    WHERE outcome = 'success' AND NOT partial AND severity IS NOT NULL GROUP BY ALL) GROUP BY ALL),
t AS (SELECT tenant_key, server_id, count(*) AS requests, {FLAGGED} AS flagged FROM log GROUP BY ALL)
SELECT t.*, outcomes, coalesce(severities, '') AS severities FROM t
JOIN o ON t.tenant_key IS NOT DISTINCT FROM o.tenant_key AND t.server_id = o.server_id
LEFT JOIN s ON t.tenant_key IS NOT DISTINCT FROM s.tenant_key AND t.server_id = s.server_id""")
def snapshot(spark, sf):
    def flat(name):
        pairs = F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
        return F.array_join(pairs, ",").alias(name)

    taken = usage.usage(inputs.event_log(spark, sf))
    return taken.select("tenant_key", "server_id", "requests", "flagged", flat("outcomes"), flat("severities"))


# Days instead of minutes, since the test log is sparse.
DAILY = f"""{LOG}, daily AS (SELECT date_trunc('day', occurred_at) + INTERVAL 1 DAY AS reported_at, tenant_key, server_id,
  count(*) AS requests, {FLAGGED} AS flagged, {SAMPLES} AS samples FROM log GROUP BY ALL),
running AS (SELECT reported_at, tenant_key, server_id, (sum(requests) OVER w)::BIGINT AS requests, (sum(flagged) OVER w)::BIGINT AS flagged,
  floor((sum(samples) OVER w) / 16000)::BIGINT AS audio_seconds FROM daily
  WINDOW w AS (PARTITION BY tenant_key, server_id ORDER BY reported_at))"""


def _running(spark, sf):
    return usage.cumulative_snapshots(usage.usage_intervals(inputs.event_log(spark, sf), interval="1 day"))


@query("a6_w1_snapshots", f"""WITH {DAILY}
SELECT epoch_us(reported_at) AS reported_us, * EXCLUDE (reported_at) FROM running""")
def snapshots(spark, sf):
    return _running(spark, sf).select(
        F.unix_micros("reported_at").alias("reported_us"), "tenant_key", "server_id", "requests", "flagged", "audio_seconds"
    )


# Counters that start again every tenth day, as after a restart.
RESTARTED = "CASE WHEN day(reported_at) % 10 = 0 THEN {c} % 7 ELSE {c} END"


@query("w2_deltas", f"""WITH {DAILY},
reset AS (SELECT reported_at, tenant_key, server_id, {RESTARTED.format(c='requests')} AS requests FROM running),
lagged AS (SELECT *, lag(requests) OVER (PARTITION BY tenant_key, server_id ORDER BY reported_at) AS before FROM reset)
SELECT epoch_us(reported_at) AS reported_us, tenant_key, server_id,
  CASE WHEN before IS NULL OR requests < before THEN requests ELSE requests - before END AS requests FROM lagged""")
def deltas(spark, sf):
    restarted = _running(spark, sf).withColumn("requests", F.expr(RESTARTED.format(c="requests")))
    return usage.snapshot_deltas(restarted, ["requests"]).select(
        F.unix_micros("reported_at").alias("reported_us"), "tenant_key", "server_id", "requests"
    )


def _map_text(column):
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")


def _running_map(name, column, condition):
    @query(name, f"""WITH {DAILY},
vals AS (SELECT DISTINCT {column} AS v FROM log WHERE {condition}),
per AS (SELECT date_trunc('day', occurred_at) + INTERVAL 1 DAY AS reported_at, tenant_key, server_id, {column} AS v, count(*) AS n FROM log WHERE {condition} GROUP BY ALL),
grid AS (SELECT r.reported_at, r.tenant_key, r.server_id, vals.v, coalesce(p.n, 0) AS n FROM running r CROSS JOIN vals
  LEFT JOIN per p ON p.reported_at = r.reported_at AND p.server_id = r.server_id AND p.tenant_key IS NOT DISTINCT FROM r.tenant_key AND p.v = vals.v),
total AS (SELECT *, sum(n) OVER (PARTITION BY tenant_key, server_id, v ORDER BY reported_at) AS s FROM grid)
SELECT epoch_us(reported_at) AS reported_us, tenant_key, server_id,
  coalesce(string_agg(v || ':' || CAST(s AS BIGINT), ',' ORDER BY v) FILTER (s > 0), '') AS counts FROM total GROUP BY ALL""")
    def run(spark, sf):
        log = inputs.event_log(spark, sf)
        values = [r[0] for r in log.filter(condition).select(column).distinct().collect()]
        histogram = usage.histogram_intervals(log, column, interval="1 day")
        maps = usage.cumulative_maps(histogram, column, usage.usage_intervals(log, interval="1 day"), values)
        return maps.select(F.unix_micros("reported_at").alias("reported_us"), "tenant_key", "server_id", _map_text("counts").alias("counts"))


_running_map("a6_w1_outcomes", "outcome", "true")
_running_map("a6_w1_severities", "severity", "outcome = 'success' AND NOT partial AND severity IS NOT NULL")


@query("w3_newest", f"""WITH {LOG} SELECT tenant_key, request_id, severity FROM log WHERE tenant_key IS NOT NULL AND severity > 0
ORDER BY occurred_at DESC, tenant_key DESC, request_id DESC LIMIT 2000""")
def newest(spark, sf):
    log = inputs.event_log(spark, sf).filter("tenant_key IS NOT NULL AND severity > 0")
    return ev.newest_events(log).select("tenant_key", "request_id", "severity")


@query("w4_sorted_lists", f"""WITH {LOG} SELECT server_id, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes FROM log GROUP BY server_id""")
def sorted_lists(spark, sf):
    log = inputs.event_log(spark, sf)
    return log.groupBy("server_id").agg(F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("outcomes"))


@query("w5_language_sets", """WITH d AS (SELECT DISTINCT lang AS l FROM documents),
n AS (SELECT DISTINCT lower(substr(n_name, 1, 2)) AS l FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'both' AS part, l AS language FROM d WHERE l IN (SELECT l FROM n)
UNION ALL SELECT 'packs only', l FROM d WHERE l NOT IN (SELECT l FROM n)
UNION ALL SELECT 'models only', l FROM n WHERE l NOT IN (SELECT l FROM d)""")
def language_sets(spark, sf):
    packs = inputs.table(spark, sf, "documents").agg(F.collect_set("lang")).scalar()
    nations = inputs.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    heard = inputs.table(spark, sf, "customer").join(nations, "c_nationkey").agg(
        F.collect_set(F.lower(F.substring("n_name", 1, 2))).alias("models")
    ).withColumn("packs", packs)
    parts = F.array(
        F.struct(F.lit("both").alias("part"), F.array_intersect("packs", "models").alias("codes")),
        F.struct(F.lit("packs only").alias("part"), F.array_except("packs", "models").alias("codes")),
        F.struct(F.lit("models only").alias("part"), F.array_except("models", "packs").alias("codes")),
    )
    return heard.select(F.inline(parts)).select("part", F.explode("codes").alias("language"))


@query("a7_top_match", f"""WITH {DOC_MATCHES}
SELECT doc_id, arg_min(rule_id, (-severity, pack_ord, pass, rule_ord)) AS rule_id, max(severity) AS severity,
  arg_min(matched_text, (-severity, pack_ord, pass, rule_ord)) AS matched_text, count(*)::INTEGER AS rule_count
FROM named GROUP BY doc_id""")
def top_match(spark, sf):
    return ev.top_match(doc_matches(spark, sf), ["doc_id"]).select(
        "doc_id", "rule_id", "severity", "matched_text", "rule_count"
    )


@query("a8_rule_statistics", f"""WITH {WORDS_SQL}
SELECT lang AS language, CASE WHEN {FUZZY_OF} THEN 'fuzzy' ELSE 'exact' END AS match_type, {CATEGORY_OF} AS category,
  ({SEVERITY_OF})::INTEGER AS severity, {REVIEW_OF} AS context_required, count(*) AS n_rules, count(*) AS n_patterns
FROM words GROUP BY ALL""")
def statistics(spark, sf):
    packs = inputs.word_packs(spark, sf)
    return packqa.rule_statistics(packs.rules, packs.patterns)


@query("a9_latency", """WITH t AS (SELECT event_type AS outcome, CAST(round(value * 10) AS BIGINT) AS ms FROM events)
SELECT outcome, count(*) AS n, round(avg(ms), 6) AS mean_ms, quantile_cont(ms, 0.5) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms
FROM t GROUP BY outcome""")
def latency(spark, sf):
    traces = inputs.table(spark, sf, "events").select(
        F.col("event_type").alias("outcome"), F.expr("CAST(round(value * 10) AS BIGINT)").alias("total_ms")
    )
    return usage.latency_summary(traces, exact=True).select(
        "outcome", "n", F.round("mean_ms", 6).alias("mean_ms"), "p50_ms", F.round("p95_ms", 6).alias("p95_ms")
    )


STAGE_SQL = {"decode": "event_id % 7", "stt": "event_id % 11", "rules": "CASE WHEN event_id % 4 > 0 THEN event_id % 5 END", "classifier": "0",
             "serialize": "NULL", "total": "CAST(round(value * 10) AS BIGINT)"}


@query("a9_stages", "WITH t AS (" + " UNION ALL ".join(
    f"SELECT event_type AS outcome, '{stage}' AS stage, CAST({sql} AS BIGINT) AS ms FROM events" for stage, sql in STAGE_SQL.items()
) + """) SELECT outcome, stage, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms
FROM t WHERE ms IS NOT NULL GROUP BY outcome, stage""")
def stage_latencies(spark, sf):
    events = inputs.table(spark, sf, "events")
    traces = events.select(
        F.col("event_type").alias("outcome"), *[F.expr(f"CAST({sql} AS BIGINT)").alias(f"{stage}_ms") for stage, sql in STAGE_SQL.items()]
    )
    found = usage.stage_latencies(traces, exact=True)
    return found.select("outcome", "stage", "n", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms")])
