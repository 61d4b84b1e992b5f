"""Inputs the queries share: test tables read as transcripts, request logs and packs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import domains
from earshot.functions import text as tx
from earshot.plans.sizing import materialize
from earshot.sources.packs import RulePacks, packs_from_files, read_packs

PACKS = str(Path(__file__).resolve().parent.parent / "packs" / "neutral")
INSTALLED = ("de", "en", "es", "fr")
MODEL_LANGUAGES = ("de", "en", "es", "fi")
_loaded: dict[int, RulePacks] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def neutral_packs(spark: SparkSession) -> RulePacks:
    """Read once per session: their tables are local relations."""
    key = id(spark.sparkContext)
    if key not in _loaded:
        _loaded[key] = read_packs(spark, PACKS)
    return _loaded[key]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as utterances pinned to their own language."""
    return table(spark, sf, "documents").select(
        "doc_id", "lang", tx.normalize(F.col("text")).alias("norm"),
        F.array("lang").alias("run_packs"), F.col("lang").alias("verdict_language"),
    )


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn, in no stated language: every installed pack runs."""
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.normalize(F.col("text")).alias("norm"),
        F.array(*map(F.lit, INSTALLED)).alias("run_packs"),
        F.lit(None).cast("string").alias("verdict_language"),
    )


# --- the request log ---------------------------------------------------------------
# One SQL text for both engines; only the JSON accessor and the time cast differ.

EVENT_LOG = """
SELECT concat('r', CAST(event_id AS STRING)) AS request_id,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('t', CAST(user_id % 7 AS STRING)) END AS tenant_key,
  concat('s', CAST(user_id % 4 AS STRING)) AS server_id,
  CAST(user_id AS STRING) AS player_id, {ts} AS occurred_at, event_id,
  CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'signup' THEN 'language_unsupported'
    ELSE 'success' END AS outcome,
  event_type = 'view' AS partial,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST({k} AS INT) % 4 END AS severity,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(round(value * 1000) AS BIGINT) ELSE 0 END
    AS samples_16k
FROM events
"""

# Copies of the log: every tenth a minute later, every eleventh with another digest,
# every thirteenth after its entry has run out.
REPLAY_LOG = """
SELECT request_id, scope, occurred_us, digest, row_id FROM (
  SELECT request_id, scope, occurred_us, digest, event_id * 4 AS row_id FROM base
  UNION ALL SELECT request_id, scope, occurred_us + 60000000, digest, event_id * 4 + 1
    FROM base WHERE event_id % 10 = 0
  UNION ALL SELECT request_id, scope, occurred_us + 60000000, concat(digest, 'x'), event_id * 4 + 2
    FROM base WHERE event_id % 11 = 0
  UNION ALL SELECT request_id, scope, occurred_us + 121000000, digest, event_id * 4 + 3
    FROM base WHERE event_id % 13 = 0
) AS copies
"""

# The log with what clients do: every tenth request again a minute later in another spelling,
# every eleventh id a minute later with another preroll, every thirteenth after its entry ran
# out; and with each request of tok-4 in every other hour, four more within five seconds.
RAW_REQUESTS = """
SELECT row_id, event_id, occurred_at,
  CASE WHEN event_id % 17 = 3 THEN upper(u) WHEN event_id % 17 = 4 THEN replace(u, '-', '') ELSE u END AS request_id,
  CASE WHEN event_id % 19 = 7 THEN 'nobody' ELSE
    CASE (event_id + spelling) % 7 WHEN 1 THEN concat('urn:uuid:', upper(p)) WHEN 2 THEN concat('{{', p, '}}')
      WHEN 3 THEN replace(p, '-', '') WHEN 4 THEN upper(p) ELSE p END END AS player_id,
  CASE event_id % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'en' WHEN 2 THEN 'en,de' WHEN 3 THEN 'fi'
    WHEN 4 THEN 'en,xx' ELSE 'de,de' END AS language_spec,
  CASE event_id % 23 WHEN 1 THEN '7' WHEN 2 THEN '-3' WHEN 4 THEN 'abc' WHEN 8 THEN '384003'
    ELSE concat(CASE spelling WHEN 1 THEN ' +' ELSE '' END, CAST(960 * (event_id % 10) + more AS STRING), CASE spelling WHEN 1 THEN ' ' ELSE '' END)
    END AS preroll,
  CASE event_id % 13 WHEN 1 THEN NULL WHEN 2 THEN '1' WHEN 3 THEN ' 1 ' WHEN 4 THEN 'yes' ELSE '0' END AS partial_flag,
  CASE event_id % 5 WHEN 0 THEN 'es' WHEN 1 THEN '' WHEN 2 THEN 'pl' ELSE NULL END AS detected_language,
  concat('tok-', CAST(user_id % 8 AS STRING)) AS token,
  samples_16k
FROM (
  SELECT row_id, event_id, user_id, occurred_at, spelling, more, CAST(round(value * 1000) AS BIGINT) AS samples_16k,
    concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS u,
    concat(substr(g, 1, 8), '-', substr(g, 9, 4), '-', substr(g, 13, 4), '-', substr(g, 17, 4), '-', substr(g, 21, 12)) AS p
  FROM (
    SELECT c.*, md5(concat(CAST(event_id AS STRING), burst)) AS h, md5(CAST(user_id AS STRING)) AS g FROM (
      SELECT event_id, user_id, value, event_id * 8 AS row_id, {ts} AS occurred_at, 0 AS spelling, 0 AS more, '' AS burst FROM events
      UNION ALL SELECT event_id, user_id, value, event_id * 8 + 1, {ts} + INTERVAL 60 SECONDS, 1, 0, '' FROM events WHERE event_id % 10 = 0
      UNION ALL SELECT event_id, user_id, value, event_id * 8 + 2, {ts} + INTERVAL 60 SECONDS, 0, 3, '' FROM events WHERE event_id % 11 = 0
      UNION ALL SELECT event_id, user_id, value, event_id * 8 + 3, {ts} + INTERVAL 121 SECONDS, 2, 0, '' FROM events WHERE event_id % 13 = 0
      UNION ALL SELECT event_id, user_id, value, event_id * 8 + 4, {ts} + INTERVAL 1 SECONDS, 0, 0, 'a' FROM events WHERE user_id % 8 = 4 AND event_id % 2 = 0
      UNION ALL SELECT event_id, user_id, value, event_id * 8 + 5, {ts} + INTERVAL 2 SECONDS, 0, 0, 'b' FROM events WHERE user_id % 8 = 4 AND event_id % 2 = 0
      UNION ALL SELECT event_id, user_id, value, event_id * 8 + 6, {ts} + INTERVAL 3 SECONDS, 0, 0, 'c' FROM events WHERE user_id % 8 = 4 AND event_id % 2 = 0
      UNION ALL SELECT event_id, user_id, value, event_id * 8 + 7, {ts} + INTERVAL 5 SECONDS, 0, 0, 'd' FROM events WHERE user_id % 8 = 4 AND event_id % 2 = 0
    ) AS c
  ) AS hashed
) AS named
"""

# token, server, tenant, licensed languages, limit per window, expiry
CREDENTIALS = (
    ("tok-0", "s0", "t0", None, None, None),
    ("tok-1", "s1", "t1", ("en",), None, None),
    ("tok-2", "s2", "t2", ("en", "de"), None, None),
    ("tok-3", "s3", "t3", None, None, "2024-01-15 00:00:00"),
    ("tok-4", "s0", "t4", None, 3, None),
    ("tok-5", "s1", "t5", ("fi",), None, None),
    ("tok-6", "s2", None, None, None, None),
)


def spark_ts(column: str = "ts") -> str:
    return f"CAST({column} AS TIMESTAMP)"


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        EVENT_LOG.format(ts=spark_ts(), k="get_json_object(props, '$.k')").replace("FROM events", "FROM {events}"),
        events=table(spark, sf, "events"),
    )


def event_log_sql() -> str:
    return EVENT_LOG.format(ts="ts", k="json_extract_string(props, '$.k')").replace("AS STRING", "AS VARCHAR")


def replay_log(spark: SparkSession, sf: str) -> DataFrame:
    base = event_log(spark, sf).select(
        "request_id", "event_id",
        F.concat(F.coalesce("tenant_key", F.lit("selfhost")), F.lit("|"), "server_id").alias("scope"),
        F.unix_micros("occurred_at").alias("occurred_us"),
        F.md5(F.concat("player_id", F.lit("|"), "request_id")).alias("digest"),
    )
    return spark.sql(REPLAY_LOG.replace("FROM base", "FROM {base}"), base=base).withColumn(
        "occurred_at", F.timestamp_micros("occurred_us")
    )


def replay_log_ctes() -> str:
    return f"""
log AS ({event_log_sql()}),
base AS (SELECT request_id, event_id, concat(coalesce(tenant_key, 'selfhost'), '|', server_id) AS scope,
  epoch_us(occurred_at) AS occurred_us, md5(concat(player_id, '|', request_id)) AS digest FROM log),
copies AS ({REPLAY_LOG})"""


def texts_said(spark: SparkSession, sf: str, numbered: DataFrame) -> DataFrame:
    """numbered (event_id and more) with the text of the document whose turn it is: every event says something."""
    docs = table(spark, sf, "documents")
    turn = F.pmod("event_id", F.lit(docs.count())).alias("doc_id")
    return numbered.select("*", turn).join(docs.select("doc_id", "lang", "text"), "doc_id")


def raw_requests(spark: SparkSession, sf: str) -> DataFrame:
    sql = RAW_REQUESTS.format(ts=spark_ts()).replace("FROM events", "FROM {events}")
    return spark.sql(sql.replace("'{", "'{{").replace("}'", "}}'"), events=table(spark, sf, "events")).withColumn(
        "token_digest", F.unhex(F.sha2("token", 256))
    )


def raw_requests_sql() -> str:
    return RAW_REQUESTS.format(ts="ts").replace("AS STRING", "AS VARCHAR")


def credentials(spark: SparkSession) -> DataFrame:
    rows = [
        (token, server, tenant, list(langs) if langs else None, limit, expires)
        for token, server, tenant, langs, limit, expires in CREDENTIALS
    ]
    df = spark.createDataFrame(
        rows, "token string, server_id string, tenant_key string, languages array<string>, "
        "rate_limit_per_minute int, expires string",
    )
    return df.select(
        F.unhex(F.sha2("token", 256)).alias("token_digest"), "server_id", "tenant_key", "languages",
        "rate_limit_per_minute", F.col("expires").cast("timestamp").alias("expires_at"),
    )


def credentials_sql() -> str:
    def lit(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, tuple):
            return "[" + ", ".join(f"'{v}'" for v in value) + "]"
        return str(value) if isinstance(value, int) else f"'{value}'"

    rows = ", ".join(
        f"(sha256({lit(t)}), {lit(s)}, {lit(k)}, {lit(langs)}::VARCHAR[], {lit(n)}, {lit(e)}::TIMESTAMP)"
        for t, s, k, langs, n, e in CREDENTIALS
    )
    return (
        f"SELECT * FROM (VALUES {rows}) AS c(token_digest, server_id, tenant_key, languages, "
        "rate_limit_per_minute, expires_at)"
    )


# --- packs written from the data's own words ----------------------------------------
# Every word of the documents is a rule. A language's words are dealt by hash over as many
# packs as keep each well under the thousand rules a pack may have: en-s0000, en-s0001, ...

PACK_RULES = 500


def pack_words(spark: SparkSession, sf: str) -> DataFrame:
    """lang, the pack, and word: every distinct word that fits in a pattern."""
    seen = documents(spark, sf).select("lang", F.explode(F.array_distinct(tx.tokens(F.col("norm")))).alias("word"))
    # Read many times over, the documents are not.
    words = materialize(seen.filter(f"word <> '' AND length(word) <= {domains.MAX_PATTERN_CHARS}").distinct(), "words")
    sizes = words.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / PACK_RULES).cast("long").alias("packs"))
    shard = F.pmod(F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long"), F.col("packs"))
    return words.join(F.broadcast(sizes), "lang").select(
        F.concat("lang", F.lit("-s"), F.lpad(shard.cast("string"), 4, "0")).alias("lang"), "word"
    )


NORM = r"trim(regexp_replace(replace(lower(nfc_normalize(text)),'ß','ss'),'[^\p{L}\p{N}]+',' ','g'))"

WORDS_SQL = rf"""
docs AS (SELECT doc_id, lang, {NORM} AS norm FROM documents),
seen AS (SELECT DISTINCT lang, word FROM (SELECT lang, unnest(string_split(norm, ' ')) AS word FROM docs)
  WHERE word <> '' AND length(word) <= {domains.MAX_PATTERN_CHARS}),
sizes AS (SELECT lang, CAST(ceil(count(*) / {PACK_RULES}) AS BIGINT) AS packs FROM seen GROUP BY lang),
words AS (SELECT concat(lang, '-s', lpad(CAST(CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % packs AS VARCHAR), 4, '0')) AS lang, word
  FROM seen JOIN sizes USING (lang))"""

# How a word becomes a rule; the same rule in both engines' words.
CATEGORY_OF = "CASE length(word) % 5 WHEN 0 THEN 'spam' WHEN 1 THEN 'hate' WHEN 2 THEN 'threat' WHEN 3 THEN 'sexual' ELSE 'harassment' END"
SEVERITY_OF = "1 + length(word) % 3"
REVIEW_OF = "substr(md5(concat(lang, word)), 1, 1) IN ('0', '1', '2', '3')"
FUZZY_OF = f"length(word) >= {domains.FUZZY_MIN_CHARS} AND substr(md5(concat(lang, word)), 2, 1) IN ('0', '1')"
PREFIX_OF = "CASE WHEN length(word) % 11 = 0 THEN 'misc' ELSE lang END"


def word_pack_files(spark: SparkSession, sf: str, styled: bool = False) -> DataFrame:
    """The words as YAML packs, (source_path, content).

    styled writes terms with a capital and a full stop, which readers must undo.
    """
    term = "concat(upper(substr(word, 1, 1)), substr(word, 2), '.')" if styled else "word"
    rule = (
        "concat('  - {id: ', PREFIX, '.w-', substr(md5(word), 1, 12), ', term: \"', TERM, '\", category: ', CATEGORY, "
        "', severity: ', cast(SEVERITY as string), ', match: ', if(FUZZY, 'fuzzy', 'exact'), ', context_required: ', "
        "if(REVIEW, 'true', 'false'), '}')"
    )
    for name, text in (("PREFIX", PREFIX_OF), ("TERM", term), ("CATEGORY", CATEGORY_OF),
                       ("SEVERITY", SEVERITY_OF), ("FUZZY", FUZZY_OF), ("REVIEW", REVIEW_OF)):
        rule = rule.replace(name, f"{text}" if name == "TERM" else f"({text})")
    lines = pack_words(spark, sf).select("lang", "word", F.expr(rule).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "line"))), lambda r: r["line"]), "\n")
    # One file's rules are gathered; a pack is limited to a thousand. So many parts, however few bytes: parsing costs more than moving.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(parts, "lang").groupBy("lang").agg(body.alias("rules")).select(
        F.concat(F.lit("/packs/"), "lang", F.lit(".yml")).alias("source_path"),
        F.concat(F.lit("version: 1\nlanguage: "), "lang", F.lit("\nrules:\n"), "rules", F.lit("\n"))
        .cast("binary").alias("content"),
    )


def word_packs(spark: SparkSession, sf: str) -> RulePacks:
    return packs_from_files(word_pack_files(spark, sf))
