"""N: text functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs
from catalogue.inputs import NORM
from catalogue.registry import query
from earshot.functions import text as tx

DOCS = f"docs AS (SELECT doc_id, lang, {NORM} AS norm FROM documents)"
TALK = f"talk AS (SELECT conv_id, turn, {NORM} AS norm FROM conversations)"
# Vowels by base letter that the test languages can hold.
VOWELS_RE = "aeiouyàáâãäåèéêëìíîïòóôõöùúûüýÿāăąēĕėęěĩīĭįōŏőũūŭůűųŷ"

# Single letters in a row of three or more become one token.
JOIN_CTES = """
toks AS (SELECT {k}, unnest(string_split(norm, ' ')) AS w,
    generate_subscripts(string_split(norm, ' '), 1) AS i FROM {src}
  WHERE regexp_matches(norm, '(^| )[^ ] [^ ] [^ ]( |$)')),
flagged AS (SELECT *, length(w) = 1 AND NOT regexp_matches(w, '^\\p{{N}}$') AS single FROM toks),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY {k}, single ORDER BY i) AS island FROM flagged),
sized AS (SELECT *, count(*) OVER (PARTITION BY {k}, single, island) AS size FROM islands),
pieces AS (SELECT {k}, min(i) AS i, CASE WHEN bool_and(single AND size >= 3) THEN string_agg(w, '' ORDER BY i)
    ELSE string_agg(w, ' ' ORDER BY i) END AS piece
  FROM sized GROUP BY {k}, single, island),
rejoined AS (SELECT {k}, string_agg(piece, ' ' ORDER BY i) AS joined FROM pieces GROUP BY {k})"""


@query("n1_normalize", f"WITH {DOCS} SELECT doc_id, norm FROM docs")
def normalize(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", "norm")


@query("n2_tokens", f"""WITH {TALK}
SELECT conv_id, turn, (i - 1)::INTEGER AS pos, toks[i] AS token,
  (length(array_to_string(toks[1:i], ' ')) - length(toks[i]))::INTEGER AS start
FROM (SELECT conv_id, turn, string_split(norm, ' ') AS toks,
  unnest(range(1, len(string_split(norm, ' ')) + 1)) AS i FROM talk)""")
def token_positions(spark, sf):
    toks = tx.tokens(F.col("norm"))
    talk = inputs.conversations(spark, sf).select("conv_id", "turn", F.posexplode(toks).alias("pos", "token"))
    from pyspark.sql import Window

    # A turn is one text; the prefix sum runs inside it.
    before = Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0)).cast("int")
    return talk.select("conv_id", "turn", "pos", "token", start.alias("start"))


WORDS = f"""{DOCS},
vocab AS (SELECT DISTINCT unnest(string_split(norm, ' ')) AS word FROM docs),
chars AS (SELECT word, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i
  FROM vocab WHERE word <> ''),
marks AS (SELECT *, i - row_number() OVER (PARTITION BY word, c ORDER BY i) AS island FROM chars),
runs AS (SELECT word, c, min(i) AS i, count(*) AS n FROM marks GROUP BY word, c, island)"""


def _vocabulary(spark, sf):
    words = inputs.documents(spark, sf).select(F.explode(tx.tokens(F.col("norm"))).alias("word"))
    return words.filter("word <> ''").distinct()


@query("n3_runs", f"""WITH {WORDS}
SELECT word, string_agg(c || n, '' ORDER BY i) AS runs, count(*) AS n_runs FROM runs GROUP BY word""")
def run_encoding(spark, sf):
    word = F.col("word")
    runs = F.zip_with(tx.run_chars(word), tx.run_lengths(word), lambda c, n: F.concat(c, n.cast("string")))
    return _vocabulary(spark, sf).select(
        "word", F.array_join(runs, "").alias("runs"), F.size(runs).cast("bigint").alias("n_runs")
    )


@query("n4_vowels", f"""WITH {WORDS}
SELECT c AS letter, regexp_matches(c, '^[{VOWELS_RE}]$') AS vowel, count(*) AS n FROM chars GROUP BY c""")
def vowels(spark, sf):
    letters = _vocabulary(spark, sf).select(F.explode(F.split("word", "")).alias("letter"))
    return letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).select(
        "letter", tx.is_vowel(F.col("letter")).alias("vowel"), "n"
    )


@query("n5_leet_vowels", f"""WITH {WORDS}
SELECT c AS digit, CASE c WHEN '0' THEN 'o' WHEN '1' THEN 'i' WHEN '3' THEN 'e' WHEN '4' THEN 'a' END AS vowel,
  count(*) AS n FROM chars WHERE regexp_matches(c, '^\\p{{N}}$') GROUP BY c""")
def leet_vowels(spark, sf):
    letters = _vocabulary(spark, sf).select(F.explode(F.split("word", "")).alias("digit"))
    digits = letters.filter(F.col("digit").rlike(r"^\p{N}$")).groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    return digits.select("digit", tx.leet_vowel(F.col("digit")).alias("vowel"), "n")


@query("n6_spelled_out", f"""WITH {DOCS}, {JOIN_CTES.format(k='doc_id', src='docs')}
SELECT doc_id, coalesce(joined, norm) AS joined, coalesce(joined <> norm, false) AS changed
FROM docs LEFT JOIN rejoined USING (doc_id)""")
def spelled_out(spark, sf):
    docs = inputs.documents(spark, sf)
    return docs.withColumn("joined", tx.join_spelled_out(F.col("norm"))).select(
        "doc_id", "joined", (F.col("joined") != F.col("norm")).alias("changed")
    )


@query("n7_request_digest", rf"""WITH raw AS ({inputs.raw_requests_sql()}),
bare AS (SELECT *, lower(regexp_replace(replace(player_id, 'urn:uuid:', ''), '[{{}}-]', '', 'g')) AS p FROM raw)
SELECT row_id, sha256(concat_ws(chr(1), CASE WHEN length(p) = 32 THEN regexp_replace(p, '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\1-\2-\3-\4-\5') ELSE chr(0) END,
  language_spec, coalesce(CAST(try_cast(trim(preroll) AS BIGINT) AS VARCHAR), chr(0)),
  CASE WHEN coalesce(trim(partial_flag), '0') = '1' THEN 'true' WHEN coalesce(trim(partial_flag), '0') = '0' THEN 'false' ELSE chr(0) END,
  sha256(request_id))) AS digest FROM bare""")
def digests(spark, sf):
    from earshot.operators.route import canonical_uuid, partial_flag, preroll_samples

    raw = inputs.raw_requests(spark, sf)
    digest = tx.request_digest(
        canonical_uuid(F.col("player_id")), F.col("language_spec"), preroll_samples(F.col("preroll")),
        partial_flag(F.col("partial_flag")), F.sha2("request_id", 256),
    )
    return raw.select("row_id", digest.alias("digest"))


@query("n8_stamps", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS event_stamp,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS usage_stamp FROM events""")
def stamps(spark, sf):
    at = F.col("occurred_at")
    return inputs.event_log(spark, sf).select(
        "event_id", tx.iso_utc(at, True).alias("event_stamp"), tx.iso_utc(at, False).alias("usage_stamp")
    )


@query("n9_without_marks", f"""WITH {WORDS}
SELECT word, strip_accents(word) AS plain FROM vocab WHERE word <> ''""")
def plain_spelling(spark, sf):
    return _vocabulary(spark, sf).select("word", tx.without_marks(F.col("word")).alias("plain"))


@query("n10_contraction_twins", f"""WITH {DOCS}
SELECT doc_id, CASE WHEN instr(norm, 'the of ') > 0
  THEN substr(norm, 1, instr(norm, 'the of ') - 1) || 'theof ' || substr(norm, instr(norm, 'the of ') + 7)
  ELSE norm END AS twin FROM docs""")
def contraction_twins(spark, sf):
    twin = tx.replace_word_once(F.col("norm"), F.lit("the of"), F.lit("theof"))
    return inputs.documents(spark, sf).select("doc_id", twin.alias("twin"))


@query("n11_sorted_map_json", f"""WITH log AS ({inputs.event_log_sql()}),
counts AS (SELECT server_id, outcome, count(*) AS n FROM log GROUP BY server_id, outcome)
SELECT server_id, '{{' || string_agg('"' || outcome || '":' || n, ',' ORDER BY outcome) || '}}' AS outcomes
FROM counts GROUP BY server_id""")
def sorted_maps(spark, sf):
    counts = inputs.event_log(spark, sf).groupBy("server_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n"))))
    return counts.groupBy("server_id").agg(F.to_json(entries).alias("outcomes"))
