"""M: matching documents and conversations against the neutral packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs
from catalogue.registry import query
from catalogue.text import DOCS, JOIN_CTES, TALK, VOWELS_RE
from earshot.operators import match, verdict

# The neutral packs once more, as the rows a SQL engine can join to.
RULE_ROWS = """rules(language, pack_ord, rule_ord, rule_id, category, severity, review) AS (VALUES
  ('de', 0, 0, 'de.hate.nicht', 'hate', 3, false), ('de', 0, 1, 'de.spam.erung', 'spam', 1, true),
  ('en', 1, 0, 'en.spam.attion', 'spam', 1, false), ('en', 1, 1, 'en.threat.phrase', 'threat', 2, true),
  ('en', 1, 2, 'en.harassment.retion', 'harassment', 2, false), ('en', 1, 3, 'en.hate.thing', 'hate', 3, false),
  ('en', 1, 4, 'en.sexual.eriner', 'sexual', 3, false), ('en', 1, 5, 'en.spam.spelled', 'spam', 1, false),
  ('es', 2, 0, 'es.threat.para', 'threat', 2, false), ('es', 2, 1, 'es.spam.mente', 'spam', 1, true),
  ('fr', 3, 0, 'fr.hate.etion', 'hate', 3, false), ('fr', 3, 1, 'fr.sexual.ement', 'sexual', 2, true))"""
EXACT_ROWS = """exact(language, rule_ord, pattern_ord, pattern) AS (VALUES
  ('de', 0, 0, 'nicht'), ('de', 1, 0, 'erung'), ('en', 0, 0, 'attion'), ('en', 1, 0, 'of the'),
  ('en', 1, 1, 'the of'), ('es', 0, 0, 'para'), ('es', 1, 0, 'mente'), ('fr', 0, 0, 'étion'), ('fr', 1, 0, 'ément'))"""
ALLOW_ROWS = "allowed(language, term) AS (VALUES ('en', 'attion to thanedble'), ('en', 'eraner'))"

# The fuzzy comparison with "eriner": six runs, its consonants in place, each vowel a
# vowel or its own digit, and at most two runs that differ.
_V = "|".join(f"{v}+" for v in VOWELS_RE)
ERINER = f"^({_V}|3+)(r+)({_V}|1+)(n+)({_V}|3+)(r+)$"
IS_ERINER = (
    f"(length(w) BETWEEN 4 AND 12 AND regexp_matches(w, '{ERINER}') AND "
    + " + ".join(
        f"(regexp_extract(w, '{ERINER}', {g}) <> '{c}')::INTEGER" for g, c in enumerate("eriner", 1)
    )
    + " <= 2)"
)

DOC_TEXTS = f"""{DOCS}, {JOIN_CTES.format(k='doc_id', src='docs')},
texts AS (SELECT doc_id, lang AS language, 1 AS pass, norm AS t FROM docs
  UNION ALL SELECT doc_id, lang, 2, joined FROM docs JOIN rejoined USING (doc_id) WHERE joined <> norm)"""
TALK_TEXTS = f"""{TALK}, {JOIN_CTES.format(k='conv_id, turn', src='talk')},
passes AS (SELECT conv_id, turn, 1 AS pass, norm AS t FROM talk
  UNION ALL SELECT conv_id, turn, 2, joined FROM talk JOIN rejoined USING (conv_id, turn) WHERE joined <> norm),
texts AS (SELECT passes.*, language FROM passes, (VALUES ('de'), ('en'), ('es'), ('fr')) AS l(language))"""


def hit_ctes(k: str) -> str:
    """Occurrences of everything in texts(k, language, pass, t), positions in tokens."""
    return f"""
{RULE_ROWS}, {EXACT_ROWS}, {ALLOW_ROWS},
split AS (SELECT *, string_split(t, ' ') AS toks FROM texts),
places AS (SELECT {k}, language, pass, toks, unnest(range(1, len(toks) + 1)) AS i FROM split),
words AS (SELECT {k}, language, pass, toks[i] AS w, i FROM places),
spans AS (SELECT {k}, a.language, pass, i AS lo, i + len(string_split(term, ' ')) - 1 AS hi
  FROM places a JOIN allowed p ON a.language = p.language AND toks[i] = string_split(term, ' ')[1]
  WHERE toks[i:i + len(string_split(term, ' ')) - 1] = string_split(term, ' ')),
exact_hits AS (SELECT {k}, a.language, pass, rule_ord, pattern_ord, i AS lo,
    i + len(string_split(pattern, ' ')) - 1 AS hi, pattern AS matched
  FROM places a JOIN exact p ON a.language = p.language AND toks[i] = string_split(pattern, ' ')[1]
  WHERE toks[i:i + len(string_split(pattern, ' ')) - 1] = string_split(pattern, ' ')),
contains_hits AS (SELECT {k}, language, pass, r AS rule_ord, 0 AS pattern_ord, i AS lo, i AS hi, p AS matched
  FROM words, (VALUES (2, 'retion'), (5, 'aaa')) AS c(r, p) WHERE language = 'en' AND contains(w, p)),
regex_hits AS (SELECT {k}, language, pass, 3 AS rule_ord, 0 AS pattern_ord, i AS lo, i AS hi, w AS matched
  FROM words WHERE language = 'en' AND w IN ('thtion', 'thing')),
fuzzy_hits AS (SELECT {k}, language, pass, 4 AS rule_ord, i AS pattern_ord, i AS lo, i AS hi, w AS matched
  FROM words WHERE language = 'en' AND w LIKE '%r%n%r' AND {IS_ERINER}),
hits AS (SELECT * FROM exact_hits UNION ALL SELECT * FROM contains_hits
  UNION ALL SELECT * FROM regex_hits UNION ALL SELECT * FROM fuzzy_hits),
free AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM spans s
  WHERE ({', '.join('s.' + c for c in k.split(', '))}) = ({', '.join('h.' + c for c in k.split(', '))})
    AND s.language = h.language AND s.pass = h.pass AND s.lo <= h.lo AND s.hi >= h.hi)),
matches AS (SELECT {k}, language, rule_ord, min(pass) AS pass,
    arg_min(matched, (pass, pattern_ord, lo)) AS matched_text FROM free GROUP BY {k}, language, rule_ord),
named AS (SELECT {k}, pack_ord, pass, m.rule_ord, m.language, rule_id, category, severity, matched_text,
    review AS context_required FROM matches m JOIN rules r ON m.language = r.language AND m.rule_ord = r.rule_ord)"""


DOC_MATCHES = f"{DOC_TEXTS}, {hit_ctes('doc_id')}"
TALK_MATCHES = f"{TALK_TEXTS}, {hit_ctes('conv_id, turn')}"


def _doc_hits(spark, sf, kind):
    """Occurrences of one match type in the documents, allow spans beside them."""
    packs = inputs.neutral_packs(spark).with_types(kind)
    return match.all_hits(inputs.documents(spark, sf), packs, ["doc_id"])


def _spots(df, *extra):
    return df.select(
        "doc_id", F.col("pass").alias("pass"), "rule_ord",
        F.col("tok_start").alias("lo"), F.col("tok_end").alias("hi"), "matched_text", *extra,
    )


def _spots_sql(source: str) -> str:
    return (
        f"WITH {DOC_MATCHES} SELECT doc_id, pass, rule_ord, (lo - 1)::INTEGER AS lo, (hi - 1)::INTEGER AS hi, "
        f"matched AS matched_text FROM {source}"
    )


@query("m1_exact_hits", _spots_sql("exact_hits"))
def exact_hits(spark, sf):
    return _spots(_doc_hits(spark, sf, "exact").filter("entry = 'exact'"))


@query("m2_contains_hits", _spots_sql("contains_hits"))
def contains_hits(spark, sf):
    return _spots(_doc_hits(spark, sf, "contains").filter("entry = 'contains'"))


@query("m3_regex_hits", _spots_sql("regex_hits"))
def regex_hits(spark, sf):
    return _spots(_doc_hits(spark, sf, "regex").filter("entry = 'regex'"))


@query("m4_fuzzy_hits", _spots_sql("fuzzy_hits"))
def fuzzy_hits(spark, sf):
    return _spots(match.accepted_fuzzy(_doc_hits(spark, sf, "fuzzy")))


@query("m5_allow_spans", f"""WITH {DOC_MATCHES}
SELECT doc_id, pass, (lo - 1)::INTEGER AS lo, (hi - 1)::INTEGER AS hi FROM spans""")
def allow_spans(spark, sf):
    spans = _doc_hits(spark, sf, "exact").filter("entry = 'allow'")
    return spans.select("doc_id", "pass", F.col("tok_start").alias("lo"), F.col("tok_end").alias("hi"))


@query("m6_suppressed", f"""WITH {DOC_MATCHES}
SELECT language, rule_ord, count(*) AS hits_left FROM free WHERE rule_ord <> 4 OR language <> 'en' GROUP BY language, rule_ord""")
def suppression(spark, sf):
    hits = match.all_hits(inputs.documents(spark, sf), inputs.neutral_packs(spark), ["doc_id"])
    left = match.suppress_allowed(hits, ["doc_id"]).filter("entry <> 'fuzzy'")
    return left.groupBy("language", "rule_ord").agg(F.count(F.lit(1)).alias("hits_left"))


@query("m7_first_hit_per_rule", f"WITH {DOC_MATCHES} SELECT doc_id, language, rule_ord, matched_text FROM matches")
def first_hits(spark, sf):
    hits = match.all_hits(inputs.documents(spark, sf), inputs.neutral_packs(spark), ["doc_id"])
    found = match.first_hit_per_rule(match.suppress_allowed(hits, ["doc_id"]), ["doc_id"])
    return found.select("doc_id", "language", "rule_ord", "matched_text")


@query("m8_spelled_out_pass", f"""WITH {DOC_MATCHES}
SELECT rule_id, pass, count(*) AS n FROM named GROUP BY rule_id, pass""")
def spelled_out_pass(spark, sf):
    return doc_matches(spark, sf).groupBy("rule_id", "pass").agg(F.count(F.lit(1)).alias("n"))


MATCH_COLUMNS = (
    "pack_ord, pass, rule_ord, language, rule_id, category, severity, matched_text, context_required"
)


def doc_matches(spark, sf):
    return match.match_texts(inputs.documents(spark, sf), inputs.neutral_packs(spark), ["doc_id"])


@query("m9_pack_match_documents", f"WITH {DOC_MATCHES} SELECT doc_id, {MATCH_COLUMNS.replace('pack_ord', '0 AS pack_ord')} FROM named")
def pack_match(spark, sf):
    return doc_matches(spark, sf)


@query("m9_pack_match_conversations", f"WITH {TALK_MATCHES} SELECT conv_id, turn, {MATCH_COLUMNS} FROM named")
def pack_match_talk(spark, sf):
    return match.match_texts(inputs.conversations(spark, sf), inputs.neutral_packs(spark), ["conv_id", "turn"])


SEVERITIES = """severities AS (SELECT doc_id, count(rule_id) AS n_matches,
  coalesce(max(CASE WHEN NOT context_required THEN severity END), 0) AS severity
  FROM docs LEFT JOIN named USING (doc_id) GROUP BY doc_id)"""


@query("m10_effective_severity", f"""WITH {DOC_MATCHES}, {SEVERITIES}
SELECT lang, severity, count(*) AS n FROM severities JOIN docs USING (doc_id) GROUP BY lang, severity""")
def severity_by_language(spark, sf):
    docs = inputs.documents(spark, sf)
    answered = verdict.verdicts(docs, doc_matches(spark, sf), ["doc_id"])
    return answered.groupBy("lang", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("m11_verdicts", f"""WITH {TALK_MATCHES}, listed AS (SELECT conv_id, turn, count(rule_id)::INTEGER AS n_matches,
    coalesce(string_agg(rule_id, ',' ORDER BY pack_ord, pass, rule_ord), '') AS rule_ids,
    coalesce(max(CASE WHEN NOT context_required THEN severity END), 0) AS severity
  FROM talk LEFT JOIN named USING (conv_id, turn) GROUP BY conv_id, turn)
SELECT conv_id, turn, norm AS transcript, 'auto' AS language, n_matches, rule_ids, severity,
  CASE WHEN n_matches > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence
FROM listed JOIN talk USING (conv_id, turn)""")
def verdicts(spark, sf):
    talk, keys = inputs.conversations(spark, sf), ["conv_id", "turn"]
    found = match.match_texts(talk, inputs.neutral_packs(spark), keys)
    return verdict.verdicts(talk, found, keys).select(
        *keys, "transcript", "language", "n_matches",
        F.array_join(F.transform("matches", lambda m: m["rule_id"]), ",").alias("rule_ids"),
        "severity", "confidence",
    )


@query("m12_confidence", f"""WITH {DOC_MATCHES}, {SEVERITIES}
SELECT severity, CASE WHEN n_matches > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, count(*) AS n
FROM severities GROUP BY ALL""")
def confidence(spark, sf):
    answered = verdict.verdicts(inputs.documents(spark, sf), doc_matches(spark, sf), ["doc_id"])
    return answered.groupBy("severity", "confidence").agg(F.count(F.lit(1)).alias("n"))


def scored_documents(spark, sf):
    """Documents with their label beside them; it plays the scorer's part."""
    labels = inputs.table(spark, sf, "labels").select("doc_id", "toxic")
    return inputs.documents(spark, sf).join(labels, "doc_id", "left")


def label_scorer(transcript, language):
    return F.when(
        F.col("toxic") == 1,
        F.struct(
            F.lit("harassment").alias("category"), F.lit(2).alias("severity"),
            F.lit(0.9).alias("confidence"), F.substring(transcript, 1, 20).alias("matched_text"),
            language.alias("language"),
        ),
    )


@query("m13_classifier", f"""WITH {DOC_MATCHES}, {SEVERITIES}
SELECT doc_id, (n_matches + coalesce(toxic, 0))::INTEGER AS n_matches,
  greatest(severity, CASE WHEN toxic = 1 THEN 2 ELSE 0 END) AS severity,
  CASE WHEN n_matches > 0 THEN 1.0::DOUBLE WHEN toxic = 1 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN toxic = 1 THEN 'tier2a.local-toxicity' END AS last_rule_id
FROM severities LEFT JOIN labels USING (doc_id)""")
def classified(spark, sf):
    docs = scored_documents(spark, sf)
    answered = verdict.verdicts(docs, doc_matches(spark, sf), ["doc_id"], classifier=label_scorer)
    last = F.get(F.col("matches"), F.size("matches") - 1)["rule_id"]
    return answered.select(
        "doc_id", "n_matches", "severity", "confidence",
        F.when(last == "tier2a.local-toxicity", last).alias("last_rule_id"),
    )


@query("m14_verdict_language", f"""WITH raw AS ({inputs.raw_requests_sql()})
SELECT row_id, CASE WHEN language_spec <> 'auto' THEN string_split(language_spec, ',')[1]
  ELSE coalesce(nullif(detected_language, ''), 'auto') END AS language FROM raw""")
def verdict_language(spark, sf):
    from earshot.operators import route

    raw = inputs.raw_requests(spark, sf)
    requested = route.requested_languages(F.col("language_spec"))
    heard = route.heard_language(F.col("detected_language"), inputs.MODEL_LANGUAGES)
    chosen = route.verdict_language(requested, heard)
    return raw.select("row_id", F.coalesce(chosen, F.lit("auto")).alias("language"))
