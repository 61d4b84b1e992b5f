"""Q: quality jobs, over packs made of all the documents' words."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalogue import inputs
from catalogue.inputs import (
    CATEGORY_OF, FUZZY_OF, PREFIX_OF, REVIEW_OF, SEVERITY_OF, WORDS_SQL,
)
from catalogue.matching import DOC_MATCHES, hit_ctes
from catalogue.registry import query
from catalogue.text import VOWELS_RE
from earshot import domains
from earshot.functions import text as tx
from earshot.operators import packqa
from earshot.plans.sizing import materialize
from earshot.sources.packs import packs_from_files

RULE_ID_OF = f"concat(({PREFIX_OF}), '.w-', substr(md5(word), 1, 12))"
RULED = f"""{WORDS_SQL},
ruled AS (SELECT lang AS language, word, {RULE_ID_OF} AS rule_id, {CATEGORY_OF} AS category,
  ({SEVERITY_OF})::INTEGER AS severity, {REVIEW_OF} AS review, {FUZZY_OF} AS fuzzy FROM words)"""

# Runs of a word as lists side by side, and what two words of as many runs cost.
ENCODED = f"""
letters AS (SELECT word, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM vocab),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY word, c ORDER BY i) AS island FROM letters),
grouped AS (SELECT word, c, min(i) AS i, count(*) AS n, regexp_matches(c, '^[{VOWELS_RE}]$') AS vowel FROM marked GROUP BY word, c, island),
runs AS (SELECT word, list(c ORDER BY i) AS cs, list(strip_accents(c) ORDER BY i) AS bases, list(n ORDER BY i) AS ns, list(vowel ORDER BY i) AS vowels,
  string_agg(CASE WHEN vowel OR c IN ('0', '1', '3', '4') THEN 'a' ELSE c END, '' ORDER BY i) AS frame FROM grouped GROUP BY word)"""
COST = """list_sum(list_transform(range(1, len(a.cs) + 1), lambda k: CASE WHEN a.cs[k] = b.cs[k] AND a.ns[k] = b.ns[k] THEN 0
  WHEN a.cs[k] = b.cs[k] OR (a.vowels[k] AND b.vowels[k]) OR (b.cs[k] || a.bases[k]) IN ('0o', '1i', '3e', '4a') THEN 1 ELSE 99 END))"""

# Which fuzzy words accept which other words: those of one skeleton, at a low enough cost.
PAIRS = f"""
vocab AS (SELECT DISTINCT word FROM ruled), {ENCODED},
fuzzy_pairs AS (SELECT a.word AS pattern, b.word AS token FROM (SELECT DISTINCT word FROM ruled WHERE fuzzy) p JOIN runs a ON a.word = p.word
  JOIN runs b ON b.frame = a.frame WHERE length(b.word) >= 4 AND length(b.word) <= length(a.word) + 6
  AND {COST} <= CASE WHEN length(a.word) >= 6 THEN 2 ELSE 1 END),
fires AS (SELECT language, word AS token, rule_id, category, severity, review FROM ruled WHERE NOT fuzzy
  UNION ALL SELECT language, token, rule_id, category, severity, review FROM ruled JOIN fuzzy_pairs ON pattern = word WHERE fuzzy)"""
FIRES = f"{RULED}, {PAIRS}"


def _words(spark, sf):
    return inputs.pack_words(spark, sf)


@query("q1_self_firing", f"""WITH {FIRES}
SELECT r.language, r.rule_id, 1::BIGINT AS n_patterns, count(*) FILTER (f.rule_id = r.rule_id) AS n_firing,
  count(*) FILTER (f.rule_id <> r.rule_id) AS n_others_fired
FROM ruled r LEFT JOIN fires f ON f.language = r.language AND f.token = r.word GROUP BY r.language, r.rule_id""")
def self_firing(spark, sf):
    return packqa.self_firing(inputs.word_packs(spark, sf))


# Every other pack allows all of its own spam, and so declares a category it never reaches.
MUTED = "category = 'spam' AND right(language, 1) IN ('0', '2', '4', '6', '8')"


@query("q2_declared_facets", f"""WITH {RULED}
SELECT DISTINCT language, 'category' AS facet, category AS value, NOT ({MUTED}) AS reached FROM ruled WHERE NOT review
UNION SELECT language, 'severity', severity::VARCHAR, bool_or(NOT ({MUTED})) FROM ruled WHERE NOT review GROUP BY language, severity""")
def declared_facets(spark, sf):
    muted = MUTED.replace("category", f"({CATEGORY_OF})").replace("language", "lang")
    return packqa.declared_facets(_with_allow(spark, sf, "word", muted))


@query("q3_acting_review_patterns", f"""WITH {FIRES}
SELECT r.language, r.rule_id, r.word AS pattern, f.rule_id AS acting_rule_id FROM ruled r
JOIN fires f ON f.language = r.language AND f.token = r.word WHERE r.review AND NOT f.review""")
def acting_review(spark, sf):
    return packqa.acting_review_patterns(inputs.word_packs(spark, sf))


CROSS = f"""{FIRES}, crossing AS (SELECT DISTINCT r.language, r.word AS pattern, f.language AS other_language, f.rule_id AS acting_rule_id
  FROM ruled r JOIN fires f ON f.token = r.word AND f.language <> r.language WHERE r.review AND NOT f.review),
known AS (SELECT r.language, word AS pattern, o.language AS other_language FROM ruled r JOIN (SELECT DISTINCT language FROM ruled) o
  ON o.language <> r.language AND split_part(o.language, '-s', 2) = split_part(r.language, '-s', 2) WHERE substr(md5(word), 4, 1) IN ('0', '1', '2', '3', '4'))"""


def _known(spark, sf):
    """Disagreements taken for known: some words, against the packs of their number in other languages."""
    number = lambda c: F.substring_index(c, "-s", -1)
    words = _words(spark, sf)
    some = words.filter("substr(md5(word), 4, 1) IN ('0', '1', '2', '3', '4')").withColumn("number", number("lang"))
    others = words.select(F.col("lang").alias("other_language"), number("lang").alias("number")).distinct()
    return some.join(others, "number").filter("lang <> other_language").select(
        F.col("lang").alias("language"), F.col("word").alias("pattern"), "other_language"
    )


@query("q4_muted_elsewhere", f"""WITH {CROSS} SELECT * FROM crossing
WHERE (language, pattern, other_language) NOT IN (SELECT (language, pattern, other_language) FROM known)""")
def muted_elsewhere(spark, sf):
    return packqa.muted_elsewhere(inputs.word_packs(spark, sf), _known(spark, sf))


@query("q5_settled_disagreements", f"""WITH {CROSS} SELECT * FROM known
WHERE (language, pattern, other_language) NOT IN (SELECT (language, pattern, other_language) FROM crossing)""")
def settled(spark, sf):
    return packqa.settled_disagreements(inputs.word_packs(spark, sf), _known(spark, sf))


def _with_allow(spark, sf, term, where="true"):
    """The word packs with an allow term made from each chosen word."""
    packs = inputs.word_packs(spark, sf)
    terms = _words(spark, sf).filter(where).select(
        F.col("lang").alias("language"), F.lit(0).alias("allow_ord"), F.expr(term).alias("term")
    ).withColumn("n_tokens", F.size(tx.tokens(F.col("term"))))
    kept = materialize(terms, "allow-terms")
    return replace(packs, allow_terms=kept, n_allow=kept.count(), allow_languages=packs.languages)


SHADOW = "CASE WHEN substr(md5(word), 3, 1) = '0' THEN word ELSE concat(word, 'qx') END"


@query("q6_shadowing_allow_terms", f"""WITH {WORDS_SQL} SELECT lang AS language, word AS term FROM words WHERE substr(md5(word), 3, 1) = '0'""")
def shadowing(spark, sf):
    return packqa.shadowing_allow_terms(_with_allow(spark, sf, SHADOW))


@query("q7_idle_allow_terms", f"""WITH {WORDS_SQL} SELECT lang AS language, concat(word, 'qx') AS term, 'suppresses nothing' AS fault
FROM words WHERE substr(md5(word), 3, 1) <> '0'""")
def idle_allow(spark, sf):
    term = "CASE WHEN substr(md5(word), 3, 1) = '0' THEN concat(word, ' ', word) ELSE concat(word, 'qx') END"
    return packqa.idle_allow_terms(_with_allow(spark, sf, term))


# Terms cut short or doubled, as a careless author might list them.
CARELESS = "CASE substr(md5(word), 5, 1) WHEN '0' THEN substr(word, 1, 3) WHEN '1' THEN concat(word, ' ', word) ELSE word END"


def _careless(spark, sf):
    words = _words(spark, sf).select(
        F.col("lang").alias("language"), F.expr(RULE_ID_OF).alias("rule_id"), F.expr(CARELESS).alias("pattern"), F.lit("fuzzy").alias("match_type")
    )
    return words.withColumn("n_tokens", F.size(tx.tokens(F.col("pattern")))).withColumn("n_chars", F.length("pattern"))


@query("q8_unfit_fuzzy", f"""WITH {WORDS_SQL} SELECT lang AS language, {RULE_ID_OF} AS rule_id, {CARELESS} AS pattern FROM words
WHERE substr(md5(word), 5, 1) IN ('0', '1') OR length(word) < 4""")
def unfit_fuzzy(spark, sf):
    return packqa.unfit_fuzzy_patterns(_careless(spark, sf))


@query("q9_adjacent_vowels", f"""WITH {WORDS_SQL},
c AS (SELECT lang, word, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM words),
pairs AS (SELECT *, lag(c) OVER (PARTITION BY lang, word ORDER BY i) AS p FROM c)
SELECT lang AS language, {RULE_ID_OF} AS rule_id, word AS pattern FROM pairs
GROUP BY lang, word HAVING bool_or(p <> c AND regexp_matches(c, '^[{VOWELS_RE}]$') AND regexp_matches(p, '^[{VOWELS_RE}]$'))""")
def adjacent_vowels(spark, sf):
    words = _words(spark, sf).select(
        F.col("lang").alias("language"), F.expr(RULE_ID_OF).alias("rule_id"), F.col("word").alias("pattern"), F.lit("fuzzy").alias("match_type")
    )
    return packqa.uneven_fuzzy_patterns(words)


def _phrase_packs(spark, sf, phrase):
    """The word packs with one more exact rule per word, for a phrase made from it."""
    packs = inputs.word_packs(spark, sf)
    made = _words(spark, sf).select(
        F.col("lang").alias("language"), F.expr(RULE_ID_OF).alias("base_id"), F.expr(phrase).alias("pattern")
    ).filter("pattern IS NOT NULL")
    base = packs.rules.select("language", F.col("rule_id").alias("base_id"), (F.col("rule_ord") + 10_000).alias("rule_ord"))
    numbered = made.join(base, ["language", "base_id"]).withColumn("rule_id", F.concat("base_id", F.lit("-p")))
    rules = numbered.select(
        "language", F.lit(0).alias("pack_ord"), "rule_ord", "rule_id", F.lit("spam").alias("category"),
        F.lit(1).alias("severity"), F.lit("exact").alias("match_type"), F.lit(False).alias("context_required"),
    )
    none = F.lit(None)
    patterns = numbered.select(
        "language", "rule_id", "rule_ord", F.lit("exact").alias("match_type"), F.lit(0).alias("pattern_ord"), "pattern",
        F.col("pattern").alias("source_pattern"), none.cast("string").alias("prefilter"), none.cast("array<array<string>>").alias("literals"),
        F.size(tx.tokens(F.col("pattern"))).alias("n_tokens"), F.length("pattern").alias("n_chars"),
        none.cast("array<string>").alias("run_chars"), none.cast("array<int>").alias("run_lens"), none.cast("string").alias("skeleton"),
    )
    rules, patterns = materialize(rules, "phrase-rules"), materialize(patterns, "phrase-patterns")
    return replace(
        packs, rules=packs.rules.unionByName(rules), patterns=packs.patterns.unionByName(patterns),
        n_patterns=packs.n_patterns + patterns.count(),
    )


TWINNED = "CASE length(word) % 3 WHEN 0 THEN concat('i ll ', word) WHEN 1 THEN concat('ill ', word) ELSE concat('so i ll ', word) END"


@query("q10_contractions", f"""WITH {RULED}, p AS (SELECT language, concat(rule_id, '-p') AS rule_id, {TWINNED} AS pattern FROM ruled WHERE language LIKE 'en-%')
SELECT language, rule_id, pattern, CASE WHEN contains(pattern, 'i ll ') THEN replace(pattern, 'i ll ', 'ill ') ELSE replace(pattern, 'ill ', 'i ll ') END AS twin
FROM p WHERE pattern IS NOT NULL""")
def contractions(spark, sf):
    pairs = (("i ll", "ill"), ("don t", "dont"))
    packs = _phrase_packs(spark, sf, TWINNED)
    english = [language for language in packs.languages if language.startswith("en-")]
    return packqa.missing_contraction_twins(packs, pairs, english)


@query("q11_plain_twins", f"""WITH {RULED} SELECT language, rule_id, word AS pattern, strip_accents(word) AS twin FROM ruled WHERE strip_accents(word) <> word""")
def plain_twins(spark, sf):
    return packqa.missing_plain_twins(inputs.word_packs(spark, sf))


@query("q12_misnamed_rules", f"WITH {RULED} SELECT language, rule_id FROM ruled WHERE rule_id LIKE 'misc.%'")
def misnamed(spark, sf):
    return packqa.misnamed_rules(inputs.word_packs(spark, sf).rules)


@query("q13_unnormalised", f"""WITH {RULED} SELECT language, rule_id, concat(upper(substr(word, 1, 1)), substr(word, 2), '.') AS source_pattern, word AS normalised FROM ruled""")
def unnormalised(spark, sf):
    return packqa.unnormalised_patterns(packs_from_files(inputs.word_pack_files(spark, sf, styled=True)).patterns)


EXPECTED = "CASE lang WHEN 'de' THEN 'de.hate.nicht' WHEN 'en' THEN 'en.hate.thing' WHEN 'es' THEN 'es.spam.mente' ELSE 'fr.hate.etion' END"
EXPECT = "CASE doc_id % 4 WHEN 0 THEN 'flag' WHEN 1 THEN 'alert' WHEN 2 THEN 'silent' ELSE 'inert' END"


@query("q14_corpus", f"""WITH {DOC_MATCHES},
got AS (SELECT doc_id, lang, {EXPECTED} AS rule_id, {EXPECT} AS expect, count(n.rule_id)::INTEGER AS n_hits,
  coalesce(max(CASE WHEN NOT context_required THEN severity END), 0) AS got,
  coalesce(bool_or(n.rule_id = {EXPECTED}), false) AS fired, coalesce(bool_or(n.rule_id = {EXPECTED} AND NOT context_required), false) AS acted
  FROM docs LEFT JOIN named n USING (doc_id) GROUP BY doc_id, lang)
SELECT doc_id AS case_id, lang AS pack, expect, rule_id, 3 AS severity, got, n_hits::BIGINT AS n_hits FROM got
WHERE NOT CASE expect WHEN 'flag' THEN acted AND got = 3 WHEN 'alert' THEN fired AND got = 0 WHEN 'silent' THEN n_hits = 0 ELSE got = 0 END""")
def corpus(spark, sf):
    cases = inputs.table(spark, sf, "documents").select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("pack"), "text", F.expr(EXPECT).alias("expect"),
        F.expr(EXPECTED).alias("rule_id"), F.lit(3).alias("severity"),
    )
    return packqa.corpus_regressions(cases, inputs.neutral_packs(spark))


PINNED = "substr(md5(concat(word, 'pin')), 1, 1) IN ('0', '1', '2')"
PIN_WORD = "CASE WHEN length(word) % 7 = 0 THEN concat(word, 'qx') ELSE word END"


@query("q15_pins", f"""WITH {RULED}, pins AS (SELECT language, {PIN_WORD} AS pattern, {PINNED} AS review FROM ruled)
SELECT p.language, p.pattern, p.review, r.review AS is_review FROM pins p
LEFT JOIN ruled r ON r.language = p.language AND r.word = p.pattern WHERE r.review IS NULL OR r.review <> p.review""")
def pins(spark, sf):
    pinned = _words(spark, sf).select(
        F.col("lang").alias("language"), F.expr(PIN_WORD).alias("pattern"), F.expr(PINNED).alias("review")
    )
    return packqa.broken_pins(inputs.word_packs(spark, sf), pinned)


_CONSONANTS = ", ".join(f"('{c}')" for c in packqa.CONSONANTS)
_VOWELS = ", ".join(f"('{c}')" for c in domains.VOWELS)
TRIED = f"""{RULED}, patterns AS (SELECT language, word AS p, length(word) AS n FROM ruled WHERE fuzzy),
spots AS (SELECT *, substr(p, i, 1) AS c, substr(p, 1, i - 1) AS head, substr(p, i + 1) AS tail, contains('{domains.VOWELS}', substr(p, i, 1)) AS vowel,
  CASE WHEN i > 1 THEN substr(p, i - 1, 1) ELSE '' END AS l, substr(p, i + 1, 1) AS r FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM patterns)),
gaps AS (SELECT *, substr(p, i, 1) AS c, CASE WHEN i > 1 THEN substr(p, i - 1, 1) ELSE '' END AS l FROM (SELECT *, unnest(range(1, n + 2)) AS i FROM patterns)),
twos AS (SELECT *, list_filter(range(1, n + 1), lambda k: contains('{domains.VOWELS}', substr(p, k, 1)))[1:2] AS two FROM patterns),
tried AS (
  SELECT language, p, 'consonant swapped' AS kind, head || x || tail AS token, false AS accepted FROM spots, (VALUES {_CONSONANTS}) AS s(x) WHERE NOT vowel AND c <> x
  UNION ALL SELECT language, p, 'consonant inserted', substr(p, 1, i - 1) || x || substr(p, i), false FROM gaps, (VALUES {_CONSONANTS}) AS s(x) WHERE l <> x AND c <> x
  UNION ALL SELECT language, p, 'consonant dropped', head || tail, false FROM spots WHERE NOT vowel AND c <> l AND c <> r
  UNION ALL SELECT language, p, 'vowel swapped', head || x || tail, true FROM spots, (VALUES {_VOWELS}) AS s(x) WHERE vowel AND c <> x
  UNION ALL SELECT language, p, 'letter held', head || repeat(c, 3) || tail, true FROM spots
  UNION ALL SELECT language, p, 'two vowels swapped', array_to_string(list_transform(range(1, n + 1), lambda k: CASE WHEN NOT list_contains(two, k) THEN substr(p, k, 1)
    WHEN substr(p, k, 1) = 'a' THEN 'u' ELSE 'a' END), ''), n >= 6 FROM twos WHERE len(two) = 2),
vocab AS (SELECT p AS word FROM tried UNION SELECT token FROM tried), {ENCODED}"""


@query("q16_mutations", f"""WITH {TRIED},
judged AS (SELECT t.*, t.token = t.p OR (length(t.token) >= 4 AND length(t.token) <= length(t.p) + 6 AND len(a.cs) = len(b.cs)
  AND {COST} <= CASE WHEN length(t.p) >= 6 THEN 2 ELSE 1 END) AS got
  FROM tried t JOIN runs a ON a.word = t.p JOIN runs b ON b.word = t.token)
SELECT language, kind, accepted, count(*) AS n, count(*) FILTER (accepted = got) AS n_as_promised FROM judged GROUP BY language, kind, accepted""")
def mutations(spark, sf):
    """Kinds of drift tried on every fuzzy word, and how often the answer was the promised one."""
    words = _words(spark, sf).filter(FUZZY_OF).select(
        F.col("lang").alias("language"), F.expr(RULE_ID_OF).alias("rule_id"), F.col("word").alias("pattern")
    )
    from earshot.operators.match import fuzzy_accepts

    tried = packqa.mutations(words).withColumn("got", fuzzy_accepts(F.col("pattern"), F.col("token")))
    return tried.groupBy("language", "kind", "accepted").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("got") == F.col("accepted")).alias("n_as_promised")
    )


PAGE_TEXT = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
PAGE_WORDS = rf"""visible AS (SELECT page_id, trim(regexp_replace(replace(lower(nfc_normalize({PAGE_TEXT})),'ß','ss'),'[^\p{{L}}\p{{N}}]+',' ','g')) AS norm FROM pages),
vocabulary AS (SELECT DISTINCT unnest(string_split(norm, ' ')) AS word FROM visible),
texts AS (SELECT word, 1 AS pass, word AS t, language FROM vocabulary, (VALUES ('de'), ('en'), ('es'), ('fr')) AS l(language) WHERE word <> '')"""


@query("q17_vocabulary_sweep", f"""WITH {PAGE_WORDS}, {hit_ctes('word').replace('words AS', 'spoken_words AS').replace('FROM words', 'FROM spoken_words')}
SELECT word, language AS pack, rule_id, severity, context_required FROM named""")
def vocabulary_sweep(spark, sf):
    pages = inputs.table(spark, sf, "pages").select(
        tx.normalize(F.regexp_replace("html", "<[^>]*>", " ")).alias("norm")
    )
    return packqa.vocabulary_hits(pages, inputs.neutral_packs(spark))


DOUBLED = "concat(word, ' ', word)"


@query("q18_defeated_phrases", f"""WITH {FIRES}
SELECT r.language, concat(r.rule_id, '-p') AS rule_id, concat(word, ' ', word) AS pattern, f.rule_id AS matched_rule_id
FROM ruled r JOIN fires f ON f.language = r.language AND f.token = r.word""")
def defeated(spark, sf):
    return packqa.defeated_phrases(_phrase_packs(spark, sf, DOUBLED))


@query("q19_silent_terms", f"""WITH {RULED}
SELECT language, rule_id, word AS pattern, 'okay so {{}} right' AS carrier FROM ruled WHERE substr(md5(word), 8, 1) = '0'""")
def silent(spark, sf):
    packs = _with_allow(spark, sf, "concat('okay so ', word, ' right')", "substr(md5(word), 8, 1) = '0'")
    return packqa.silent_terms(packs)
