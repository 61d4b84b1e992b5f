"""Quality jobs over rule packs. Each gives the rows that break a promise; none means it holds.

Patterns, mutations and carrier sentences become texts, and go through the same
matching as speech does.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import domains
from earshot.functions import text as tx
from earshot.operators import match
from earshot.operators.verdict import acting_severity
from earshot.plans.sizing import broadcast_counted
from earshot.sources.packs import RulePacks

#: Letters a mutation puts in a pattern's place or between its letters.
CONSONANTS = "".join(c for c in string.ascii_lowercase if c not in domains.VOWELS)


def listed(packs: RulePacks, with_regex: bool = False) -> DataFrame:
    """Patterns with their rule's tier, category and severity."""
    rules = packs.rules.select(
        "language", "rule_ord", "category", "severity", "context_required"
    )
    patterns = packs.patterns if with_regex else packs.patterns.filter("match_type <> 'regex'")
    return patterns.select(
        "language", "rule_id", "rule_ord", "match_type", "pattern_ord", "pattern", "n_tokens",
        "n_chars",
    ).join(broadcast_counted(rules, packs.n_patterns), ["language", "rule_ord"])


def run_texts(cases: DataFrame, packs: RulePacks, case_keys: Sequence[str], short: bool = True) -> DataFrame:
    """Matches for (case_keys, text, pack): each case's text in one given pack.

    short texts are made of a pattern; others may be as long as a document.
    """
    ready = cases.select(
        *case_keys, tx.normalize(F.col("text")).alias("norm"), F.array("pack").alias("run_packs")
    )
    return match.match_texts(ready, packs, case_keys, short=short).withColumnRenamed("language", "pack").withColumnsRenamed(
        {c: f"hit_{c}" for c in ("rule_id", "rule_ord", "category", "severity", "context_required")}
    )


def _case(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("case_id", F.sha2(F.to_json(F.struct(*columns)), 256))


def _severity_per_case(hits: DataFrame) -> DataFrame:
    return hits.groupBy("case_id").agg(
        acting_severity("hit_severity", "hit_context_required").alias("got"),
        F.count(F.lit(1)).alias("n_hits"),
        F.collect_set("hit_rule_id").alias("rule_ids"),
    )


def _self_hits(packs: RulePacks) -> tuple[DataFrame, DataFrame]:
    """(patterns as cases, their matches in their own pack)."""
    cases = _case(
        listed(packs).withColumns({"text": F.col("pattern"), "pack": F.col("language")}),
        "language", "rule_id", "pattern_ord",
    )
    return cases, run_texts(cases, packs, ["case_id"])


def self_firing(packs: RulePacks) -> DataFrame:
    """Per rule, regexes aside: its patterns, those that fire it, and what else they fire."""
    cases, hits = _self_hits(packs)
    own = F.col("hit_rule_id") == F.col("rule_id")
    return cases.join(hits, "case_id", "left").groupBy("language", "rule_id").agg(
        F.count_distinct("case_id").alias("n_patterns"),
        F.count_if(own).alias("n_firing"),
        F.count_if(~own).alias("n_others_fired"),
    )


def dead_rules(packs: RulePacks) -> DataFrame:
    """Rules, regexes aside, that match none of their own patterns."""
    return self_firing(packs).filter("n_firing = 0").select("language", "rule_id")


def declared_facets(packs: RulePacks) -> DataFrame:
    """(language, facet, value, reached) for the categories and severities declared for action."""

    def facets(df: DataFrame, category: str, severity: str) -> DataFrame:
        pair = F.array(
            F.struct(F.lit("category").alias("facet"), F.col(category).alias("value")),
            F.struct(F.lit("severity").alias("facet"), F.col(severity).cast("string").alias("value")),
        )
        return df.select("language", F.inline(pair)).distinct()

    automatic = packs.rules.filter("NOT context_required")
    cases, hits = _self_hits(packs)
    reached = cases.filter("NOT context_required").join(hits, "case_id").filter("hit_rule_id = rule_id")
    # A regex rule proved itself with its probe when the pack was read.
    by_regex = packs.rules.filter("match_type = 'regex'")
    covered = facets(reached, "category", "severity").unionByName(facets(by_regex, "category", "severity"))
    declared = facets(automatic, "category", "severity")
    return declared.join(
        covered.distinct().withColumn("reached", F.lit(True)), ["language", "facet", "value"], "left"
    ).fillna({"reached": False})


def unreached_declarations(packs: RulePacks) -> DataFrame:
    """Categories and severities a pack declares for action and never reaches."""
    return declared_facets(packs).filter("NOT reached").drop("reached")


def acting_review_patterns(packs: RulePacks) -> DataFrame:
    """Review-tier patterns that set off an automatic rule of their own pack."""
    cases, hits = _self_hits(packs)
    review = cases.filter("context_required").select("case_id", "language", "rule_id", "pattern")
    acting = hits.filter("NOT hit_context_required")
    return review.join(acting, "case_id").select(
        "language", "rule_id", "pattern", F.col("hit_rule_id").alias("acting_rule_id")
    )


def _cross_pack_actions(packs: RulePacks) -> DataFrame:
    """(language, pattern, other_language, acting_rule_id) for review words others act on."""
    words = listed(packs).filter("context_required AND n_tokens = 1").select("language", "pattern").distinct()
    cases = _case(words, "language", "pattern")
    every = F.array(F.lit(match.EVERY_PACK)).alias("run_packs")
    texts = cases.select("case_id", every, tx.normalize(F.col("pattern")).alias("norm"))
    hits = match.match_texts(texts, packs, ["case_id"], short=True, every_pack=True).filter("NOT context_required")
    return cases.join(
        hits.select("case_id", F.col("language").alias("other_language"), F.col("rule_id").alias("acting_rule_id")),
        "case_id",
    ).filter("language <> other_language").select("language", "pattern", "other_language", "acting_rule_id")


def muted_elsewhere(packs: RulePacks, known: DataFrame) -> DataFrame:
    """Single review-tier words that another pack acts on, known disagreements aside.

    known is (language, pattern, other_language).
    """
    return _cross_pack_actions(packs).join(
        known, ["language", "pattern", "other_language"], "left_anti"
    )


def settled_disagreements(packs: RulePacks, known: DataFrame) -> DataFrame:
    """Known disagreements that are none any more."""
    real = _cross_pack_actions(packs).select("language", "pattern", "other_language")
    return known.join(real, ["language", "pattern", "other_language"], "left_anti")


def shadowing_allow_terms(packs: RulePacks) -> DataFrame:
    """Allow terms equal to a listed pattern, which then can never fire."""
    patterns = packs.patterns.select("language", F.col("pattern").alias("term"))
    return packs.allow_terms.join(patterns, ["language", "term"], "left_semi").select("language", "term")


def idle_allow_terms(packs: RulePacks) -> DataFrame:
    """Allow terms that suppress nothing, or do not suppress all of their own matches."""
    cases = _case(
        packs.allow_terms.select("language", "term", F.col("term").alias("text"), F.col("language").alias("pack")),
        "language", "term",
    )
    without = run_texts(cases, packs.without_allow(), ["case_id"]).select("case_id").distinct()
    still = run_texts(cases, packs, ["case_id"]).select("case_id").distinct()
    idle = cases.join(without, "case_id", "left_anti").withColumn("fault", F.lit("suppresses nothing"))
    leaky = cases.join(still, "case_id", "left_semi").withColumn("fault", F.lit("still matches"))
    return idle.unionByName(leaky).select("language", "term", "fault")


def unfit_fuzzy_patterns(patterns: DataFrame) -> DataFrame:
    """Fuzzy patterns of several tokens or too few characters. Takes a patterns table."""
    return patterns.filter(
        (F.col("match_type") == "fuzzy")
        & ((F.col("n_tokens") > 1) | (F.col("n_chars") < domains.FUZZY_MIN_CHARS))
    ).select("language", "rule_id", "pattern")


def adjacent_vowels(pattern: Column) -> Column:
    """Are two different vowels side by side? Swapping one into the other merges runs."""
    chars = F.split(pattern, "")
    pairs = F.zip_with(
        F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))),
        F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))),
        lambda a, b: tx.is_vowel(a) & tx.is_vowel(b) & (a != b),
    )
    return F.exists(pairs, lambda p: p)


def uneven_fuzzy_patterns(patterns: DataFrame) -> DataFrame:
    """Fuzzy patterns whose tolerance is uneven because of adjacent different vowels."""
    return patterns.filter((F.col("match_type") == "fuzzy") & adjacent_vowels(F.col("pattern"))).select(
        "language", "rule_id", "pattern"
    )


def missing_contraction_twins(
    packs: RulePacks, pairs: Sequence[tuple[str, str]], languages: Sequence[str] = ("en",)
) -> DataFrame:
    """Patterns with one spelling of a contraction whose rule lacks the other.

    pairs is (spaced, joined); each pattern is checked against every pair that occurs
    in it, the spaced spelling first.
    """
    own = listed(packs).filter(F.col("language").isin(*languages)).select("language", "rule_id", "pattern")

    def has(word: Column) -> Column:
        return F.startswith(F.col("pattern"), F.concat(word, F.lit(" "))) | F.contains(
            F.col("pattern"), F.concat(F.lit(" "), word, F.lit(" "))
        )

    spaced, joined = F.col("spaced"), F.col("joined")
    twin = F.when(has(spaced), tx.replace_word_once(F.col("pattern"), spaced, joined)).when(
        has(joined), tx.replace_word_once(F.col("pattern"), joined, spaced)
    )
    both = F.array(*[F.struct(F.lit(s).alias("spaced"), F.lit(j).alias("joined")) for s, j in pairs])
    expected = (
        own.select("language", "rule_id", "pattern", F.inline(both))
        .withColumn("twin", twin)
        .filter("twin IS NOT NULL")
    )
    present = own.select("language", "rule_id", F.col("pattern").alias("twin"))
    return expected.join(present, ["language", "rule_id", "twin"], "left_anti").select(
        "language", "rule_id", "pattern", "twin"
    )


def missing_plain_twins(packs: RulePacks) -> DataFrame:
    """Patterns with marks whose rule lacks the spelling without them."""
    own = listed(packs).select("language", "rule_id", "pattern")
    marked = own.withColumn("twin", tx.without_marks(F.col("pattern"))).filter("twin <> pattern")
    present = own.select("language", "rule_id", F.col("pattern").alias("twin"))
    return marked.join(present, ["language", "rule_id", "twin"], "left_anti").select(
        "language", "rule_id", "pattern", "twin"
    )


def misnamed_rules(rules: DataFrame) -> DataFrame:
    """Rule ids that do not start with their pack's language."""
    return rules.filter(
        ~F.startswith(F.col("rule_id"), F.concat(F.col("language"), F.lit(".")))
    ).select("language", "rule_id")


def unnormalised_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns not written the way they are matched. Regex sources are their own matter."""
    plain = patterns.filter("match_type <> 'regex'").withColumn(
        "normalised", tx.normalize(F.col("source_pattern"))
    )
    return plain.filter("normalised <> source_pattern").select(
        "language", "rule_id", "source_pattern", "normalised"
    )


def corpus_regressions(corpus: DataFrame, packs: RulePacks) -> DataFrame:
    """Labelled texts that come out otherwise than labelled.

    corpus is (case_id, pack, text, expect, rule_id, severity). expect is "flag": the
    rule acts at this severity; "alert": the rule fires and nothing acts; "silent":
    nothing matches; "inert": something may match and nothing acts.
    """
    hits = run_texts(corpus, packs, ["case_id"], short=False)
    got = _severity_per_case(hits).join(
        hits.groupBy("case_id").agg(
            F.collect_set(F.when(~F.col("hit_context_required"), F.col("hit_rule_id"))).alias("acting_ids")
        ),
        "case_id",
    )
    none = F.array().cast("array<string>")
    joined = corpus.join(got, "case_id", "left").select(
        corpus["*"],
        F.coalesce("got", F.lit(0)).alias("got"),
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.coalesce("rule_ids", none).alias("rule_ids"),
        F.coalesce("acting_ids", none).alias("acting_ids"),
    )
    fired = F.array_contains("rule_ids", F.col("rule_id"))
    acted = F.array_contains("acting_ids", F.col("rule_id"))
    as_labelled = (
        F.when(F.col("expect") == "flag", acted & (F.col("got") == F.col("severity")))
        .when(F.col("expect") == "alert", fired & (F.col("got") == 0))
        .when(F.col("expect") == "silent", F.col("n_hits") == 0)
        .when(F.col("expect") == "inert", F.col("got") == 0)
    )
    return joined.filter(~F.coalesce(as_labelled, F.lit(False))).select(
        "case_id", "pack", "expect", "rule_id", "severity", "got", "n_hits"
    )


def broken_pins(packs: RulePacks, pins: DataFrame) -> DataFrame:
    """Pins (language, pattern, review BOOLEAN) whose pattern is gone or changed tier."""
    tiers = listed(packs, with_regex=True).groupBy("language", "pattern").agg(
        F.min_by("context_required", F.struct("rule_ord", "pattern_ord")).alias("is_review")
    )
    return pins.join(tiers, ["language", "pattern"], "left").filter(
        F.col("is_review").isNull() | (F.col("is_review") != F.col("review"))
    ).select("language", "pattern", "review", "is_review")


# --- mutations ---------------------------------------------------------------------


def _chars_of(text: str) -> Column:
    return F.array(*map(F.lit, text))


def mutations(fuzzy: DataFrame) -> DataFrame:
    """(language, rule_id, pattern, kind, token, accepted): drift a fuzzy pattern must take or refuse.

    fuzzy is (language, rule_id, pattern).
    """
    p, i = F.col("pattern"), F.col("i")
    n = F.length(p)
    char = F.substring(p, i, F.lit(1))
    before, after = F.substring(p, F.lit(1), i - 1), F.substring(p, i + 1, n)
    left, right = F.substring(p, i - 1, F.lit(1)), F.substring(p, i + 1, F.lit(1))
    left = F.when(i > 1, left).otherwise("")
    vowel = F.lit(domains.VOWELS).contains(char)
    at = fuzzy.select("language", "rule_id", "pattern", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    gaps = fuzzy.select("language", "rule_id", "pattern", F.explode(F.sequence(F.lit(1), n + 1)).alias("i"))
    consonants = at.withColumn("r", F.explode(_chars_of(CONSONANTS)))
    vowels = at.withColumn("r", F.explode(_chars_of(domains.VOWELS)))
    inserts = gaps.withColumn("r", F.explode(_chars_of(CONSONANTS)))
    r = F.col("r")

    def made(df: DataFrame, kind: str, token: Column, accepted: bool) -> DataFrame:
        return df.select(
            "language", "rule_id", "pattern", F.lit(kind).alias("kind"), token.alias("token"),
            F.lit(accepted).alias("accepted"),
        )

    swapped = made(consonants.filter(~vowel & (char != r)), "consonant swapped", F.concat(before, r, after), False)
    inserted = made(
        inserts.filter((left != r) & (F.substring(p, i, F.lit(1)) != r)), "consonant inserted",
        F.concat(before, r, F.substring(p, i, n)), False,
    )
    dropped = made(
        at.filter(~vowel & (char != left) & (char != right)), "consonant dropped",
        F.concat(before, after), False,
    )
    drifted = made(vowels.filter(vowel & (char != r)), "vowel swapped", F.concat(before, r, after), True)
    held = made(at, "letter held", F.concat(before, F.repeat(char, F.lit(3)), after), True)
    first_two = F.slice(
        F.filter(F.sequence(F.lit(1), n), lambda k: F.lit(domains.VOWELS).contains(F.substring(p, k, F.lit(1)))), 1, 2
    )
    doubled = fuzzy.withColumn("two", first_two).filter(F.size("two") == 2)
    rewritten = F.array_join(
        F.transform(
            F.split(p, ""),
            lambda c, k: F.when(
                F.array_contains("two", k + 1), F.when(c == "a", F.lit("u")).otherwise(F.lit("a"))
            ).otherwise(c),
        ),
        "",
    )
    both = doubled.select(
        "language", "rule_id", "pattern", F.lit("two vowels swapped").alias("kind"),
        rewritten.alias("token"), (n >= domains.FUZZY_WIDE_BUDGET_CHARS).alias("accepted"),
    )
    parts = [inserted, dropped, drifted, held, both]
    out = swapped
    for part in parts:
        out = out.unionByName(part)
    return out


def mutation_failures(fuzzy: DataFrame) -> DataFrame:
    """Mutations the fuzzy comparison decides otherwise than it should."""
    tried = mutations(fuzzy).withColumn("got", match.fuzzy_accepts(F.col("pattern"), F.col("token")))
    return tried.filter("got <> accepted")


# --- corpora and carriers ----------------------------------------------------------


def vocabulary_hits(texts: DataFrame, packs: RulePacks, text: str = "norm") -> DataFrame:
    """Distinct words of a corpus that any pack matches: the false-positive surface.

    Words are deduplicated before they are matched, so a common one costs no more than
    a rare one.
    """
    words = texts.select(F.explode(tx.tokens(F.col(text))).alias("word")).filter("word <> ''").distinct()
    every = F.array(*map(F.lit, packs.languages)).cast("array<string>")
    ready = words.withColumn("run_packs", every).withColumn("norm", F.col("word"))
    return match.match_texts(ready, packs, ["word"]).select(
        "word", F.col("language").alias("pack"), "rule_id", "severity", "context_required"
    )


def defeated_phrases(packs: RulePacks, filler: str = "uh") -> DataFrame:
    """Exact phrases that still match with a filler word after their first: none should."""
    phrases = listed(packs).filter("match_type = 'exact' AND n_tokens > 1").withColumns(
        {
            "text": F.regexp_replace("pattern", "^([^ ]+) ", f"$1 {filler} "),
            "pack": F.col("language"),
        }
    )
    cases = _case(phrases, "language", "rule_id", "pattern_ord")
    return cases.join(run_texts(cases, packs, ["case_id"]), "case_id").select(
        "language", "rule_id", "pattern", F.col("hit_rule_id").alias("matched_rule_id")
    )


def silent_terms(packs: RulePacks, carriers: Sequence[str] = ("{}", "okay so {} right")) -> DataFrame:
    """Listed terms that do not flag alone, or inside an ordinary sentence."""
    sentences = F.array(*[
        F.struct(
            F.lit(c).alias("carrier"),
            F.concat(F.lit(c.split("{}")[0]), F.col("pattern"), F.lit(c.split("{}")[1])).alias("text"),
        )
        for c in carriers
    ])
    cases = _case(
        listed(packs).select("*", F.col("language").alias("pack"), F.inline(sentences)),
        "language", "rule_id", "pattern_ord", "carrier",
    )
    got = _severity_per_case(run_texts(cases, packs, ["case_id"]))
    joined = cases.join(got, "case_id", "left")
    fires = F.coalesce(F.array_contains("rule_ids", F.col("rule_id")), F.lit(False))
    acts = F.col("context_required") | (F.coalesce("got", F.lit(0)) >= F.col("severity"))
    return joined.filter(~(fires & acts)).select("language", "rule_id", "pattern", "carrier")


def rule_statistics(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rules and patterns per language, match type, category, severity and tier."""
    per_rule = patterns.groupBy("language", "rule_id").agg(F.count(F.lit(1)).alias("n_patterns"))
    return rules.join(per_rule, ["language", "rule_id"], "left").groupBy(
        "language", "match_type", "category", "severity", "context_required"
    ).agg(F.count(F.lit(1)).alias("n_rules"), F.sum("n_patterns").alias("n_patterns"))
