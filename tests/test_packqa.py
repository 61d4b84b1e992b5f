import model
import pytest
from conftest import rule
from pyspark.sql import functions as F

from earshot.operators import match, packqa


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def two_packs(make_packs):
    return make_packs({
        "de": ([rule("de.a", "exact", "pedra", review=True, severity=3), rule("misc.b", "exact", "stein")], []),
        "en": ([
            rule("en.a", "exact", "pedra", severity=2), rule("en.b", "exact", "i ll go", "dont go", "don t go"),
            rule("en.c", "fuzzy", "banana", severity=3), rule("en.d", "exact", "bonana", review=True),
            rule("en.e", "exact", "čaj", "čau", "cau"), rule("en.f", "regex", "zzz+", probe="zzz", category="hate"),
            rule("en.g", "exact", "Big Word"),
        ], ["pedra garden", "quiet phrase"]),
    })


def test_tier_jobs(spark, make_packs):
    packs = two_packs(make_packs)
    assert rows(packqa.acting_review_patterns(packs), "language", "pattern", "acting_rule_id") == [("en", "bonana", "en.c")]
    none = spark.createDataFrame([], "language string, pattern string, other_language string")
    known = spark.createDataFrame([("de", "pedra", "en"), ("de", "stein", "en")], none.schema)
    assert rows(packqa.muted_elsewhere(packs, none), "language", "pattern", "other_language", "acting_rule_id") == [("de", "pedra", "en", "en.a")]
    assert rows(packqa.muted_elsewhere(packs, known), "pattern") == []
    assert rows(packqa.settled_disagreements(packs, known), "pattern") == [("stein",)]


def test_words_held_against_very_many_packs_are_shuffled(spark, make_packs):
    from dataclasses import replace

    packs = two_packs(make_packs)
    none = spark.createDataFrame([], "language string, pattern string, other_language string")
    known = spark.createDataFrame([("de", "pedra", "en"), ("de", "stein", "en")], none.schema)
    for job, given in ((packqa.muted_elsewhere, none), (packqa.settled_disagreements, known)):
        many = job(replace(packs, n_patterns=10_000_000), given)
        plan = many._jdf.queryExecution().optimizedPlan().toString()
        # Neither slices of the patterns for the driver to gather, nor a list of all packs.
        assert "broadcast" not in plan and "array_position" not in plan
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, job(packs, given).collect())) != []


def test_coverage_jobs(make_packs):
    packs = two_packs(make_packs)
    assert rows(packqa.dead_rules(packs), "rule_id") == []
    assert rows(packqa.unreached_declarations(packs), "value") == []
    assert rows(packqa.idle_allow_terms(packs), "term", "fault") == [("quiet phrase", "suppresses nothing")]
    assert rows(packqa.shadowing_allow_terms(packs), "term") == []
    assert rows(packqa.silent_terms(packs), "pattern") == []
    assert rows(packqa.defeated_phrases(packs), "pattern") == []


def test_authoring_jobs(spark, make_packs):
    packs = two_packs(make_packs)
    assert rows(packqa.misnamed_rules(packs.rules), "rule_id") == [("misc.b",)]
    assert rows(packqa.unnormalised_patterns(packs.patterns), "source_pattern", "normalised") == [("Big Word", "big word")]
    assert rows(packqa.missing_plain_twins(packs), "pattern", "twin") == [("čaj", "caj")]
    pairs = (("i ll", "ill"), ("don t", "dont"))
    assert rows(packqa.missing_contraction_twins(packs, pairs), "pattern", "twin") == [("i ll go", "ill go")]
    table = spark.createDataFrame([("en", "r", "fuzzy", p, len(p.split()), len(p)) for p in ("abc", "two words", "boat", "banana", "bóo")],
                                  "language string, rule_id string, match_type string, pattern string, n_tokens int, n_chars int")
    assert rows(packqa.unfit_fuzzy_patterns(table), "pattern") == [("abc",), ("bóo",), ("two words",)]
    assert rows(packqa.uneven_fuzzy_patterns(table), "pattern") == [("boat",), ("bóo",)]


def test_corpus_and_pins(spark, make_packs):
    packs = two_packs(make_packs)
    cases = [
        (1, "en", "a pedra", "flag", "en.a", 2), (2, "en", "a pedra", "flag", "en.a", 3), (3, "de", "pedra", "alert", "de.a", 0),
        (4, "en", "pedra", "alert", "en.a", 0), (5, "en", "hello", "silent", None, 0), (6, "de", "Pedra!", "silent", None, 0),
        (7, "de", "pedra", "inert", None, 0), (8, "en", "bonana", "inert", None, 0),
    ]
    corpus = spark.createDataFrame(cases, "case_id int, pack string, text string, expect string, rule_id string, severity int")
    assert [r[0] for r in rows(packqa.corpus_regressions(corpus, packs), "case_id")] == [2, 4, 6, 8]
    pins = spark.createDataFrame([("de", "pedra", True), ("en", "pedra", True), ("en", "gone", False)], "language string, pattern string, review boolean")
    assert rows(packqa.broken_pins(packs, pins), "language", "pattern") == [("en", "gone"), ("en", "pedra")]


def test_mutations_against_the_model(spark):
    words = ["banana", "kilos", "nagas", "strand"]
    fuzzy = spark.createDataFrame([("en", "r", w) for w in words], "language string, rule_id string, pattern string")
    tried = packqa.mutations(fuzzy).collect()
    kinds = {r.kind for r in tried}
    assert kinds == {"consonant swapped", "consonant inserted", "consonant dropped", "vowel swapped", "letter held", "two vowels swapped"}
    failures = {(r.pattern, r.token) for r in packqa.mutation_failures(fuzzy).collect()}
    assert failures == {(r.pattern, r.token) for r in tried if model.fuzzy(r.pattern, r.token) != r.accepted}
    assert failures == set()
    held = {r.token for r in tried if r.kind == "letter held" and r.pattern == "kilos"}
    assert held == {"kkkilos", "kiiilos", "kiloos".replace("oo", "ooo"), "killlos", "kilosss"}


def test_vocabulary_sweep(spark, make_packs):
    texts = spark.createDataFrame([("bonano and pedra pedra",), ("",), ("zzzz",)], "norm string")
    got = rows(packqa.vocabulary_hits(texts, two_packs(make_packs)), "word", "pack", "rule_id")
    assert got == [("bonano", "en", "en.c"), ("pedra", "de", "de.a"), ("pedra", "en", "en.a"), ("zzzz", "en", "en.f")]


def test_statistics(make_packs):
    packs = two_packs(make_packs)
    got = packqa.rule_statistics(packs.rules, packs.patterns).agg(F.sum("n_rules"), F.sum("n_patterns")).first()
    assert tuple(got) == (9, 13)


def test_short_texts_meet_a_large_table_by_a_shuffle(make_packs, monkeypatch):
    packs = two_packs(make_packs)
    columns = ("language", "rule_id", "n_patterns", "n_firing", "n_others_fired")
    small = rows(packqa.self_firing(packs), *columns)
    monkeypatch.setattr(match, "broadcast_counted", lambda df, n, m=0: df)
    monkeypatch.setattr(match, "broadcast_slices", lambda df, n, m=0: pytest.fail("a pass over the texts for each slice"))
    assert rows(packqa.self_firing(packs), *columns) == small


def test_texts_are_joined_by_their_own_pack(make_packs):
    packs = two_packs(make_packs)
    cases, hits = packqa._self_hits(packs)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    # A word or skeleton of every pack meets those of its own pack only.
    assert "Join [probe" in plan and ", run_packs" in plan.split("Join [probe")[1].split("]")[0]
