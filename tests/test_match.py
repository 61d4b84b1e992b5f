import random
import re

import model
import pytest
from conftest import rule
from pyspark.sql import functions as F

from earshot.functions import text as tx
from earshot.operators import match, verdict


def found(spark, packs, texts, run_packs):
    df = spark.createDataFrame([(i, t, run_packs) for i, t in enumerate(texts)], "id int, text string, run_packs array<string>")
    df = df.withColumn("norm", tx.normalize(F.col("text")))
    rows = match.match_texts(df, packs, ["id"]).orderBy("id", "pack_ord", "pass", "rule_ord").collect()
    out = {i: [] for i in range(len(texts))}
    for r in rows:
        out[r.id].append((r.rule_id, r.matched_text))
    return out


RULES = [
    rule("en.a", "exact", "kill it", "it", "kill it now it"),
    rule("en.b", "contains", "an an", "nan"),
    rule("en.c", "regex", r"\b(?:ban|pan)\w*", r"kill\s+\w", probe="banana"),
    rule("en.d", "fuzzy", "banana", "kilo"),
    rule("en.e", "exact", "banana", review=True, severity=3),
    rule("en.f", "exact", "kys", severity=2),
    rule("en.g", "regex", r"n (?:it|a)", probe="n it"),
    rule("en.h", "contains", "it now i"),
]
ALLOW = ["kill it now", "banana pan", "it"[:1] + "t it", "bonana"]


def test_random_texts_match_the_model(spark, make_packs):
    packs = make_packs({"en": (RULES, ALLOW)})
    rng = random.Random(11)
    words = ["kill", "it", "now", "banana", "bananna", "b4nana", "b1nana", "bandna", "bonano", "bonana",
             "pan", "nan", "an", "k", "y", "s", "kys", "kilo", "kylo", "k1lo", "ban", "x", "1", "baaaaaaaaaanana"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    got = found(spark, packs, texts, ["en"])
    for i, text in enumerate(texts):
        assert got[i] == model.matches(text, RULES, ALLOW), text


def test_rules_without_allow(spark, make_packs):
    packs = make_packs({"en": (RULES, [])})
    texts = ["kill it now it", "pan banana nan an an", "k y s kys", "", "!!!"]
    got = found(spark, packs, texts, ["en"])
    for i, text in enumerate(texts):
        assert got[i] == model.matches(text, RULES, []), text


def test_fuzzy_pairs_match_the_model(spark):
    rng = random.Random(5)
    patterns = ["banana", "kilo", "běžný", "nagas", "o0ze", "aabbcc"]
    def drift(word):
        out = list(word)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(out))
            out[at] = rng.choice(["a", "e", "í", "1", "0", "3", "4", "z", "", out[at] * 2, out[at] * 4])
        return "".join(out)
    pairs = [(p, drift(p)) for p in patterns for _ in range(400)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, t string")
    got = df.orderBy("i").select(
        match.fuzzy_accepts(F.col("p"), F.col("t")), tx.skeleton(F.col("p")) == tx.skeleton(F.col("t"))
    ).collect()
    for (p, t), (accepted, same_skeleton) in zip(pairs, got):
        assert accepted == model.fuzzy(p, t), (p, t)
        assert same_skeleton or not accepted, (p, t)


def test_packs_report_in_the_order_asked_for(spark, make_packs):
    packs = make_packs({"de": ([rule("de.x", "exact", "word")], []), "en": ([rule("en.x", "exact", "word")], [])})
    assert [r for r, _ in found(spark, packs, ["a word"], ["en", "de"])[0]] == ["en.x", "de.x"]
    assert [r for r, _ in found(spark, packs, ["a word"], ["de", "en"])[0]] == ["de.x", "en.x"]
    assert found(spark, packs, ["a word"], [])[0] == []


def test_allow_is_per_language(spark, make_packs):
    packs = make_packs({
        "de": ([rule("de.x", "exact", "niger")], ["the niger river"]),
        "en": ([rule("en.x", "exact", "niger")], []),
    })
    assert [r for r, _ in found(spark, packs, ["the niger river"], ["de", "en"])[0]] == ["en.x"]


def test_sliced_patterns_find_the_same(spark, make_packs, monkeypatch):
    packs = make_packs({"en": (RULES, ALLOW)})
    texts = ["kill it now it banana pan", "b4nana kylo k y s"]
    whole = found(spark, packs, texts, ["en"])
    monkeypatch.setattr(match, "broadcast_slices", lambda df, n: __import__(
        "earshot.plans.sizing", fromlist=["x"]).broadcast_slices(df, n, 3))
    assert found(spark, packs, texts, ["en"]) == whole


def test_only_hits_are_shuffled_and_once(spark, packs):
    df = spark.range(100).select("id", F.lit("attion of the").alias("norm"), F.array(F.lit("en")).alias("run_packs"))
    plan = match.match_texts(df, packs, ["id"])._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("LocalTableScan")[0] + plan
    assert plan.count("Exchange hashpartitioning(id") <= 2  # the duplicated head counts it twice
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("grams_from", [1, 200])
def test_tokens_are_looked_up_in_generated_code(spark, make_packs, monkeypatch, grams_from):
    monkeypatch.setattr(match, "GRAMS_FROM", grams_from)
    packs = make_packs({"en": (RULES, ALLOW)})
    df = spark.createDataFrame([(1, "clean text")], "id int, norm string").withColumn("run_packs", F.array(F.lit("en")))
    hits = match.all_hits(df, packs, ["id"])
    hits.collect()
    final = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Else each token is written out with its whole text, and a long text with the square of its length.
    assert re.findall(r"(\*\(\d+\) )?BroadcastHashJoin", final) and all(re.findall(r"(\*\(\d+\) )?BroadcastHashJoin", final))


def _verdicts(spark, packs, texts, classifier=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, norm string")
    df = df.withColumn("run_packs", F.array(*map(F.lit, packs.languages))).withColumn("verdict_language", F.lit("en"))
    found_rows = match.match_texts(df, packs, ["id"])
    return {r.id: r for r in verdict.verdicts(df, found_rows, ["id"], classifier=classifier).collect()}


def test_review_tier_never_raises_severity(spark, make_packs):
    packs = make_packs({"en": ([
        rule("en.r", "exact", "alpha", severity=3, review=True), rule("en.a", "exact", "beta", severity=1),
    ], [])})
    got = _verdicts(spark, packs, ["alpha beta", "alpha", "gamma", ""])
    assert [(got[i].severity, got[i].n_matches, got[i].confidence) for i in range(4)] == [
        (1, 2, 1.0), (0, 1, 1.0), (0, 0, 0.0), (0, 0, 0.0)]
    assert got[0].matches[0].rule_id == "en.r"


def test_classifier_hook(spark, make_packs):
    packs = make_packs({"en": ([rule("en.a", "exact", "beta", severity=1)], [])})

    def scorer(category="hate", confidence=0.9):
        def score(transcript, language):
            return F.when(transcript.contains("gamma"), F.struct(
                F.lit(category).alias("category"), F.lit(2).alias("severity"),
                F.lit(confidence).alias("confidence"), F.lit("gamma").alias("matched_text"),
                language.alias("language")))
        return score

    got = _verdicts(spark, packs, ["beta", "gamma", "beta gamma", "x"], scorer())
    assert [(got[i].severity, got[i].n_matches, got[i].confidence) for i in range(4)] == [
        (1, 1, 1.0), (2, 1, 0.9), (2, 2, 1.0), (0, 0, 0.0)]
    assert got[2].matches[1].rule_id == "tier2a.local-toxicity"
    with pytest.raises(Exception, match="invalid toxicity classifier result"):
        _verdicts(spark, packs, ["gamma"], scorer("rude"))
    with pytest.raises(Exception, match="invalid toxicity classifier result"):
        _verdicts(spark, packs, ["gamma"], scorer(confidence=1.5))


def test_classifier_as_a_pandas_udf(spark, make_packs):
    import pandas as pd

    from earshot import schemas

    @F.pandas_udf(schemas.TOXICITY)
    def score(transcripts: pd.Series, languages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "category": "threat", "severity": 3, "confidence": 0.5, "matched_text": transcripts.str[:3], "language": languages,
        })

    def scorer(transcript, language):
        return F.when(transcript.contains("gamma"), score(transcript, language))

    packs = make_packs({"en": ([rule("en.a", "exact", "beta", severity=1)], [])})
    got = _verdicts(spark, packs, ["beta", "gamma rays"], scorer)
    assert [(got[i].severity, got[i].confidence) for i in range(2)] == [(1, 1.0), (3, 0.5)]
    assert got[1].matches[0].matched_text == "gam"


def test_bucketed_texts_are_not_shuffled(spark, packs, tmp_path):
    from earshot.plans.moderation import stage_normalized

    spark.sql("CREATE DATABASE IF NOT EXISTS staged LOCATION '%s'" % (tmp_path / "db"))
    texts = spark.range(50).select("id", F.lit("attion of the").alias("text"),
                                   F.array(F.lit("en")).alias("run_packs"), F.lit("en").alias("verdict_language"))
    staged = stage_normalized(texts, "staged.t", "id", 4)
    found_rows = match.match_texts(staged, packs, ["id"])
    out = verdict.verdicts(staged.drop("text"), found_rows, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("n_matches = 2").count() == 50
    # Regexes run in Python, after which Spark no longer knows the buckets: hits move, texts stay.
    assert plan.count("Exchange hashpartitioning(id") == 1
    in_jvm = packs.with_types("exact", "fuzzy", "contains")
    found_rows = match.match_texts(staged, in_jvm, ["id"])
    plan = verdict.verdicts(staged.drop("text"), found_rows, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(id" not in plan
    spark.sql("DROP DATABASE staged CASCADE")


def test_every_pack_by_one_name(spark, make_packs):
    rules = [rule("xx.a", "exact", "banana", "two words"), rule("xx.b", "fuzzy", "banana"), rule("xx.c", "contains", "nan"),
             rule("xx.d", "regex", r"\bban\w*", probe="banana")]
    packs = make_packs({language: (rules, allow) for language, allow in (("de", []), ("en", ["banana pan"]), ("es", []))})
    texts = ["banana pan", "two words bonana", "clean"]
    assert found(spark, packs, texts, [match.EVERY_PACK]) == found(spark, packs, texts, ["de", "en", "es"])


def test_runs_are_compared_only_where_skeletons_agree(spark):
    # Held against all patterns, as mutations are, most tokens fail a cheap look.
    accepted = spark.range(1).select(match.fuzzy_accepts(F.lit("banana"), F.col("id").cast("string")))
    plan = accepted._jdf.queryExecution().analyzed().toString()
    assert plan.index("regexp_replace(") < plan.index("regexp_extract_all(")
