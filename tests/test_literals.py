"""Literals of expressions, and the index of grams they are looked up in."""

import random

import model

import pytest
from conftest import rule
from pyspark.sql import functions as F
from test_match import ALLOW, RULES, found


from earshot.functions import text as tx
from earshot.functions.literals import required_literals
from earshot.operators import match
from earshot.sources.packs import compile_rule_regex


@pytest.mark.parametrize("pattern,clauses", [
    (r"\bth(?:tion|ing)\b", [["thing", "thtion"]]),
    (r"foo.*bar|baz", [["baz", "foo"]]),
    (r"kill\s+\w", [["kill"]]),
    (r"abc+d", [["abc"], ["d"]]),
    (r"(?:ab){2}c?", [["abab"]]),
    (r"foo(?=bar)baz", [["foobaz"]]),
    (r"Straße", [["strasse"]]),
    (r"kıx", [["kix"]]),
    (r"s[ck]reen", [["screen", "skreen"]]),
    (r".*", []), (r"\w+", []), (r"a?b?", []), (r"[^x]", []), (r" ?x| ", []),
    (r"(?:foo){e<=1}", []), (r"\p{L}abc", []), (r"[[a-z]--[b]]x", []), (r"(broken", []),
])
def test_clauses(pattern, clauses):
    assert required_literals(pattern) == clauses


def test_every_match_holds_a_literal_of_every_clause():
    r = random.Random(4)

    def piece(depth):
        kind = r.randrange(9 if depth else 4)
        if kind < 3:
            return "".join(r.choice("abcdIsß ıx") for _ in range(r.randrange(1, 4)))
        if kind == 3:
            return r.choice([r"\b", ".", r"\w", "[ab]", "[^a]", "[a-d]", r"\s", "(?<=a)", "(?!x)"])
        inner = piece(depth - 1)
        if kind == 4:
            return f"(?:{inner})" + r.choice(["", "?", "*", "+", "{2}", "{1,2}", "{0,3}", "+?"])
        if kind == 5:
            return f"(?:{inner}|{piece(depth - 1)})"
        return inner + piece(depth - 1)

    met = known = 0
    texts = [tx.normalize_text("".join(r.choice("abcdisßx ") for _ in range(12))) for _ in range(60)]
    texts += [t.replace("i", "ı") for t in texts[:20]]
    for _ in range(1500):
        pattern = piece(4)
        clauses = required_literals(pattern)
        known += bool(clauses)
        engine = compile_rule_regex(pattern)
        for text in texts:
            if engine.search(text):
                met += 1
                seen = text.replace("ı", "i")
                assert all(any(x in seen for x in clause) for clause in clauses), (pattern, clauses, text)
    assert met > 10_000 and known > 400


def test_grams_find_what_scanning_finds(spark, make_packs, monkeypatch):
    monkeypatch.setattr(match, "GRAMS_FROM", 1)
    rules = [*RULES, rule("en.i", "regex", r"b(?:an|on)an\w", r"\bxy?z", r"[^ ]{7}", probe="banana"), rule("en.j", "contains", "ı", "ana", "kys k")]
    packs = make_packs({"en": (rules, ALLOW)})
    rng = random.Random(12)
    words = ["kill", "it", "now", "banana", "bananna", "bonano", "bonana", "pan", "nan", "an", "k", "y", "s", "kys", "xz", "xyz", "banına", "ı", "baaaaaana"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    got = found(spark, packs, texts, ["en"])
    for i, text in enumerate(texts):
        assert got[i] == model.matches(text, rules, ALLOW), text


def many_patterns(n):
    r = random.Random(9)
    return ["".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(n)]


def test_thousands_of_patterns_bring_no_text_to_python(spark, make_packs):
    names = many_patterns(3000)
    rules = [rule(f"en.c{i}", "contains", *names[10 * i : 10 * i + 10]) for i in range(200)]
    rules += [rule(f"en.r{i}", "regex", *(rf"\b{x}\w*" for x in names[2000 + 10 * i : 2010 + 10 * i]), probe=names[2000 + 10 * i]) for i in range(100)]
    packs = make_packs({"en": (rules, [])})
    assert packs.n_whole == {"en": 3000}
    texts = [f"nothing of the kind {i}" for i in range(200)] + [f"xx{names[7]}yy", f"some {names[2050]}ing", f"in{names[2050]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, norm string").withColumn("run_packs", F.array(F.lit("en")))
    passes = match.text_passes(df, ["id"], "norm", "run_packs", packs.languages)
    looked_up = match._looked_up(passes, packs, ["id"])
    # What is left of 600,000 pairs: the substring's text, and the two that an expression must decide.
    assert sorted((x.id, x.entry) for x in looked_up.collect()) == [(200, "contains"), (201, "regex"), (202, "regex")]
    assert {(r.id, r.matched_text) for r in match.match_texts(df, packs, ["id"]).collect()} == {(200, names[7]), (201, f"{names[2050]}ing")}


def test_anchors_are_spread_over_rare_grams(spark, make_packs, monkeypatch):
    monkeypatch.setattr(match, "GRAMS_FROM", 1)
    # All begin alike: each must be found by a gram of its own.
    names = [f"common{x}" for x in many_patterns(30)]
    packs = make_packs({"en": ([rule("en.c", "contains", *names)], [])})
    used = match.anchors(packs).groupBy("anchor").count().collect()
    assert len(used) == 30 and all(x.anchor.startswith(match.GRAM) for x in used)
