import random

import model
import pytest
from pyspark.sql import functions as F

from earshot.functions import text as tx


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_normalize_known_cases(spark):
    cases = {
        "  ČAU, Straße! ＡＢＣ  ": "čau strasse abc",
        "İstanbul": "i stanbul",
        "ﬁn²": "fin2",
        "½ a_b": "1 2 a b",
        "ΟΔΟΣ": "οδοσ",
        "": "",
        "!!!": "",
        "a\u0301b": "áb",
        "ſs ẞ": "ss ss",
        "Привет, МИР\n\tё": "привет мир ё",
    }
    assert column(spark, list(cases), tx.normalize) == list(cases.values())
    assert column(spark, [None], tx.normalize) == [None]


def test_jvm_path_folds_every_plain_character_like_python(spark):
    """Each character alone, doubled and between letters, through the JVM expression."""
    import re

    plain = [chr(p) for low, high in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", tx.plain_class())
             for p in range(int(low, 16), int(high, 16) + 1)]
    assert len(plain) > 500 and "ß" in plain and "é" in plain
    texts = [f(c) for c in plain for f in (str, lambda c: f"x{c}{c}Y", lambda c: f"{c} {c}A")]
    assert column(spark, texts, tx.normalize) == [model.normal(t) for t in texts]


def test_normalize_random_unicode(spark):
    rng = random.Random(7)
    pool = [chr(p) for p in range(0x20, 0x2FFFF) if not 0xD800 <= p < 0xE000]
    texts = ["".join(rng.choice(pool if rng.random() < 0.3 else "aB é,ß") for _ in range(20)) for _ in range(2000)]
    assert column(spark, texts, tx.normalize) == [model.normal(t) for t in texts]


def test_join_spelled_out(spark):
    rng = random.Random(3)
    words = ["a", "b", "č", "1", "²".translate({0xB2: "2"}), "ab", "x", "ж", "१"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts += ["k y s", "x y z 1 2", "a b", ""]
    assert column(spark, texts, tx.join_spelled_out) == [model.despell(t) for t in texts]


def test_runs(spark):
    words = ["bbananna", "a", "žžz", "1122"]
    assert column(spark, words, tx.run_chars) == [[c for c, _ in model.groups_of(w)] for w in words]
    assert column(spark, words, tx.run_lengths) == [[n for _, n in model.groups_of(w)] for w in words]


def test_vowels_by_base_letter(spark):
    chars = list("aeiouyáěÿůbžñçжοя1 ") + ["ǖ", "å", "ø"]
    assert column(spark, chars, tx.is_vowel) == [model.base(c) in "aeiouy" for c in chars]
    assert column(spark, list("01234x"), tx.leet_vowel) == ["o", "i", None, "e", "a", None]


def test_marks_and_twins(spark):
    assert column(spark, ["připoj můj", "abc"], tx.without_marks) == ["pripoj muj", "abc"]
    twin = column(spark, ["i ll go i ll"], lambda v: tx.replace_word_once(v, F.lit("i ll"), F.lit("ill")))
    assert twin == ["ill go i ll"]


def test_digest_tells_metadata_apart(spark):
    df = spark.createDataFrame(
        [("p", "en", "0", "x"), ("p", "en", "0", "x"), ("p", "de", "0", "x"), ("p", "en", "3", "x")],
        "p string, l string, pre string, b string",
    )
    digests = [r[0] for r in df.select(
        tx.request_digest(F.col("p"), F.col("l"), F.col("pre"), F.lit(False), F.col("b"))
    ).collect()]
    assert digests[0] == digests[1] and len(set(digests)) == 3


def test_stamps(spark):
    row = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678' AS t").select(
        tx.iso_utc(F.col("t"), True), tx.iso_utc(F.col("t"), False)
    ).first()
    assert tuple(row) == ("2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05Z")


@pytest.mark.parametrize("text", ["Straße", "ΟΔΟΣ", "½"])
def test_python_helper_agrees_with_model(text):
    assert tx.normalize_text(text) == model.normal(text)


def test_one_very_long_token(spark):
    """No recursion on the length of a text or a run."""
    from earshot.operators.match import fuzzy_accepts

    long = "b" + "a" * 300_000 + "nana"
    df = spark.createDataFrame([(long,), ("x " * 100_000,)], "v string")
    got = df.select(F.length(tx.skeleton(tx.join_spelled_out(tx.normalize(F.col("v")))))).collect()
    assert [r[0] for r in got] == [6, 1]
    assert not df.filter(F.length("v") > 250_000).select(fuzzy_accepts(F.lit("banana"), F.col("v"))).first()[0]
