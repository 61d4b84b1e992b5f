"""Text functions over transcripts.

Everything here is a Column expression except full normalisation, which needs the
Unicode tables only Python has. Even there, rows whose characters have no special
folding stay in the JVM, and only the others travel to a Python worker.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from earshot.domains import LEET_VOWELS, VOWELS

_NOT_ALPHANUMERIC = re.compile(r"[\W_]+")
# One stand-in for "some vowel, or a digit drawn like one" in a skeleton.
VOWEL_CLASS = "a"


def normalize_text(text: str) -> str:
    """NFKC, casefold, and one space between runs of letters and digits."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return _NOT_ALPHANUMERIC.sub(" ", folded).strip(" ")


def remove_marks(text: str) -> str:
    """NFKD without combining marks: the spelling a mark-dropping recogniser writes."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _as_ranges(points: list[int]) -> list[tuple[int, int]]:
    ranges: list[list[int]] = []
    for point in points:
        if ranges and ranges[-1][1] + 1 == point:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return [(low, high) for low, high in ranges]


def _java_class(points: list[int]) -> str:
    return "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in _as_ranges(points))


@lru_cache(maxsize=1)
def _joins_backwards() -> frozenset[str]:
    """Characters that some canonical composition takes as its second part."""
    pairs = (unicodedata.decomposition(chr(p)).split() for p in range(0x110000))
    return frozenset(chr(int(pair[1], 16)) for pair in pairs if len(pair) == 2 and pair[0][0] != "<")


def _is_plain(point: int) -> bool:
    """Does the JVM fold this character as Python does, whatever stands beside it?

    It must be as old as both engines' tables, unchanged by NFKC alone or joined to a
    neighbour, and lower-cased to what casefold gives; or be no letter in any reading.
    """
    char = chr(point)
    if unicodedata.ucd_3_2_0.category(char) == "Cn" and point < 0x1F000:
        return False
    if unicodedata.combining(char) or char in _joins_backwards():
        return False
    if normalize_text(char) == "":
        # Never an L or N category: it turns into a space either way.
        return unicodedata.category(char)[0] not in "LNC" or point in (0x9, 0xA, 0xD)
    folded = "σ" if char in "Σς" else char.lower()
    return (
        unicodedata.normalize("NFKC", char) == char
        and len(folded) == 1
        and (char.casefold() == folded or char == "ß")
        and unicodedata.normalize("NFKC", folded) == folded
    )


# Scripts the JVM path covers: Latin, Greek, Cyrillic, punctuation, symbols, emoji.
_PLAIN_BLOCKS = (
    (0x9, 0x7F), (0x80, 0x17F), (0x180, 0x36F), (0x370, 0x52F), (0x1E00, 0x1EFF), (0x2010, 0x206F), (0x20A0, 0x20BF), (0x2190, 0x27BF),
    (0x1F300, 0x1FAFF),
)


@lru_cache(maxsize=1)
def plain_class() -> str:
    """Java character class of the characters the JVM folds exactly, by _is_plain."""
    # A class per block, ASCII first: Java asks one range after another, so that a letter of
    # a common script is settled after a few instead of all of them.
    return "".join(
        f"[{_java_class([p for p in range(low, high + 1) if _is_plain(p)])}]" for low, high in _PLAIN_BLOCKS
    )


@lru_cache(maxsize=1)
def numeral_class() -> str:
    """Java character class of every numeral, so that no letter is taken for one."""
    points = [p for p in range(0x30, 0x110000) if unicodedata.category(chr(p))[0] == "N"]
    return _java_class(points)


@lru_cache(maxsize=1)
def vowel_chars() -> str:
    """Every character whose base letter is a vowel, marks included."""
    return "".join(
        chr(p)
        for p in range(0x41, 0x110000)
        if not 0xD800 <= p < 0xE000 and unicodedata.normalize("NFKD", chr(p))[0] in VOWELS
    )


@F.pandas_udf(StringType())
def _normalize_udf(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text, na_action="ignore")


@F.pandas_udf(StringType())
def _remove_marks_udf(texts: pd.Series) -> pd.Series:
    return texts.map(remove_marks, na_action="ignore")


def normalize(text: Column) -> Column:
    """Normalised form of a text column; null stays null.

    Only rows holding a character outside plain_class() are handed to Python, the
    rest arrive there as nulls and cost nothing.
    """
    plain = text.rlike(f"\\A[{plain_class()}]*\\z")
    folded = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    in_jvm = F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))
    return F.coalesce(_normalize_udf(F.when(~plain, text)), in_jvm)


def without_marks(text: Column) -> Column:
    return _remove_marks_udf(text)


def tokens(normalized: Column) -> Column:
    return F.split(normalized, " ")


def join_spelled_out(normalized: Column) -> Column:
    """Runs of three or more single-letter tokens become one token ("k y s" to "kys").

    A space goes when it stands inside such a run, which is when the two single
    letters it parts have a third one before or after them.
    """
    letter = f"[^ {numeral_class()}]"
    inner = (
        f"(?<=(?:^| ){letter} {letter}) (?={letter}(?: |$))"
        f"|(?<=(?:^| ){letter}) (?={letter} {letter}(?: |$))"
    )
    # Most texts already fail the first, cheaper look.
    spelled = normalized.rlike("[^ ] [^ ] [^ ]") & normalized.rlike("(?:^| )[^ ] [^ ] [^ ](?: |$)")
    return F.when(spelled, F.regexp_replace(normalized, inner, "")).otherwise(normalized)


def run_chars(token: Column) -> Column:
    """The character of each maximal run: "aabc" gives [a, b, c]."""
    return F.regexp_extract_all(token, F.lit(r"((.)\2*)"), F.lit(2))


def run_lengths(token: Column) -> Column:
    runs = F.regexp_extract_all(token, F.lit(r"((.)\2*)"), F.lit(1))
    return F.transform(runs, F.length)


def is_vowel(char: Column) -> Column:
    return (F.length(char) > 0) & F.lit(vowel_chars()).contains(char)


def leet_vowel(char: Column) -> Column:
    """The vowel a digit depicts, or null."""
    depicted = F.lit(None).cast("string")
    for digit, vowel in LEET_VOWELS.items():
        depicted = F.when(char == digit, F.lit(vowel)).otherwise(depicted)
    return depicted


def skeleton(normalized: Column) -> Column:
    """Run characters with every vowel and vowel-like digit as one class, spaces kept.

    Two tokens the fuzzy comparison accepts always share it, so it is a join key.
    """
    single = F.regexp_replace(normalized, r"([^ ])\1+", "$1")
    merged = vowel_chars() + "".join(LEET_VOWELS)
    return F.translate(single, merged, VOWEL_CLASS * len(merged))


def base_letter(char: str) -> str:
    return unicodedata.normalize("NFKD", char)[0]


def replace_word_once(text: Column, word: Column, substitute: Column) -> Column:
    """text with its first "<word> " replaced; the twin of a contraction spelling."""
    key = F.concat(word, F.lit(" "))
    at = F.position(key, text)
    rewritten = F.concat(
        F.substring(text, F.lit(1), at - 1),
        substitute,
        F.lit(" "),
        F.substring(text, at + F.length(key), F.length(text)),
    )
    return F.when(at > 0, rewritten).otherwise(text)


_DAY_US = 86_400_000_000


def utc_date(moment: Column) -> Column:
    """The day a moment falls on in UTC, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(moment) / _DAY_US).cast("int"))


def iso_utc(moment: Column, millis: bool) -> Column:
    """An ISO stamp in UTC, whatever the session's zone."""
    in_day = F.pmod(F.unix_micros(moment), F.lit(_DAY_US))

    def part(unit: int, of: int, width: int) -> Column:
        return F.lpad(F.pmod(F.floor(in_day / unit), F.lit(of)).cast("string"), width, "0")

    clock = [F.lit("T"), part(3_600_000_000, 24, 2), F.lit(":"), part(60_000_000, 60, 2), F.lit(":"), part(1_000_000, 60, 2)]
    if millis:
        clock += [F.lit("."), part(1_000, 1_000, 3)]
    return F.concat(utc_date(moment).cast("string"), *clock, F.lit("Z"))


def request_digest(
    player_id: Column, language_spec: Column, preroll: Column, partial: Column, body: Column
) -> Column:
    """Two requests with one id are the same request exactly when this agrees.

    Token and server are left out: a retry may come through another connection.
    """
    parts = [player_id, language_spec, preroll.cast("string"), partial.cast("string"), body]
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("\u0000")) for p in parts]), 256)


def fuzzy_budget(pattern_chars: Column, wide_from: int) -> Column:
    return F.when(pattern_chars >= wide_from, 2).otherwise(1)
