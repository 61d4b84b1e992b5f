"""Matching transcripts against rule packs.

One pass over the text finds everything: each token is looked up in a broadcast table
of pattern anchors, so clean text never leaves its task. Substrings, and the literals that
expressions cannot match without, are looked up by one of their trigrams in the same table
once there are many of them: a text costs the same for a few hundred as for many thousand.
Only hits are shuffled, once, by the key of their text. If the texts are already bucketed by that key, not even they
are.

Positions are token numbers. Normalised text is single-spaced, so a span of characters
lies inside an allowed phrase exactly when its tokens do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from earshot import domains
from earshot.functions import text as tx
from earshot.plans.sizing import broadcast_counted, broadcast_slices
from earshot.sources.packs import RulePacks, compile_rule_regex


# --- single comparisons ------------------------------------------------------------


def _base_vowel(char: Column) -> Column:
    vowels = tx.vowel_chars()
    return F.translate(char, vowels, "".join(map(tx.base_letter, vowels)))


def fuzzy_cost(pattern: Column, token: Column) -> Column:
    """How many runs differ, or null if the two cannot be the same word at all."""
    p_chars, p_lens = tx.run_chars(pattern), tx.run_lengths(pattern)
    t_chars, t_lens = tx.run_chars(token), tx.run_lengths(token)

    def cell(p: Column, t: Column) -> Column:
        vowels = tx.is_vowel(p["c"]) & tx.is_vowel(t["c"])
        drawn = F.coalesce(tx.leet_vowel(t["c"]) == _base_vowel(p["c"]), F.lit(False))
        return (
            F.when(p["c"] == t["c"], (p["n"] != t["n"]).cast("int"))
            .when(vowels | drawn, 1)
            .otherwise(F.lit(None).cast("int"))
        )

    def runs(chars: Column, lens: Column) -> Column:
        return F.zip_with(chars, lens, lambda c, n: F.struct(c.alias("c"), n.alias("n")))

    cells = F.zip_with(runs(p_chars, p_lens), runs(t_chars, t_lens), cell)
    total = F.aggregate(cells, F.lit(0), lambda acc, c: acc + c)
    return F.when(F.size(p_chars) == F.size(t_chars), total)


def fuzzy_accepts(pattern: Column, token: Column) -> Column:
    """Is the token this pattern with few enough runs drifted?"""
    p_len, t_len = F.length(pattern), F.length(token)
    long_enough = (p_len >= domains.FUZZY_MIN_CHARS) & (t_len >= domains.FUZZY_MIN_CHARS)
    padded = t_len <= p_len + domains.FUZZY_MAX_EXTRA_CHARS
    budget = tx.fuzzy_budget(p_len, domains.FUZZY_WIDE_BUDGET_CHARS)
    # Most pairs already fail the first, cheaper look: their runs are not compared.
    alike = tx.skeleton(pattern) == tx.skeleton(token)
    drifted = long_enough & padded & alike & F.coalesce(fuzzy_cost(pattern, token) <= budget, F.lit(False))
    return (pattern == token) | drifted


def _window_text(toks: Column, start: Column, n: Column) -> Column:
    """The n tokens from position start, as text; start below 0 is clamped."""
    return F.array_join(F.slice(toks, F.greatest(start + 1, F.lit(1)), n), " ")


# --- finding occurrences -----------------------------------------------------------

# Marks that keep other probes apart from tokens, which are letters and digits only.
WHOLE_TEXT, SKELETON, GRAM = "\u0001", "\u0002", "\u0003"
WHOLE_TEXT_TYPES = ("contains", "regex")
#: In run_packs: all packs, in their own order. With thousands of them a text cannot carry their names.
EVERY_PACK = "*"
#: Characters of the grams that substrings are found by; shorter ones are looked for in whole texts.
GRAM_CHARS = 3
#: Patterns of one language from which on their grams are looked up: with fewer it is
#: cheaper to look for each of them in the text.
GRAMS_FROM = 200


def _lit_array(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _runs_any(languages: Sequence[str]) -> Column:
    """Does a text run a pack of these? A look at each of its own packs, however many there are."""
    return F.exists("run_packs", lambda pack: pack.isin(EVERY_PACK, *languages))


def text_passes(
    texts: DataFrame, keys: Sequence[str], text: str, run_packs: str, languages: Sequence[str] | None
) -> DataFrame:
    """Pass 1 is the text itself; pass 2 its spelled-out form, where that differs.

    Only texts that run a pack of these languages, if any are given: said first, so that
    the filter reaches the scan and the others are not even normalised.
    """
    first = F.struct(F.lit(1).alias("pass"), F.col("t").alias("t"))
    second = F.struct(F.lit(2).alias("pass"), F.col("j").alias("t"))
    both = F.when(F.col("j") == F.col("t"), F.array(first)).otherwise(F.array(first, second))
    return (
        texts.select(*keys, F.col(run_packs).alias("run_packs"), F.col(text).alias("t"))
        .filter(F.lit(True) if languages is None else _runs_any(languages))
        .withColumn("j", tx.join_spelled_out(F.col("t")))
        .select(*keys, "run_packs", F.inline(both))
    )


def _with_grams(packs: RulePacks) -> list[str]:
    """Languages with so many substrings and expressions that an index of grams pays."""
    kinds = {language for kind in WHOLE_TEXT_TYPES for language in packs.of_type(kind)}
    return sorted(language for language in kinds if packs.n_whole.get(language, 0) >= GRAMS_FROM)


def _grams_of(text: Column) -> Column:
    """All runs of GRAM_CHARS characters without a space, overlapping ones too."""
    return F.regexp_extract_all(text, F.lit(f"(?=([^ ]{{{GRAM_CHARS}}}))"), F.lit(1))


def _gram_anchors(others: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Substrings and expressions with the grams they are found by, or with their language's mark.

    Of a pattern's first clause each literal has an anchor of its own, at the gram that
    the fewest literals of the language have. A pattern with a literal too short for
    grams, or without literals, is looked for in every text of its language.
    """
    long_enough = F.forall(F.get("literals", F.lit(0)), lambda x: F.size(_grams_of(x)) > 0)
    indexed = F.col("language").isin(*languages) & (F.size("literals") > 0) & long_enough
    marked = others.withColumn("indexed", F.coalesce(indexed, F.lit(False)))
    every = marked.filter(~F.col("indexed")).select(*others.columns, F.concat(F.lit(WHOLE_TEXT), "language").alias("anchor"))
    literals = marked.filter("indexed").select(
        *[c for c in others.columns if c != "literal_at"], F.posexplode(F.get("literals", F.lit(0))).alias("literal_at", "literal")
    )
    grams = literals.select("language", "literal", F.explode(F.array_distinct(_grams_of(F.col("literal")))).alias("gram")).distinct()
    held = grams.groupBy("language", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(held, ["language", "gram"]).groupBy("language", "literal").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    found = literals.join(rarest, ["language", "literal"]).select(*others.columns, F.concat(F.lit(GRAM), "gram").alias("anchor"))
    return every.unionByName(found)


def anchors(packs: RulePacks) -> DataFrame:
    """Every pattern and allow term by the one probe it is found by.

    A phrase is found by its longest word, which is usually its rarest; a fuzzy pattern
    by its skeleton; a substring or regex by its language, once per text, or by grams.
    """
    common = ("language", "rule_ord", "pattern_ord", "pattern", "n_tokens", "prefilter", "literals", "first_only")
    allows = F.col("language").isin(*packs.allow_languages)
    patterns = packs.patterns.withColumn("first_only", ~allows)
    none = F.lit(None)
    allow = packs.allow_terms.select(
        "language", F.lit(-1).alias("rule_ord"), F.col("allow_ord").alias("pattern_ord"),
        F.col("term").alias("pattern"), "n_tokens", none.cast("string").alias("prefilter"),
        none.cast("array<array<string>>").alias("literals"), F.lit(False).alias("first_only"), F.lit("allow").alias("entry"),
    )
    longest = F.array_max(
        F.transform(
            tx.tokens(F.col("pattern")),
            lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("back"), t.alias("token")),
        )
    )
    exact = patterns.filter("match_type = 'exact'").select(*common, F.lit("exact").alias("entry"))
    phrases = exact.unionByName(allow).withColumn("longest", longest).select(
        *common, "entry", (-F.col("longest.back")).alias("anchor_at"), F.lit(0).alias("literal_at"),
        F.col("longest.token").alias("anchor"),
    )
    others = patterns.filter("match_type <> 'exact'").select(
        *common, F.col("match_type").alias("entry"), F.lit(0).alias("anchor_at"), F.lit(0).alias("literal_at"), "skeleton",
    )
    fuzzy = others.filter("entry = 'fuzzy'").withColumn("anchor", F.concat(F.lit(SKELETON), "skeleton"))
    whole = others.filter("entry <> 'fuzzy'")
    if languages := _with_grams(packs):
        whole = _gram_anchors(whole, languages)
    else:
        whole = whole.withColumn("anchor", F.concat(F.lit(WHOLE_TEXT), "language"))
    return phrases.unionByName(fuzzy.drop("skeleton")).unionByName(whole.drop("skeleton"))


def _as_compared(text: Column) -> Column:
    """Text as expressions compare it: dotless i is an i to them."""
    return F.translate(text, "ı", "i")


def _probes(packs: RulePacks) -> Column:
    """What a text is looked up by: its tokens, their skeletons, itself per pack, the grams of its words."""
    nothing = F.array().cast("array<string>")
    parts = [F.col("toks")]
    fuzzy = packs.of_type("fuzzy")
    if fuzzy:
        marked = F.concat(
            F.lit(SKELETON), F.replace(tx.skeleton(F.col("t")), F.lit(" "), F.lit(f" {SKELETON}"))
        )
        parts.append(F.when(F.col("runs_fuzzy"), tx.tokens(marked)).otherwise(nothing))
    whole = {language for kind in WHOLE_TEXT_TYPES for language in packs.of_type(kind)}
    parts += [
        F.when(
            F.array_contains("run_packs", language) | F.array_contains("run_packs", EVERY_PACK), _lit_array([WHOLE_TEXT + language])
        ).otherwise(nothing)
        for language in sorted(whole)
    ]
    if languages := _with_grams(packs):
        words = F.array_join(F.array_distinct("toks"), " ")
        both = F.when(F.instr(words, "ı") > 0, F.concat(words, F.lit(" "), _as_compared(words))).otherwise(words)
        grams = F.concat(F.lit(GRAM), F.array_join(F.array_distinct(_grams_of(both)), f" {GRAM}"))
        parts.append(F.when(F.col("runs_grams"), tx.tokens(grams)).otherwise(nothing))
    return F.concat(*parts)


def _first_literal_met() -> Column:
    """What generated code can ask of _literals_met: is the anchor's own literal there, or the only one of its clause?"""
    first = F.get("literals", F.lit(0))
    own = F.instr(_as_compared(F.col("t")), F.get(first, F.col("literal_at"))) > 0
    one_of_many = (F.substring("anchor", 1, 1) != GRAM) & (F.size(first) > 1)
    return F.coalesce(F.size("literals"), F.lit(0)).isin(0, -1) | one_of_many | own


def _literals_met() -> Column:
    """Does t hold a literal of every clause, and of the first one none before that of this anchor?"""
    text = F.when(F.col("entry") == "regex", _as_compared(F.col("t"))).otherwise(F.col("t"))
    met = F.forall("literals", lambda clause: F.exists(clause, lambda x: F.instr(text, x) > 0))
    first = F.get("literals", F.lit(0))
    own = F.instr(text, F.get(first, F.col("literal_at"))) > 0
    earlier = F.exists(F.slice(first, F.lit(1), F.col("literal_at")), lambda x: F.instr(text, x) > 0)
    by_gram = F.substring("anchor", 1, 1) == GRAM
    # Several literals may be found in one text: it counts for the first of them.
    return F.coalesce(F.size("literals"), F.lit(0)).isin(0, -1) | (F.when(by_gram, own & ~earlier).otherwise(F.lit(True)) & met)


_compiled = lru_cache(maxsize=4096)(compile_rule_regex)
_SPANS = ArrayType(
    StructType()
    .add("tok_start", IntegerType())
    .add("tok_end", IntegerType())
    .add("matched_text", StringType())
)


def _spans(text: str, pattern: str, first_only: bool) -> list[tuple[int, int, str]]:
    spans = []
    for match in _compiled(pattern).finditer(text):
        before, through = text.count(" ", 0, match.start()), text.count(" ", 0, match.end())
        spans.append((before, through, match.group()))
        if first_only:
            break
    return spans


@F.pandas_udf(_SPANS)
def _regex_spans(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    for texts, patterns, first_only in batches:
        found = [
            None if text is None else _spans(text, pattern, first)
            for text, pattern, first in zip(texts, patterns, first_only)
        ]
        yield pd.Series(found, dtype=object)


# Kept from being copied into a pushed-down filter and so evaluated twice.
_regex_spans = _regex_spans.asNondeterministic()


def _contains_spans() -> Column:
    """Token windows of t that hold the pattern.

    Both the pattern and a window of its length hold n - 1 spaces, so they line up one
    way only.
    """
    toks, n = tx.tokens(F.col("t")), F.col("n_tokens")
    windows = F.transform(
        toks,
        lambda token, i: F.struct(
            i.alias("tok_start"), (i + n - 1).alias("tok_end"),
            F.when(n == 1, token).otherwise(_window_text(toks, i, n)).alias("matched_text"),
        ),
    )
    holding = F.filter(windows, lambda w: F.instr(w["matched_text"], F.col("pattern")) > 0)
    return F.transform(
        holding, lambda w: F.struct(w["tok_start"], w["tok_end"], F.col("pattern").alias("matched_text"))
    )


def _looked_up(
    passes: DataFrame, packs: RulePacks, keys: Sequence[str], short: bool = False, every_pack: bool = False
) -> DataFrame:
    """One row per anchor found: a hit, but for substrings and regexes only a text that has one.

    Short texts are shuffled to a table too large for a broadcast: passes over them for each
    slice would grow with the square of the patterns. Nor do they list the packs, which may
    be as many as their texts: those of every pack have no order of packs.

    The lookup must stay in generated code: out of it, every token is written out with the
    whole text beside it. So conditions on arrays come after, held there by an id.
    """
    wanted = {"runs_fuzzy": packs.of_type("fuzzy"), "runs_grams": _with_grams(packs)}
    ready = passes.withColumns({"toks": tx.tokens(F.col("t"))} | {name: F.lit(True) if short else _runs_any(has) for name, has in wanted.items() if has})
    exploded = ready.select(
        *keys, "run_packs", "pass", "t", "toks", F.posexplode(_probes(packs)).alias("probe_at", "probe")
    )
    fuzzy, whole = F.col("entry") == "fuzzy", F.col("entry").isin(*WHOLE_TEXT_TYPES)
    start = F.col("probe_at") - F.when(fuzzy, F.size("toks")).otherwise(F.col("anchor_at"))
    token = F.get("toks", start)
    # Cheap checks decide here. A regex goes on where its prefilter, if it has one, lets it.
    really = (
        F.when(fuzzy, (F.length(token) >= domains.FUZZY_MIN_CHARS)
               & (F.length(token) <= F.length("pattern") + domains.FUZZY_MAX_EXTRA_CHARS))
        .when(F.col("entry") == "contains", F.instr(F.col("t"), F.col("pattern")) > 0)
        .when(F.col("entry") == "regex", _first_literal_met() & (
            F.col("prefilter").isNull() | F.regexp_like(_as_compared(F.col("t")), F.col("prefilter"))))
        .otherwise((F.col("n_tokens") == 1) | (
            (start >= 0) & (_window_text(F.col("toks"), start, F.col("n_tokens")) == F.col("pattern"))))
    )
    pack_at = F.lit(1) if short else F.when(
        F.array_contains("run_packs", EVERY_PACK), F.array_position(_lit_array(packs.languages), F.col("language"))
    ).otherwise(F.array_position("run_packs", F.col("language")))
    by_literals = [*map(F.col, ("literals", "literal_at", "anchor")), F.monotonically_increasing_id().alias("_held")] if packs.of_type("regex") else []
    of_pack = pack_at > 0
    if short:
        of_pack = F.lit(True) if every_pack else F.get("run_packs", F.lit(0)) == F.col("language")
    table, n_rows = anchors(packs), packs.n_patterns + packs.n_allow
    found = []
    for part in [broadcast_counted(table, n_rows)] if short else broadcast_slices(table, n_rows):
        condition = (F.col("probe") == F.col("anchor")) & of_pack & really
        found.append(
            exploded.join(part, condition).select(
                *keys, "pass", "language", (pack_at - 1).cast("int").alias("pack_ord"), "entry",
                "rule_ord", "pattern_ord", start.alias("tok_start"),
                (start + F.col("n_tokens") - 1).alias("tok_end"),
                F.when(fuzzy, token).otherwise(F.col("pattern")).alias("matched_text"), "pattern",
                # Carried only where the rest of the work needs it.
                F.when(whole, F.col("t")).alias("t"), "n_tokens", "first_only", *by_literals,
            )
        )
    if by_literals:
        met = (F.col("_held") >= 0) & ((F.col("entry") != "regex") | _literals_met())
        found = [part.filter(met).drop("literals", "literal_at", "anchor", "_held") for part in found]
    return reduce(DataFrame.unionByName, found)


def all_hits(
    texts: DataFrame, packs: RulePacks, keys: Sequence[str], text: str = "norm",
    run_packs: str = "run_packs", short: bool = False, every_pack: bool = False,
) -> DataFrame:
    """Every occurrence of every pattern and allow term, before suppression.

    One reading of the texts. Fuzzy rows are candidates still: their comparison works on
    arrays, outside generated code, and comes once the hits have left this stage. All
    non-overlapping matches of a regex count, since an allowed one must not hide the
    next; where a pack allows nothing, the first is enough.

    short is for texts as short as patterns, each of exactly one named pack; with
    every_pack, all of EVERY_PACK, and their hits have pack_ord 0 whatever the pack.
    """
    passes = text_passes(texts, keys, text, run_packs, None if short else packs.languages)
    found = _looked_up(passes, packs, keys, short, every_pack)
    kept = [*keys, "pass", "language", "pack_ord", "entry", "rule_ord", "pattern_ord"]
    if not any(packs.of_type(kind) for kind in WHOLE_TEXT_TYPES):
        return found.select(*kept, "tok_start", "tok_end", F.lit(0).alias("occurrence"), "matched_text", "pattern")
    itself = F.array(F.struct("tok_start", "tok_end", "matched_text"))
    spans = F.when(F.col("entry") == "contains", _contains_spans()).otherwise(itself)
    if packs.of_type("regex"):
        is_regex = F.col("entry") == "regex"
        found = found.withColumn(
            "regex_spans", _regex_spans(F.when(is_regex, F.col("t")), "pattern", "first_only")
        )
        spans = F.when(is_regex, F.col("regex_spans")).otherwise(spans)
    return found.select(*kept, F.posexplode(spans).alias("occurrence", "span"), "pattern").select(
        *kept, "span.tok_start", "span.tok_end", "occurrence", "span.matched_text", "pattern"
    )


def accepted_fuzzy(hits: DataFrame) -> DataFrame:
    """Fuzzy candidates that pass the comparison, for a caller that wants only them.

    The id is there to hold the comparison behind the lookup: the optimizer would move
    it into the join condition and take that out of generated code.
    """
    held = hits.filter("entry = 'fuzzy'").withColumn("_held", F.monotonically_increasing_id())
    accepted = fuzzy_accepts(F.col("pattern"), F.col("matched_text")) & (F.col("_held") >= 0)
    return held.filter(accepted).drop("_held")


# --- suppression and choice --------------------------------------------------------


def suppress_allowed(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop allow spans, and every hit lying wholly inside one of them.

    In order of start, a hit is inside some span exactly when the furthest end among
    the spans begun so far reaches its own. Ordering by language and pass first lets
    one window over the text's key serve all of them; the struct carries whose span
    the running maximum is.
    """
    order = Window.partitionBy(*keys).orderBy("language", "pass", "tok_start")
    span = F.struct("language", "pass", F.col("tok_end").alias("reach"))
    furthest = F.max(F.when(F.col("entry") == "allow", span)).over(order)
    covered = F.coalesce(
        (F.col("furthest.language") == F.col("language"))
        & (F.col("furthest.pass") == F.col("pass"))
        & (F.col("furthest.reach") >= F.col("tok_end")),
        F.lit(False),
    )
    return (
        hits.withColumn("furthest", furthest)
        .filter((F.col("entry") != "allow") & ~covered)
        .drop("furthest")
    )


def first_hit_per_rule(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per text and rule: the first pass, then the first pattern or token.

    Phrases, substrings and regexes report their first listed pattern that hits; a
    fuzzy rule reports the first token that any of its patterns accepts.
    """
    fuzzy = F.col("entry") == "fuzzy"
    position = F.when(fuzzy, F.col("tok_start")).otherwise(F.col("pattern_ord"))
    order = F.struct("pass", position, "tok_start", "occurrence")
    accepted = ~fuzzy | fuzzy_accepts(F.col("pattern"), F.col("matched_text"))
    return (
        hits.filter(accepted)
        .groupBy(*keys, "language", "rule_ord")
        .agg(
            F.min("pack_ord").alias("pack_ord"),
            F.min("pass").alias("pass"),
            F.min_by("matched_text", order).alias("matched_text"),
        )
    )


def match_texts(
    texts: DataFrame, packs: RulePacks, keys: Sequence[str], text: str = "norm",
    run_packs: str = "run_packs", short: bool = False, every_pack: bool = False,
) -> DataFrame:
    """Rules each text breaks, one row per (keys, rule).

    texts holds normalised text and, in run_packs, the languages whose packs to run in
    the order they report, or only EVERY_PACK. keys must identify a row. short and
    every_pack as in all_hits.
    """
    hits = suppress_allowed(all_hits(texts, packs, keys, text, run_packs, short, every_pack), keys)
    return join_rules(first_hit_per_rule(hits, keys), packs, keys)


def join_rules(found: DataFrame, packs: RulePacks, keys: Sequence[str]) -> DataFrame:
    rules = packs.rules.select(
        "language", "rule_ord", "rule_id", "category", "severity", "context_required"
    )
    # Every rule has a pattern, so there are no more of them.
    small = broadcast_counted(rules, packs.n_patterns)
    return found.join(small, ["language", "rule_ord"]).select(
        *keys, "pack_ord", "pass", "rule_ord", "language", "rule_id", "category", "severity",
        "matched_text", "context_required",
    )
