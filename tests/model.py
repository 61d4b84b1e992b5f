"""What matching means, spelled out slowly on plain strings, as a check on the Spark plan."""

import itertools
import unicodedata

import regex

DRAWN = {"0": "o", "1": "i", "3": "e", "4": "a"}


def base(char):
    return unicodedata.normalize("NFKD", char)[0]


def normal(text):
    folded = unicodedata.normalize("NFKC", text).casefold()
    words = "".join(c if unicodedata.category(c)[0] in "LN" else "\n" for c in folded).split("\n")
    return " ".join(filter(None, words))


def despell(text):
    out = []
    groups = itertools.groupby(
        text.split(" "), lambda t: len(t) == 1 and unicodedata.category(t)[0] == "L"
    )
    for single, group in groups:
        group = list(group)
        out += ["".join(group)] if single and len(group) >= 3 else group
    return " ".join(out)


def groups_of(word):
    return [(c, len(list(g))) for c, g in itertools.groupby(word)]


def fuzzy(pattern, token):
    if pattern == token:
        return True
    if min(len(pattern), len(token)) < 4 or len(token) - len(pattern) > 6:
        return False
    left, right = groups_of(pattern), groups_of(token)
    if len(left) != len(right):
        return False
    differing = [(p, t) for p, t in zip(left, right) if p != t]
    for (p, _), (t, _) in differing:
        both_vowels = base(p) in "aeiouy" and base(t) in "aeiouy"
        if p != t and not both_vowels and DRAWN.get(t) != base(p):
            return False
    return len(differing) <= (2 if len(pattern) >= 6 else 1)


def occurrences(text, needle):
    return [i for i in range(len(text)) if text.startswith(needle, i)]


def bounded(text, needle):
    padded = f" {text} "
    return [
        (i, i + len(needle)) for i in occurrences(padded, f" {needle} ")
    ]


def one_pass(text, rules, allow):
    spans = [s for term in allow for s in bounded(text, term)]

    def free(start, end):
        return not any(a <= start and end <= b for a, b in spans)

    found = {}
    for r in rules:
        patterns = [r["term"], *r["variants"]]
        hits = []
        if r["match"] == "regex":
            for p in patterns:
                compiled = regex.compile(p, regex.V1 | regex.I | regex.FULLCASE)
                hits += [m.group() for m in compiled.finditer(text) if free(*m.span())]
        elif r["match"] == "fuzzy":
            at = 0
            for token in text.split(" "):
                if len(token) >= 4 and free(at, at + len(token)):
                    if any(fuzzy(normal(p), token) for p in patterns):
                        hits.append(token)
                at += len(token) + 1
        else:
            for p in map(normal, patterns):
                where = (
                    bounded(text, p)
                    if r["match"] == "exact"
                    else [(i, i + len(p)) for i in occurrences(text, p)]
                )
                hits += [p for span in where if free(*span)]
        if hits:
            found[r["id"]] = hits[0]
    return found


def matches(text, rules, allow=()):
    """[(rule id, matched text)] in reporting order, for raw text and one pack."""
    text = normal(text)
    allow = [normal(a) for a in allow]
    if not text:
        return []
    first = one_pass(text, rules, allow)
    again = {}
    if despell(text) != text:
        again = one_pass(despell(text), rules, allow)
    return list(first.items()) + [(k, v) for k, v in again.items() if k not in first]
