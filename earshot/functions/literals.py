"""What a text must hold for a regular expression to match it, as literals.

required_literals gives clauses: every match of the expression holds, of each clause, at
least one literal. So a text without them need not be shown to the expression, and the
literals can be looked up in an index of substrings. An expression nothing is known of has
no clauses.

Literals are in the form the rule engine compares: case-folded, dotless i as i. Texts are
normalised, so each of their characters is its own folding, and folding a literal gives
the only characters it can meet there.
"""

from __future__ import annotations

import re
import warnings
from itertools import product

try:  # The standard library's parser of expressions; without it nothing is known of any.
    from re import _constants as _c
    from re import _parser
except ImportError:  # pragma: no cover
    _parser = None

#: Bounds of a clause: how many literals, and of how many characters.
MOST_LITERALS = 64
MOST_CHARS = 40
# Syntax the rule engine reads otherwise than the parser here: fuzzy counts, and sets with operators.
_OTHERWISE = re.compile(r"\{(?!\d*,?\d*\})|\[\^?\[|--|&&|\|\||~~|\[:")
_RANGE = 12

Clause = frozenset[str]


class _Known:
    """Of a part of an expression: all it can match, if that is known, and clauses."""

    def __init__(self, exact: set[str] | None, clauses: list[Clause] = ()):
        self.exact, self.clauses = exact, list(clauses)


_NOTHING = _Known(None)


def fold(text: str) -> str:
    return text.casefold().replace("ı", "i")


def longest_piece(literal: str) -> int:
    """Characters of the longest part without a space: what an index of tokens can find it by."""
    return max(map(len, literal.split(" ")))


def strength(clause: Clause) -> tuple[int, int]:
    """Clauses to look up first are greater: their weakest literal is long, and they have few."""
    return min(map(longest_piece, clause)), -len(clause)


def _clause(exact: set[str]) -> list[Clause]:
    return [frozenset(exact)] if exact and all(x.strip(" ") for x in exact) else []


def _joined(parts: list[_Known]) -> _Known:
    """Parts one after another: neighbours known in full are one literal."""
    current: set[str] = {""}
    clauses: list[Clause] = []
    whole = True
    for part in parts:
        clauses += part.clauses
        if part.exact is None:
            clauses += _clause(current)
            current, whole = {""}, False
            continue
        longer = {a + b for a, b in product(current, part.exact)}
        if len(longer) > MOST_LITERALS or max(map(len, longer)) > MOST_CHARS:
            clauses += _clause(current)
            current, whole = set(part.exact), False
        else:
            current = longer
    if whole:
        return _Known(current, clauses)
    return _Known(None, clauses + _clause(current))


def _either(parts: list[_Known]) -> _Known:
    if all(p.exact is not None for p in parts):
        exact = set().union(*(p.exact for p in parts))
        if len(exact) <= MOST_LITERALS:
            return _Known(exact)
    best = [max(p.clauses + _clause(p.exact or set()), key=strength, default=None) for p in parts]
    if None in best:
        return _NOTHING
    union = frozenset().union(*best)
    return _Known(None, [union] if len(union) <= MOST_LITERALS else [])


def _characters(items: list) -> _Known:
    chars: set[str] = set()
    for kind, value in items:
        if kind is _c.LITERAL:
            chars.add(chr(value))
        elif kind is _c.RANGE and value[1] - value[0] < _RANGE:
            chars.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return _NOTHING
    folded = [_letter(c).exact for c in chars]
    return _NOTHING if None in folded else _Known(set().union(*folded))


def _letter(char: str) -> _Known:
    """A character; one whose folding leaves marks behind is met in normalised text as something else."""
    folded = fold(char)
    return _Known({folded}) if len(folded) == 1 or folded.isalnum() else _NOTHING


def _repeated(low: int, high: int, part: _Known) -> list[_Known]:
    """At least so many in a row, then whatever follows."""
    if low == 0:
        return [_Known(part.exact | {""}) if high == 1 and part.exact is not None else _NOTHING]
    once = [part] * min(low, 4)
    return once if low == high and low <= 4 else [*once, _NOTHING]


def _parts(kind, value) -> list[_Known]:
    if kind is _c.LITERAL:
        return [_letter(chr(value))]
    if kind is _c.IN:
        return [_characters(value)]
    if kind is _c.SUBPATTERN:
        return [_sequence(value[3])]
    if kind is _c.ATOMIC_GROUP:
        return [_sequence(value)]
    if kind is _c.BRANCH:
        return [_either([_sequence(branch) for branch in value[1]])]
    if kind in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT):
        return _repeated(int(value[0]), int(value[1]), _sequence(value[2]))
    if kind in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
        # They take no room: what stands before and after them is adjacent.
        return [_Known({""})]
    return [_NOTHING]


def _sequence(nodes) -> _Known:
    return _joined([part for kind, value in nodes for part in _parts(kind, value)])


def required_literals(pattern: str) -> list[list[str]]:
    """Clauses of an expression, the best one to look up first; empty if nothing is known."""
    if _parser is None or _OTHERWISE.search(pattern):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            known = _sequence(_parser.parse(pattern, re.IGNORECASE))
    except (re.error, OverflowError, RecursionError, KeyError):
        return []
    clauses = known.clauses + _clause(known.exact or set())
    # A literal that holds another one of its clause says nothing more than that one.
    lean = {frozenset(x for x in c if not any(y != x and y in x for y in c)) for c in clauses}
    return [sorted(c) for c in sorted(lean, key=lambda c: (strength(c), sorted(c)), reverse=True)]
