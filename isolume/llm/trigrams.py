"""Boolean trigram queries from regular expressions.

A query is an OR of ANDs: a list of sets of trigrams, one of which a text must
hold whole if the pattern matches it. A list that has an empty set holds for
every text. Trigrams are of the lower-cased text, which only widens a query.
"""

from __future__ import annotations

import re
from itertools import product

from re import _constants as c
from re import _parser

ANY: list[frozenset[str]] = [frozenset()]
#: Literal alternatives are followed up to this many strings; beyond it a part demands nothing.
MOST_STRINGS = 64


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    return _least({x | y for x, y in product(a, b)})


def _least(sets: set[frozenset[str]]) -> list[frozenset[str]]:
    """Drops each set that holds another one."""
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _of_strings(strings: set[str]) -> list[frozenset[str]]:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _strings(op, arg) -> set[str] | None:
    """All strings that a part can match, lower-cased; None if they are too many."""
    if op is c.LITERAL:
        return {chr(arg).lower()}
    if op is c.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is c.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is c.IN and all(x[0] is c.LITERAL for x in arg):
        return {chr(x[1]).lower() for x in arg}
    if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if op is c.AT:
        return {""}
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        part = _strings(op, arg)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, part)}
    return out


def _query(items) -> list[frozenset[str]]:
    out, run = ANY, {""}
    for op, arg in items:
        part = _strings(op, arg)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, part)}
            continue
        out, run = _both(out, _of_strings(run)), {""}
        if op is c.SUBPATTERN:
            out = _both(out, _query(arg[-1]))
        elif op is c.BRANCH:
            out = _both(out, _least(set().union(*map(_query, arg[1]))))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] >= 1:
            out = _both(out, _query(arg[2]))
    return _both(out, _of_strings(run))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The clauses of a pattern; [frozenset()] if it has no mandatory trigrams."""
    return _query(_parser.parse(pattern, re.IGNORECASE if pattern.startswith("(?i)") else 0))
