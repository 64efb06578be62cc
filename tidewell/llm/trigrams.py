"""Boolean trigram queries of regular expressions.

A query is an OR of ANDs: a list of trigram sets, of which a matching text (ASCII letters lowered) holds at least one
entirely. A query with an empty set demands nothing: the rule has no mandatory trigram and has to scan every text.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

Query = list[frozenset[str]]
ANY: Query = [frozenset()]
#: Strings spelled out, and ANDs in a query, before a part of the expression is taken as unknown.
MOST = 64


def _slim(query: Query) -> Query:
    """Drop the sets that another set's presence already implies."""
    kept: Query = []
    for s in sorted(set(query), key=lambda s: (len(s), sorted(s))):
        if not any(k <= s for k in kept):
            kept.append(s)
    return kept


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST:
        return min(a, b, key=len) if ANY[0] not in min(a, b, key=len) else max(a, b, key=len)
    return _slim([x | y for x in a for y in b])


def _of_strings(strings: set[str]) -> Query:
    return _slim([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _spelled(items: list) -> set[str] | None:
    """The characters of a class, if they are few."""
    chars: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return chars if len(chars) <= 8 else None


def _walk(node) -> tuple[set[str] | None, Query]:
    """All strings that the node can match (None: not known), and its query."""
    run: set[str] = {""}
    query, known = ANY, True
    for kind, value in node:
        exact: set[str] | None = None
        inner = ANY
        if kind is op.LITERAL:
            exact = {chr(value).lower()}
        elif kind is op.IN:
            exact = _spelled(value)
        elif kind is op.AT:
            exact = {""}
        elif kind is op.SUBPATTERN:
            exact, inner = _walk(value[3])
        elif kind is op.BRANCH:
            found = [_walk(x) for x in value[1]]
            if all(x is not None for x, _ in found):
                exact = set().union(*(x for x, _ in found))
            else:
                inner = _slim([s for _, q in found for s in q])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, sub = value
            strings, inner = _walk(sub)
            if strings is not None and most == 1:
                exact = strings | ({""} if least == 0 else set())
            elif strings is not None and least == most and len(strings) ** least <= MOST:
                exact = {""}
                for _ in range(least):
                    exact = {a + b for a in exact for b in strings}
            elif least == 0:
                inner = ANY
        if exact is not None and len(exact) * len(run) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        query = _both(query, _of_strings(run))
        if exact is not None and len(exact) <= MOST:
            run = exact
        else:
            query, run = _both(query, inner), {""}
        known = False
    return (run if known else None), _both(query, _of_strings(run))


def query_of(pattern: str) -> Query:
    return _walk(parser.parse(pattern))[1]
