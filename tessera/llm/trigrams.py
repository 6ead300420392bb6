"""Boolean trigram queries that every match of a regular expression satisfies.

A query is ``True`` (no trigram is mandatory), a trigram, or ("and"/"or", parts).
Trigrams are lower-case: a text is asked in lower case too, so the query is
necessary for patterns of either kind of case.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser

#: Alternatives of an exact stretch that are kept apart.
MOST = 64

Query = bool | str | tuple


def _all(parts: list[Query]) -> Query:
    flat = {q for p in parts if p is not True for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else ("and", tuple(sorted(flat, key=str)))


def _any(parts: list[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    sets = [frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts]
    least = [s for s in dict.fromkeys(sets) if not any(t < s for t in sets)]  # a part that asks for more than another adds nothing
    queries = [_all(list(s)) for s in least]
    return queries[0] if len(queries) == 1 else ("or", tuple(sorted(queries, key=str)))


def _of_strings(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return True
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _charset(items: list) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is c.LITERAL:
            found.add(chr(value).lower())
        elif kind is c.RANGE and value[1] - value[0] < 8:
            found |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(items) -> tuple[set[str] | None, Query]:
    """Exact strings of a sequence, if they are few, and what any match of it asks for otherwise."""
    run: set[str] = {""}
    parts: list[Query] = []
    exact = True
    for kind, value in items:
        own: set[str] | None = None
        asks: Query = True
        if kind is c.LITERAL:
            own = {chr(value).lower()}
        elif kind is c.IN:
            own = _charset(value)
        elif kind is c.SUBPATTERN:
            own, asks = _walk(value[3])
        elif kind is c.BRANCH:
            walked = [_walk(x) for x in value[1]]
            own = set().union(*(w for w, _ in walked)) if all(w is not None for w, _ in walked) else None
            asks = _any([_of_strings(w) if w is not None else q for w, q in walked])
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, sub = value
            inner, inner_asks = _walk(sub)
            if inner is not None and high == 1:
                own = inner | ({""} if low == 0 else set())
            elif low:
                asks = _of_strings(inner) if inner is not None else inner_asks
        elif kind is c.AT:
            own = {""}
        if own is not None and len(run) * len(own) <= MOST:
            run = {a + b for a in run for b in own}
            continue
        parts.append(_of_strings(run))
        run, exact = {""}, False
        if own is not None:
            run = own
        else:
            parts.append(asks)
    if exact:
        return run, _of_strings(run)
    return None, _all([*parts, _of_strings(run)])


def trigram_query(pattern: str) -> Query:
    exact, asks = _walk(parser.parse(pattern))
    return _of_strings(exact) if exact is not None else asks


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*(trigrams_of(q) for q in query[1])) if isinstance(query, tuple) else set()
