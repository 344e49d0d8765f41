"""Boolean trigram queries of regular expressions.

A query is an OR of ANDs: a set of clauses, each a set of lower-case trigrams.
Any text that the expression matches contains, when lower-cased, all trigrams
of at least one clause. The clause set ``{frozenset()}`` asks for nothing: such
an expression has no mandatory trigram.

Derived on the driver from Python's parse of the expression, bottom up, with
for every part the strings it may be (when few), else the strings it may begin
and end with; strings that meet where parts are concatenated give trigrams.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

ANYTHING: frozenset = frozenset({frozenset()})
FEW = 32  # strings that a part is followed through
CLAUSES = 64


def _any_of(texts: frozenset[str]) -> frozenset:
    """The query 'one of ``texts`` occurs'."""
    return _least(frozenset(frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts))


def _least(clauses: frozenset) -> frozenset:
    """Without clauses that ask for more than another one."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: frozenset, b: frozenset) -> frozenset:
    out = _least(frozenset(x | y for x in a for y in b))
    return out if len(out) <= CLAUSES else a if len(a) <= len(b) or b == ANYTHING else b


@dataclass(frozen=True)
class _Part:
    """``exact``: all strings the part matches, or None when they are many."""

    exact: frozenset[str] | None
    begins: frozenset[str] = frozenset({""})
    ends: frozenset[str] = frozenset({""})
    query: frozenset = ANYTHING

    def first(self) -> frozenset[str]:
        return self.begins if self.exact is None else self.exact

    def last(self) -> frozenset[str]:
        return self.ends if self.exact is None else self.exact

    def asks(self) -> frozenset:
        return self.query if self.exact is None else _any_of(self.exact)


EMPTY, MANY = _Part(frozenset({""})), _Part(None)


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= FEW:
        return _Part(frozenset(x + y for x in a.exact for y in b.exact))
    query = _both(a.asks(), b.asks())
    ends, begins = {x[-2:] for x in a.last()}, {y[:2] for y in b.first()}
    if len(ends) * len(begins) <= CLAUSES:
        query = _both(query, _any_of(frozenset(x + y for x in ends for y in begins)))
    first = a.begins if a.exact is None else {x + y for x in a.exact for y in begins}
    last = b.ends if b.exact is None else {x + y for x in ends for y in b.exact}
    return _Part(None, frozenset(x[:2] for x in first), frozenset(x[-2:] for x in last), query)


def _either(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= FEW:
        return _Part(a.exact | b.exact)
    query = _least(a.asks() | b.asks())
    return _Part(None, frozenset(x[:2] for x in a.first() | b.first()),
                 frozenset(x[-2:] for x in a.last() | b.last()),
                 query if len(query) <= CLAUSES else ANYTHING)


def _members(items: list) -> _Part:
    chars: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 64:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:  # a negation, a category or a wide range
            return MANY
    return _Part(frozenset(chars)) if len(chars) <= FEW // 2 else MANY


def _part(kind, value) -> _Part:
    if kind is op.LITERAL:
        return _Part(frozenset({chr(value).lower()}))
    if kind is op.IN:
        return _members(value)
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        out = _sequence(value[1][0])
        for one in value[1][1:]:
            out = _either(out, _sequence(one))
        return out
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value[0], value[1], _sequence(value[2])
        if least == 0:
            return _either(inner, EMPTY) if most == 1 else MANY
        out = inner
        for _ in range(min(least, 8) - 1):
            out = _then(out, inner)
        return out if least == most <= 8 else _then(out, MANY) if inner.exact is not None else _Part(
            None, inner.begins, inner.ends, inner.query)
    if kind is op.AT:
        return EMPTY
    return MANY  # any character, a negated one, a look-around or a reference


def _sequence(items) -> _Part:
    out = EMPTY
    for kind, value in items:
        out = _then(out, _part(kind, value))
    return out


def trigram_query(pattern: str) -> frozenset:
    """The clauses of ``pattern``; ``ANYTHING`` when it has no mandatory trigram."""
    query = _sequence(parser.parse(pattern)).asks()
    return ANYTHING if frozenset() in query else query
