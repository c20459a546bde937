"""Boolean trigram queries from regular expressions, and postings that answer them.

A query is a set of clauses, an OR of ANDs of trigrams (three UTF-8 bytes, A-Z lowered): every text that the expression
matches holds all trigrams of some clause. The clause without trigrams is held by every text; a query that has it asks
nothing, so its expression scans all texts.

Read off Python's own syntax tree: each part of an expression has the set of strings it matches, while that is small, or
else the strings it can begin and end with; what stands together in a sequence is joined, and strings of three and more
bytes give trigrams. What can't be read off (wide classes, repeats that may be absent, assertions) asks nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as kinds  # the tree that re.compile works from
from re import _parser

import numpy as np

from tallyspark.llm.arrays import running

Query = frozenset[frozenset[bytes]]
ANY: Query = frozenset([frozenset()])
MOST_STRINGS, MOST_CLAUSES, WIDEST = 24, 64, 6
STEP = 2**22  # bytes whose trigrams are looked up at once


def _without_longer(clauses: set[frozenset[bytes]]) -> Query:
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def both(a: Query, b: Query) -> Query:
    """Holds of texts that hold ``a`` and ``b``; too many clauses leave the shorter of them."""
    if len(a) * len(b) > MOST_CLAUSES:
        return min(a, b, key=len)
    return _without_longer({x | y for x, y in product(a, b)})


def either(a: Query, b: Query) -> Query:
    return _without_longer({*a, *b}) if len(a) + len(b) <= MOST_CLAUSES else ANY


def _of_strings(strings: frozenset[bytes]) -> Query:
    return _without_longer({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


@dataclass(frozen=True)
class _Part:
    """What a part of an expression matches: ``exact`` strings, or else its possible first and last bytes."""

    exact: frozenset[bytes] | None
    first: frozenset[bytes]
    last: frozenset[bytes]
    asks: Query = ANY

    def loose(self) -> _Part:
        """Without exact strings; they become trigrams and ends of two bytes."""
        if self.exact is None:
            return self
        return _Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), both(self.asks, _of_strings(self.exact)))


_EMPTY = frozenset([b""])
_NOTHING_KNOWN = _Part(None, _EMPTY, _EMPTY)


def _strings(strings: set[bytes] | frozenset[bytes]) -> _Part:
    return _Part(frozenset(strings), _EMPTY, _EMPTY)


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Part(frozenset(x + y for x, y in product(a.exact, b.exact)), _EMPTY, _EMPTY, both(a.asks, b.asks))
    ends, starts = a.exact or a.last, b.exact or b.first
    asks = both(a.asks, b.asks)
    if len(ends) * len(starts) <= MOST_STRINGS:
        seam = frozenset(x + y for x, y in product(ends, starts))
        asks = both(asks, _of_strings(seam))
        x, y = a.loose(), b.loose()
        first = frozenset(s[:2] for s in seam) if a.exact is not None else x.first
        last = frozenset(s[-2:] for s in seam) if b.exact is not None else y.last
        return _Part(None, first, last, both(asks, both(x.asks, y.asks)))
    x, y = a.loose(), b.loose()
    return _Part(None, x.first, y.last, both(x.asks, y.asks))


def _one_of(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return _Part(a.exact | b.exact, _EMPTY, _EMPTY, either(a.asks, b.asks))
    x, y = a.loose(), b.loose()
    return _Part(None, x.first | y.first, x.last | y.last, either(x.asks, y.asks))


def _folded(code: int) -> bytes:
    return chr(code).encode("utf-8", "replace").lower()


def _class(items: list) -> _Part:
    codes: set[bytes] = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            codes.add(_folded(value))
        elif kind is kinds.RANGE and value[1] - value[0] < 2 * WIDEST:
            codes |= {_folded(c) for c in range(value[0], value[1] + 1)}
        else:
            return _NOTHING_KNOWN
    return _strings(codes) if len(codes) <= WIDEST else _NOTHING_KNOWN


def _read(tree) -> _Part:
    return reduce(_joined, (_node(kind, value) for kind, value in tree), _strings({b""}))


def _node(kind, value) -> _Part:
    if kind is kinds.LITERAL:
        return _strings({_folded(value)})
    if kind is kinds.IN:
        return _class(value)
    if kind is kinds.SUBPATTERN:
        return _read(value[-1])
    if kind is kinds.BRANCH:
        return reduce(_one_of, map(_read, value[1]))
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        least, most, inner = value
        part = _read(inner)
        if least == 0:
            return _one_of(_strings({b""}), part) if most == 1 else _NOTHING_KNOWN
        some = reduce(_joined, [part] * min(least, 3))
        return some if most == least <= 3 else some.loose()
    if kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
        return _strings({b""})
    return _NOTHING_KNOWN


def query_of(pattern: str) -> Query:
    """Trigrams that any match of ``pattern``, compiled with ``re.ASCII``, holds."""
    return _read(_parser.parse(pattern)).loose().asks


class Index:
    """Postings of some trigrams over texts laid end to end: for each trigram the sorted numbers of the texts that hold it."""

    def __init__(self, trigrams: set[bytes], folded: np.ndarray, starts: np.ndarray):
        """``folded``: bytes with A-Z lowered; ``starts``: where each text starts, with the end last."""
        self._n = len(starts) - 1
        names = sorted(trigrams)
        wanted = np.array([int.from_bytes(t, "big") for t in names], np.uint32)
        self._postings = {t: np.zeros(0, np.int64) for t in names}
        if len(folded) < 3 or not names:
            return
        marked = _marked(tuple(wanted.tolist()))
        found = []
        for at in range(0, len(folded) - 2, STEP):
            wide = folded[at : at + STEP + 2].astype(np.uint32)
            codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
            hit = np.flatnonzero(marked[codes])
            text = np.searchsorted(starts, hit + at, "right") - 1
            inside = hit + at + 3 <= starts[text + 1]
            found.append(np.unique(np.searchsorted(wanted, codes[hit[inside]]) * self._n + text[inside]))
        pairs = np.unique(np.concatenate(found))
        bounds = running(np.bincount(pairs // self._n, minlength=len(names)))
        for i, name in enumerate(names):
            self._postings[name] = pairs[bounds[i] : bounds[i + 1]] % self._n

    def holding(self, query: Query) -> np.ndarray:
        """Sorted numbers of the texts that hold all trigrams of some clause."""
        found = [np.zeros(0, np.int64)]
        for clause in query:
            if not clause:
                return np.arange(self._n)
            shortest_first = sorted((self._postings[t] for t in clause), key=len)
            found.append(reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), shortest_first))
        return np.unique(np.concatenate(found))


_marks: dict[tuple[int, ...], np.ndarray] = {}


def _marked(wanted: tuple[int, ...]) -> np.ndarray:
    """True at each wanted code; one table is kept."""
    if wanted not in _marks:
        _marks.clear()
        table = np.zeros(2**24, bool)
        table[list(wanted)] = True
        _marks[wanted] = table
    return _marks[wanted]
