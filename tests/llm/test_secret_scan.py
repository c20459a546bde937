"""Secret scan: spans against the plain expressions, trigram queries against their own matches."""

import hashlib
import random
import re

import numpy as np
import pytest

from tallyspark.llm import secret_scan as S
from tallyspark.llm.trigram_queries import ANY, Index, query_of

PLAIN = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24),
} | {r.kind: (r.pattern, lambda m: True) for r in S.MORE}
KINDS = list(PLAIN)


def plain(text):
    found = [(m.start(), KINDS.index(k), m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


BITS = [
    "password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "api__key", "AKIA", "akia", "=", ":", " ", "  ", '"', "'", "abc", "hunter22", "a1b2c3d4e5f6", "0123456789abcdef",
    "é", "漢", "😀", "\n", "-----BEGIN ", "RSA PRIVATE KEY-----", "PRIVATE KEY-----", "ghp_", "gho_", "xoxb-", "1234567890", "ABCDEFGHIJKLMNOPQRST", "://", "user:pw@", "K", "ſ",
]


def test_random_texts(spark, make_docs):
    draw = random.Random(11)
    texts = ["".join(draw.choices(BITS, k=draw.randint(0, 30))) for _ in range(600)]
    texts += ["".join(draw.choices(BITS, k=3000)), "password=abc;password=abcdef", "AKIAAKIA" + "A" * 12, "AKIA" + "A" * 15, "f" * 23, "f" * 24 + "g" + "0" * 30, "tokentoken= token=value1"]
    found = {r.doc_id: r for r in S.digests(S.scan(make_docs(list(enumerate(texts))))).collect()}
    hit = set()
    for i, text in enumerate(texts):
        want, r = plain(text), found[i]
        base = [s for s in want if s[0] in ("assign", "access", "hex")]
        hit |= {s[0] for s in want}
        assert r.spans == joined(want), text
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
    assert hit == set(KINDS)


def test_edges(spark, make_docs):
    long = "filler words " * 250_000 + "secret: abcdef12 " + "漢" * 10 + " AKIA" + "Z" * 16
    rows = [(1, None), (2, ""), (3, long), (None, "token=abcdefg"), (4, "token=abcdefg"), (4, "token=abcdefg"), (5, " \n")]
    found = S.digests(S.scan(make_docs(rows, extra=("found", "kind", "spans", "start")))).collect()
    assert sorted((str(r.doc_id), r.spans) for r in found) == sorted((str(i), joined(plain(t))) for i, t in rows)
    assert len(plain(long)) == 2
    assert S.digests(S.scan(make_docs([]))).count() == 0


def folded(text):
    data = np.frombuffer(text.encode().lower(), np.uint8)
    return Index({t for q in (query_of(r.pattern) for r in S.RULES) for c in q for t in c}, data, np.array([0, len(data)]))


def test_rules_ask_for_trigrams():
    asked = {r.kind: query_of(r.pattern) for r in S.RULES}
    assert [k for k, q in asked.items() if q == ANY] == ["hex"]
    assert asked["access"] == {frozenset([b"aki", b"kia"])}
    assert len(asked["assign"]) == 6


@pytest.mark.parametrize(
    "pattern",
    ["abc", "ab", "a?bcd", "(abc|xyz)+q", "x*abc", "[ab]cd[ef]g", "[a-z]bcd", "ab(c|d|)ef", "(ab){2,5}c", "a.c.def", "(?:foo|ba[rz])qux?", "é漢a", "^abc$", r"\bword\b", r"a\d{3}bcd", "(?=abc)abcd", "(a|b)(c|d)(e|f)(g|h)(i|j)(k|l)"],
)
def test_query_holds_of_every_match(pattern):
    """Every text that holds a match holds a clause, over random texts from the expression's own characters."""
    draw = random.Random(pattern)
    query, expression = query_of(pattern), re.compile(pattern, re.ASCII)
    letters = "abcdefghijklxyzquorwé漢 0123" if len(pattern) > 6 else "abcd"
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 14))) for _ in range(3000)]
    texts += ["abcdefg", "acdeg", "foobarqux", "foobazqu", "bcd", "abef", "abcef", "ababc", "abababc", "é漢a", "a word b", "a123bcd", "acegik", "bdfhjl", "abcxyzq", "azczdef"]
    data = np.frombuffer("".join(texts).encode().lower(), np.uint8)
    starts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    index = Index({t for c in query for t in c}, data, starts)
    held = set(index.holding(query).tolist())
    matching = {i for i, t in enumerate(texts) if expression.search(t)}
    assert matching <= held
    if query != ANY:
        assert held == {i for i, t in enumerate(texts) if any(all(x in t.encode().lower() for x in c) for c in query)}


def test_only_candidates_are_matched(spark, make_docs):
    """An expression never sees a text without its trigrams: such texts are no candidates."""
    index = folded("plain words without any")
    assert [r.kind for r in S.RULES if len(index.holding(query_of(r.pattern)))] == ["hex"]
