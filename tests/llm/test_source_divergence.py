"""Source divergence against plain Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import source_divergence as S

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows):
    """Rows of the audit from (text, lang, source)."""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= 3}
        sources = [s for at, s in count if at == lang]
        own = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}

        def p(counts):
            total = sum(counts.values()) + len(kept)
            return {t: 1 + 10**9 * (c + 1) // total for t, c in counts.items()}

        ps, q = {s: p(own[s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(o, sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (ps[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, S.TOP)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def audited(make_docs, rows, extra=()):
    docs = make_docs([(i, text, lang, source, None) for i, (text, lang, source) in enumerate(rows)], extra=extra)
    found = [tuple(r) for r in S.audit(docs).collect()]
    assert len(found) == len(set(found))
    return set(found)


def random_rows(seed, n, words):
    draw = random.Random(seed)
    vocabulary = [draw.choice(("é", "ß", "a", "Zz", "漢", "q")) + "".join(draw.choices("abcXYZ", k=draw.randint(0, 3))) for _ in range(words)]
    rows = []
    for _ in range(n):
        text = draw.choice((" ", "-", "1", "\n")).join(draw.choices(vocabulary, k=int(draw.expovariate(0.1))))
        rows.append((text, draw.choice(("en", "en", "de", None)), draw.choice(("web", "web", "web", "a", "b", "", None, "ü"))))
    return rows


@pytest.mark.parametrize(("n", "words", "block"), [(40, 10, 4096), (150, 400, 16), (150, 60, 7)])
def test_random(spark, make_docs, monkeypatch, n, words, block):
    monkeypatch.setattr(S, "BLOCK_TERMS", block)
    monkeypatch.setattr(S, "TASK_TERMS", 50)
    rows = random_rows(n + words, n, words)
    assert audited(make_docs, rows) == plain(rows)


def test_edges(spark, make_docs):
    long = "Hot " * 700_000 + "cold"  # one text in several stretches
    rows = [
        (None, None, None), ("", "", "x"), ("same same", "en", "a"), ("same same", "en", "a"), ("same same", "en", "a"),
        ("1234 !?", "en", "nothing"), ("other", "en", "b"), (long, "fr", "a"), ("hot", "fr", "b"), ("HOT cold", "fr", "b"), ("cold", "fr", None),
        ("rare", "xx", "a"), ("seldom", "xx", "b"), ("lone word", "yy", "only"), ("lone word", "yy", "only"), ("lone word", "yy", "only"),
        ("tie b a", "zz", "s1"), ("tie b a", "zz", "s1"), ("tie b a", "zz", "s1"), ("tie", "zz", "s2"),
    ]
    want = plain(rows)
    assert audited(make_docs, rows, extra=("term", "n", "docs", "uses", "v", "value", "rank", "block")) == want
    assert {(r[1], r[3], r[4]) for r in want if r[0] == "xx"} == {("a", "b", 0), ("b", "a", 0)}
    assert not any(r[0] == "yy" and r[2] == "pair" for r in want)
    assert audited(make_docs, []) == set()


def test_more_terms_than_ranks(spark, make_docs):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(26 * 12)]
    rows = [(" ".join(words), "en", "a")] * 3 + [("other words wholly", "en", "b")] * 3
    want = plain(rows)
    assert sum(r[1] == "a" and r[2] == "term" for r in want) == S.TOP
    assert audited(make_docs, rows) == want


def test_joint_cells():
    draw = np.random.default_rng(3)
    size = 1000
    counts = draw.geometric(0.3, (2, size)) - 1
    sides = [S.Levels(np.flatnonzero(c), c[c > 0], size, int(c.sum()), size) for c in counts]
    cells = sides[0].cells(sides[1])
    names = [[0, *np.unique(c[c > 0]).tolist()] for c in counts]
    for i, a in enumerate(names[0]):
        for j, b in enumerate(names[1]):
            assert cells[i, j] == ((counts[0] == a) & (counts[1] == b)).sum()


def test_large_counts_are_exact():
    assert S.shares([10**13], 10**15, 10**6).tolist() == [1 + 10**9 * (10**13 + 1) // (10**15 + 10**6)]
