"""Filter interaction against plain loops over all orders."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import filter_interaction as I
from tallyspark.llm.text_tries import Trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def own(text):
    w = WORD.findall(text)
    return {
        "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
    }


def plain(rows, labels):
    """The audit of (id, text, part) with labels {id: (quality, toxic)}."""
    least = {}
    for id, text, _ in rows:
        if id is not None:
            least[text or ""] = min(id, least.get(text or "", id))
    docs = []
    for id, text, part in rows:
        fails = {k for k, v in own(text or "").items() if v} | ({"E"} if id is not None and id > least[text or ""] else set())
        docs.append((part or "", fails, *labels.get(id, (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        total = Counter()
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            before = set()
            for step, name in enumerate(order):
                hit = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                here = [d for d in docs if d[0] == part and name in d[1]]
                total[name] += len(hit)
                out[part, "".join(order), step + 1] = [len(left), len(hit), sum(bool(d[1] & before) for d in here), sum(d[1] == {name} for d in here), sum(d[2] == 1 for d in hit), sum(d[3] == 1 for d in hit)]
                before.add(name)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, make_docs, rows, labels=(), extra=()):
    docs = make_docs([(id, text, None, part, None) for id, text, part in rows], extra=extra)
    known = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    found = I.audit(I.ledger(I.flagged(docs), known)).collect()
    assert len(found) == len({r[:3] for r in found})
    return {tuple(r[:3]): tuple(r[3:]) for r in found}


GOOD = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(210))


def test_edges(spark, make_docs):
    rows = [
        (5, GOOD, "a"), (3, GOOD, "b"), (3, GOOD, "b"), (9, GOOD, None), (None, GOOD, "a"), (None, None, "a"), (2, None, ""), (1, "", "c"),
        (7, GOOD + " x#", "a"), (8, GOOD + " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA BBBBBBBBBBBBBBBBBB", "a"), (10, "la " * 300, "a"), (11, "la " * 300, "c"), (12, GOOD[:-1], "c"),
        (13, GOOD + "é", "c"), (14, "x y " * 400_000, "long"), (15, "x y " * 400_000, "long"), (16, GOOD, "a"),
    ]
    labels = {3: (1, 0), 9: (1, 1), 10: (0, 1), 16: (1, 0), 15: (1, 0)}
    given = [(i, q, t) for i, (q, t) in labels.items()] + [(16, 0, 0), (None, 1, 1), (99, 1, 1), (8, None, None)]
    found = audited(spark, make_docs, rows, given, extra=("n", "fails", "part", "prefix", "heavy", "s"))
    assert found == plain(rows, labels)
    assert audited(spark, make_docs, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_random_copies(spark, make_docs, monkeypatch, seed):
    """Many copies of few texts, tries handed on early, and prefixes that many texts share."""
    for name, value in {"TRIE_BYTES": 3000, "TRIE_ROWS": 40, "PART_BYTES": 500, "DEPTHS": (2, 4, 8, 16, 64)}.items():
        monkeypatch.setattr(I, name, value)
    draw = random.Random(seed)
    texts = ["common start of many texts " + "".join(draw.choices("ab A#", k=draw.randint(0, 30))) for _ in range(60)] + ["", "a", "ab", "abc"]
    rows = [(draw.randint(0, 300), texts[min(int(draw.expovariate(0.1)), 63)], draw.choice(("s", "s", "t", None))) for _ in range(400)]
    docs = make_docs([(id, text, None, part, None) for id, text, part in rows]).repartition(7)
    least = {}
    for id, text, _ in rows:
        least[text] = min(id, least.get(text, id))
    found = Counter()
    for r in I.flagged(docs).collect():
        found[r.doc_id, r.part, r.fails] += r.n
    want = Counter()
    for id, text, part in rows:
        bits = sum(1 << i for i, f in enumerate("ABCD") if own(text)[f])
        want[id, part or "", bits | I.COPY * (id > least[text])] += 1
    assert found == want


def test_heavy_prefixes_are_split(spark, make_docs, monkeypatch):
    """Different texts behind one prefix are dealt out, copies of one text aren't."""
    monkeypatch.setattr(I, "PART_BYTES", 200)
    texts = spark.createDataFrame([(f"the same beginning {i} " + "x" * i,) for i in range(40)] + [("copy" * 20,)] * 30, "text string")
    heavy = I.heavy_prefixes(texts)
    assert [h.count() for h in heavy] == [1]
    rows = texts.select(F.lit(1).alias("doc_id"), F.lit("").alias("part"), F.lit(0).alias("fails"), F.lit(1).alias("n"), "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [p for p in I.by_prefix(rows, heavy).rdd.glom().map(lambda rows: {r.text for r in rows}).collect() if p]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(map(len, parts)) == 41 and len(parts) > 1


def test_trie():
    draw = random.Random(5)
    texts = [bytes(draw.choices(b"ab", k=draw.randint(0, 9))) for _ in range(500)] + [b"", b"x" * 10_000, b"x" * 10_000 + b"y"]
    trie, least, node = Trie(), {}, {}
    for i, text in enumerate(draw.sample(texts, len(texts))):
        id = draw.randint(0, 99)
        at = trie.insert(text, id)
        assert node.setdefault(text, at) == at
        least[text] = min(id, least.get(text, id))
    assert {text: trie.least[at] for at, text in trie.texts()} == least
    assert len(set(node.values())) == len(least)
    assert trie.size <= sum(map(len, least))
