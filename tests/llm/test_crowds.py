"""Near duplicates in crowds of variants whose common original is not in the table, against all pairs."""

import random

import numpy as np
from llm_helpers import roots, shingles

from tallyspark.llm import lsh_forest as L


def variants(count, seed, words=120, most=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rnd.choices(vocabulary, k=words)
    out = []
    for i in range(count):
        w = list(base)
        for _ in range(rnd.randrange(2, most + 1)):
            w[rnd.randrange(words)] = rnd.choice(vocabulary)
        out.append((10 + i, " ".join(w)))
    return out


def all_pairs(docs):
    """Components by exact counts of common shingles, one matrix product."""
    sets = [shingles(t) for _, t in docs]
    at = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    table = np.zeros((len(docs), len(at)), np.float32)
    for i, own in enumerate(sets):
        table[i, [at[s] for s in own]] = 1
    common = (table @ table.T).astype(int)
    size = np.array([len(s) for s in sets])
    found = np.argwhere(np.triu(100 * common >= 75 * (size[:, None] + size - common), 1))
    return roots({i for i, _ in docs}, [(docs[a][0], docs[b][0]) for a, b in found.tolist()])


def test_crowd_without_its_original(spark, make_docs):
    for count, seed in ((1500, 1), (2500, 2)):
        docs = variants(count, seed)
        want = all_pairs(docs)
        got = {r.doc_id: r.component_id for r in L.near_duplicates(make_docs(docs).repartition(4)).collect()}
        assert sum(got[i] != want[i] for i in want) == 0


def test_two_texts_under_one_id(spark, make_docs):
    rnd = random.Random(6)
    a, b, c, d = (" ".join(rnd.choices([f"w{i}" for i in range(900)], k=60)) for _ in range(4))
    docs = [(5, a), (5, b), (3, a), (9, b), (9, c), (7, c + " more"), (20, d)]
    rows = L.near_duplicates(make_docs(docs)).collect()
    assert len(rows) == len(docs)
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(3, 3, True), (5, 3, False), (7, 3, False), (9, 3, False), (20, 20, True)}
