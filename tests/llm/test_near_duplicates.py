"""Near duplicates against all pairs, components against a plain union-find, and the edges of the definition."""

import random

from llm_helpers import brute, roots

from tallyspark.llm import lsh_forest as L
from tallyspark.llm.queries import QUERIES

def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want, size = brute(docs)
    got = {r.doc_id: r for r in QUERIES["op5_lsh_forest"](spark, folder).collect()}
    assert len(got) == len(docs)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: size[k] for k, (i, _) in enumerate(docs)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_large_groups_chains_and_edges(spark, make_docs):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rnd.choices(vocabulary, k=120)
    docs = [(1000 + i, " ".join(base)) for i in range(60)]  # copies
    for i in range(150):  # near copies of one text, differing from each other
        w = list(base)
        for _ in range(rnd.randrange(1, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        docs.append((2000 + i, " ".join(w)))
    shared = rnd.choices(vocabulary, k=60)  # a passage that unlike texts share
    docs += [(3000 + i, " ".join([*shared, *rnd.choices(vocabulary, k=rnd.randrange(30, 200))])) for i in range(120)]
    chain = rnd.choices(vocabulary, k=400)  # each link alike, the ends not
    docs += [(4000 + i, " ".join(chain[i * 8 : i * 8 + 90])) for i in range(30)]
    docs += [(1, None), (2, ""), (3, " \n "), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "É x y z w"), (8, "é x y z w"), (9, "long " * 3 + "word " * 9000)]
    want, _ = brute(docs)
    rnd.shuffle(docs)
    frame = make_docs([*docs, (4, "One two"), (None, "One two"), (None, None)], extra=("a", "b", "id", "label", "class", "set")).repartition(5)
    rows = L.near_duplicates(frame).collect()
    assert len(rows) == len(docs) + 3
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2
    assert want[5] == 4 and want[6] == 6 and want[8] == 8 and want[2000] == 1000
    assert L.near_duplicates(make_docs([])).count() == 0
    assert L.near_duplicates(make_docs([(1, None), (2, "")])).count() == 2


def test_components(spark):
    rnd = random.Random(9)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(64)] + [(2000, 2000 + i) for i in range(1, 40)]
    rows = L.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = roots({i for p in pairs for i in p}, pairs)
    assert {r.id: r.label for r in rows} == {i: t for i, t in want.items() if i != t}
