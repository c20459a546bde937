"""Language, toxicity and quality: held-out accuracy on the given tables, and the edges of each definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language_id, quality_mil, toxicity
from tallyspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    return docs, labels


def test_language_query(spark, table_rows):
    docs, _ = table_rows
    rows = QUERIES["op9_language_id"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.02


def test_toxicity_query(spark, table_rows):
    docs, labels = table_rows
    rows = QUERIES["op10_toxicity"](spark, FOLDER).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    clean = [r.predicted for r in rows if r.held_out and r.doc_id in labels and labels[r.doc_id].toxic == 0]
    assert np.mean(clean) < 0.05


def test_quality_query(spark, table_rows):
    docs, labels = table_rows
    rows = QUERIES["op1_quality_mil"](spark, FOLDER).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = [r.predicted == labels[r.doc_id].quality for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean(right) > 0.97


ODD = [(1, None), (2, ""), (3, " 12 !? "), (4, "x"), (4, "x"), (None, "the same again and again"), (5, "long text here " * 20_000)]


def test_language_edges(spark, make_docs):
    docs = make_docs([(i, "the cat sat on the mat with another cat " * 3, "en") for i in range(9)] + [(i + 20, "der hund und die katze sind nicht hier gewesen " * 3, "de") for i in range(9)], extra=("score",))
    contents = language_id.fit(docs, F.lit(True))
    assert sorted(contents) == ["de", "en"]
    odd = make_docs([*ODD, (7, "THE CAT sat on the mat"), (8, "die katze und der hund")], extra=("lang_pred", "margin"))
    rows = language_id.predict(odd, contents).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1, 2, 3, 7, 8)] == ["und", "und", "und", "en", "de"] and by[1].rejected and by[1].score == 0
    assert not by[7].rejected and not by[8].rejected
    assert language_id.predict(make_docs([]), contents).count() == 0
    nothing = language_id.fit(make_docs([(1, "text", None), (2, None, "en")]), F.lit(True))
    assert nothing == {} and {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    one = language_id.predict(odd, {"en": contents["en"]}).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}


def test_language_of_short_texts_and_number_signs(spark, make_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    contents = language_id.fit(docs, F.lit(True))
    rows = [(1, "²"), (2, "½ ① 12 Ⅷ"), (3, "_ 5"), (4, "the"), (5, "that of the"), (6, "der die"), (7, "ó"), (8, "x²")]
    by = {r.doc_id: r for r in language_id.predict(make_docs(rows), contents).collect()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(by[i].rejected and by[i].score == 0 for i in (1, 2, 3))
    assert all(by[i].lang_pred != "und" for i in range(4, 9))
    assert all(r.rejected == (r.lang_pred == "und" or r.margin < language_id.NARROW) for r in by.values())
    closely = language_id._Closely([b"one language of this kind ", b"eine andere sprache hat das "])
    assert closely.sizes(b"language kind").argmin() == 0 and closely.sizes(b"andere sprache").argmin() == 1


def test_long_labelled_texts_are_learned_from_all_over(spark, make_docs):
    long = "a" * 9000 + " middle " + "b" * 9000 + " finish"
    content = language_id.fit(make_docs([(1, long, "xx")]), F.lit(True))["xx"]
    assert b"a" * 400 in content and b"b" * 400 in content and b"finish" in content and len(content) < language_id.SAMPLE_CHARS + 50


def test_toxicity_edges(spark, make_docs):
    rnd = np.random.default_rng(1)
    vocabulary = [f"{a}{b}{c}" for a in ("lo", "mi", "ta", "ze") for b in ("ran", "sol", "vel") for c in ("do", "ki", "pu", "x")]
    text = lambda bad: " ".join([*rnd.choice(vocabulary, 30), *(["abominable"] * bad), *rnd.choice(vocabulary, 30)])
    docs = make_docs([(i, text(i % 2)) for i in range(200)], extra=("y", "k", "n"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    mark = toxicity.marked("abominable")
    assert mark.encode() in model.toxic and mark.encode() not in model.ordinary
    odd = make_docs([*ODD, (7, text(1)), (8, text(0))], extra=("evidence", "score"))
    by = {r.doc_id: r.score for r in toxicity.predict(odd, model).collect()}
    assert len(by) == 8 and by[7] >= toxicity.AT and all(v < toxicity.AT for i, v in by.items() if i != 7)
    assert toxicity.predict(make_docs([]), model).count() == 0
    none = toxicity.fit(docs, labels.filter("toxic = 0"), F.lit(True))
    assert {r.score for r in toxicity.predict(odd, none).collect()} == {0.0}


def test_quality_edges(spark, make_docs):
    rnd = np.random.default_rng(1)
    good = lambda: " ".join(rnd.choice(["river", "stone", "light", "under", "walked", "slowly"], 90))
    junk = lambda: " | ".join(rnd.choice(["BUY", "###", "$$$", "NOW!!"], 90))
    docs = make_docs([(i, good() if i % 2 else junk()) for i in range(120)], extra=("y", "n", "x"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(999, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    model = quality_mil.fit(docs, labels, F.lit(True))
    odd = make_docs([*ODD, (7, good()), (8, junk()), (9, junk() + "\n" + good())], extra=("score", "n_passages"))
    rows = quality_mil.predict(odd, model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in rows)
    assert by[7].score > 0.5 > by[8].score and by[1].n_passages == 1 and by[5].n_passages == -(-60_000 // 64)
    assert quality_mil.predict(make_docs([]), model).count() == 0
    none = quality_mil.fit(docs, labels.filter("quality = 1"), F.lit(True))
    assert {r.score for r in quality_mil.predict(odd, none).collect()} == {0.5}


def test_gradients_of_the_attention_model():
    rnd = np.random.default_rng(0)
    x, first, y = rnd.normal(size=(9, quality_mil.FEATURES)), np.array([0, 4, 5, 9]), np.array([1, 0, 1])
    rounds, quality_mil.ROUNDS = quality_mil.ROUNDS, 1
    try:
        model = quality_mil.learn_weights(x, first, y)
    finally:
        quality_mil.ROUNDS = rounds
    weight = np.array([0.3, 0.5, 0.2])

    def loss():
        p = model.forward(x, first)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    for name, g in model.gradients(x, first, y, weight).items():
        at = tuple(rnd.integers(0, s) for s in model.w[name].shape)
        kept = model.w[name][at]
        values = []
        for step in (1e-5, -1e-5):
            model.w[name][at] = kept + step
            values.append(loss())
        model.w[name][at] = kept
        assert np.isclose((values[0] - values[1]) / 2e-5, g[at], atol=1e-6), name
    out = model.forward(x, first)
    assert np.allclose(np.add.reduceat(out["a"], first[:-1]), 1)


def test_passages_see_only_their_text():
    texts = ["one two  three\n" * 40, "", "Zwölf | ### UPPER " * 30, "x"]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    whole, first = quality_mil.encode(np.frombuffer(b"".join(raw), np.uint8), at)
    for i, r in enumerate(raw):
        own, _ = quality_mil.encode(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.allclose(own, whole[first[i] : first[i + 1]], atol=1e-6)
