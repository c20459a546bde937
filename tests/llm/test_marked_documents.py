"""Toxicity on the held-out documents of a whole table, by language group: what is caught and what is flagged by mistake."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language_id, toxicity
from tallyspark.llm.compression import Dictionary, letters

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    held_out = language_id.held_out("doc_id", 3, 1)
    model = toxicity.fit(docs, labels, ~held_out)
    held = docs.join(labels, "doc_id").filter(held_out & F.col("toxic").isNotNull()).select("doc_id", "toxic", "lang", "text")
    known = {r.doc_id: (r.toxic, r.lang, r.text) for r in held.collect()}
    found = {r.doc_id: r for r in toxicity.predict(held, model).collect()}
    return model, known, found


def test_documents_of_every_group_are_found(scored):
    _, known, found = scored
    for lang, least in (("en", 0.8), ("fr", 0.9), ("de", 0.9), ("es", 0.8)):
        caught = [found[i].score >= toxicity.AT for i, (toxic, own, _) in known.items() if toxic and own == lang]
        assert len(caught) >= 10 and np.mean(caught) >= least, lang
        clean = [found[i].score >= toxicity.AT for i, (toxic, own, _) in known.items() if not toxic and own == lang]
        assert np.mean(clean) < 0.05, lang
    assert np.mean([found[i].score >= toxicity.AT for i, (toxic, *_) in known.items() if toxic]) > 0.85
    assert np.mean([found[i].score >= toxicity.AT for i, (toxic, *_) in known.items() if not toxic]) < 0.02


def test_evidence_against_plain_windows(scored):
    """Lengths of all windows under both dictionaries, one call each, added up anew."""
    model, known, found = scored
    toxic, ordinary = (Dictionary(c + toxicity.CONTEXT, min_match=toxicity.MATCH, table_log=toxicity.TABLE_LOG) for c in (model.toxic, model.ordinary))
    for i, (_, _, text) in sorted(known.items())[:60]:
        words = [toxicity.marked(w) for w in letters(text).split()]
        saved = 0
        for at in range(0, len(words), toxicity.WINDOW):
            window = [toxicity.CONTEXT + f" {' '.join(words[at : at + toxicity.WINDOW])} ".encode() + toxicity.CONTEXT]
            saved += ordinary.sizes(window)[0] - toxic.sizes(window)[0]
        assert found[i].evidence == pytest.approx((saved - model.drift * len(words)) / (toxicity.HALF + len(words)) ** 0.5)
        want = 1 / (1 + np.exp(-np.clip(toxicity.SLOPE * (found[i].evidence - model.threshold) + np.log(0.7 / 0.3), -50, 50)))
        assert found[i].score == pytest.approx(want)


def test_segments():
    assert toxicity.segments("idiots") == [" IDI", " IDIO", " IDIOt", " IDIOts", " IDIOts "]
    assert toxicity.segments("ab") == [" AB "]
    long = toxicity.segments("x" * 30)
    assert len(long) == toxicity.LONGEST - toxicity.SHORTEST + 1 and not long[-1].endswith(" ")
    seen = [toxicity.PLACES[i : i + 4] for i in range(len(toxicity.PLACES) - 3)]
    assert len(set(seen)) == len(seen)
    assert toxicity._strongest([(" AB", 7.0), (" ABC", 9.0), (" ABCd", 9.0), (" XY", 8.0), (" XYz", 6.5)]) == [" ABCd", " XY"]
