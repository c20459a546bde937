"""The pipeline against a version made of plain loops where the stages can be stated so."""

import corpus_pipeline as P
import public_tokenizers
from llm_helpers import brute, failed_rules, placed
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import language_id

FOLDER = "/root/testdata/sf0.01"


def test_stages_against_plain_loops(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames, df = [], docs
    for name, stage in P.STAGES:
        stage(spark, df, FOLDER).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        frames.append(df)
    rows = {r.doc_id: r for r in docs.collect()}
    first = {r.doc_id: r for r in frames[0].collect()}
    found = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs, F.lit(True))).collect()}
    assert set(first) == {i for i, r in found.items() if r.lang_pred != "und" and r.margin >= language_id.NARROW}
    assert all(tuple(first[i]) == tuple(rows[i]) for i in first) and frames[0].columns == docs.columns
    second = {r.doc_id: r.text for r in frames[1].collect()}
    assert set(second) == {i for i in first if not failed_rules(rows[i].text)}
    root, _ = brute(list(second.items()))
    third = {r.doc_id: r.text for r in frames[2].collect()}
    assert set(third) == {i for i in second if root[i] == i} and frames[2].columns == docs.columns
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    size = {}
    out = frames[3].collect()
    for r in out:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in third.items()}
    placed(out, 1024)


def test_run_and_odd_rows(spark, make_docs, tmp_path):
    text = " ".join(f"the {w} of thing and then" for w in "river stone light house water garden window table".split())
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34", "en"), (4, text, "en"), (5, text, "en"), (4, text, "en"), (None, text, "en"), (6, "wort und nicht die der das " * 9, "de")]
    make_docs(rows, extra=("kept", "doc", "id")).write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {4, 5, 6, None} and 4 in {r.doc_id for r in out} and 5 not in {r.doc_id for r in out}
    assert len([r for r in out if r.doc_id == 4]) == 1
    make_docs([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
