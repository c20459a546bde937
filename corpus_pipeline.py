"""A corpus pipeline of four stages, each on what the one before kept.

Language ID drops what it rejects, the quality rules drop what they reject, near-duplicate removal keeps one document of
each group, and packing places all that is left in sequences. A stage takes ``(spark, docs, sf_dir)`` and returns a frame;
all but the last return the columns of ``documents``. Rows without an id pass each stage on their own merits.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import language_id, lsh_forest, packing, rule_ledger
from tallyspark.plans.lineage import fresh_dir
from tallyspark.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """Carries the columns of ``documents`` through an operator that returns one row per row, in a single column."""
    return docs.select(F.struct(*COLUMNS).alias("doc"), F.col("text"), F.col("doc_id"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found by a margin. Learns from labelled documents of ``sf_dir``."""
    contents = language_id.fit(table(spark, sf_dir, "documents"), F.lit(True))
    found = language_id.predict(_keyed(docs), contents, id="doc")
    return found.filter(~F.col("rejected")).select("doc.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that no rule of the policy rejects."""
    return rule_ledger.passing(_keyed(docs), id="doc").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; of repeated rows of one id the first by text."""
    kept = lsh_forest.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
    return one.select("doc_id", "r.*").union(docs.filter("doc_id IS NULL").select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's pieces in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", language), ("rules", rules), ("near_duplicates", near_duplicates), ("packed", packed)]

#: Compressed lengths and set similarity over all pairs aren't SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "corpus")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
