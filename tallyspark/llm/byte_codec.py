"""Byte-level BPE encoding and decoding of a text column (length-bucketed padded matrices, see ``byte_bpe``).

Null and empty texts have no tokens. Special tokens' strings are plain text. Rows are handled on their own, so repeated
rows, extra columns and an empty table need no care; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrays import gather, running, slices
from tallyspark.llm.byte_bpe import Encoder, decode, from_json, from_ranks
from tallyspark.sources.tables import spread


def vocabulary(path: str):
    """Of a rank file or a tokenizers file; every node has it under the same path."""
    return from_json(path) if path.endswith(".json") else from_ranks(path)


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``ids``, the token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for part, data, texts in slices(batches, "text"):
            ids, at = encoder(data, texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=[id, "ids"])

    return _input(docs, id, text).mapInArrow(run, f"`{id}` {_kind(docs, id)}, ids array<int>")


def decoded(tokens: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id`` and ``bytes``, what the token ids stand for; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            out = [decode(words, np.array(x.as_py() or [], np.int64)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id, "bytes"])

    return tokens.select(F.col(id), F.col(ids).alias("ids")).mapInArrow(run, f"`{id}` {_kind(tokens, id)}, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids again, and returns digests of both: ``id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        encoder = Encoder(words)
        decimal = [b"%d," % i for i in range(len(words.token))]
        size = np.array([len(d) for d in decimal])
        begin, decimal = running(size)[:-1], np.frombuffer(b"".join(decimal), np.uint8)
        for part, data, texts in slices(batches, "text"):
            ids, at = encoder(data, texts)
            listed, listed_at = gather(decimal, begin[ids], size[ids]), running(size[ids])[at]
            back, back_at = decode(words, ids), running(words.length[ids])[at]
            listed, back = listed.tobytes(), back.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(listed_at[:-1], listed_at[1:])], pa.string()),
                    pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(back_at[:-1], back_at[1:])], pa.string()),
                ],
                names=[id, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _input(docs, id, text).mapInArrow(run, f"`{id}` {_kind(docs, id)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _input(docs: DataFrame, id: str, text: str) -> DataFrame:
    return spread(docs.select(F.col(id), F.col(text).cast("string").alias("text")))
