"""Language ID by compression: each language's zstandard dictionary holds labelled text, the shortest code wins.

The dictionaries are fitted on a bounded sample: per language the ``SAMPLE_DOCS`` labelled texts that come first by a hash
of the row's key, short ones (at most ``SAMPLE_CHARS``) before long ones; of a longer one ``PIECES`` pieces from all over it, as many
characters in all. Prediction reads every text whole, in windows: the sum of compressed window lengths per language. The margin is the
runner-up's distance in parts of its length; a narrow margin (below ``NARROW``) or a text without a letter is rejected.

Compressed lengths are whole bytes, and zstandard stores what gains too little raw, so short texts often tie. A text of one
window with a narrow margin is measured again, a few words at a time between two copies of ``CONTEXT`` that every dictionary
ends with, which gain enough for the words' own savings to show; its margin is that of these lengths less the context's.

Null text, or text without a letter (number signs are none), is ``und`` with score 0, and so is all if no language was learned. Ties
go to the language that sorts first. Each row is predicted by itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.compression import Dictionary, letters, windows
from tallyspark.sources.tables import spread

SAMPLE_DOCS, SAMPLE_CHARS, PIECES = 48, 6000, 12
WINDOW = 512
CONTEXT, FEW = b"#0918273645#1726", 3  # no word of letters matches it; words between two copies
PART = 256  # rows whose texts are Python strings at once
NARROW = 0.005
SURE = 0.04  # margin at which the score is 1 - 1/e


def fit(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content of each language. ``learn``: which rows may be learned from; null languages are not.

    The driver gets at most ``SAMPLE_DOCS * SAMPLE_CHARS`` characters per language.
    """
    rows = docs.filter(learn & F.col(lang).isNotNull()).select(F.col(id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    key = F.xxhash64(F.coalesce("id", F.lit("")))
    size = F.char_length("text")
    first = Window.partitionBy("lang").orderBy(~size.between(200, SAMPLE_CHARS), key, "text")
    piece = SAMPLE_CHARS // PIECES
    spread_out = F.expr(f"concat_ws(' ', transform(sequence(0, {PIECES - 1}), i -> substring(text, 1 + cast(i * (char_length(text) - {piece}) / {PIECES - 1} as int), {piece})))")
    sample = rows.select("lang", F.when(size > SAMPLE_CHARS, spread_out).otherwise(F.col("text")).alias("part"), F.row_number().over(first).alias("n")).filter(F.col("n") <= SAMPLE_DOCS)
    found: dict[str, list[tuple[int, str]]] = {}
    for r in sample.collect():
        found.setdefault(r.lang, []).append((r.n, letters(r.part)))
    return {k: " ".join(t for _, t in sorted(v)).encode() for k, v in sorted(found.items())}


class _Closely:
    """Compressed lengths of short texts, a few words at a time, less those of the context around them."""

    def __init__(self, contents: list[bytes]):
        self._of = [Dictionary(c + b" " + CONTEXT, thorough=True) for c in contents]
        self._bare = [d.sizes([CONTEXT + b"  " + CONTEXT])[0] for d in self._of]

    def sizes(self, plain: bytes) -> np.ndarray:
        words = plain.split()
        parts = [CONTEXT + b" " + b" ".join(words[i : i + FEW]) + b" " + CONTEXT for i in range(0, len(words), FEW)]
        return np.array([max(1, sum(d.sizes(parts)) - len(parts) * bare) for d, bare in zip(self._of, self._bare)])


def _margin(size: np.ndarray) -> float:
    at = int(size.argmin())
    return float(1 - size[at] / np.delete(size, at).min())


def predict(docs: DataFrame, contents: dict[str, bytes], id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, lang_pred, score, margin, rejected`` of every row."""
    kind = docs.schema[id].dataType.simpleString()
    names = sorted(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries = [Dictionary(contents[n]) for n in names]
        closely = _Closely([contents[n] for n in names])
        for batch in (whole.slice(at, PART) for whole in batches for at in range(0, whole.num_rows, PART)):
            best, margin = [], []
            for whole in batch.column(1).to_pylist():
                plain = letters(whole).encode()
                if not plain or not names:
                    best.append("und")
                    margin.append(0.0)
                    continue
                parts = windows(plain, WINDOW)
                size = np.array([sum(d.sizes(parts)) for d in dictionaries])
                found = _margin(size) if len(names) > 1 else 1.0
                if found < NARROW and len(parts) == 1:
                    size = closely.sizes(plain)
                    found = _margin(size)
                best.append(names[int(size.argmin())])
                margin.append(found)
            m = np.array(margin)
            none = np.array([b == "und" for b in best])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(1 - np.exp(-m / SURE)), pa.array(m), pa.array(none | (m < NARROW))],
                names=[id, "lang_pred", "score", "margin", "rejected"],
            )

    rows = spread(docs.select(F.col(id), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, f"`{id}` {kind}, lang_pred string, score double, margin double, rejected boolean")


def held_out(id: str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % parts == part, F.lit(False))
