"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary labelled text.

A dictionary is trained the way cover-based trainers do it, with segments of the class's texts chosen greedily, but a segment
counts by contrast: by how many standard errors more of the class's documents hold it than of the other class's. Segments
are beginnings of words (from ``SHORTEST`` letters up to the whole word), so a stem that is only met inside compounds counts as
a whole word does. Of segments that begin each other only the strongest is taken, if it is ``SIGNIFICANT``. Behind its own segments
each dictionary holds the words that both classes share, so an ordinary word takes the same room under either.
The sample is bounded (``SAMPLE_DOCS`` documents per class, first by a hash of the key), each class trains on its own documents whatever
their number, and copies and near copies (equal in one of ``SAME`` minimum hashes) count once, else the words of one
much-copied text would pass for toxic.

A text is compressed window by window, ``WINDOW`` words each. Letters are written in a fixed pattern of capitals by their place in the word
(``PLACES``, in which no four places in a row look like another four), so a segment matches only at the place
in a word where it was learned. A window stands between two copies of ``CONTEXT``, with which both dictionaries end: zstandard
stores a window raw unless it gains some bytes, and the context gains them whatever the words. Per document the bytes
saved by the toxic dictionary are summed, losses included; ``evidence`` is their sum less what ordinary text of that length saves by chance,
over the square root of the length.

Thresholds are calibrated on the sample: the drift is what ordinary documents save per word; of all cuts with at most
``MOST_FALSE`` of the ordinary documents above, the one with the best balance of both classes' shares; the score is a
logistic curve through ``AT`` there, so ``score >= AT`` is toxic.

Null and empty texts have no evidence. Without labels of both classes all scores are 0. Each row is scored by itself, so
repeated rows and null ids pass through; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import labelled
from tallyspark.llm.compression import Dictionary, letters, parts
from tallyspark.llm.lsh_forest import signatures
from tallyspark.plans.lineage import cut
from tallyspark.sources.tables import spread

SAMPLE_DOCS = 2000
WINDOW = 4  # words
SHORTEST, LONGEST = 3, 24  # letters of a segment; longer words count by their beginning
SIGNIFICANT, SHARED = 5.0, 4.0  # standard errors: segments of one class; words of both
MOST_SEGMENTS, SHARED_WORDS = 20_000, 2000
CONTEXT = b"#0918273645#1726"  # no word of letters matches it
PLACES = "1111000010011010"  # 1: capital; later places are like the last
MATCH = 6  # bytes of the shortest match
TABLE_LOG = 14  # size of the match tables, about one place for each byte of a dictionary
KNOWN_WORDS = 200_000  # spellings kept per task
HALF = 100  # words at which the length starts to count
SAME = 4
MOST_FALSE = 0.01
AT = 0.7
SLOPE = 4.0


def marked(word: str) -> str:
    """A lower-case word with its letters in the pattern of capitals."""
    return "".join(c.upper() if PLACES[min(i, len(PLACES) - 1)] == "1" else c for i, c in enumerate(word))


def segments(word: str) -> list[str]:
    """The beginnings of a marked word behind a space, and the whole word between two."""
    behind = " " + marked(word[:LONGEST])
    return [behind[:i] for i in range(SHORTEST + 1, len(behind) + 1)] + [behind + " "] * (len(word) <= LONGEST)


@dataclass(frozen=True)
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    drift: float = 0.0
    threshold: float = math.inf


class Savings:
    """Bytes that the toxic dictionary saves on the windows of a text."""

    def __init__(self, model: Model):
        self._toxic, self._ordinary = (Dictionary(c + CONTEXT, min_match=MATCH, table_log=TABLE_LOG) for c in (model.toxic, model.ordinary))
        self._known: dict[str, bytes] = {}

    def _spelled(self, word: str) -> bytes:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= KNOWN_WORDS:
                self._known.clear()
            found = self._known[word] = marked(word).encode()
        return found

    def of(self, text: str | None) -> tuple[int, int]:
        """Bytes saved and words."""
        saved = count = 0
        for part in parts(text or ""):
            words = [self._spelled(w) if len(w) < 64 else marked(w).encode() for w in letters(part).split()]
            windows = [CONTEXT + b" " + b" ".join(words[i : i + WINDOW]) + b" " + CONTEXT for i in range(0, len(words), WINDOW)]
            saved += sum(self._ordinary.sizes(windows)) - sum(self._toxic.sizes(windows))
            count += len(words)
        return saved, count


PART = 256  # rows whose texts are Python strings at once


def _measured(rows: DataFrame, model: Model, keep: str) -> DataFrame:
    """``rows`` (one kept column, ``text``) with ``saved`` and ``words`` instead of the text."""
    kind = rows.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = Savings(model)
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                found = [savings.of(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))], names=[keep, "saved", "words"])

    return rows.select(keep, "text").mapInArrow(run, f"`{keep}` {kind}, saved long, words long")


def _segment_counts(sample: DataFrame) -> DataFrame:
    """``segment`` with the toxic (``t``) and ordinary (``o``) documents that hold it, added up within a task first."""

    def handed_on(held: dict[int, Counter]) -> pa.RecordBatch:
        names = list(held[0] | held[1])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([held[y][n] for n in names], pa.int64()) for y in (1, 0))], names=["segment", "t", "o"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = {w for part in parts(text.as_py()) for w in letters(part).split()}
                held[y].update({s for w in words for s in segments(w)})
                if sum(map(len, held.values())) > 500_000:
                    yield handed_on(held)
                    held = {0: Counter(), 1: Counter()}
        yield handed_on(held)

    return sample.select("y", "text").mapInArrow(run, "segment string, t long, o long").groupBy("segment").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _strongest(found: list[tuple[str, float]]) -> list[str]:
    """Greedy choice, strongest first, without any that begins another; ties go to the longest."""
    taken: list[str] = []
    begun: set[str] = set()  # all beginnings of those taken
    for segment, _ in sorted(found, key=lambda x: (-x[1], -len(x[0]), x[0])):
        own = {segment[:i] for i in range(1, len(segment) + 1)}
        if segment not in begun and not own & set(taken):
            taken.append(segment)
            begun |= own
    return taken


def _once(sample: DataFrame) -> DataFrame:
    """``y, text`` of the sample without copies and near copies within a class."""
    marks = signatures(sample, "k").join(sample, F.col("id") == F.col("k"))
    for i in range(SAME):
        first = Window.partitionBy("y", F.substring("signature", 4 * i + 1, 4)).orderBy("k")
        marks = marks.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return marks.select("y", "text")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the documents that ``learn`` names. The driver gets at most ``MOST_SEGMENTS`` segments, ``SHARED_WORDS`` words and
    the sample's evidence."""
    sample = cut(_once(cut(labelled.sample(docs, labels, learn, SAMPLE_DOCS, id, text, label).filter("text IS NOT NULL"))))
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model()
    a, b = F.col("t") / n[1], F.col("o") / n[0]
    pooled = F.least((F.col("t") + F.col("o") + 1) / (n[0] + n[1]), F.lit(0.999))
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    counts = cut(_segment_counts(sample).withColumn("z", z))
    strong = counts.filter((F.abs("z") > SIGNIFICANT) & (F.col("t") + F.col("o") >= 3))
    strong = [(r.segment, r.z) for r in strong.orderBy(F.abs("z").desc(), "segment").limit(MOST_SEGMENTS).collect()]
    both = counts.filter((F.abs("z") < SHARED) & F.col("segment").endswith(" ")).orderBy((F.col("t") + F.col("o")).desc(), "segment").limit(SHARED_WORDS)
    tail = "".join(r.segment for r in reversed(both.collect()))

    def content(sign: int) -> bytes:
        own = _strongest([(s, sign * v) for s, v in strong if sign * v > 0])
        return ("".join(reversed(own)) + tail).encode()

    return _calibrated(Model(content(1), content(-1)), sample)


def _calibrated(model: Model, sample: DataFrame) -> Model:
    seen = _measured(sample, model, "y").toArrow()
    y, saved, words = (seen.column(c).to_numpy() for c in ("y", "saved", "words"))
    drift = float(saved[y == 0].sum() / max(1, words[y == 0].sum()))
    e = (saved - drift * words) / np.sqrt(HALF + words)
    levels = np.unique(e)
    cuts = np.concatenate([[levels[0] - 1], (levels[1:] + levels[:-1]) / 2, [levels[-1] + 1]])
    low, high = np.sort(e[y == 0]), np.sort(e[y == 1])
    false = 1 - np.searchsorted(low, cuts) / len(low)
    caught = 1 - np.searchsorted(high, cuts) / len(high)
    balance = np.where(false <= MOST_FALSE, caught - false, -1.0)
    return replace(model, drift=drift, threshold=float(cuts[balance.argmax()]))


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, score, evidence`` of every row."""
    found = _measured(spread(docs.select(F.col(id), F.col(text).cast("string").alias("text"))), model, id)
    evidence = (F.col("saved") - model.drift * F.col("words")) / F.sqrt(HALF + F.col("words"))
    if not math.isfinite(model.threshold):
        return found.select(id, F.lit(0.0).alias("score"), evidence.alias("evidence"))
    z = SLOPE * (evidence - model.threshold) + math.log(AT / (1 - AT))
    return found.select(id, (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))).alias("score"), evidence.alias("evidence"))
