"""Quality by attention-based multiple-instance learning: a document is a bag of passages, only bags have labels.

A passage is ``PASSAGE_WORDS`` words in a row. Its encoding counts how byte kinds follow one another (letters by case, digits,
white space, line breaks, kinds of marks), and measures its words: length, distinct ones, ones equal to the word before, and
ones inside a four-word run that stands more than once in the document. A learned layer turns it into ``h``; gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` over the document's passages weighs them into one vector, and a logistic unit
scores that. All of it is learned from document labels by gradient descent on a bounded sample: the first ``SAMPLE_DOCS``
labelled documents per class by a hash of the key, without those of more than ``SAMPLE_CHARS`` characters.

Scoring reads every text whole, all its passages. A null or empty text is one empty passage. Without labels of both classes
all scores are 0.5. Each row is scored by itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import labelled
from tallyspark.llm.arrays import mix, running, slices, words
from tallyspark.sources.tables import spread

PASSAGE_WORDS = 64
SAMPLE_DOCS, SAMPLE_CHARS = 2500, 12_000
HIDDEN, GATE = 24, 16
ROUNDS, BATCH, RATE, DECAY = 12, 64, 4e-3, 1e-4

KINDS = 12
_KIND = np.zeros(256, np.uint8)  # 0: other marks
for _kind, _bytes in enumerate((b"", range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), range(0x80, 0x100), b" \t\x0b\x0c\r", b"\n", b".", b",;:", b"!?", b"#*$%&<>|", b"'\"()-")):
    _KIND[list(_bytes)] = _kind
FEATURES = KINDS * KINDS + 6


def encode(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages, and the number of passages before each text (each text has one at least)."""
    word, before, begin = words(data, texts)
    n = np.diff(before)
    count = np.maximum(1, -(-n // PASSAGE_WORDS))
    first = running(count)
    text_of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(word)) - before[:-1][text_of]
    passage = first[text_of] + place // PASSAGE_WORDS
    total = int(first[-1])
    out = np.zeros((total, FEATURES), np.float32)
    size = np.maximum(1, np.bincount(passage, minlength=total))
    if len(data):
        # a byte belongs to the passage of the last word that starts at or before it, else to its text's first
        owner = np.zeros(len(data), np.int64)
        owner[texts[:-1][np.diff(texts) > 0]] = first[:-1][np.diff(texts) > 0]
        owner[begin] = np.maximum(owner[begin], passage)
        owner = np.maximum.accumulate(owner)
        kind = _KIND[data].astype(np.int64)
        cell = owner[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
        cell = cell[owner[1:] == owner[:-1]]
        pairs = np.bincount(cell, minlength=total * KINDS * KINDS).reshape(total, -1)
        out[:, : KINDS * KINDS] = np.sqrt(pairs / np.maximum(1, pairs.sum(1, keepdims=True)))
        bytes_of = np.bincount(owner, minlength=total)
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (text_of[1:] == text_of[:-1])
        key = mix(word + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct = np.bincount(passage[np.unique(key, return_index=True)[1]], minlength=total)
        run = np.zeros(len(word), bool)
        if len(word) > 3:
            four = mix(word[:-3] + word[1:-2] * np.uint64(3) + word[2:-1] * np.uint64(5) + word[3:] * np.uint64(7) + text_of[:-3].astype(np.uint64))
            _, back, times = np.unique(four, return_inverse=True, return_counts=True)
            twice = (times[back] > 1) & (text_of[3:] == text_of[:-3])
            for j in range(4):
                run[j : len(word) - 3 + j] |= twice
        extra = [bytes_of / size / 8, distinct / size, np.bincount(passage, again, total) / size, np.bincount(passage, run, total) / size, np.log1p(size), np.log1p(np.repeat(n, count)) / 4]
        out[:, KINDS * KINDS :] = np.stack(extra, 1)
    else:
        out[:, KINDS * KINDS + 4] = np.log1p(size)  # what an empty text has among others, too
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights by name; empty if nothing could be learned."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, bag = self.w, np.repeat(np.arange(len(first) - 1), np.diff(first))
        x = np.clip((x - w["mean"]) / w["scale"], -6, 6)
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        a = (t * s) @ w["a"]
        a = np.exp(a - np.maximum.reduceat(a, first[:-1])[bag])
        a /= np.add.reduceat(a, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "p": _sigmoid(z @ w["c"] + w["b"])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["p"] if self.w else np.full(len(first) - 1, 0.5)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, first)
        d = (f["p"] - y) * weight / weight.sum()
        dz = d[:, None] * w["c"]
        dz_row = dz[f["bag"]]
        da = (f["h"] * dz_row).sum(1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["bag"]])
        dt, du = ds[:, None] * w["a"] * f["s"] * (1 - f["t"] ** 2), ds[:, None] * w["a"] * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz_row + dt @ w["V"].T + du @ w["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dx, "e": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ du, "a": (f["t"] * f["s"]).T @ ds, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}


def learn_weights(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """Adam on the bags; classes weigh alike."""
    rnd = np.random.default_rng(seed)
    w = {"mean": x.mean(0), "scale": x.std(0) + 0.02}
    for name, shape in (("E", (x.shape[1], HIDDEN)), ("V", (HIDDEN, GATE)), ("U", (HIDDEN, GATE))):
        w[name] = rnd.normal(0, shape[0] ** -0.5, shape)
    w |= {"e": np.zeros(HIDDEN), "a": rnd.normal(0, GATE**-0.5, GATE), "c": rnd.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1)}
    model = Model(w)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items() if k not in ("mean", "scale")}
    step = 0
    for _ in range(ROUNDS):
        order = rnd.permutation(len(y))
        for at in range(0, len(order), BATCH):
            bags = order[at : at + BATCH]
            count = np.diff(first)[bags]
            rows = np.repeat(first[bags] - running(count)[:-1], count) + np.arange(count.sum())
            step += 1
            for k, g in model.gradients(x[rows], running(count), y[bags], weight[bags]).items():
                g = g + DECAY * w[k]
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] = w[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from the documents that ``learn`` names. The driver gets the encodings of the bounded sample."""
    rows = labelled.sample(docs, labels, learn, SAMPLE_DOCS, id, text, label)
    sample = rows.filter(F.char_length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, texts in slices(batches, "text"):
            x, at = encode(data, texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["y", "x"])

    got = sample.mapInArrow(run, "y int, x binary").toArrow()
    y = got.column("y").to_numpy()
    if len(np.unique(y)) < 2:
        return Model()
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got.column("x").to_pylist()]
    order = sorted(range(len(bags)), key=lambda i: (y[i], bags[i].tobytes()))  # the same however rows arrive
    return learn_weights(np.concatenate([bags[i] for i in order]).astype(np.float64), running(np.array([len(bags[i]) for i in order])), y[order])


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, score, n_passages`` of every row."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, texts in slices(batches, "text"):
            x, first = encode(data, texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x, first)), pa.array(np.diff(first))], names=[id, "score", "n_passages"])

    rows = spread(docs.select(F.col(id), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, f"`{id}` {kind}, score double, n_passages long")
