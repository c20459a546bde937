"""Text columns as flat numpy arrays: slices of bounded size, code point classes, ragged gathers, hashes."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000  # text handled at once by the array code; a longer single text is handled whole
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# Ranges of the Unicode White_Space property.
WHITE_SPACE = (
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    for low, high in WHITE_SPACE:
        out[low : high + 1] = SPACE
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and each text's start, with the end last; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most ``limit`` bytes of text each (one longer text alone), with their flat text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, starts = flat(batch.column(batch.schema.get_field_index(text)))
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(starts, starts[low] + limit, "right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low), data[starts[low] : starts[high]], starts[low : high + 1] - starts[low]
            low = high


def stretches(text: bytes, between: re.Pattern[bytes], size: int = 2**20) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut where ``between`` matches, so what is listed of one part is bounded."""
    at = 0
    while at < len(text):
        cut = between.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def char_widths(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    out = np.ones(len(points), np.int8)
    for first in (0x80, 0x800, 0x10000):
        out += points >= first
    return out


def running(counts: np.ndarray) -> np.ndarray:
    """Start of each part, and the end of the last."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The parts ``values[start : start + length]`` one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    at = np.repeat(starts - running(lengths)[:-1], lengths)
    at += np.arange(total)
    return values[at]


_RANDOM = np.random.default_rng(20_240_517)
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial read from one running sum, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered."""
    return _LOWER[data]


def words(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word (runs without ASCII white space, A-Z lowered), words before each text, and word starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64), np.zeros(0, np.int64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = starts[(starts > 0) & (starts < n)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hashes(_LOWER[data] if lower else data, begins, ends), np.searchsorted(begins, starts), begins
