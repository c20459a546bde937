"""Byte-level BPE over whole columns of text.

Texts are cut into pieces by the usual split pattern with array operations on code point classes. The distinct pieces
of a slice go, by length, into padded matrices of token ids; each round every row merges its leftmost pair of lowest
rank, the two new pairs are looked up in an open hash table, and finished rows leave the matrix. Rows of one matrix
shrink by one token a round, so its last column goes too. Pieces seen before in a task come from a bounded cache.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from tallyspark.llm.arrays import LETTER, SPACE, char_classes, char_widths, code_points, gather, hashes, running

NO_RANK = np.int32(2**31 - 1)
FREE = np.uint64(2**64 - 1)
CELLS = 100_000  # of one padded matrix
CACHED_PIECES = 600_000  # distinct pieces a task remembers


def piece_starts(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """True where a piece starts. ``texts``: where each text starts, the end last.

    The pattern: English contractions; letters, digits or other marks, each run with one space before it; white space,
    whose last character goes to what follows.
    """
    n = len(points)
    out = np.zeros(n, bool)
    if not n:
        return out
    kind = char_classes()[points]
    fresh = np.zeros(n + 1, bool)  # a text starts here
    fresh[texts] = True
    out[1:] = kind[1:] != kind[:-1]
    out |= fresh[:n]
    begin = np.flatnonzero(out)
    end = np.append(begin[1:], n)
    kinds = kind[begin]
    followed = ~fresh[end]  # by another run of the same text
    white = np.flatnonzero((kinds == SPACE) & followed)
    out[end[white] - 1] = True
    out[end[white[points[end[white] - 1] == 0x20]]] = False
    quote = np.flatnonzero((points[begin] == 0x27) & (end - begin == 1) & followed & out[begin])
    quote = quote[kinds[np.minimum(quote + 1, len(kinds) - 1)] == LETTER]
    at, room = begin[quote] + 1, end[quote + 1] - begin[quote + 1]
    one = points[at]
    two = np.where(room > 1, points[np.minimum(at + 1, n - 1)], 0)
    is_one = np.isin(one, [ord(c) for c in "stmd"])
    is_two = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    found = is_one | is_two
    at, size = at[found], np.where(is_two[found], 2, 1)
    out[at] = False
    after = at + size
    out[after[after < n]] = True
    return out


def pieces(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pieces (the end last), and the number of pieces before each text."""
    points = code_points(data)
    at = running(char_widths(points))
    first = np.searchsorted(at, texts)
    starts = np.flatnonzero(piece_starts(points, first))
    return np.append(at[starts], len(data)), np.searchsorted(starts, first)


@dataclass
class Vocabulary:
    """Merge pairs in a hash table with linear probing, the ids of single bytes, and the bytes of each id."""

    byte_id: np.ndarray
    token: list[bytes]
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray  # a pair's rank tells what it merges to
    merged: np.ndarray
    whole_first: bool
    bits: int = 20
    keys: np.ndarray = field(init=False)
    rank_at: np.ndarray = field(init=False)
    result: np.ndarray = field(init=False)  # id that a merge of this rank makes
    flat: np.ndarray = field(init=False)
    length: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        while (1 << self.bits) < 4 * len(self.left):
            self.bits += 1
        size = 1 << self.bits
        self.keys = np.full(size, FREE)
        self.rank_at = np.full(size, NO_RANK)
        key = (self.left.astype(np.uint64) << np.uint64(32)) | self.right.astype(np.uint64)
        left, at = np.arange(len(key)), self._home(key)
        while len(left):
            free = self.keys[at] == FREE
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            self.rank_at[at[one]] = self.rank[left[one]]
            self.keys[at[one]] = key[left[one]]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.start = running(self.length)[:-1]
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.result = np.full(int(self.rank.max(initial=0)) + 1, -1, np.int32)
        self.result[self.rank] = self.merged
        if self.whole_first:
            known = np.flatnonzero(self.length)
            h = hashes(self.flat, self.start[known], self.start[known] + self.length[known])
            order = np.argsort(h)
            self.whole_hash, self.whole_id = h[order], known[order]

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NO_RANK`` without one. Ids below 0 (padding) have none."""
        shape = a.shape
        key = ((a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)).view(np.uint64).ravel()
        at = self._home(key)
        there = self.keys[at]
        out = np.where(there == key, self.rank_at[at], NO_RANK)
        more = np.flatnonzero((there != key) & (there != FREE))
        mask = (1 << self.bits) - 1
        while len(more):
            at[more] = (at[more] + 1) & mask
            there = self.keys[at[more]]
            hit = there == key[more]
            out[more[hit]] = self.rank_at[at[more[hit]]]
            more = more[~hit & (there != FREE)]
        return out.reshape(shape)

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each row of a padded matrix (-1) to the end: the tokens of all rows in order, and how many each has."""
        rows, width = ids.shape
        out = np.full((rows, width), -1, np.int32)
        row = np.arange(rows)
        rank = self.find(ids[:, :-1], ids[:, 1:])
        while len(row) and rank.shape[1]:
            at = rank.argmin(1)
            here = np.arange(len(row))
            lowest = rank[here, at]
            going = lowest != NO_RANK
            if not going.all():
                out[row[~going], : ids.shape[1]] = ids[~going]
                row, ids, rank, at, lowest = row[going], ids[going], rank[going], at[going], lowest[going]
                here = here[: len(row)]
            ids[here, at] = self.result[lowest]
            n, width = len(row), ids.shape[1] - 1
            stays = np.ones((n, width + 1), bool)
            stays[here, at + 1] = False
            ids = ids[stays].reshape(n, width)
            stays = np.ones((n, width), bool)
            stays[here, at] = False  # the merged pair's rank goes, its neighbours' ranks are looked up anew
            rank = rank[stays].reshape(n, width - 1)
            for side in (-1, 0):
                has = np.flatnonzero((at + side >= 0) & (at + side < width - 1))
                c = at[has] + side
                rank[has, c] = self.find(ids[has, c], ids[has, c + 1])
        if len(row):
            out[row, : ids.shape[1]] = ids
        real = out >= 0
        return out[real], real.sum(1)

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One very long piece: the same merges, leftmost lowest rank first, on one row without moving the rest."""
        n = len(ids)
        ids = ids.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.find(ids[:-1], ids[1:]), NO_RANK)
        block = max(16, int(n**0.5))
        pad = -n % block
        rank = np.append(rank, np.full(pad, NO_RANK))
        low = rank.reshape(-1, block).min(1)
        while True:
            b = int(low.argmin())
            if low[b] == NO_RANK:
                break
            i = b * block + int(rank[b * block : (b + 1) * block].argmin())
            j = int(after[i])
            ids[i] = self.result[rank[i]]
            ids[j] = -1
            k = int(after[j])
            after[i] = k
            if k < n:
                before[k] = i
            touched = [j, i]
            rank[j] = NO_RANK
            h = int(before[i])
            for x, y in ((h, i), (i, k)):
                if x >= 0:
                    rank[x] = self.find(ids[x : x + 1], ids[y : y + 1])[0] if y < n else NO_RANK
                    touched.append(x)
            for t in {t // block for t in touched}:
                low[t] = rank[t * block : (t + 1) * block].min()
        return ids[ids >= 0]

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces in order, and how many each piece has."""
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # rows and their tokens, bucket by bucket
        left = np.ones(len(starts), bool)
        if self.whole_first and len(starts):
            h = hashes(data, starts, starts + lengths)
            at = np.minimum(np.searchsorted(self.whole_hash, h), len(self.whole_hash) - 1)
            hit = (self.whole_hash[at] == h) & (lengths == self.length[self.whole_id[at]])
            rows = np.flatnonzero(hit)
            counts[rows] = 1
            parts.append((rows, self.whole_id[at[rows]].astype(np.int32)))
            left = ~hit
        bounds = [0, 2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256]
        for low, width in zip(bounds, bounds[1:]):
            bucket = np.flatnonzero(left & (lengths > low) & (lengths <= width))
            for rows in np.array_split(bucket, -(-len(bucket) * width // CELLS)) if len(bucket) else ():
                size = lengths[rows]
                cell = np.arange(width)
                inside = cell < size[:, None]
                at = np.where(inside, starts[rows][:, None] + cell, 0)
                ids, n = self.merge_rows(np.where(inside, self.byte_id[data[at]], -1).astype(np.int32))
                counts[rows] = n
                parts.append((rows, ids))
        for r in np.flatnonzero(left & (lengths > bounds[-1])):
            ids = self.merge_long(self.byte_id[data[starts[r] : starts[r] + lengths[r]]].astype(np.int32))
            counts[r] = len(ids)
            parts.append((np.array([r]), ids.astype(np.int32)))
        begin = running(counts)
        out = np.empty(begin[-1], np.int32)
        for rows, ids in parts:
            n = counts[rows]
            at = np.repeat(begin[rows] - running(n)[:-1], n) + np.arange(len(ids))
            out[at] = ids
        return out, counts


@lru_cache(maxsize=4)
def from_ranks(path: str) -> Vocabulary:
    """A rank file: any two neighbours whose bytes together are a token may merge; whole tokens are taken at once."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    token = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        token[r] = t
    triples = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
    left, right, rank = np.array(triples, np.int64).T
    single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    return Vocabulary(single, token, left, right, rank, rank, True)


@lru_cache(maxsize=4)
def from_json(path: str) -> Vocabulary:
    """A tokenizers file with byte-level BPE: the listed merges in their order. Special tokens' strings are plain text."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # bytes that don't print stand as code points from 256 on
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printing))}
    byte = {c: b for b, c in letter.items()}
    ids = model["vocab"]
    token = [b""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        token[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right, merged = np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], np.int64).T
    single = np.array([ids[letter[i]] for i in range(256)], np.int32)
    return Vocabulary(single, token, left, right, np.arange(len(merges)), merged, False)


class Encoder:
    """Encodes slices of flat text, remembering the tokens of pieces by their hash."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)  # sorted
        self.code = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and where each text's ids start, the end last."""
        import pandas as pd

        if len(self.seen) > CACHED_PIECES:
            self._forget()
        edges, before = pieces(data, texts)
        starts, ends = edges[:-1], edges[1:]
        codes, distinct = pd.factorize(hashes(data, starts, ends))
        one = np.empty(len(distinct), np.int64)
        one[codes[::-1]] = np.arange(len(codes))[::-1]
        at = np.searchsorted(self.seen, distinct)
        known = at < len(self.seen)
        known[known] = self.seen[at[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            ids, count = self.vocabulary.encode_pieces(data, starts[one[new]], (ends - starts)[one[new]])
            self.ids = np.concatenate([self.ids, ids])
            self.code = np.concatenate([self.code, len(self.count) + np.arange(len(new))])
            self.count = np.concatenate([self.count, count])
            self.seen = np.concatenate([self.seen, distinct[new]])
            order = np.argsort(self.seen, kind="stable")
            self.seen, self.code = self.seen[order], self.code[order]
            at = np.searchsorted(self.seen, distinct)
        which = self.code[at][codes] if len(codes) else np.zeros(0, np.int64)
        count = self.count[which]
        out = gather(self.ids, running(self.count)[:-1][which], count)
        return out, running(count)[before]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes that the ids stand for."""
    return gather(vocabulary.flat, vocabulary.start[ids], vocabulary.length[ids])
