"""Tokens: the encoder against two libraries, packing, length histogram, codec digests."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_helpers import placed
from tokenizers import Tokenizer

from tallyspark.llm import byte_codec, packing, token_counts
from tallyspark.llm.byte_bpe import Encoder, from_json, from_ranks
from tallyspark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "don't we'll I'm 're '\n's", "x" * 700, "ab" * 300, " \n\n  tail\n", "ß漢字🙂 é ٣½", "'" * 50, "<|endoftext|> as text", "\x1c\x85\xa0 　z"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    ids, begin = encoder(np.frombuffer(b"".join(raw), np.uint8), at)
    return [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]


def test_same_ids_as_both_libraries(library):
    rnd = random.Random(5)
    alphabet = "ab 's'll're  \n\t'tdm1é½漢🙂.,!?-_\x1ćttheing"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(1500)] + [t or "" for t in ODD]
    assert encoded(Encoder(from_ranks(MULTI)), texts) == [library.encode_ordinary(t) for t in texts]
    other = Tokenizer.from_file(JSON)
    other.encode_special_tokens = True
    assert encoded(Encoder(from_json(JSON)), texts) == [x.ids for x in other.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_digests(spark, make_docs, library):
    docs = make_docs([*enumerate(ODD), (3, "a"), (None, "no id")], extra=("ids", "n_tokens"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_codec.round_trip_digests(docs, MULTI).collect())

    def want(i, t):
        ids = library.encode_ordinary(t or "")
        return i is None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert got == sorted(want(i, t) for i, t in [*enumerate(ODD), (3, "a"), (None, "no id")])
    tokens = byte_codec.encode(docs, MULTI)
    back = {r.doc_id: bytes(r.bytes).decode() for r in byte_codec.decoded(tokens, MULTI).collect()}
    assert back[7] == ODD[7] and back[0] == ""
    assert byte_codec.round_trip_digests(make_docs([]), MULTI).count() == 0


def test_packing_query(spark):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op2_sum_of_squares_packing"](spark, SMALL).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and (len(own) == 1) == (len(ids) <= 1024)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    placed(rows, 1024)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.05 * -(-total // 1024) + 1


def test_rule_chooses_the_smallest_sum_of_squares():
    """The vectorised choice against one that recomputes the whole sum."""
    rnd = np.random.default_rng(3)
    for capacity in (7, 20):
        sizes = rnd.integers(0, capacity, 120)
        sequence, offset = packing.place(sizes, capacity)
        fill: list[int] = []
        opened, bound = 0, packing.EAGER * sizes.sum() / capacity
        for i in np.argsort(-sizes, kind="stable"):
            def score(levels):
                return sum(n * n for g, n in Counter(capacity - f for f in levels).items() if 0 < g < capacity)

            s = int(sizes[i])
            choices = [score(fill[:b] + [fill[b] + s] + fill[b + 1 :]) for b in range(len(fill)) if fill[b] < capacity and fill[b] + s <= capacity]
            took, new = int(sequence[i]), int(sequence[i]) == len(fill)
            alone = score([*fill, s])
            if new:
                assert not choices or (opened < bound and alone < min(choices))
                fill.append(0)
                opened += 1
            else:
                assert score(fill[:took] + [fill[took] + s] + fill[took + 1 :]) == min(choices)
            assert offset[i] == fill[took]
            fill[took] += s


def test_pack_edges(spark):
    items = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (2, None, "b"), (3, 10, "c"), (4, 12, "d"), (None, 3, "e"), (5, 0, "f")], "item long, length long, offset string")
    rows = packing.pack(items, capacity=10, block=3).collect()
    assert len(rows) == 7
    assert {r.item for r in rows} == {1, 2, 3, 4, 5, None}
    by = defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.length or 0
    assert max(by.values()) == 12 and sum(v > 10 for v in by.values()) == 1
    assert packing.pack(items.limit(0), capacity=10).count() == 0


def test_length_histogram(spark, make_docs):
    docs = make_docs([*enumerate(ODD), (3, "a"), (None, "a")])
    path = P.path("byte_bpe_50k.tiktoken")
    other = Tokenizer.from_file(JSON)
    other.encode_special_tokens = True
    n = [len(other.encode(t or "", add_special_tokens=False).ids) for t in [*ODD, "a", "a"]]
    table = token_counts.histogram(token_counts.lengths(docs, path))
    rows = {r.length: r for r in table.collect()}
    assert set(rows) == set(n)
    for length, r in rows.items():
        assert (r.n_docs, r.n_tokens) == (n.count(length), n.count(length) * length)
        assert r.docs_from == sum(x >= length for x in n) and r.docs_over == sum(x > length for x in n)
        assert r.tokens_from == sum(x for x in n if x >= length)
        assert r.truncated_tokens == sum(min(x, length) for x in n)
        assert (r.rank_to, r.total_docs, r.total_tokens) == (sum(x <= length for x in n), len(n), sum(n))
    got = {r.context: r for r in token_counts.at_limits(table, [0, 4, 1000]).collect()}
    for limit, r in got.items():
        assert (r.docs_fit, r.docs_cut, r.tokens_kept) == (sum(x <= limit for x in n), sum(x > limit for x in n), sum(min(x, limit) for x in n))
    assert token_counts.quantile(table, 0.5).first().length == sorted(n)[-(-len(n) // 2) - 1]
    assert token_counts.histogram(token_counts.lengths(make_docs([]), path)).count() == 0
