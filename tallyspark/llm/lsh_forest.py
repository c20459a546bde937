"""Near-duplicate documents by an LSH forest.

Each text becomes its set of distinct five-word shingles. Texts with equal sets form one class, which goes on as its
smallest id, so copies never meet as pairs. A class has ``3 * TREES`` minimum hashes. Tree t orders all classes by the
hashes from number 3t on (cyclically, ``DEPTH`` of them), and each class is paired with its ``REACH`` next neighbours in
that order as long as the first three hashes agree. Neighbours in the order share the longest prefix there is, so depth
follows the region; in a crowded one (more than ``CROWD`` classes that agree in three hashes) only the ``CLOSE`` next ones are
taken, and hubs (below) stand for the rest. So pairs grow with the classes, never with the square of a region. The orders are made by range partitioning, which
splits a crowded region at any place; the few rows at partition borders are paired in a second step.

A pair of similarity s agrees in the three first hashes of some tree with probability 1 - (1 - s^3)^24, 0.999998 at 0.75.
Pairs whose sketches agree in less than ``ROUGH`` of the hashes are dropped (0.75 is 4.9 standard deviations above it).
The others are confirmed on full sets until no unconfirmed pair lies between two components: first one pair per class,
then one per component, then from both ends of crossing pairs to one and to more hubs of the other end's component (see
``_to_hubs``), then all that still cross. Pairs inside a component cannot change it and aren't confirmed.

Pairs further apart in an order than the next neighbours are left to a last step (see ``_crowd_links``): in each region with
more classes than neighbours reach, all pairs of classes that agree in three hashes and are still in different components
are compared on full sets. So a linked pair is found with the same probability in a crowd and outside; the steps before
only make the components that need not be compared inside. That work grows with the members outside a region's largest
component times its members; it is dealt out in blocks of ``BLOCK`` shingles.

Null or empty texts have no shingles and are linked with nothing. Rows with one id are one document, whichever of their
texts is linked. A null id is linked
with nothing, its component is null and it is kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.arrays import mix, slices, words
from tallyspark.plans.lineage import cut, shuffles_dropped
from tallyspark.sources.tables import spread

SHINGLE = 5
SIMILAR = 75  # per cent
TREES, FIRST, DEPTH, REACH = 24, 3, 9, 8
CROWD, CLOSE = 24, 3
ROUGH = 0.5
HUBS = 32
BLOCK, LEAST = 2**18, 128  # shingles of one side of a comparison of crowded classes; what a small class counts there
PART_ROWS = 500_000  # rows of small tables (pairs, links, labels) that go to one task
HASHES = TREES * FIRST
_RANDOM = np.random.default_rng(71)
_TIMES = _RANDOM.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, HASHES, np.uint64)
_PLACE = [np.uint64(pow(0xC2B2AE3D27D4EB4F, j, 2**64)) for j in range(SHINGLE)]


def shingle_sets(data: np.ndarray, texts: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    word, before, _ = words(data, texts)
    n = len(word)
    rolled = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        rolled += word[j : n - SHINGLE + 1 + j] * _PLACE[j] if len(rolled) else rolled
    rolled = mix(rolled)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(rolled[a : b - SHINGLE + 1])
        elif b > a:
            short = np.array(_PLACE[: b - a], np.uint64)
            yield mix((word[a:b] * short).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield word[:0]


def signatures(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` (long), ``n_shingles``, ``class`` (digest of the set) and ``signature`` (big-endian minimum hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, texts in slices(batches, "text"):
            size, digest, signature = [], [], []
            for found in shingle_sets(data, texts):
                size.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                least = np.full(HASHES, 2**64 - 1, np.uint64)
                for at in range(0, len(found), 4096):
                    np.minimum(least, (_TIMES[:, None] * found[at : at + 4096] + _PLUS[:, None]).min(1), out=least)
                signature.append((least >> np.uint64(32)).astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], names=["id", "n_shingles", "class", "signature"])

    rows = spread(docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, "id long, n_shingles long, class binary, signature binary")


def _sets(docs: DataFrame, id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(data, texts)], pa.binary())], names=["id", "set"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, set binary")


def _next_neighbours(ids: np.ndarray, tree: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids at most ``REACH`` apart in the order whose first hashes agree, ``CLOSE`` in a crowd."""
    new = np.ones(len(ids), bool)
    new[1:] = (tree[1:] != tree[:-1]) | (order[1:, : 4 * FIRST] != order[:-1, : 4 * FIRST]).any(1)
    region = np.cumsum(new)
    crowded = np.bincount(region)[region] > CROWD
    for step in range(1, min(REACH, len(ids) - 1) + 1):
        near = np.flatnonzero((region[step:] == region[:-step]) & (ids[step:] != ids[:-step]) & ((step <= CLOSE) | ~crowded[step:]))
        yield ids[near], ids[near + step]


def _crowded(tree: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of rows whose first hashes agree with those of a row that is out of their reach."""
    step = REACH + 1
    return np.flatnonzero((tree[step:] == tree[:-step]) & (order[step:, : 4 * FIRST] == order[:-step, : 4 * FIRST]).all(1))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, 4 * DEPTH)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), order


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(a, b), np.maximum(a, b)


def _first(t: int, j: int = 0) -> Column:
    """``FIRST`` hashes from place ``j`` of tree t's order on."""
    return F.substring("signature", 4 * ((FIRST * t + j) % HASHES) + 1, 4 * FIRST)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``a < b`` of neighbours in any tree, from ``id`` and ``signature``, and the regions ``tree, head`` that
    hold more classes than neighbours reach."""
    turns = [F.concat(*[_first(t, j) for j in range(0, DEPTH, FIRST)]) for t in range(TREES)]
    rows = classes.select("id", F.posexplode(F.array(*turns)).alias("tree", "order"))
    ordered = rows.repartitionByRange("tree", "order", "id").sortWithinPartitions("tree", "order", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last rows so far
        head = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _columns(batch)
            ids, tree, order = new if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, new))
            known = 0 if held is None else len(held[0])
            a, b = [], []
            for x, y in _next_neighbours(ids, tree, order):
                a.append(x)
                b.append(y)
            if a:
                a, b = _pairs(np.concatenate(a), np.concatenate(b))
                both = np.unique(np.stack([a, b], 1), axis=0)
                yield _rows(both[:, 0], both[:, 1])
            yield _heads(tree, order)
            if head <= REACH:  # the first rows of the partition
                size = min(REACH + 1 - head, len(ids) - known)
                yield _rows(ids[known : known + size], None, tree[known : known + size], order[known : known + size])
                head += size
            held = tuple(x[-REACH - 1 :] for x in (ids, tree, order))
        if held is not None:
            yield _rows(held[0], None, held[1], held[2])

    found = cut(ordered.mapInArrow(run, "a long, b long, tree int, order binary"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_columns(batch) for batch in batches if batch.num_rows]
        if parts:
            ids, tree, order = (np.concatenate(c) for c in zip(*parts))
            for x, y in _next_neighbours(ids, tree, order):
                yield _rows(*_pairs(x, y))
            yield _heads(tree, order)

    # at most 2 * REACH + 2 rows per partition, so one task: pairs across one border or several short partitions
    borders = found.filter("a IS NOT NULL AND b IS NULL").select("a", "tree", "order").distinct().coalesce(1).sortWithinPartitions("tree", "order", "a")
    whole = found.union(cut(borders.mapInArrow(across, "a long, b long, tree int, order binary")))
    return whole.filter("b IS NOT NULL").select("a", "b").distinct(), whole.filter("a IS NULL").select("tree", F.col("order").alias("head")).distinct()


def _heads(tree: np.ndarray, order: np.ndarray) -> pa.RecordBatch:
    """Rows without ids: the first hashes of crowded regions, once each."""
    at = _crowded(tree, order)
    tree, order = tree[at], np.ascontiguousarray(order[at, : 4 * FIRST])
    new = np.ones(len(at), bool)
    new[1:] = (tree[1:] != tree[:-1]) | (order[1:] != order[:-1]).any(1)
    return _rows(None, None, tree[new], order[new])


def _rows(a: np.ndarray | None, b: np.ndarray | None, tree: np.ndarray | None = None, order: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(tree if a is None else a)
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, pa.int64()) if a is None else pa.array(a),
            pa.nulls(n, pa.int64()) if b is None else pa.array(b),
            pa.nulls(n, pa.int32()) if tree is None else pa.array(tree),
            pa.nulls(n, pa.binary()) if order is None else pa.array([x.tobytes() for x in order], pa.binary()),
        ],
        names=["a", "b", "tree", "order"],
    )


def _sketches(classes: DataFrame) -> DataFrame:
    """``id`` and ``sketch``: the last byte of each minimum hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, HASHES, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in whole[:, :, 3]], pa.binary())], names=["id", "sketch"])

    return classes.select("id", "signature").mapInArrow(run, "id long, sketch binary")


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs with ``share``, the part of sketch places that agree, if it is at least ``ROUGH``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            share = (x == y).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["a", "b", "share"]).filter(pa.array(share >= ROUGH))

    both = pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    # an id that stands for several texts may meet itself in several ways
    return both.mapInArrow(run, "a long, b long, share double").groupBy("a", "b").agg(F.max("share").alias("share"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                keep.append(both > 0 and 100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``label``, the smallest id reachable, for every id in the links ``a, b`` but that smallest one.

    Alternates two steps until every id points to a root and nowhere else: every id hands its smallest neighbour to its
    larger neighbours, then to its smaller ones. Distances halve, so rounds grow with the logarithm of the longest path.
    """
    edges = _few(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() or _two_ways(edges):
        ways = _together(edges, edges.select("v", "u"))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = _few(_together(small.select(F.col("v").alias("u"), F.col("m").alias("v")), small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _two_ways(edges: DataFrame) -> bool:
    """Whether an id still has two smaller neighbours."""
    return not edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _few(df: DataFrame) -> DataFrame:
    """A checkpointed table in as few partitions as its rows need; one partition joins and groups without an exchange."""
    kept = cut(df)
    return kept.coalesce(max(1, -(-kept.count() // PART_ROWS)))


def _together(one: DataFrame, other: DataFrame) -> DataFrame:
    """Their union; of two single partitions one."""
    both = one.union(other)
    return both.coalesce(1) if one.rdd.getNumPartitions() == other.rdd.getNumPartitions() == 1 else both


def links(docs: DataFrame, classes: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``label`` of all classes that are linked, from ``docs`` and its classes (``id, signature``)."""
    sketches = cut(_sketches(classes))
    near, heads = candidates(classes)
    pairs = _few(_alike(near, sketches))
    crowd = _few(_members(classes, _few(heads)))
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowd.select("id")).distinct()
    sets = cut(_sets(docs.select(id, text).join(needed.toDF(id), id, "left_semi"), id, text))
    labels = None
    weight = _few(_weights(pairs))
    open_pairs = pairs.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"), "share")
    for end in "ab":
        open_pairs = open_pairs.join(weight.toDF(end, f"w{end}"), end, "left")
    open_pairs = _few(open_pairs)
    for way in ("each", "each", "hub", "hubs", "all"):
        if way in ("hub", "hubs"):
            tried = _to_hubs(open_pairs, weight, labels, sketches, 1 if way == "hub" else HUBS)
        else:
            tried = (_one_each(open_pairs) if way == "each" else open_pairs).select("a", "b", "la", "lb")
        tried = _few(tried)
        found = _few(_confirmed(tried.select("a", "b"), sets))
        merged = components(found.join(tried, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")))
        labels = merged if labels is None else _moved(labels, merged)
        if way == "all":
            break
        at = labels.toDF("x", "to")
        crossing = open_pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        crossing = crossing.join(at, F.col("a") == F.col("x"), "left").withColumn("la", F.coalesce("to", "a")).drop("x", "to")
        crossing = crossing.join(at, F.col("b") == F.col("x"), "left").withColumn("lb", F.coalesce("to", "b")).drop("x", "to")
        open_pairs = _few(crossing.filter("la <> lb").select("a", "b", "la", "lb", "share", "wa", "wb"))
        if open_pairs.isEmpty():
            break
    if crowd.isEmpty():
        return labels
    return _moved(labels, components(_crowd_links(crowd, labels, sets)))


def _moved(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """``labels`` after components of them (``merged``: ids and labels of components) became one."""
    moved = labels.join(merged.toDF("label", "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return _few(_together(moved, merged.join(labels.select("id"), "id", "left_anti")))


def _members(classes: DataFrame, heads: DataFrame) -> DataFrame:
    """``id, tree, head`` of the classes in the regions ``heads``."""
    rows = classes.select("id", F.posexplode(F.array(*[_first(t) for t in range(TREES)])).alias("tree", "head"))
    return rows.join(F.broadcast(heads) if heads.count() <= PART_ROWS else heads, ["tree", "head"]).select("id", "tree", "head")


def _crowd_links(crowd: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between the components of alike members of one region.

    Regions with members of one component only are done. Regions whose largest components are one and have the same smallest
    member there are taken together, each member once, so a crowd that several trees found is compared once. The members of
    the largest component meet all others, and these each other. Both are dealt out in blocks by a hash of the id: a key is a
    block of others with a block of either.
    """
    size = sets.select("id", F.greatest(F.expr("octet_length(set) div 8"), F.lit(LEAST)).alias("size")).groupBy("id").agg(F.sum("size").alias("size"))
    stands = crowd.select("id", F.xxhash64("tree", "head").alias("region")).distinct().join(labels, "id", "left").join(size, "id")
    stands = _few(stands.select("id", "region", F.coalesce("label", "id").alias("label"), "size"))
    by = stands.groupBy("region", "label").agg(F.sum("size").alias("size"), F.min("id").alias("least"))
    mixed = by.groupBy("region").agg(F.max(F.struct("size", "label", "least")).alias("most"), F.count("*").alias("n")).filter("n > 1")
    mixed = mixed.select("region", F.col("most.label").alias("main"), F.xxhash64("most.label", "most.least").alias("crowd"))
    region = _few(stands.join(mixed, "region").select(F.col("crowd").alias("region"), "main", "id", "label", "size").distinct())
    blocks = {name: F.ceil(F.sum(F.when(side, F.col("size"))) / BLOCK).cast("int").alias(name) for name, side in (("others", F.col("label") != F.col("main")), ("mains", F.col("label") == F.col("main")))}
    rows = region.join(region.groupBy("region").agg(*blocks.values()), "region").withColumn("h", F.xxhash64("id", F.lit(3)))
    one = rows.filter("label = main").select("id", "region", "label", F.expr("pmod(h, mains)").alias("b"), F.explode(F.expr("sequence(0L, others - 1L)")).alias("i"))
    main = one.select("id", "label", F.xxhash64("region", "i", F.lit("main"), "b").alias("key"), F.lit(False).alias("other"))
    rest = rows.filter("label <> main").select("id", "region", "label", "others", "mains", F.expr("pmod(h, others)").alias("i"))
    asked = rest.select("id", "label", F.explode(F.expr("transform(sequence(0L, mains - 1L), b -> xxhash64(region, i, 'main', b))")).alias("key"), F.lit(True).alias("other"))
    both = rest.select("id", "label", F.explode(F.expr("transform(sequence(0L, others - 1L), j -> xxhash64(region, least(i, j), 'other', greatest(i, j)))")).alias("key"), F.lit(True).alias("other"))
    dealt = main.union(asked).union(both).join(sets, "id").select("key", "other", "label", "set")

    def run(group: pa.Table) -> pa.Table:
        other = group.column("other").to_numpy()
        label = group.column("label").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        x = np.flatnonzero(other)
        y = x if other.all() else np.flatnonzero(~other)
        a, b = _linked([own[i] for i in x], [own[i] for i in y], label[x], label[y])
        return pa.table({"a": a, "b": b})

    return cut(dealt.groupBy("key").applyInArrow(run, "a long, b long").distinct())


def _linked(x: list[np.ndarray], y: list[np.ndarray], of_x: np.ndarray, of_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between different labels that have similar sets, one of each side: each label with the root of its component."""
    common = np.zeros((len(x), len(y)), np.float32)  # exact up to 2**24 shingles
    flat = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (x, y)]
    shared = np.intersect1d(*flat)
    sides = []
    for sets, values in zip((x, y), flat):
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(shared, values)
        met = at < len(shared)
        met[met] = shared[at[met]] == values[met]
        row, at = row[met], at[met]
        turn = np.argsort(at, kind="stable")
        sides.append((row[turn], at[turn], len(sets)))
    width = max(64, 2**22 // max(1, len(x) + len(y)))  # columns at once
    for start in range(0, len(shared), width):
        parts = []
        for row, at, n in sides:
            lo, hi = np.searchsorted(at, [start, start + width])
            part = np.zeros((n, min(width, len(shared) - start)), np.float32)
            part[row[lo:hi], at[lo:hi] - start] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    many = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])
    alike = (common > 0) & (100 * common.astype(np.int64) >= SIMILAR * (many - common.astype(np.int64))) & (of_x[:, None] != of_y)
    i, j = np.nonzero(alike)
    up: dict[int, int] = {}
    for a, b in np.unique(np.stack(_pairs(of_x[i], of_y[j]), 1), axis=0).tolist():
        while up.setdefault(a, a) != a:
            up[a] = a = up[up[a]]
        while up.setdefault(b, b) != b:
            up[b] = b = up[up[b]]
        up[max(a, b)] = min(a, b)
    links = [(k, v) for k, v in up.items() if k != v]
    return np.array([k for k, _ in links], np.int64), np.array([v for _, v in links], np.int64)


def _weights(pairs: DataFrame) -> DataFrame:
    """``id, w``: how much an id is like those it was paired with; the text behind a crowd of variants has the most."""
    alike = F.col("share") - ROUGH
    return _together(pairs.select(F.col("a").alias("id"), alike.alias("w")), pairs.select("b", alike)).groupBy("id").agg(F.sum("w").alias("w"))


def _to_hubs(open_pairs: DataFrame, weight: DataFrame, labels: DataFrame, sketches: DataFrame, count: int) -> DataFrame:
    """Each end of an open pair with the hubs of the other end's component, as ``a, b, la, lb``.

    Hubs are the members of most weight. In a crowd of variants of one text, a variant far
    out may be alike to that text only, and have other variants for neighbours in every order.
    """
    weight = weight.join(labels, "id", "left").select("id", "w", F.coalesce("label", "id").alias("l"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("w"), "id"))
    hubs = weight.withColumn("n", place).filter(F.col("n") <= count).select("l", F.col("id").alias("hub"))
    ends = _together(open_pairs.select(F.col("a").alias("x"), F.col("la").alias("lx"), F.col("lb").alias("l")), open_pairs.select("b", "lb", "la")).distinct()
    met = ends.join(hubs, "l").select(F.least("x", "hub").alias("a"), F.greatest("x", "hub").alias("b"), F.when(F.col("x") < F.col("hub"), F.col("lx")).otherwise(F.col("l")).alias("la"), F.when(F.col("x") < F.col("hub"), F.col("l")).otherwise(F.col("lx")).alias("lb")).distinct()
    if count == 1:
        return met
    met = _few(met)
    return met.join(_alike(met.select("a", "b"), sketches).select("a", "b"), ["a", "b"])


def _one_each(pairs: DataFrame) -> DataFrame:
    """For each component one pair: the one whose other end has the most weight, of equals the most alike."""

    def choice(other: str) -> Column:
        return F.struct((-F.col(other)).alias("w"), (1 - F.col("share")).alias("off"), "a", "b").alias("c")

    sides = _together(pairs.select(F.col("la").alias("own"), choice("wb")), pairs.select("lb", choice("wa")))
    best = sides.groupBy("own").agg(F.min("c").alias("c"))
    return best.select("c.a", "c.b").distinct().join(pairs, ["a", "b"])


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``."""
    with shuffles_dropped(docs.sparkSession):
        signed, groups, labels = _classes_and_labels(docs, id, text)
    own = signed.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).alias("class"))
    grouped = own.join(groups.select("class", "least"), "class", "left")
    found = grouped.join(labels.toDF("least", "label"), "least", "left")
    component = F.coalesce("label", "least", "id")
    return found.select(
        F.col("id").alias(id),
        "n_shingles",
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _classes_and_labels(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, the classes, and the labels of those that are linked."""
    signed = cut(signatures(docs, id, text))
    real = signed.filter("id IS NOT NULL AND n_shingles > 0")
    groups = cut(real.groupBy("class").agg(F.min("id").alias("least"), F.first("signature").alias("signature")))
    labels = links(docs, groups.select(F.col("least").alias("id"), "signature"), id, text)
    # an id with several texts stands in several classes, which it joins
    several = real.groupBy("id").agg(F.count_distinct("class").alias("n")).filter("n > 1").select("id")
    stands = real.join(several, "id").join(groups.select("class", "least"), "class").join(labels.toDF("least", "label"), "least", "left")
    ties = _few(stands.select("id", F.coalesce("label", "least").alias("root")).distinct())
    if not ties.isEmpty():
        roots = ties.groupBy("id").agg(F.min("root").alias("a"))
        labels = _moved(labels, components(ties.join(roots, "id").select("a", F.col("root").alias("b"))))
    return signed, groups, labels
