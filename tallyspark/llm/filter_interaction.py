"""Filter interaction audit: five filters as a bit mask per document, duplicates by radix tries of whole texts.

Filters: A under ``MIN_WORDS`` words; B less than ``MIN_DISTINCT`` per cent distinct words; C more than ``MAX_CAPITALS`` per cent
``[A-Z]`` of the code points; D holds any of ``#$%&*|``; E identical to the text of any smaller id, table-wide.

``flagged`` decides E by compressed tries, which keep the smallest id at the node where a text ends. Each task first puts its
own texts in a trie: a row that has a smaller id there is a duplicate at once and goes on without its text; of every distinct
text only the smallest id stays open, so a text that a third of all rows share crosses the exchange once per task and trie. Open
texts are range-partitioned by an adaptive prefix: its first ``DEPTHS[0]`` characters, and more wherever different texts with one
prefix hold more than ``PART_BYTES`` (or one part in ``SHARES`` of all bytes). Equal texts have equal prefixes, so they meet in one partition; a second trie
there has the smallest id of all. Texts that agree in more characters than the deepest prefix stay together, which costs
memory for their differing ends only.

``ledger`` joins the labels and counts rows per part, mask and labels. ``audit`` reads nothing but these counts: what a filter
removes at a step are the masks that hold its bit and none of an earlier filter's; in ``120 / k`` of the 120 orders a filter is the
first of a mask with k bits, which makes the sum over all orders.

Null texts and parts are the empty string. A null id is no smaller than any and has no smaller one, and no labels. Rows that
repeat an id and text are no duplicates of each other. Of several labels of an id the larger counts. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrays import stretches
from tallyspark.llm.text_tries import Trie
from tallyspark.plans.lineage import cut, fresh_dir
from tallyspark.sources.tables import spread

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
COPY = 1 << FILTERS.index("E")
TRIE_BYTES = 2**24  # text in a task's own trie before it hands on what it knows
TRIE_ROWS = 2**18  # rows of it
PART_BYTES, SHARES = 2**24, 2**17
DEPTHS = (8, 32, 128, 512, 2048, 8192, 32768)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS = bytes(range(65, 91))
_SYMBOL = re.compile(rb"[#$%&*|]")
_SCHEMA = "doc_id long, part string, fails int, n long"


def own_fails(text: bytes) -> int:
    """Bits of the filters that a text fails by itself."""
    words, distinct = 0, set()
    for part in stretches(text, _SPACE):
        found = part.split()
        words += len(found)
        distinct.update(found)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.decode("utf-8", "replace"))
    failed = (words < MIN_WORDS, 100 * len(distinct) < MIN_DISTINCT * words, 100 * capitals > MAX_CAPITALS * points, _SYMBOL.search(text) is not None)
    return sum(1 << i for i, fails in enumerate(failed) if fails)


def _batch(rows: list[tuple], texts: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()][: 4 + texts]
    names = ["doc_id", "part", "fails", "n", "text"]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(kinds)])


def _first_tries(batches: Iterator[pa.RecordBatch], most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, part, fails, n, text`` of a task's rows (``doc_id, part, text``). Text only where the row may still be a copy."""
    trie, fails, rows = Trie(), {}, Counter()

    def handed_on() -> Iterator[pa.RecordBatch]:
        open_rows: dict[int, list[tuple]] = {}
        done = []
        for (node, id, part), n in rows.items():
            if id == trie.least[node]:
                open_rows.setdefault(node, []).append((id, part, fails[node], n))
            else:
                done.append((id, part, fails[node] | COPY, n, None))
        yield _batch(done, True)
        some, size = [], 0
        for node, text in trie.texts():
            for row in open_rows[node]:
                some.append((*row, text))
                size += len(text)
            if size > 2**22:
                yield _batch(some, True)
                some, size = [], 0
        yield _batch(some, True)

    for batch in batches:
        ids, parts, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        lone = []
        for i, (id, part) in enumerate(zip(ids, parts)):
            text = texts[i].as_py()
            if id is None:
                lone.append((None, part, own_fails(text), 1, None))
                continue
            node = trie.insert(text, id)
            if node not in fails:
                fails[node] = own_fails(text)
            rows[node, id, part] += 1
            if trie.size > most_bytes or len(rows) > most_rows:
                yield from handed_on()
                trie, fails, rows = Trie(), {}, Counter()
        yield _batch(lone, True)
    yield from handed_on()


def _second_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, part, fails, n`` of open rows, with the bit of E where a smaller id has the text."""
    trie, rows = Trie(), []
    for batch in batches:
        texts = batch.column(4)
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            rows.append((*row, trie.insert(texts[i].as_py(), row[0])))
    for at in range(0, len(rows), 10_000):
        yield _batch([(id, part, fails | COPY * (id > trie.least[node]), n) for id, part, fails, n, node in rows[at : at + 10_000]], False)


def _prefix(depth: int) -> Column:
    return F.xxhash64(F.substring("text", 1, depth))


def heavy_prefixes(texts: DataFrame) -> list[DataFrame]:
    """For each depth, hashes ``heavy`` of the prefixes that a deeper one has to split: at most ``SHARES`` of them."""
    found: list[DataFrame] = []
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = max(PART_BYTES, total / SHARES)
    for depth in DEPTHS[:-1]:
        rows = texts if not found else texts.join(F.broadcast(found[-1]), _prefix(DEPTHS[len(found) - 1]) == F.col("heavy"), "left_semi")
        sizes = rows.groupBy(_prefix(depth).alias("heavy")).agg(F.sum(F.octet_length("text")).alias("size"), F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
        heavy = cut(sizes.filter((F.col("size") > most) & (F.col("low") != F.col("high"))).select("heavy"))
        if heavy.isEmpty():
            break
        found.append(heavy)
    return found


def by_prefix(rows: DataFrame, heavy: list[DataFrame]) -> DataFrame:
    """Rows range-partitioned by the adaptive prefix of ``text``."""
    prefix = F.substring("text", 1, DEPTHS[0])
    for i, hashes in enumerate(heavy):
        rows = rows.join(F.broadcast(hashes.toDF(f"heavy{i}")), _prefix(DEPTHS[i]) == F.col(f"heavy{i}"), "left")
    for i in range(len(heavy)):
        deeper = F.col("heavy0").isNotNull()
        for j in range(1, i + 1):
            deeper &= F.col(f"heavy{j}").isNotNull()
        prefix = F.when(deeper, F.substring("text", 1, DEPTHS[i + 1])).otherwise(prefix)
    return rows.select("doc_id", "part", "fails", "n", "text", prefix.alias("prefix")).repartitionByRange("prefix").drop("prefix")


def flagged(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id, part, fails, n``: mask of the failed filters per document; n equal rows of one id are one row."""
    spark = docs.sparkSession
    most = TRIE_BYTES, TRIE_ROWS

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _first_tries(batches, *most)

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), plain(part).alias("part"), plain(text).alias("text"))
    folder = fresh_dir(spark, "tries")
    schema = f"{_SCHEMA}, text binary"
    spread(rows.withColumn("text", F.col("text").cast("binary"))).mapInArrow(first, schema).write.parquet(folder)
    known = spark.read.schema(schema).parquet(folder)
    open_rows = known.filter("text IS NOT NULL").withColumn("text", F.col("text").cast("string"))
    dealt = by_prefix(open_rows, heavy_prefixes(open_rows.select("text")))
    met = dealt.withColumn("text", F.col("text").cast("binary")).mapInArrow(_second_tries, _SCHEMA)
    return met.union(known.filter("text IS NULL").drop("text"))


def ledger(masks: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """``part, fails, good, toxic, n``: documents per mask and labels."""
    known = labels.groupBy(F.col(id).cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    both = masks.join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    return both.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def _steps() -> Column:
    """All orders of the filters, step by step: the filter's bit and those of the filters before it."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(name) for name in order]
        steps += [F.struct(F.lit(order).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(bits[i]).alias("bit"), F.lit(sum(bits[:i])).alias("before")) for i in range(len(bits))]
    return F.array(*steps)


def audit(counts: DataFrame) -> DataFrame:
    """``part, filter_order, step`` with ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    fails, before, bit, n = F.col("fails"), F.col("s.before"), F.col("s.bit"), F.col("n")
    here = fails.bitwiseAND(bit) != 0
    met = fails.bitwiseAND(before) != 0
    removed = here & ~met
    orders = F.lit(len(list(permutations(FILTERS)))) / F.greatest(F.bit_count(fails), F.lit(1))

    def of(when: Column, value: Column = n) -> Column:
        return F.sum(F.when(when, value).otherwise(0)).cast("long")

    spelled = counts.withColumn("s", F.explode(_steps()))
    return spelled.groupBy("part", F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step")).agg(
        of(~here & ~met).alias("kept"),
        of(removed).alias("removed"),
        of(here & met).alias("redundant"),
        of(fails == bit).alias("unique_fails"),
        of(removed & F.col("good")).alias("good_lost"),
        of(removed & F.col("toxic")).alias("toxic_lost"),
        of(here, n * orders.cast("long")).alias("shapley"),
    )
