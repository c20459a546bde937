"""Source divergence audit by count-level bitmaps.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lowered. A language keeps the terms that stand in at least
``LEAST_DOCS`` of its rows. With N occurrences of kept terms in a group and V kept terms, a term that occurs c times has
``p = 1 + floor(10^9 * (c + 1) / (N + V))``, and ``f(p, q) = floor((p - q)^2 / q)`` compares it with another group's q.

p depends on the count alone. So the kept terms of a language are dealt into blocks by a hash, and in a block each group has
one bitset of term numbers per count (a level); the terms a group lacks are the complement of its levels. Two levels of two
groups, ANDed and their bits counted, give the number of terms in that joint cell, times f both ways. A block's sum over all
cells goes out as one row per ordered pair of groups, and the blocks add up. All arithmetic is on whole numbers: p and q are
divided as Python integers, ``(p - q)^2`` is at most 10^18, and a sum over all terms is at most ``(sum |p - q|)^2 <= 4 * 10^18``.

``pairs``: each other source of the language, f summed over all kept terms, all ranks. ``terms``: kept terms of the group more
likely there than in its whole language, ranks to ``TOP``. ``audit`` is both. Ties go to the item that sorts first in UTF-8.

Null text, language and source are the empty string. Every row counts as a document, repeated rows and null ids too. A group
without terms has count 0 everywhere; a language with no kept terms has pairs of value 0; a language with one source has no
pairs. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.arrays import stretches
from tallyspark.plans.lineage import fresh_dir
from tallyspark.sources.tables import spread

LEAST_DOCS = 3
TOP = 200
SCALE = 10**9
BLOCK_TERMS = 4096  # kept terms of a block, on average
TASK_TERMS = 100_000  # different terms that a task holds before it hands its counts on

_TERM = re.compile(rb"[a-z\x80-\xff]+")  # after A-Z are lowered
_BETWEEN = re.compile(rb"[^A-Za-z\x80-\xff]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, some at a time."""
    for part in stretches(text, _BETWEEN):
        yield _TERM.findall(part.lower())


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Partial ``lang, source, term, n, docs``: occurrences and rows of each group's terms, added up within a task."""
    schema = "lang string, source string, term string, n long, docs long"

    def handed_on(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (a, b), (n, rows) in held.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(a), size), pa.repeat(pa.scalar(b), size), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([rows[t] for t in n], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, key in enumerate(zip(langs, sources)):
                n, rows = held.setdefault(key, (Counter(), Counter()))
                known, own = len(n), set()
                for terms in terms_of(texts[i].as_py()):
                    n.update(terms)
                    own.update(terms)
                rows.update(own)
                size += len(n) - known
                if size > TASK_TERMS:
                    yield from handed_on(held)
                    held, size = {}, 0
        yield from handed_on(held)

    def plain(name: str) -> F.Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = spread(docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("text")))
    return rows.mapInArrow(run, schema)


def kept_terms(counts: DataFrame) -> DataFrame:
    """``lang, term, uses`` (array of ``source, n``) of the terms in enough rows of their language; one exchange in all."""
    dealt = counts.repartition("lang", "term")
    by_group = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_group.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("uses"), F.sum("docs").alias("docs"))
    return by_term.filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", "uses")


def groups_of(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, n`` (N) and ``v`` (V) of every group that occurs."""
    there = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    used = kept.select("lang", F.explode("uses").alias("u")).groupBy("lang", F.col("u.source").alias("source")).agg(F.sum("u.n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    return there.join(used, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n", "v"])


def shares(counts: list[int], n: int, v: int) -> np.ndarray:
    """p of each count."""
    return np.array([1 + SCALE * (c + 1) // (n + v) for c in counts], np.int64)


def compared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Levels:
    """Bitsets of a block's terms, one per count that occurs in a group, the zeros as the complement of the others."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, size: int, n: int, v: int):
        found, level = np.unique(counts, return_inverse=True)
        bits = np.zeros((len(found) + 1, -(-size // 64) * 64), bool)
        bits[level + 1, terms] = True
        bits[0, :size] = ~bits[1:, :size].any(0)
        self.sets = np.packbits(bits, axis=1).view(np.uint64)
        self.p = shares([0, *found.tolist()], n, v)

    def cells(self, other: Levels) -> np.ndarray:
        """Terms of the block with one count here and one there, for each two counts."""
        return np.stack([np.bitwise_count(own & other.sets).sum(1, dtype=np.int64) for own in self.sets])


def _block(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Rows ``part, source, item, value`` of one block of one language."""
    langs = groups.column("lang")[:1].to_pylist()
    names, n = groups.column("source").to_pylist(), groups.column("n").to_pylist()
    v = groups.column("v")[0].as_py()
    words = terms.column("term").to_pylist()
    uses = terms.column("uses").combine_chunks()
    at = np.repeat(np.arange(len(words)), uses.value_lengths().to_numpy(zero_copy_only=False))
    flat = uses.flatten()
    place = {name: i for i, name in enumerate(names)}
    group = np.array([place[s] for s in flat.field("source").to_pylist()], np.int64)
    count = flat.field("n").to_numpy()
    out: list[tuple[str, str, str, int]] = []
    if words:
        total = np.zeros(len(words), np.int64)
        np.add.at(total, at, count)
        q = shares(total.tolist(), sum(n), v)
        levels = []
        for g, name in enumerate(names):
            own = np.flatnonzero(group == g)
            levels.append(Levels(at[own], count[own], len(words), n[g], v))
            p = shares(count[own].tolist(), n[g], v)
            more = np.flatnonzero(p > q[at[own]])
            found = zip(compared(p[more], q[at[own][more]]).tolist(), (words[i] for i in at[own][more].tolist()))
            best = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:TOP]
            out += [("term", name, word, value) for value, word in best]
        for g, one in enumerate(levels):
            for h in range(g + 1, len(levels)):
                cells, p, r = one.cells(levels[h]), one.p[:, None], levels[h].p[None, :]
                out.append(("pair", names[g], names[h], int((cells * compared(p, r)).sum())))
                out.append(("pair", names[h], names[g], int((cells * compared(r, p)).sum())))
    else:
        out = [("pair", a, b, 0) for a in names for b in names if a != b]
    parts, sources, items, values = zip(*out) if out else ((), (), (), ())
    return pa.table({"lang": pa.array(langs * len(out), pa.string()), "source": pa.array(sources, pa.string()), "part": pa.array(parts, pa.string()), "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``. The kept terms are written to the shared folder once."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "terms")
    kept_terms(term_counts(docs, text, lang, source)).write.parquet(folder)
    kept = spark.read.schema("lang string, term string, uses array<struct<source: string, n: bigint>>").parquet(folder)
    groups = groups_of(docs, kept, lang, source)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v")).select("lang", blocks.alias("blocks"))
    dealt = kept.join(sizes, "lang").select("lang", "term", "uses", F.expr("pmod(xxhash64(term), blocks)").cast("int").alias("block"))
    # every block of a language meets all its groups
    there = groups.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    schema = "lang string, source string, part string, item string, value long"
    found = dealt.groupBy("lang", "block").cogroup(there.groupBy("lang", "block")).applyInArrow(_block, schema)
    # a term stands in one block, a pair in all
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")
