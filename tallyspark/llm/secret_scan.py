"""Secret scan by a trigram inverted index.

Each rule is a regular expression, with a least length for a group of the match where a shorter match is none. From the
expression comes a Boolean trigram query (``trigram_queries``). A task indexes its texts slice by slice (about two million bytes, a
longer text alone): postings of all trigrams that some rule asks for. A rule intersects the postings of a clause, unites its
clauses, and runs its expression over the candidates alone; a rule without a mandatory trigram (``hex``) runs over all texts of
the slice. A query holds of every text that its expression matches, so no match is lost. Nothing is exchanged, and a lost
task is read and indexed again by itself.

Matches are leftmost and non-overlapping for each kind, in the whole text; positions are code points, the end exclusive. The first
three rules are the base, the others come on top. ``hex`` and ``access`` state their length in the expression: their
classes match whole runs, so a run that is too short holds no match.

A null or empty text has no spans. Each row is scanned by itself, so repeated rows and null ids pass through; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrays import lowered, slices
from tallyspark.llm.trigram_queries import Index, query_of
from tallyspark.sources.tables import spread


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters of the group


BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_app", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login_url", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$-]+@"),
)
RULES = BASE + MORE


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``id`` and ``found``, an array of ``kind, start, end`` by start and then by the order of the rules, for every row."""
    kind = docs.schema[id].dataType.simpleString()
    asked = [query_of(rule.pattern) for rule in rules]
    trigrams = {t for query in asked for clause in query for t in clause}
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(rule.pattern, re.ASCII) for rule in rules]
        for part, data, starts in slices(batches, "text"):
            index = Index(trigrams, lowered(data), starts)
            texts, found = part.column(1), [[] for _ in range(part.num_rows)]
            held: dict[int, str] = {}
            candidates = [index.holding(query).tolist() for query in asked]
            for i in sorted({i for own in candidates for i in own}):
                held[i] = texts[i].as_py() or ""
            for place, (rule, expression, own) in enumerate(zip(rules, compiled, candidates)):
                for i in own:
                    for m in expression.finditer(held[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[i].append((m.start(), place, m.end()))
            spans = [[{"kind": rules[place].kind, "start": a, "end": b} for a, place, b in sorted(own)] for own in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(span))], names=[id, "found"])

    rows = spread(docs.select(F.col(id), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, f"`{id}` {kind}, found array<struct<kind: string, start: long, end: long>>")


def joined(found: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    base = [rule.kind for rule in BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("found", lambda x: x["kind"].isin(base))
    return found.select(id, *map(count, base), F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
