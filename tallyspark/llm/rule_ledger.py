"""Rule bitmask ledger: every quality rule once per document, as a bit, next to the measurements it reads.

``ledger`` measures the whole text and sets one bit per failed rule. A policy is a versioned set of rules, a bit mask:
``verdicts`` keeps a document whose failed bits miss the mask. ``ablations`` counts what each policy keeps, and what it
would keep without each of its rules, from the counts per distinct bit pattern alone. All of it is column expressions.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words and fails ``few_words`` alone. Each row is a document of
its own, so repeated rows and null ids pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 8  # words of the windows whose repeats count
SPACES = " \t\n\x0b\f\r"
BETWEEN = r"[\x20\x09-\x0D]+"

# Each rule: (name, when it fails). Shares are compared in whole numbers. The position is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("few_letters", "100 * n_letters < 60 * word_chars"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("echoed_words", "100 * n_echo_words > 20 * n_words"),
    ("shouting", "100 * n_shouts > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
)
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(name for name, _ in RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_echo_words", "n_shouts")


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def _repeat_words(words: Column, hits: Column) -> Column:
    """Words covered by windows that start at the sorted positions."""
    total = F.aggregate(
        hits,
        F.struct(F.lit(-SPAN).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(x.alias("at"), (s["n"] + F.least(F.lit(SPAN), x - s["at"])).alias("n")),
    )
    return F.coalesce(total["n"], F.lit(0).cast("long"))


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, all ``MEASURES`` (long) and ``fail_bits`` (long).

    Repeated windows: a hash of each window first tells whether a text has any (equal windows have equal hashes). Only
    texts that do are sorted by it, and neighbours are compared word by word.
    """
    t, w, h, p = F.col("__text"), F.col("__w"), F.col("__h"), F.col("__p")
    here = docs.select(F.col(id), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    bare = F.trim(t, F.lit(SPACES))
    here = here.withColumn("__w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BETWEEN)))
    here = here.withColumn("__h", F.when(F.size(w) >= SPAN, F.transform(F.sequence(F.lit(1), F.size(w) - SPAN + 1), lambda i: F.xxhash64(F.slice(w, i, SPAN)))))
    twice = F.size(F.array_distinct(h)) < F.size(h)
    here = here.withColumn("__p", F.when(twice, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice(w, a["i"] + 1, SPAN) == F.slice(w, b["i"] + 1, SPAN))

    def repeated(x: Column, k: Column) -> Column:
        """Equal to a neighbour in the order."""
        return F.coalesce(same(x, F.get(p, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, k + 1)), F.lit(False))

    here = here.withColumn("__hits", F.sort_array(F.transform(F.filter(p, repeated), lambda x: x["i"])))
    here = here.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""))

    def longs(**columns: Column) -> dict[str, Column]:
        return {name: c.cast("long") for name, c in columns.items()}

    here = here.select(
        id,
        *[
            c.alias(name)
            for name, c in longs(
                n_words=F.size(w),
                word_chars=F.char_length(F.array_join(w, "")),
                n_symbols=F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
                n_dup_lines=F.size("__lines") - F.size(F.array_distinct("__lines")),
                n_repeat_words=_repeat_words(w, F.col("__hits")),
                n_lines=F.size("__lines"),
                n_letters=F.char_length(F.regexp_replace(t, r"[^\p{L}]+", "")),
                n_echo_words=F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))),
                n_shouts=F.char_length(t) - F.char_length(F.replace(t, F.lit("!"), F.lit(""))),
            ).items()
        ],
    )
    bits = [F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, (_, fails) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return here.withColumn("fail_bits", total.cast("long"))


def verdicts(book: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """The ledger with a boolean ``kept_<policy>`` for each policy."""
    return book.withColumns({f"kept_{name}": F.col("fail_bits").bitwiseAND(F.lit(mask(rules))) == 0 for name, rules in policies.items()})


def ablations(book: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``policy, without, n_kept, n_docs``: ``without`` is null for the whole policy, else the rule left out."""
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    trials = [(name, without, mask(tuple(r for r in rules if r != without))) for name, rules in policies.items() for without in (None, *rules)]
    cases = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(x).cast("string").alias("without"), F.lit(m).cast("long").alias("mask")) for p, x, m in trials])
    each = patterns.withColumn("t", F.explode(cases))
    kept = F.col("fail_bits").bitwiseAND(F.col("t.mask")) == 0
    return each.groupBy("t.policy", "t.without").agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_kept"), F.sum("n").alias("n_docs"))


def decided(docs: DataFrame, policy: str = "v1", id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under one policy."""
    rules = {"base": BASE, "own": POLICIES[policy]}
    book = verdicts(ledger(docs, id, text), rules)
    return book.withColumns({"base_failed": ~F.col("kept_base"), "kept": F.col("kept_base") & F.col("kept_own")}).drop("kept_base", "kept_own")


def passing(docs: DataFrame, policy: str = "v1", id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` of the rows that the policy keeps.

    The verdict goes through a generator: a plain filter would be pushed below the measurements, which are then computed
    again in it, once for every mention.
    """
    return decided(docs, policy, id, text).select(id, F.explode(F.array("kept")).alias("kept")).filter("kept").select(id)
