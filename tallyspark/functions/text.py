"""Text columns: cleaning, summaries, symbols, categories, relevance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import words
from tallyspark.plans.keyed import any_of

# ``(?U)`` gives \w and \s their Unicode meaning.
NOT_WORD_OR_SPACE = r"(?U)[^\w\s]"
SPACES = r"(?U)\s+"


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def clean_merchant(text: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    return collapse_spaces(F.regexp_replace(F.lower(text), NOT_WORD_OR_SPACE, " "))


def clean_text(text: Column) -> Column:
    """As for merchants, and digits removed."""
    spaced = F.regexp_replace(F.lower(text), NOT_WORD_OR_SPACE, " ")
    return collapse_spaces(F.regexp_replace(spaced, r"(?U)\d+", ""))


def summary(text: Column, longest: int = 100, sentences: int = 3) -> Column:
    """First sentences; cut with an ellipsis beyond ``longest`` characters."""
    head = F.concat(F.array_join(F.slice(F.split(text, r"\. "), 1, sentences), ". "), F.lit("."))
    return F.when(F.length(head) > longest, F.concat(F.substring(head, 1, longest), F.lit("..."))).otherwise(head)


def key_points(text: Column) -> Column:
    """Up to five numbered sentences of texts with more than three parts."""
    parts = F.split(text, r"\.")
    numbered = F.transform(
        F.slice(parts, 1, 5), lambda s, i: F.struct((i + 1).alias("number"), F.trim(s, F.lit(" \n\t\r")).alias("point"))
    )
    kept = F.filter(numbered, lambda p: p["point"] != "")
    return F.when(F.size(parts) > 3, kept)


def symbols(text: Column) -> Column:
    """Stock symbols in a text, sorted: plain capitals, ``$ABC`` and ``ABC.XYZ``."""
    plain = F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z]{1,5})\b(?=\s|$)"), 1)
    dollar = F.regexp_extract_all(text, F.lit(r"(?U)\$([A-Z]{1,5})\b"), 1)
    listed = F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z]{1,5})\.([A-Z]{1,3})\b"), 1)
    found = F.array_union(F.array_union(plain, dollar), listed)
    return F.array_sort(F.array_except(found, F.array(*[F.lit(w) for w in words.NOT_SYMBOLS])))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Applies ``use`` to a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def category(text: Column) -> Column:
    """First category, in order, with one of its keywords in the text."""

    def choose(low: Column) -> Column:
        out = None
        for name, keys in words.CATEGORY_KEYWORDS.items():
            hit = any_of([low.contains(k) for k in keys])
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise(words.DEFAULT_CATEGORY)

    return _once(F.lower(text), choose)


def hits(text: Column, keys: Sequence[str]) -> Column:
    """How many of the keywords occur in the text."""
    return _once(
        F.lower(text), lambda low: sum((low.contains(k.lower()).cast("int") for k in keys), F.lit(0))
    )


def relevance(text: Column, hours_old: Column, interests: Sequence[str] = ()) -> Column:
    """Finance keywords 0.6, interests 0.4, recency over a day 0.2; capped at 1."""
    score = hits(text, words.FINANCE_KEYWORDS) / len(words.FINANCE_KEYWORDS) * 0.6
    if interests:
        score = score + hits(text, interests) / len(interests) * 0.4
    recent = F.greatest(F.lit(0.0), 1 - hours_old / 24) * 0.2
    return F.least(score + F.coalesce(recent, F.lit(0.0)), F.lit(1.0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))


def read_minutes(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(word_count(text) / 200).cast("int"))


def title_key(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(title), r"(?U)\W+", ""), 1, 50)


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.1, "Positive").when(score < -0.1, "Negative").otherwise("Neutral")


def parse_time(text: Column, default: Column) -> Column:
    """ISO times (a trailing Z is UTC), dates and epoch seconds; else the default."""
    epoch = F.timestamp_seconds(F.when(text.rlike(r"^\d{9,11}$"), text.try_cast("long")))
    return F.coalesce(text.try_cast("timestamp"), epoch, default.cast("timestamp"))
