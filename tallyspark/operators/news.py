"""News feed: processing, scoring, ranking and filtering of articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text, words
from tallyspark.plans.keyed import KeyedRows

SHORTEST = 50
FEED_SIZE = 20


def with_content(articles: DataFrame) -> DataFrame:
    """Articles with at least 50 characters of content."""
    return articles.filter(F.length(F.trim("content")) >= SHORTEST)


def hours_between(then: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(3_600_000_000.0)


def scored_text(first: str = "title", second: str = "content") -> Column:
    """The two texts an article is scored on; a missing one is empty."""
    return F.concat_ws(" ", first, second)


def sentiment(articles: DataFrame) -> DataFrame:
    """Mean polarity of the lexicon words in title and content, 0 without any.

    The lexicon is a fixed map, so words are scored where they are read; only two
    numbers per article are kept and nothing is shuffled.
    """
    pairs = [x for w, p in words.POLARITY.items() for x in (F.lit(w), F.lit(p))]
    lexicon = F.create_map(*pairs)
    tokens = F.split(F.lower(scored_text()), r"(?U)\W+")
    known = F.filter(F.transform(tokens, lambda w: F.element_at(lexicon, w)), lambda p: p.isNotNull())
    total = F.aggregate("_known", F.lit(0.0), lambda a, p: a + p)
    return articles.withColumn("_known", known).withColumn(
        "sentiment_score",
        F.when(F.size("_known") > 0, total / F.size("_known")).otherwise(0.0),
    ).drop("_known")


def sentiment_by_lexicon(articles: DataFrame, lexicon: DataFrame, id_col: str = "id") -> DataFrame:
    """The same score from a lexicon table (word, polarity) of any size, by a join."""
    tokens = articles.select(id_col, F.explode_outer(F.split(F.lower(scored_text()), r"(?U)\W+")).alias("word"))
    counts = tokens.groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("_n"))
    matched = counts.join(lexicon, "word")
    scored = matched.groupBy(id_col).agg(
        (F.sum(F.col("polarity") * F.col("_n")) / F.sum("_n")).alias("sentiment_score")
    )
    return articles.join(scored, id_col, "left").fillna(0.0, ["sentiment_score"])


def process(articles: DataFrame, as_of: Column, interests: Sequence[str] = ()) -> DataFrame:
    """Adds summary, symbols, category, relevance, read time and sentiment."""
    kept = with_content(articles)
    both = F.concat(F.col("title"), F.lit(" "), F.col("content"))
    hours = hours_between(F.col("published_at"), as_of)
    out = kept.withColumns(
        {
            "summary": text.summary(F.col("content")),
            "symbols": text.symbols(both),
            "category": text.category(both),
            "relevance_score": text.relevance(scored_text("title", "description"), hours, interests),
            "read_time": text.read_minutes(F.col("content")),
        }
    )
    return sentiment(out)


def rank_score(relevance: Column, published_at: Column, as_of: Column) -> Column:
    """0.7 relevance plus 0.3 for recency within a day."""
    age = hours_between(published_at, as_of) / 24
    return relevance * 0.7 + (1 - F.least(F.lit(1.0), age)) * 0.3


def first_per_title(articles: DataFrame, order: Sequence[Column], title: str = "title") -> DataFrame:
    """The first article of each normalised title; groups are limited before the shuffle."""
    w = Window.partitionBy("_key").orderBy(*order)
    keyed = articles.withColumn("_key", text.title_key(F.col(title)))
    return keyed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_key", "_r")


def feed(processed: DataFrame, as_of: Column, size: int = FEED_SIZE) -> DataFrame:
    """Top articles by rank after title de-duplication."""
    ranked = processed.withColumn(
        "rank_score", rank_score(F.col("relevance_score"), F.col("published_at"), as_of)
    )
    order = [F.col("rank_score").desc(), F.col("id").asc()]
    return first_per_title(ranked, order).orderBy(*order).limit(size)


def in_categories(articles: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Articles of the categories behind the chosen feed labels; All keeps everything."""
    if "All" in labels:
        return articles
    wanted = [c for label in labels for c in words.FEED_LABELS.get(label, [label.lower()])]
    # The category is a long ladder of conditions: computed once per row, as an element of
    # an array, instead of again in the pushed-down filter.
    once = articles.withColumn("category", F.explode(F.array("category")))
    return once.filter(F.col("category").isin(wanted))


def for_symbols(articles: DataFrame, tracked: DataFrame, id_col: str = "id") -> DataFrame:
    """(article, symbol) rows for symbols on a watch list."""
    mentions = articles.select(id_col, F.explode_outer("symbols").alias("symbol")).filter(F.col("symbol").isNotNull())
    return KeyedRows(mentions, ["symbol"]).attach(tracked.select("symbol").distinct().withColumn("_t", F.lit(1))).filter(
        F.col("_t").isNotNull()
    ).drop("_t")


def sentiment_distribution(articles: DataFrame) -> DataFrame:
    s = F.col("sentiment_score")
    return articles.agg(
        F.count_if(s > 0.1).alias("positive"),
        F.count_if(s < -0.1).alias("negative"),
        F.count_if((s <= 0.1) & (s >= -0.1)).alias("neutral"),
    )


def sentiment_over_time(articles: DataFrame, unit: str = "day") -> DataFrame:
    at = F.date_trunc(unit, "published_at").cast("timestamp_ntz").alias("at")
    return articles.groupBy(at).agg(F.avg("sentiment_score").alias("sentiment"), F.count(F.lit(1)).alias("articles"))
