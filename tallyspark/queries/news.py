"""Queries over articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text, words
from tallyspark.functions.exprs import age_label
from tallyspark.operators import news
from tallyspark.queries.bars import rounded
from tallyspark.queries.registry import query
from tallyspark.sources import views
from tallyspark.sources.tables import table
from tallyspark.sources.views import EVENTS_AS_OF

INTERESTS = ["the", "Market", "le"]
_AS_OF = f"TIMESTAMP '{EVENTS_AS_OF}'"


def _as_of():
    return F.lit(EVENTS_AS_OF).cast("timestamp_ntz")


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


_KEPT_SQL = "kept AS (SELECT * FROM articles WHERE length(trim(content)) >= 50)"


@query("P35", views="articles", sql=f"WITH {_KEPT_SQL} SELECT id, source FROM kept")
def articles_with_content(spark, folder):
    return news.with_content(views.articles(spark, folder)).select("id", "source")


_SUMMARY_SQL = """CASE WHEN length(s) > 100 THEN substr(s, 1, 100) || '...' ELSE s END"""


@query(
    "F3",
    views="articles",
    sql=f"""
WITH {_KEPT_SQL}, p AS (SELECT id, array_to_string(string_split(content, '. ')[1:3], '. ') || '.' AS s FROM kept)
SELECT id, {_SUMMARY_SQL} AS summary FROM p
""",
)
def article_summaries(spark, folder):
    kept = news.with_content(views.articles(spark, folder))
    return kept.select("id", text.summary(F.col("content")).alias("summary"))


@query(
    "F4",
    views="articles",
    sql=r"""
WITH p AS (SELECT id, string_split(content, '.') AS parts FROM articles),
e AS (SELECT id, unnest(parts[1:5]) AS point, generate_subscripts(parts[1:5], 1) AS number FROM p WHERE len(parts) > 3)
SELECT id, CAST(number AS INTEGER) AS number, trim(point, ' ' || chr(10) || chr(9) || chr(13)) AS point FROM e WHERE trim(point, ' ' || chr(10) || chr(9) || chr(13)) <> ''
""",
)
def key_points(spark, folder):
    points = views.articles(spark, folder).select("id", F.explode_outer(text.key_points(F.col("content"))).alias("p"))
    return points.filter(F.col("p").isNotNull()).select("id", "p.number", "p.point")


@query("F5", sql=r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def collapsed_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.collapse_spaces(F.col("text")).alias("text"))


_WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"
# RE2 has no look-ahead: take whitespace-separated pieces and test their ends.
_SYMBOLS_SQL = rf"""
b AS (SELECT id, title || ' ' || content AS t FROM kept),
s AS (SELECT id, unnest(regexp_split_to_array(t, '\s+')) AS piece FROM b),
x AS (SELECT id, unnest(list_concat(list_concat(
    regexp_extract_all(piece, '(?:^|[^{_WORD}])([A-Z]{{1,5}})$', 1),
    regexp_extract_all(piece, '\$([A-Z]{{1,5}})(?:[^{_WORD}]|$)', 1)),
    regexp_extract_all(piece, '(?:^|[^{_WORD}])([A-Z]{{1,5}})\.[A-Z]{{1,3}}(?:[^{_WORD}]|$)', 1))) AS symbol FROM s),
sym AS (SELECT DISTINCT id, symbol FROM x WHERE symbol NOT IN ({", ".join(_lit(w) for w in words.NOT_SYMBOLS)}))
"""


@query("F6 U3", views="articles", sql=f"WITH {_KEPT_SQL}, {_SYMBOLS_SQL} SELECT id, symbol FROM sym")
def article_symbols(spark, folder):
    kept = news.with_content(views.articles(spark, folder))
    both = F.concat(F.col("title"), F.lit(" "), F.col("content"))
    found = kept.select("id", F.explode_outer(text.symbols(both)).alias("symbol"))
    return found.filter(F.col("symbol").isNotNull())


@query(
    "J11",
    views="articles",
    sql=f"WITH {_KEPT_SQL}, {_SYMBOLS_SQL} SELECT id, symbol FROM sym WHERE symbol IN (SELECT DISTINCT upper(substr(n_name, 1, 1)) FROM nation UNION SELECT 'A' UNION SELECT 'I' UNION SELECT 'ID')",
)
def watch_list_articles(spark, folder):
    kept = news.with_content(views.articles(spark, folder))
    both = F.concat(F.col("title"), F.lit(" "), F.col("content"))
    tracked = table(spark, folder, "nation").select(
        F.explode(
            F.array(F.upper(F.substring("n_name", 1, 1)), F.lit("A"), F.lit("I"), F.lit("ID"))
        ).alias("symbol")
    )
    return news.for_symbols(kept.select("id", text.symbols(both).alias("symbols")), tracked)


_CATEGORY_SQL = (
    "CASE "
    + " ".join(
        "WHEN "
        + " OR ".join(f"contains(low, {_lit(k)})" for k in keys)
        + f" THEN {_lit(name)}"
        for name, keys in words.CATEGORY_KEYWORDS.items()
    )
    + f" ELSE '{words.DEFAULT_CATEGORY}' END"
)
_PROCESS_SQL = f"""
{_KEPT_SQL},
l AS (SELECT *, lower(title || ' ' || content) AS low, lower(concat_ws(' ', title, description)) AS head, (epoch_us({_AS_OF}) - epoch_us(published_at)) / 3600000000.0::DOUBLE AS hours FROM kept),
r AS (SELECT *, least(1, ({" + ".join(f"CAST(contains(head, {_lit(k)}) AS INTEGER)" for k in words.FINANCE_KEYWORDS)}) / 31.0::DOUBLE * 0.6::DOUBLE
  + ({" + ".join(f"CAST(contains(head, {_lit(k.lower())}) AS INTEGER)" for k in INTERESTS)}) / 3.0::DOUBLE * 0.4::DOUBLE
  + greatest(0, 1 - hours / 24) * 0.2::DOUBLE) AS relevance, {_CATEGORY_SQL} AS category,
  CAST(greatest(1, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) // 200) AS INTEGER) AS read_time FROM l)
"""


@query("F7", views="articles", sql=f"WITH {_PROCESS_SQL} SELECT id, category FROM r")
def article_categories(spark, folder):
    kept = news.with_content(views.articles(spark, folder))
    both = F.concat(F.col("title"), F.lit(" "), F.col("content"))
    return kept.select("id", text.category(both).alias("category"))


@query(
    "F8 F9",
    views="articles",
    sql=f"WITH {_PROCESS_SQL} SELECT id, round(relevance, 6) AS relevance_score, read_time FROM r",
)
def article_relevance(spark, folder):
    out = news.process(views.articles(spark, folder), _as_of(), INTERESTS)
    return rounded(out.select("id", "relevance_score", "read_time"))


_LEXICON = ", ".join(f"({_lit(w)}, {p}::DOUBLE)" for w, p in words.POLARITY.items())
_SENTIMENT_SQL = rf"""
lex AS (SELECT * FROM (VALUES {_LEXICON}) v(word, polarity)),
tok AS (SELECT id, unnest(regexp_split_to_array(lower(concat_ws(' ', title, content)), '[^{_WORD}]+')) AS word FROM articles),
sc AS (SELECT id, avg(polarity) AS s FROM tok JOIN lex ON tok.word = lex.word GROUP BY id),
sent AS (SELECT a.id, a.published_at, coalesce(s, 0) AS s FROM articles a LEFT JOIN sc ON a.id = sc.id)
"""


@query(
    "F10 P29",
    views="articles",
    sql=f"""
WITH {_SENTIMENT_SQL} SELECT id, round(s, 9) AS sentiment_score, CASE WHEN s > 0.1 THEN 'Positive' WHEN s < -0.1 THEN 'Negative' ELSE 'Neutral' END AS label FROM sent
""",
)
def article_sentiment(spark, folder):
    scored = news.sentiment(views.articles(spark, folder))
    return scored.select(
        "id",
        F.round("sentiment_score", 9).alias("sentiment_score"),
        text.sentiment_label(F.col("sentiment_score")).alias("label"),
    )


@query("F10", views="articles", sql=f"WITH {_SENTIMENT_SQL} SELECT id, round(s, 9) AS sentiment_score FROM sent")
def article_sentiment_joined(spark, folder):
    """Lexicon as a table: each label word of the documents scored through a join."""
    lexicon = spark.createDataFrame(list(words.POLARITY.items()), "word string, polarity double")
    scored = news.sentiment_by_lexicon(views.articles(spark, folder), lexicon)
    return rounded(scored.select("id", "sentiment_score"), digits=9)


@query(
    "A13",
    views="articles",
    sql=f"""
WITH {_SENTIMENT_SQL} SELECT count(*) FILTER (s > 0.1) AS positive, count(*) FILTER (s < -0.1) AS negative, count(*) FILTER (s BETWEEN -0.1 AND 0.1) AS neutral FROM sent
""",
)
def sentiment_distribution(spark, folder):
    return news.sentiment_distribution(news.sentiment(views.articles(spark, folder)))


@query(
    "A13",
    views="articles",
    sql=f"""
WITH {_SENTIMENT_SQL} SELECT CAST(date_trunc('day', published_at) AS TIMESTAMP) AS at, round(avg(s), 9) AS sentiment, count(*) AS articles FROM sent GROUP BY 1
""",
)
def sentiment_over_time(spark, folder):
    return rounded(news.sentiment_over_time(news.sentiment(views.articles(spark, folder))), digits=9)


_RANK_SQL = "relevance * 0.7 + (1 - least(1, hours / 24)) * 0.3"
_TITLE_SQL = f"substr(regexp_replace(lower(title), '[^{_WORD}]+', '', 'g'), 1, 50)"


@query(
    "T3 W15 F8",
    views="articles",
    sql=f"""
WITH {_PROCESS_SQL}, k AS (SELECT id, title, source, {_RANK_SQL} AS rank_score, {_TITLE_SQL} AS key FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank_score DESC, id) AS n FROM k)
SELECT id, title, source, round(rank_score, 6) AS rank_score FROM d WHERE n = 1 ORDER BY rank_score DESC, id LIMIT 20
""",
)
def news_feed(spark, folder):
    slim = views.articles(spark, folder)
    out = news.feed(news.process(slim, _as_of(), INTERESTS), _as_of())
    return rounded(out.select("id", "title", "source", "rank_score"))


@query(
    "W15",
    views="articles",
    sql=f"""
WITH k AS (SELECT id, source, {_TITLE_SQL} AS key FROM articles)
SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM k) WHERE n = 1
""",
)
def first_per_title(spark, folder):
    rows = views.articles(spark, folder).select("id", "source", "title")
    return news.first_per_title(rows, [F.col("id").asc()]).drop("title")


@query(
    "P31",
    views="articles",
    sql=f"WITH {_PROCESS_SQL} SELECT id, category FROM r WHERE category IN ('economy', 'central_banks', 'technology', 'general')",
)
def articles_by_label(spark, folder):
    kept = news.with_content(views.articles(spark, folder))
    both = F.concat(F.col("title"), F.lit(" "), F.col("content"))
    return news.in_categories(
        kept.select("id", text.category(both).alias("category")), ["Economy", "Technology", "General"]
    )


@query(
    "P30",
    views="articles",
    sql=f"""
WITH s AS (SELECT id, CAST(floor(epoch({_AS_OF}) - epoch(published_at)) AS BIGINT) AS s FROM articles)
SELECT id, CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd ago' WHEN s % 86400 > 3600 THEN (s % 86400) // 3600 || 'h ago' ELSE (s % 86400) // 60 || 'm ago' END AS age FROM s
""",
)
def article_ages(spark, folder):
    return views.articles(spark, folder).select("id", age_label(F.col("published_at"), _as_of()).alias("age"))


@query(
    "S19 U1 F11",
    views="articles",
    sql=f"""
SELECT 'a' || id AS key, coalesce(title, 'Untitled') AS title, length(content) AS n_chars, length(description) AS n_description, CASE WHEN id % 3 = 0 THEN 'Unknown' ELSE source END AS source,
  CASE WHEN id % 5 = 0 THEN {_AS_OF} ELSE published_at END AS published_at FROM articles
UNION ALL
SELECT 'p' || page_id, 'Untitled', length(html), length(html), 'Alpha Vantage', TIMESTAMP '2024-01-15 00:00:00' + to_hours(CAST(page_id AS BIGINT)) FROM pages
""",
)
def merged_news_sources(spark, folder):
    """Two payload shapes, built as JSON from the tables, merged to one article schema."""
    from tallyspark.sources import payloads

    a = views.articles(spark, folder)
    shape_a = a.select(
        F.concat(F.lit("a"), "id").alias("key"),
        F.to_json(
            F.struct(
                "title",
                "description",
                "content",
                F.when(F.col("id") % 5 == 0, "not a date")
                .otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
                .alias("publishedAt"),
                F.when(F.col("id") % 3 != 0, F.struct(F.col("source").alias("name"))).alias("source"),
            )
        ).alias("payload"),
    )
    p = table(spark, folder, "pages")
    moment = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.col("page_id").cast("int")
    )
    shape_b = p.select(
        F.concat(F.lit("p"), "page_id").alias("key"),
        F.to_json(
            F.struct(
                F.col("html").alias("summary"),
                "url",
                F.date_format(moment, "yyyyMMdd'T'HHmmss").alias("time_published"),
            )
        ).alias("payload"),
    )
    out = payloads.news_a(shape_a, _as_of()).unionByName(payloads.news_b(shape_b, _as_of()))
    return out.select(
        "key",
        "title",
        F.length("content").cast("long").alias("n_chars"),
        F.length("description").cast("long").alias("n_description"),
        "source",
        F.col("published_at").cast("timestamp_ntz").alias("published_at"),
    )
