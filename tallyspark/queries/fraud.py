"""Queries over card, census and expense features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import exprs, text
from tallyspark.operators import fraud, people
from tallyspark.operators.cleaning import drop_constant_columns, smallest_mode
from tallyspark.plans.keyed import table_quantiles, with_scalars
from tallyspark.queries.bars import rounded
from tallyspark.queries.registry import query
from tallyspark.sources import views
from tallyspark.sources.tables import table

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ROW = ", ".join(ROW)

_TIME_SQL = """
h AS (SELECT *, CAST(floor((time % 86400) / 3600) AS BIGINT) AS hour, CAST(floor(time / 86400) AS BIGINT) % 7 AS day_of_week FROM card_tx),
t AS (SELECT *, CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN hour >= 22 OR hour <= 6 THEN 1 ELSE 0 END AS is_night,
  ln(1 + amount) AS amount_log, CASE WHEN amount < 5 OR (amount >= 100 AND amount <= 300) OR amount >= 2000 THEN 1 ELSE 0 END AS high_risk_amount FROM h)
"""


@query(
    "P15",
    views="card_tx",
    sql=f"WITH {_TIME_SQL} SELECT {_ROW}, hour, day_of_week, is_weekend, is_night FROM t",
)
def card_time_features(spark, folder):
    out = fraud.time_features(views.card_tx(spark, folder).select(*ROW, "time"))
    return out.drop("time")


@query(
    "P16 F18",
    views="card_tx",
    sql=f"""
WITH {_TIME_SQL} SELECT {_ROW}, round(amount_log, 6) AS amount_log, round(sqrt(amount), 6) AS amount_sqrt, high_risk_amount,
  CASE WHEN amount > 0 AND amount <= 10 THEN 0 WHEN amount > 10 AND amount <= 50 THEN 1 WHEN amount > 50 AND amount <= 200 THEN 2
       WHEN amount > 200 AND amount <= 500 THEN 3 WHEN amount > 500 AND amount <= 2000 THEN 4 WHEN amount > 2000 THEN 5 ELSE 0 END AS amount_category FROM t
""",
)
def card_amount_features(spark, folder):
    out = fraud.amount_features(views.card_tx(spark, folder).select(*ROW, "amount"))
    return rounded(out.drop("amount"))


@query(
    "A11",
    views="card_tx",
    sql=f"SELECT {_ROW}, amount, count(*) OVER (PARTITION BY amount) AS amount_frequency FROM card_tx",
)
def amount_frequency(spark, folder):
    return fraud.amount_frequency(views.card_tx(spark, folder).select(*ROW, "amount"))


@query(
    "P19 P15 P16",
    views="card_tx",
    sql=f"""
WITH {_TIME_SQL}, m AS (SELECT max(amount_log) AS top FROM t)
SELECT {_ROW}, round(high_risk_amount * 0.3::DOUBLE + is_night * 0.2::DOUBLE + is_weekend * 0.1::DOUBLE + amount_log / top * 0.4::DOUBLE, 6) AS risk_score FROM t, m
""",
)
def card_risk_scores(spark, folder):
    tx = views.card_tx(spark, folder).select(*ROW, "time", "amount")
    out = fraud.risk_scores(fraud.amount_features(fraud.time_features(tx)))
    return rounded(out.select(*ROW, "risk_score"))


_V = [f"V{i}" for i in range(1, views.V_COUNT + 1)]
_VLIST = "[" + ", ".join(_V) + "]"


@query(
    "P17",
    views="v_features",
    sql=f"""
SELECT id, round(list_sum({_VLIST}), 6) AS v_sum, round(list_avg({_VLIST}), 6) AS v_mean, round(list_max({_VLIST}), 6) AS v_max,
  round(list_min({_VLIST}), 6) AS v_min, round(list_stddev_samp({_VLIST}), 6) AS v_std FROM v_features
""",
)
def v_aggregates(spark, folder):
    return rounded(fraud.v_aggregates(views.v_features(spark, folder)).drop("class", *_V))


@query(
    "P18",
    views="v_features",
    sql="SELECT id, "
    + ", ".join(f'round({a} * {b}, 6) AS "{a}_{b}_interaction"' for a, b in fraud.V_PAIRS)
    + " FROM v_features",
)
def v_interactions(spark, folder):
    return rounded(fraud.v_interactions(views.v_features(spark, folder)).drop("class", *_V))


@query(
    "D7",
    views="v_features",
    sql="WITH q AS (SELECT "
    + ", ".join(
        f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in fraud.V_OUTLIER_COLUMNS
    )
    + " FROM v_features) SELECT id, "
    + ", ".join(
        f'CASE WHEN {c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}) THEN 1 ELSE 0 END AS "{c}_outlier"'
        for c in fraud.V_OUTLIER_COLUMNS
    )
    + " FROM v_features, q",
)
def v_outliers(spark, folder):
    return fraud.v_outliers(views.v_features(spark, folder)).drop("class", *_V)


@query(
    "P23 P24 P25 P28 A12",
    views="people",
    sql="""
WITH n AS (SELECT id, try_cast(nullif(age, '?') AS DOUBLE) AS age, try_cast(hours_per_week AS DOUBLE) AS hours_per_week, nullif(workclass, '?') AS workclass,
  education, educational_num, capital_gain, capital_loss FROM people),
m AS (SELECT quantile_cont(age, 0.5) AS a, quantile_cont(hours_per_week, 0.5) AS h FROM n),
w AS (SELECT workclass AS mode FROM n WHERE workclass IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT id, coalesce(age, a) AS age, coalesce(hours_per_week, h) AS hours_per_week, coalesce(workclass, mode) AS workclass, education, educational_num,
  capital_gain, capital_loss FROM n, m, w)
SELECT id, age, workclass, age * age AS age_squared, capital_gain - capital_loss AS capital_total, educational_num * hours_per_week AS education_hours_interaction,
  age * educational_num AS age_education_interaction, round(hours_per_week / 168, 6) AS hours_per_week_normalized,
  CASE WHEN age > 0 AND age <= 25 THEN 'young' WHEN age > 25 AND age <= 35 THEN 'early_career' WHEN age > 35 AND age <= 45 THEN 'mid_career'
       WHEN age > 45 AND age <= 55 THEN 'senior' WHEN age > 55 AND age <= 65 THEN 'pre_retirement' WHEN age > 65 AND age <= 100 THEN 'retirement' END AS age_group,
  CASE WHEN hours_per_week > 0 AND hours_per_week <= 20 THEN 'part_time' WHEN hours_per_week > 20 AND hours_per_week <= 40 THEN 'full_time'
       WHEN hours_per_week > 40 AND hours_per_week <= 50 THEN 'standard_overtime' WHEN hours_per_week > 50 AND hours_per_week <= 60 THEN 'high_overtime'
       WHEN hours_per_week > 60 AND hours_per_week <= 100 THEN 'workaholic' END AS hours_category,
  CASE WHEN education IN ('Preschool', '1st-4th', '5th-6th', '7th-8th') THEN 'low' WHEN education IN ('Assoc-voc', 'Assoc-acdm', 'Bachelors') THEN 'high'
       WHEN education IN ('Masters', 'Prof-school', 'Doctorate') THEN 'very_high' ELSE 'medium' END AS education_level FROM f
""",
)
def census_features(spark, folder):
    raw = people.unknown_to_null(
        views.people(spark, folder).drop("native_country", "balance"), ["age", "hours_per_week", "workclass"]
    )
    raw = raw.withColumns({c: F.col(c).try_cast("double") for c in ("age", "hours_per_week")})
    mode = smallest_mode(raw, "workclass").scalar()
    medians = table_quantiles(raw, {"_age": ("age", 0.5), "_hours": ("hours_per_week", 0.5)})
    filled = with_scalars(raw, medians).withColumns(
        {
            "age": F.coalesce("age", "_age"),
            "hours_per_week": F.coalesce("hours_per_week", "_hours"),
            "workclass": F.coalesce("workclass", mode),
        }
    )
    out = people.census_features(filled.drop("_age", "_hours"))
    return out.drop("hours_per_week", "education", "educational_num", "capital_gain", "capital_loss").withColumn(
        "hours_per_week_normalized", F.round("hours_per_week_normalized", 6)
    )


@query(
    "P21 P22 P9",
    views="expenses",
    sql="""
WITH e AS (SELECT id, coalesce(try_cast(replace(amount_text, '$', '') AS DOUBLE), 0) AS amount, coalesce(merchant, 'unknown') AS merchant, coalesce(description, '') AS description FROM expenses),
m AS (SELECT max(amount) AS top FROM e)
SELECT id, round(amount, 6) AS amount, merchant, round(ln(1 + amount), 6) AS amount_log, round(amount / top, 6) AS amount_normalized,
  CASE WHEN amount > 0 AND amount <= 10 THEN 0 WHEN amount > 10 AND amount <= 25 THEN 1 WHEN amount > 25 AND amount <= 50 THEN 2
    WHEN amount > 50 AND amount <= 100 THEN 3 WHEN amount > 100 AND amount <= 200 THEN 4 WHEN amount > 200 THEN 5 ELSE 0 END AS amount_category,
  CAST(length(description) AS INTEGER) AS description_length, CAST(length(merchant) AS INTEGER) AS merchant_length FROM e, m
""",
)
def expense_numbers(spark, folder):
    rows = views.expenses(spark, folder).select(
        "id", exprs.strip_number(F.col("amount_text")).alias("amount"), "merchant", "description"
    )
    out = people.expense_numbers(people.with_defaults(rows))
    return rounded(out.drop("description", "category"))


@query(
    "J9",
    views="expenses",
    sql="""
WITH k AS (SELECT merchant, row_number() OVER (ORDER BY merchant) - 1 AS code FROM (SELECT DISTINCT coalesce(merchant, 'unknown') AS merchant FROM expenses WHERE date < TIMESTAMP '1998-01-01')),
e AS (SELECT id, coalesce(merchant, 'unknown') AS merchant FROM expenses)
SELECT id, e.merchant, coalesce(code, -1) AS merchant_encoded FROM e LEFT JOIN k ON e.merchant = k.merchant
""",
)
def merchant_codes(spark, folder):
    """Merchants of the first years are known; later ones may be unseen."""
    rows = views.expenses(spark, folder).select("id", "merchant", "date")
    codes = people.merchant_codes(rows.filter(F.col("date") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return people.encode_merchants(rows.drop("date"), codes)


@query(
    "F1 F2",
    views="expenses",
    sql=r"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(merchant), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', ' ', 'g'), '\d+', '', 'g'), '\s+', ' ', 'g')) AS merchant_words,
  trim(regexp_replace(regexp_replace(lower(merchant), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS merchant_clean FROM expenses
""",
)
def cleaned_merchants(spark, folder):
    return views.expenses(spark, folder).select(
        "id",
        text.clean_text(F.col("merchant")).alias("merchant_words"),
        text.clean_merchant(F.col("merchant")).alias("merchant_clean"),
    )


@query(
    "F1 F5",
    sql=r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', ' ', 'g'), '\d+', '', 'g'), '\s+', ' ', 'g')) AS words FROM documents
""",
)
def cleaned_descriptions(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.clean_text(F.col("text")).alias("words"))


@query(
    "P36",
    sql="SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings",
)
def varying_columns(spark, folder):
    """A constant and a nearly constant column are added and must be dropped again."""
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        F.element_at("embedding", 1).cast("double").alias("a"),
        F.element_at("embedding", 2).cast("double").alias("b"),
        F.lit(1.0).alias("same"),
        (F.element_at("embedding", 3).cast("double") * 1e-7).alias("almost"),
    )
    return drop_constant_columns(rows, ["a", "b", "same", "almost"])


@query(
    "P28",
    views="bars",
    sql="""
SELECT symbol, ts, round(coalesce(close / nullif(open - 10, 0), 0), 6) AS a, round(coalesce((high - low) / nullif(volume - 1, 0), 0), 6) AS b FROM bars
""",
)
def guarded_ratios(spark, folder):
    """Ratios with zero divisors: infinities, NaN and nulls become 0."""
    bars = views.bars(spark, folder)
    return bars.select(
        "symbol",
        "ts",
        F.round(exprs.finite_or_zero(exprs.safe_div(F.col("close"), F.col("open") - 10)), 6).alias("a"),
        F.round(
            exprs.finite_or_zero(exprs.safe_div(F.col("high") - F.col("low"), F.col("volume") - 1)), 6
        ).alias("b"),
    )
