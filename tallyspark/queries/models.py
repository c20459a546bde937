"""Queries over splits, metrics, text features and models."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import exprs
from tallyspark.functions.words import STOP_WORDS
from tallyspark.ml import boosting, ensembles, features, guided, iforest, jobs, metrics, neighbours, random_trees, split
from tallyspark.operators import anomaly, bars, people
from tallyspark.plans.keyed import with_scalars
from tallyspark.plans.lineage import cut, fresh_dir
from tallyspark.queries.bars import rounded
from tallyspark.queries.registry import query
from tallyspark.sources import views
from tallyspark.sources.tables import table

_WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"


def _hash(seed, expr, digits=13):
    return f"('0x' || substr(md5('{seed}:' || {expr}), 1, {digits}))::BIGINT"


def _uniform(seed, expr):
    return f"({_hash(seed, expr, 8)} / 4294967296.0::DOUBLE)"


# -- samples and splits ------------------------------------------------------------


@query("S2", sql=f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_hash('42', 'o_orderkey')}, o_orderkey LIMIT 500")
def sampled_rows(spark, folder):
    return split.sample_rows(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 500, "o_orderkey")


@query(
    "S3",
    sql=f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS class FROM orders),
s AS (SELECT avg(class) AS p FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {_hash('42', 'o_orderkey')}, o_orderkey) AS n FROM o)
SELECT o_orderkey, class FROM r, s WHERE n <= floor(CASE WHEN class = 1 THEN p * 1000 ELSE (1 - p) * 1000 END)
""",
)
def stratified_sample(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("class")
    )
    return split.stratified_sample(rows, 1000, "class", "o_orderkey")


@query(
    "M11",
    sql=f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_hash('42', 'doc_id')}, doc_id) AS n FROM labels)
SELECT doc_id, quality, CAST((n - 1) % 5 AS INTEGER) AS fold FROM r
""",
)
def stratified_folds(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "quality")
    return split.stratified_folds(rows, "quality", "doc_id", 5)


@query("M11", sql=f"SELECT event_id, CAST(floor({_uniform('42', 'event_id')} * 5) AS INTEGER) AS fold FROM events")
def hash_folds(spark, folder):
    return split.hash_folds(table(spark, folder, "events").select("event_id"), "event_id", 5)


@query(
    "M11",
    sql="""
WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id, CAST(CASE WHEN i < n - (n // 6) * 5 THEN 0 ELSE (i - (n - (n // 6) * 5)) // (n // 6) + 1 END AS INTEGER) AS test_fold FROM e
""",
)
def time_folds(spark, folder):
    return split.time_folds(table(spark, folder, "events").select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@query(
    "M11",
    sql="""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, i >= floor(n * 0.8) AS is_test FROM o
""",
)
def time_split(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return split.time_split(rows, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "M18",
    sql="""
SELECT o_orderpriority AS category, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * count(*)::DOUBLE), 9) AS weight FROM orders GROUP BY 1
""",
)
def class_weights(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("category"))
    return rounded(split.class_weights(rows, "category"), digits=9)


# -- metrics -----------------------------------------------------------------------


def _scored(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.col("l_extendedprice") / 105000).alias("score"),
        F.when(F.col("l_extendedprice") > 60000, 1).otherwise(0).alias("prediction"),
    )


_SCORED_SQL = """
sc AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice / 105000 AS score, CASE WHEN l_extendedprice > 60000 THEN 1 ELSE 0 END AS prediction FROM lineitem)
"""


@query(
    "M13",
    sql=f"""
WITH {_SCORED_SQL}, c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM sc)
SELECT *, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM c
""",
)
def binary_metrics(spark, folder):
    return metrics.binary_summary(_scored(spark, folder), "label", "prediction")


@query(
    "M13",
    sql=f"""
WITH {_SCORED_SQL}, g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM sc GROUP BY 1),
r AS (SELECT *, sum(pos) OVER w AS pu, sum(neg) OVER w AS nu, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING))
SELECT round(sum(pos * (nu - neg + neg / 2.0::DOUBLE)) / max(p * n), 9) AS auc,
  round(sum(pos / p::DOUBLE * (p - pu + pos) / nullif(p - pu + pos + n - nu + neg, 0)::DOUBLE), 9) AS average_precision FROM r
""",
)
def ranking_metrics(spark, folder):
    return rounded(metrics.ranking(_scored(spark, folder), "label", "score"), digits=9)


@query(
    "M13",
    sql=f"""
WITH {_SCORED_SQL} SELECT round(avg(CASE WHEN label = 1 THEN -ln(greatest(least(score, 1 - 1e-15), 1e-15)) ELSE -ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)) END), 8) AS log_loss FROM sc
""",
)
def log_loss(spark, folder):
    return rounded(metrics.log_loss(_scored(spark, folder), "label", "score"), digits=8)


def _classes(spark, folder):
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("prediction")
    )


_CLASSES_SQL = """
c AS (SELECT l_returnflag AS label, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS prediction FROM lineitem),
k AS (SELECT DISTINCT label AS class FROM c),
rep AS (SELECT class, (SELECT count(*) FROM c WHERE label = class AND prediction = class) AS hits, (SELECT count(*) FROM c WHERE prediction = class) AS predicted,
  (SELECT count(*) FROM c WHERE label = class) AS support FROM k),
pr AS (SELECT class, support, hits / predicted::DOUBLE AS precision, hits / support::DOUBLE AS recall FROM rep),
f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM pr)
"""


@query("M13", sql=f"WITH {_CLASSES_SQL} SELECT label, prediction, count(*) AS n FROM c GROUP BY 1, 2")
def confusion_matrix(spark, folder):
    return metrics.confusion(_classes(spark, folder), "label", "prediction")


@query(
    "M13",
    sql=f"WITH {_CLASSES_SQL} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM f",
)
def class_report(spark, folder):
    return rounded(metrics.class_report(_classes(spark, folder), "label", "prediction"), digits=9)


@query(
    "M13",
    sql=f"""
WITH {_CLASSES_SQL} SELECT """
    + ", ".join(
        f"round(avg({c}), 9) AS macro_{c}, round(sum({c} * support) / sum(support), 9) AS weighted_{c}"
        for c in ("precision", "recall", "f1")
    )
    + ", round((SELECT avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) FROM c), 9) AS accuracy FROM f",
)
def multiclass_metrics(spark, folder):
    return rounded(metrics.summary(_classes(spark, folder), "label", "prediction"), digits=9)


@query(
    "M13",
    sql="""
WITH p AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2100 AS e FROM lineitem)
SELECT round(1 - sum(e * e) / (var_pop(y) * count(y)), 8) AS r2, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(avg(abs(e / y)) * 100, 6) AS mape FROM p
""",
)
def regression_metrics(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2100).alias("p")
    )
    out = metrics.regression(rows, "y", "p")
    return out.select(
        F.round("r2", 8).alias("r2"),
        F.round("rmse", 4).alias("rmse"),
        F.round("mae", 4).alias("mae"),
        F.round("mape", 6).alias("mape"),
    )


@query(
    "M13 A19",
    sql="""
WITH f AS (SELECT l_linenumber AS fold, avg(CASE WHEN (l_returnflag = 'R') = (l_quantity > 25) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM lineitem GROUP BY 1)
SELECT count(*) AS folds, round(avg(accuracy), 9) AS mean_accuracy, round(stddev_pop(accuracy), 9) AS std_accuracy FROM f
""",
)
def metrics_over_folds(spark, folder):
    right = (F.col("l_returnflag") == "R") == (F.col("l_quantity") > 25)
    per_fold = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_linenumber").alias("fold"))
        .agg(F.avg(right.cast("double")).alias("accuracy"))
    )
    return rounded(metrics.over_folds(per_fold, "fold", ["accuracy"]), digits=9)


@query(
    "A19 M14",
    sql="""
WITH m AS (SELECT l_linestatus AS model, CASE WHEN l_returnflag = 'A' THEN 'original' ELSE 'smaller' END AS variant, avg(l_discount) AS score, avg(l_quantity) AS latency_ms, count(*) AS size_bytes
  FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT a.model, round(b.score / a.score, 8) AS score_retention, round(a.latency_ms / b.latency_ms, 8) AS speedup, round((1 - b.size_bytes / a.size_bytes::DOUBLE) * 100, 6) AS size_reduction
FROM m a JOIN m b ON a.model = b.model AND a.variant = 'original' AND b.variant = 'smaller'
""",
)
def comparison_ratios(spark, folder):
    rows = (
        table(spark, folder, "lineitem")
        .filter(F.col("l_returnflag") != "N")
        .groupBy(
            F.col("l_linestatus").alias("model"),
            F.when(F.col("l_returnflag") == "A", "original").otherwise("smaller").alias("variant"),
        )
        .agg(F.avg("l_discount").alias("score"), F.avg("l_quantity").alias("latency_ms"), F.count("*").alias("size_bytes"))
    )
    out = metrics.compare(rows)
    return out.select(
        "model",
        F.round("score_retention", 8).alias("score_retention"),
        F.round("speedup", 8).alias("speedup"),
        F.round("size_reduction", 6).alias("size_reduction"),
    )


# -- text and numeric features -----------------------------------------------------


def _tfidf_sql(src, size):
    return f"""
tf AS (SELECT id, term, count(*) AS tf FROM {src} GROUP BY 1, 2), n AS (SELECT count(*)::DOUBLE AS n FROM expenses),
voc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) <= (SELECT n FROM n) * 0.9 ORDER BY total DESC, term LIMIT {size}),
w AS (SELECT id, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN voc ON tf.term = voc.term, n)
SELECT w.id, w.term, round(w.w / sqrt(s.s), 6) AS weight FROM w JOIN (SELECT id, sum(w * w) AS s FROM w GROUP BY 1) s ON w.id = s.id
"""


@query(
    "M1",
    views="expenses",
    sql=rf"""
WITH c AS (SELECT id, regexp_extract_all(regexp_replace(lower(coalesce(merchant, '')), '[^{_WORD}\s]', ' ', 'g'), '[{_WORD}]{{2,}}') AS t FROM expenses),
tok AS (SELECT id, unnest(t) AS term FROM c), {_tfidf_sql("tok", 100)}
""",
)
def merchant_vectors(spark, folder):
    return rounded(features.merchant_vectors(views.expenses(spark, folder), "id"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    "M1",
    views="expenses",
    sql=rf"""
WITH c AS (SELECT id, list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(description), '[^{_WORD}\s]', ' ', 'g'), '\d+', '', 'g'), '[{_WORD}]{{2,}}'), lambda x: NOT list_contains([{_STOP}], x)) AS t FROM expenses),
tok AS (SELECT id, unnest(t) AS term FROM c UNION ALL SELECT id, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || ' ' || p[2])) FROM c WHERE len(t) > 1),
{_tfidf_sql("tok", 300)}
""",
)
def description_vectors(spark, folder):
    return rounded(features.description_vectors(views.expenses(spark, folder), "id"))


@query(
    "M2",
    sql="""
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS o_totalprice FROM orders, s
""",
)
def standardised_amounts(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rounded(features.standardised(rows, ["o_totalprice"]))


# -- neighbours, oversampling, forest ------------------------------------------------

_V = [f"V{i}" for i in range(1, views.V_COUNT + 1)]
_VLIST = "[" + ", ".join(_V) + "]"
_NEAR_SQL = f"""
few AS (SELECT id AS key, {_VLIST} AS f FROM v_features WHERE class = 1),
nn AS (SELECT a.key, b.key AS neighbour, row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.f, b.f), b.key) AS rank, list_distance(a.f, b.f) AS distance FROM few a JOIN few b ON a.key <> b.key)
"""


@query("M10", views="v_features", sql=f"WITH {_NEAR_SQL} SELECT key, neighbour, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM nn WHERE rank <= 5")
def nearest_minority(spark, folder):
    few = views.v_features(spark, folder).filter("class = 1")
    out = neighbours.nearest(few.select("id", F.array(*_V).alias("f")), "id", "f")
    return rounded(out)


@query(
    "M10",
    views="v_features",
    sql=f"""
WITH {_NEAR_SQL}, c AS (SELECT count(*) FILTER (class = 1) AS m, count(*) FILTER (class = 0) AS n FROM v_features),
base AS (SELECT key, f, row_number() OVER (ORDER BY key) - 1 AS at FROM few),
d AS (SELECT j, m, CAST(floor({_uniform('42n', 'j')} * least(5, greatest(m - 1, 1))) AS INTEGER) + 1 AS rank, {_uniform('42g', 'j')} AS gap FROM (SELECT unnest(range(0, n - m)) AS j, m FROM c))
SELECT j AS sample, b.key, nn.neighbour, 1 AS class, {", ".join(f"round(b.f[{i}] + gap * (o.f[{i}] - b.f[{i}]), 6) AS V{i}" for i in range(1, views.V_COUNT + 1))}
FROM d JOIN base b ON b.at = d.j % d.m JOIN nn ON nn.key = b.key AND nn.rank = d.rank JOIN few o ON o.key = nn.neighbour
""",
)
def oversampled_minority(spark, folder):
    return rounded(neighbours.oversample(views.v_features(spark, folder), "class", "id", _V))


@query("D8")
def isolation_forest(spark, folder):
    rows = views.v_features(spark, folder).select("id", *_V)
    out = iforest.isolation_flags(rows, _V, "id")
    return out.select("id", F.round("iso_score", 6).alias("iso_score"), "isolated")


@query("D5 D8 D9 D10")
def forest_and_noise(spark, folder):
    rows = views.readings(spark, folder).select("id", F.col("full_value").alias("value"))
    return anomaly.detect(rows, [], "value", method="ml")


# -- models ------------------------------------------------------------------------


def _shown(df, key, *more):
    p = F.round(F.array_max("probability"), 6).alias("confidence")
    return df.select(key, *more, p, "prediction")


def _cards(spark, folder):
    """Card rows with engineered features and folds, and the columns to learn from.

    The features are written and read again: a checkpoint keeps what the optimizer knows of their expressions, which then takes it minutes in every later step.
    """
    rows, columns = jobs.fraud_features(views.v_features(spark, folder))
    path = fresh_dir(spark, "cards")
    rows.write.parquet(path)
    return cut(split.stratified_folds(spark.read.schema(rows.schema).parquet(path), "class", "id")), columns


_FITTED: dict[tuple[str, str, str], object] = {}


def _once(spark, folder, name, make):
    """What ``make`` gives, kept for the queries of one application that share it."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _fraud(spark, folder):
    """The fraud job: engineered features, synthetic minority rows, a vote of boosting and a forest."""

    def make():
        rows, columns = _cards(spark, folder)
        return rows, columns, jobs.fit_fraud(cut(jobs.balanced(rows.filter("fold <> 0"), columns)), columns)

    return _once(spark, folder, "fraud", make)


@query("M4 M5 M8 M10 M11 M15 P17 P18 D7")
def fraud_scores(spark, folder):
    """Fraud risk of held-out rows, by the fraud job."""
    rows, _, model = _fraud(spark, folder)
    out = model.transform(rows.filter("fold = 0"))
    return out.select("id", "class", F.round(F.element_at("probability", 2), 6).alias("risk"), "prediction")


@query("T4 M4 M5")
def fraud_importance(spark, folder):
    """Ten most important features, averaged over two models."""
    _, columns, model = _fraud(spark, folder)
    df = spark.createDataFrame(ensembles.importances(model, columns), "feature string, importance double")
    return rounded(df.orderBy(F.col("importance").desc(), "feature").limit(10))


@query(
    "M10 M18",
    views="v_features",
    sql="""
WITH f AS (SELECT id, class, (row_number() OVER (PARTITION BY class ORDER BY HASH42, id) - 1) % 5 AS fold FROM v_features),
c AS (SELECT count(*) FILTER (class = 1) AS few, count(*) FILTER (class = 0) AS many FROM f WHERE fold <> 0)
SELECT class, n FROM (SELECT 1 AS class, many AS n FROM c UNION ALL SELECT 0, many FROM c)
""".replace("HASH42", _hash("42", "id")),
)
def balanced_training_rows(spark, folder):
    """Rows of each class that the fraud job learns from."""
    rows, columns = _cards(spark, folder)
    return jobs.balanced(rows.filter("fold <> 0"), columns).groupBy("class").agg(F.count("*").alias("n"))


def _expenses(spark, folder):
    raw = views.expenses(spark, folder).select(
        "id", exprs.strip_number(F.col("amount_text")).alias("amount"), "merchant", "description", "category"
    )
    return people.expense_numbers(people.with_defaults(raw))


@query("M1 M2 M4 M5 M8 M15 X5")
def expense_categories(spark, folder):
    """Category of held-out expenses from text, merchant and size."""
    rows = cut(split.stratified_folds(_expenses(spark, folder), "category", "id"))
    model = jobs.fit_expense(rows.filter("fold <> 0"))
    return _shown(model.transform(rows.filter("fold = 0")), "id", "category")


_NUMBERS = ["age_n", "hours_n", "educational_num", "capital_gain", "capital_loss"]
_TEXTS = ["workclass", "education", "native_country"]


def _people(spark, folder):
    raw = people.unknown_to_null(views.people(spark, folder), ["age", "hours_per_week", "workclass"])
    middle = raw.agg(F.percentile_approx("balance", 0.5)).scalar()
    return raw.withColumns(
        {
            "age_n": F.col("age").try_cast("double"),
            "hours_n": F.col("hours_per_week").try_cast("double"),
            "label": (F.col("balance") > middle).cast("double"),
        }
    )


@query("M3 M4 M6 M7 M9 M15")
def income_predictions(spark, folder):
    """Income class of held-out people by a stacked ensemble."""
    rows = cut(split.stratified_folds(_people(spark, folder), "label", "id"))
    model = jobs.fit_income(rows.filter("fold <> 0"), _NUMBERS, _TEXTS, "label", "id")
    return _shown(model.transform(rows.filter("fold = 0")), "id", "label")


def _direction_rows(spark, folder):
    def build(w):
        t = bars.target_columns(w, 1)
        s = bars.short_moving_columns(w)
        return {
            "returns": t["returns"],
            "direction": t["direction"],
            "sma_3": s["short_sma_3"],
            "sma_5": s["short_sma_5"],
            "volatility_3": s["short_volatility_3"],
            "volatility_5": s["short_volatility_5"],
        }

    base = bars.enough_history(bars.price_features(views.bars(spark, folder)))
    rows = bars.rsi(bars.indicators(base, build, before=4, after=1)).withColumnRenamed("rsi_5", "rsi")
    guarded = {c: exprs.finite_or_zero(F.col(c)) for c in jobs.DIRECTION_FEATURES}
    return rows.withColumns(guarded).select("symbol", "ts", "direction", *jobs.DIRECTION_FEATURES)


@query("M4 M6 M7 M8 M11 M15 W3 W7 W10 P28")
def direction_predictions(spark, folder):
    """Next-bar direction for the last fifth of the bars, trained on the bars before."""
    rows = cut(split.time_split(_direction_rows(spark, folder), ["ts", "symbol"]))
    model = jobs.fit_direction(rows.filter("NOT is_test"))
    return _shown(model.transform(rows.filter("is_test")), "symbol", "ts", "direction")


@query("M12")
def search_report(spark, folder):
    """Cross-validated scores of random and grid points over the forest's whole ranges."""
    rows = split.stratified_folds(views.v_features(spark, folder), "class", "id", folds=3)
    shaped = VectorAssembler(inputCols=_V, outputCol="features").transform(rows).select("class", "fold", "features")
    points = jobs.random_points(jobs.FOREST_RANGES, 4) + jobs.grid_points({"numTrees": [100, 200], "maxDepth": [10]})
    _, report = jobs.search(shaped, ensembles.random_forest("class", "features"), points, "class", "auc", parallelism=4)
    return rounded(report)


GUIDED, GUIDED_FIRST = 7, 4


@query(
    "M12",
    views="v_features",
    sql=f"SELECT {GUIDED}::BIGINT AS trials, 2::BIGINT AS batches, 0::BIGINT AS out_of_range, {GUIDED}::BIGINT AS points, true AS numbered, true AS improvements_known FROM (SELECT count(*) FROM v_features)",
)
def guided_search_trials(spark, folder):
    """A model-guided search over the forest's whole ranges: what its table of trials holds."""
    rows = split.stratified_folds(views.v_features(spark, folder), "class", "id", folds=3)
    shaped = VectorAssembler(inputCols=_V, outputCol="features").transform(rows).select("class", "fold", "features")

    def fit(train, params):
        return ensembles.random_forest("class", "features", params["numTrees"], params["maxDepth"]).fit(train)

    def auc(model, held):
        scored = ensembles.class_probabilities(model, held, "_p").select("class", F.element_at("_p", 2).alias("_s"))
        return metrics.ranking(cut(scored), "class", "_s").first()["auc"] or 0.0  # else the model goes out again with every pass

    log = guided.search(shaped, fit, auc, guided.Space(jobs.FOREST_RANGES), GUIDED, fresh_dir(spark, "trials"), first=GUIDED_FIRST, batch=3)
    trees, depth = (F.get_json_object("params", f"$.{n}").cast("int") for n in ("numTrees", "maxDepth"))
    outside = ~(trees.between(50, 300) & depth.between(5, 20) & F.col("mean_score").between(0, 1))
    return log.agg(
        F.count("*").alias("trials"),
        F.countDistinct("batch").alias("batches"),
        F.count_if(F.coalesce(outside, F.lit(True))).alias("out_of_range"),
        F.countDistinct("unit").alias("points"),
        (F.max("trial") - F.min("trial") + 1 == F.countDistinct("trial")).alias("numbered"),
        F.bool_and((F.col("batch") == 0) == F.col("improvement").isNull()).alias("improvements_known"),
    )


@query("M14 M16 A19")
def smaller_model_report(spark, folder):
    """A smaller fraud vote against the original: score kept, speed and size."""
    rows, columns = _cards(spark, folder)
    return jobs.compare_sizes(
        cut(jobs.balanced(rows.filter("fold <> 0"), columns)),
        rows.filter("fold = 0"),
        "class",
        lambda df, **sizes: jobs.fit_fraud(df, columns, **sizes),
        {},
        {"trees": 25, "rounds": 25},
        fresh_dir(spark, "models"),
        "fraud",
    )


# -- parts of fitted models, computed again from what they store ----------------------


def _agreement(df: DataFrame, differs) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("scored"), F.count_if(differs).alias("mismatches"))


_ALL_AGREE = "SELECT count(*) AS scored, 0::BIGINT AS mismatches FROM v_features"


def _small_vote(spark, folder):
    """A vote of all kinds of members, small: its parts are checked here, not its quality."""

    def make():
        rows = cut(views.v_features(spark, folder).select("id", F.col("class").cast("double").alias("class"), *_V))
        prepare = Pipeline(stages=[VectorAssembler(inputCols=_V, outputCol="features")])
        members = [
            ensembles.boosted_trees("class", "features", 3, 3),
            ensembles.random_forest("class", "features", 5, 4),
            ensembles.extra_trees("class", "features", 5, 4),
            ensembles.linear_svc("class", "features", 10),
            ensembles.logistic("class", "features"),
            ensembles.kernel_machine("class", "features", 20),
        ]
        return rows, ensembles.SoftVote.fit(rows, prepare, members)

    return _once(spark, folder, "parts", make)


@query("M4 M5 M6 M7 M8", views="v_features", sql=_ALL_AGREE)
def vote_is_the_mean_of_members(spark, folder):
    """The vote's probability against the mean over the members, each scored alone; its class is the larger one."""
    rows, vote = _small_vote(spark, folder)
    ready = vote.prepare.transform(vote.transform(rows).withColumnsRenamed({"probability": "_vote", "prediction": "_class"}))
    for i, member in enumerate(vote.models):
        ready = ensembles.class_probabilities(member, ready, f"_m{i}")
    mean = sum((F.element_at(f"_m{i}", 2) for i in range(len(vote.models))), F.lit(0.0)) / len(vote.models)
    risk = F.element_at("_vote", 2)
    wrong = (F.abs(risk - mean) > 1e-9) | ((F.col("_class") == 1) != (risk > F.element_at("_vote", 1)))
    return _agreement(ready, F.coalesce(wrong, F.lit(True)))


@query("M7 M15", views="v_features", sql=_ALL_AGREE)
def scores_from_coefficients(spark, folder):
    """Logistic and linear members against the logistic function of their stored coefficients."""
    rows, vote = _small_vote(spark, folder)
    machine, logistic = vote.models[3], vote.models[4]
    scored = ensembles.class_probabilities(machine, vote.prepare.transform(rows), "_svc")
    scored = ensembles.class_probabilities(logistic, scored, "_log")

    def plain(model):
        terms = [F.col(c) * float(w) for c, w in zip(_V, model.coefficients.toArray())]
        return 1 / (1 + F.exp(-sum(terms, F.lit(float(model.intercept)))))

    wrong = (F.abs(F.element_at("_svc", 2) - plain(machine)) > 1e-9) | (F.abs(F.element_at("_log", 2) - plain(logistic)) > 1e-9)
    return _agreement(scored, F.coalesce(wrong, F.lit(True)))


@query("M16", views="v_features", sql=_ALL_AGREE)
def reloaded_model_scores(spark, folder):
    """A saved vote, loaded again, against the one in memory."""
    rows, vote = _small_vote(spark, folder)
    path = fresh_dir(spark, "saved")
    vote.save(path)
    both = vote.transform(rows).withColumnRenamed("probability", "_before").drop("prediction")
    both = ensembles.load_ensemble(path).transform(both)
    return _agreement(both, F.abs(F.element_at("probability", 2) - F.element_at("_before", 2)) > 1e-12)


@query(
    "M17",
    sql="SELECT * FROM (VALUES ('first', 'broken', 'failed: no rows'), ('first', 'vote', 'trained'), ('second', 'broken', 'failed: no rows'), ('second', 'vote', 'kept'), ('third', 'broken', 'failed: no rows'), ('third', 'vote', 'trained')) t(run, model, outcome)",
)
def missing_models_trained(spark, folder):
    """Trains what a model folder lacks; a second run keeps it, a forced third trains again."""
    path = fresh_dir(spark, "folder")
    _, vote = _small_vote(spark, folder)

    def broken():
        raise ValueError("no rows")

    trainers = {"vote": lambda: (vote, {"trees": 5}, {}, {}), "broken": broken}
    rows = []
    for run, force in (("first", False), ("second", False), ("third", True)):
        rows += [(run, name, outcome) for name, outcome in jobs.train_missing(spark, path, trainers, force).items()]
    return spark.createDataFrame(rows, "run string, model string, outcome string")


_GRID = 16  # equal bins of the first split
_FIRST_L1, _FIRST_L2, _FIRST_WEIGHT = 0.5, 1.0, 9.0


@query(
    "M5",
    views="v_features",
    sql=f"""
WITH x AS (SELECT id, class, CASE WHEN class = 1 THEN {_FIRST_WEIGHT}::DOUBLE ELSE 1 END AS w, unnest(range(0, {views.V_COUNT})) AS feature, unnest({_VLIST}) AS v FROM v_features),
e AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1),
b AS (SELECT feature, (0.5 - class) * w AS g, 0.25 * w AS h, len(list_filter(range(1, {_GRID}), lambda i: lo + (hi - lo) * i / {_GRID} < v)) AS bin FROM x JOIN e USING (feature)),
s AS (SELECT feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM b GROUP BY 1, 2),
l AS (SELECT feature, i AS bin, sum(g) FILTER (s.bin <= i) AS gl, sum(h) FILTER (s.bin <= i) AS hl, sum(n) FILTER (s.bin <= i) AS nl, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM s, range(0, {_GRID - 1}) r(i) GROUP BY 1, 2),
k AS (SELECT *, g - gl AS gr, h - hl AS hr, n - nl AS nr FROM l WHERE hl >= 1 AND h - hl >= 1),
t AS (SELECT *, sign(g) * greatest(abs(g) - {_FIRST_L1}, 0) AS t, sign(gl) * greatest(abs(gl) - {_FIRST_L1}, 0) AS tl, sign(gr) * greatest(abs(gr) - {_FIRST_L1}, 0) AS tr FROM k),
best AS (SELECT *, (tl * tl / (hl + {_FIRST_L2}) + tr * tr / (hr + {_FIRST_L2}) - t * t / (h + {_FIRST_L2})) / 2 AS gain FROM t ORDER BY round(gain, 9) DESC, feature, bin LIMIT 1),
o AS (
  SELECT 0 AS node, feature, bin, gain, -t / (h + {_FIRST_L2}) AS weight, g, h, n FROM best
  UNION ALL SELECT 1, -1, 0, 0, -tl / (hl + {_FIRST_L2}), gl, hl, nl FROM best UNION ALL SELECT 2, -1, 0, 0, -tr / (hr + {_FIRST_L2}), gr, hr, nr FROM best)
SELECT node::INT AS node, feature::INT AS feature, bin::INT AS bin, round(gain, 6) AS gain, round(weight, 6) AS weight, round(g, 6) AS g, round(h, 6) AS h, n::BIGINT AS n FROM o
""",
)
def boosted_first_split(spark, folder):
    """The first tree of boosting, one level deep, on equal bins: split, gain and leaf weights with both penalties and a class weight."""
    rows = views.v_features(spark, folder).select("class", F.array(*_V).alias("features"))
    one = boosting.Booster("class", "features", rounds=1, depth=1, sample=1.0, columns=1.0, l1=_FIRST_L1, l2=_FIRST_L2, positive_weight=_FIRST_WEIGHT, bins=_GRID, equal_width=True)
    return rounded(one.fit(rows).table(spark).drop("round", "class", "at"))


@query("M5", views="v_features", sql="SELECT 0::BIGINT AS wrong_sums, 0::BIGINT AS wrong_weights, 0::BIGINT AS wrong_gains, count(*) AS scored, 0::BIGINT AS mismatches FROM v_features")
def boosted_nodes_recomputed(spark, folder):
    """Every stored node against sums over the rows that reach it, by joins round after round; then the scores."""
    rows = cut(views.v_features(spark, folder).select("id", F.col("class").cast("int").alias("y"), F.array(*_V).alias("x")))
    depth, l1, l2 = 3, 0.2, 0.7
    model = boosting.Booster("y", "x", rounds=3, depth=depth, sample=1.0, l1=l1, l2=l2).fit(rows)
    nodes = cut(model.table(spark))
    at = rows.withColumn("margin", F.lit(0.0))
    sums = None
    for i in range(3):
        own = nodes.filter(F.col("round") == i).select("node", "feature", "at", "weight")
        p = 1 / (1 + F.exp(-F.col("margin")))
        step = at.select("id", "x", "y", "margin", (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"), F.lit(0).alias("node"))
        for level in range(depth + 1):
            met = step.join(own, "node")
            here = met.filter(F.col("node") >= 2**level - 1).groupBy("node").agg(F.sum("g").alias("g2"), F.sum("h").alias("h2"), F.count("*").alias("n2"))
            sums = here.withColumn("round", F.lit(i)) if sums is None else sums.union(here.withColumn("round", F.lit(i)))
            below = F.get("x", F.col("feature")) <= F.col("at")
            step = met.select("id", "x", "y", "margin", "g", "h", F.when(F.col("feature") < 0, F.col("node")).otherwise(2 * F.col("node") + F.when(below, 1).otherwise(2)).alias("node"), "weight")
            step = step if level == depth else step.drop("weight")
        at = cut(step.select("id", "x", "y", (F.col("margin") + model.rate * F.col("weight")).alias("margin")))

    def soft(c):
        return F.signum(c) * F.greatest(F.abs(c) - l1, F.lit(0.0))

    def part(c, h):
        return soft(F.col(c)) * soft(F.col(c)) / (F.col(h) + l2)

    both = cut(nodes.join(sums, ["round", "node"], "left"))
    left, right = (both.select("round", (F.col("node") - i).alias("_n"), F.col("g2").alias(f"{side}_g"), F.col("h2").alias(f"{side}_h")) for i, side in ((1, "left"), (2, "right")))
    checked = both.withColumn("_n", 2 * F.col("node")).join(left, ["round", "_n"], "left").join(right, ["round", "_n"], "left")
    gain = F.when(F.col("feature") < 0, 0.0).otherwise((part("left_g", "left_h") + part("right_g", "right_h") - part("g2", "h2")) / 2)
    wrong = checked.agg(
        F.count_if(F.coalesce((F.abs(F.col("g") - F.col("g2")) > 1e-6) | (F.abs(F.col("h") - F.col("h2")) > 1e-6) | (F.col("n") != F.col("n2")), F.lit(True))).alias("wrong_sums"),
        F.count_if(F.coalesce(F.abs(F.col("weight") + soft(F.col("g2")) / (F.col("h2") + l2)) > 1e-6, F.lit(True))).alias("wrong_weights"),
        F.count_if(F.coalesce(F.abs(F.col("gain") - gain) > 1e-6, F.lit(True))).alias("wrong_gains"),
    )
    scored = model.probabilities(at, "p")
    return with_scalars(wrong, _agreement(scored, F.abs(F.element_at("p", 2) - 1 / (1 + F.exp(-F.col("margin")))) > 1e-9))


@query("M7", views="v_features", sql=_ALL_AGREE)
def random_trees_replayed(spark, folder):
    """Extremely randomised trees against a walk down their stored nodes, level by level, as joins."""
    rows = cut(views.v_features(spark, folder).select("id", F.col("class").cast("int").alias("y"), F.array(*_V).alias("x")))
    model = random_trees.ExtraTrees("y", "x", trees=12, depth=6).fit(rows)
    nodes = cut(model.table(spark))
    at = rows.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("tree"), F.lit(0).alias("node"))
    for _ in range(6):
        below = F.get("x", F.col("feature")) <= F.col("at")
        step = F.when(F.col("feature") < 0, F.col("node")).when(below, F.col("left")).otherwise(F.col("right"))
        at = at.join(nodes, ["tree", "node"]).select("id", "x", "tree", step.alias("node"))
    plain = at.join(nodes, ["tree", "node"]).groupBy("id").agg(F.avg(F.get("p", F.lit(1))).alias("plain"))
    both = model.probabilities(rows, "_p").join(plain, "id")
    return _agreement(both, F.coalesce(F.abs(F.element_at("_p", 2) - F.col("plain")) > 1e-9, F.lit(True)))


@query("M7 M15", views="v_features", sql=_ALL_AGREE)
def kernel_scores_from_landmarks(spark, folder):
    """The kernel machine's probabilities against column arithmetic over its stored landmarks, weights and sigmoid."""
    rows, vote = _small_vote(spark, folder)
    model = vote.models[5]
    scored = model.probabilities(vote.prepare.transform(rows), "_p")
    plain = 1 / (1 + F.exp(-(model.slope * model.margin_column(F.array(*_V)) + model.offset)))
    return _agreement(scored, F.coalesce(F.abs(F.element_at("_p", 2) - plain) > 1e-9, F.lit(True)))


@query("D8", views="v_features", sql=_ALL_AGREE)
def forest_scores_from_nodes(spark, folder):
    """Isolation scores against a walk down the stored nodes, level by level, as joins."""
    rows = cut(views.v_features(spark, folder).select("id", *_V))
    nodes = cut(iforest.fit_forest(rows, _V, "id"))
    scored = iforest.score_forest(rows, nodes, _V)
    values = rows.select("id", F.array(*_V).alias("x"))
    at = values.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(iforest.TREES - 1)))).withColumn("node", F.lit(0))
    for _ in range(math.ceil(math.log2(iforest.TREE_ROWS))):
        low = F.get("x", F.col("feature")) <= F.col("at")
        step = F.when(F.col("feature") < 0, F.col("node")).when(low, F.col("left")).otherwise(F.col("right"))
        at = at.join(nodes, ["tree", "node"]).select("id", "x", "tree", step.alias("node"))
    path = at.join(nodes, ["tree", "node"]).groupBy("id").agg(F.avg("length").alias("length"))
    both = scored.join(path, "id")
    plain = F.pow(F.lit(2.0), -F.col("length") / iforest.mean_path(iforest.TREE_ROWS))
    return _agreement(both, F.abs(F.col("iso_score") - plain) > 1e-9)


@query("T4 M4 M5", views="v_features", sql="SELECT 28::BIGINT AS features, 0::BIGINT AS out_of_order, 1.0::DOUBLE AS total FROM (SELECT count(*) FROM v_features)")
def importance_ranking(spark, folder):
    """All features once, in falling order of mean importance, which adds up to one."""
    _, vote = _small_vote(spark, folder)
    ranked = ensembles.importances(vote, _V)
    df = spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(ranked)], "place int, feature string, importance double")
    before = F.lag("importance").over(Window.orderBy("place"))
    return df.withColumn("_b", before).agg(
        F.countDistinct("feature").alias("features"),
        F.count_if(F.col("_b") < F.col("importance")).alias("out_of_order"),
        F.round(F.sum("importance"), 6).alias("total"),
    )
