"""Pipelines, ensembles, the model folder (M16, M17), neighbours and the forest."""

import random

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml import Pipeline
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyspark.ml import ensembles, features, iforest, jobs, metrics, neighbours, split
from tallyspark.ml.arrays import dealt
from tallyspark.ml.ensembles import SoftVote


def points(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(i % 6 == 0)
        rows.append((i, y, *(float(v) for v in rng.normal(2.5 * y, 1, 3))))
    return spark.createDataFrame(rows, "id long, class int, V1 double, V2 double, V3 double")


V = ["V1", "V2", "V3"]


def test_vote_saves_and_loads(spark, scratch):
    df = split.with_class_weights(points(spark), "class").persist()
    vote = jobs.fit_fraud(df, V, trees=4, rounds=2)
    out = vote.transform(df).select("id", "prediction", "probability").orderBy("id").collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in out)
    vote.save(f"{scratch}/vote")
    again = ensembles.load_ensemble(f"{scratch}/vote").transform(df).select("id", "prediction", "probability").orderBy("id")
    assert again.collect() == out
    assert metrics.ranking(vote.transform(df).withColumn("s", F.element_at("probability", 2)), "class", "s").first()["auc"] > 0.9
    ranked = ensembles.importances(vote, V)
    assert [v for _, v in ranked] == sorted((v for _, v in ranked), reverse=True)


def test_stack_and_model_folder(spark, scratch):
    df = points(spark).withColumn("label", F.col("class").cast("double")).persist()
    prepare = Pipeline(stages=[VectorAssembler(inputCols=V, outputCol="features")])
    members = [ensembles.random_forest("label", "features", 3, 3), ensembles.linear_svc("label", "features", 5)]
    calls = []

    def train():
        calls.append(1)
        return ensembles.Stack.fit(df, prepare, members, "label", "id"), {"trees": 3}, {}, {"f1": 1.0}

    def broken():
        raise ValueError("no rows")

    path = f"{scratch}/models"
    assert jobs.train_missing(spark, path, {"income": train, "bad": broken}) == {"income": "trained", "bad": "failed: no rows"}
    assert jobs.train_missing(spark, path, {"income": train}) == {"income": "kept"}
    assert jobs.train_missing(spark, path, {"income": train}, force=True) == {"income": "trained"}
    assert len(calls) == 2 and jobs.runs(spark, path).count() == 2
    loaded = ensembles.load_ensemble(f"{path}/income")
    right = loaded.transform(df).filter("prediction = label").count()
    assert right > 200


def test_text_and_column_stages(spark, scratch):
    df = spark.createDataFrame(
        [("Pay 12 rent now", "Shop #1", 1.0, "x"), ("pay food", None, None, "y"), ("Rent rent", "Shop #2", 3.0, None), ("other words", "Bar", 4.0, "y")],
        "description string, merchant string, n double, c string",
    )
    model = features.pipeline(
        features.text_stages("description", "d", 50, pairs=True, digits=False),
        features.column_stages(["n"], ["c"], "f"),
    ).fit(df)
    model.write().overwrite().save(f"{scratch}/p")
    from pyspark.ml import PipelineModel

    rows = PipelineModel.load(f"{scratch}/p").transform(df).select("d", "f").collect()
    assert all(abs(r["d"].norm(2) - 1) < 1e-9 for r in rows)
    assert rows[2]["f"][-1] == model.transform(df).collect()[2]["f"][-1]


def test_nearest_over_blocks(spark):
    df = points(spark, 90).select("id", F.array(*V).alias("f"))
    x = np.array([r["f"] for r in df.orderBy("id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :5]
    for rows in (20_000, 17):
        near = neighbours.nearest(df, "id", "f", 5, block_rows=rows).orderBy("key", "rank").collect()
        got = np.array([r["neighbour"] for r in near]).reshape(90, 5)
        assert (got == want).all()


def test_forest_finds_far_points(spark):
    df = points(spark, 300).drop("class").unionByName(
        spark.createDataFrame([(1000, 50.0, 50.0, 50.0)], "id long, V1 double, V2 double, V3 double")
    )
    out = iforest.isolation_flags(df, V, "id")
    flagged = {r["id"] for r in out.filter("isolated").collect()}
    assert 1000 in flagged and 25 <= len(flagged) <= 31
    assert iforest.isolation_flags(df.limit(20), V, "id").filter("isolated").count() == 0


def test_samples(spark):
    df = spark.range(5000)
    assert split.sample_rows(df, 700, "id").count() == 700
    rows = split.sample_rows(df.withColumn("id", F.col("id") % 50), 77, "id")  # equal hashes
    assert rows.count() == 77
    assert split.sample_rows(df, 9000, "id").count() == 5000


def test_equal_points_take_the_smallest_keys(spark):
    df = spark.range(60).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("f"))
    near = neighbours.nearest(df, "id", "f", 5, block_rows=25)
    assert [r.neighbour for r in near.filter("key = 30").orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert [r.neighbour for r in near.filter("key = 2").orderBy("rank").collect()] == [0, 1, 3, 4, 5]


def test_neighbours_of_clusters_visit_few_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 3)) * 100
    points = np.concatenate([c + rng.normal(size=(60, 3)) for c in centres])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, f array<double>")
    got = {(r.key, r.rank): r.neighbour for r in neighbours.nearest(df, "id", "f", 4, block_rows=20).collect()}
    d = np.sqrt(((points[:, None] - points) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, n + 1): j for i in range(len(points)) for n, j in enumerate(np.lexsort((np.arange(len(points)), d[i]))[:4])}
    rows, cells = neighbours._in_cells(df.toDF("key", "f"), 20)
    own = rows.groupBy("block").applyInPandas(lambda part: neighbours._best(part, part, 4), neighbours.FOUND)
    blocks = rows.select("block").distinct().count()
    visited = neighbours.further_blocks(rows, own, cells, 4).select("l", "r").distinct().count()
    assert blocks >= 20 and visited < blocks * (blocks - 1) / 3
    assert neighbours.nearest(df.limit(0), "id", "f").count() == 0


def test_rows_of_one_feature_take_the_forests_steps(spark):
    df = spark.range(400).select("id", F.when(F.col("id") == 7, float("nan")).otherwise(F.floor(F.sin("id") * 40) / 4).alias("V1"))
    nodes = iforest.fit_forest(df.filter("id <> 7"), ["V1"], "id").localCheckpoint()
    trees = [tuple(g[c].to_numpy() for c in ("feature", "at", "left", "right", "length")) for _, g in nodes.orderBy("tree", "node").toPandas().groupby("tree")]
    rows = iforest.score_forest(df, nodes, ["V1"]).orderBy("id").toPandas()
    walk = iforest.walked(rows[["V1"]].to_numpy(float), trees)
    assert (rows["iso_score"] == 2 ** (-(walk / len(trees)) / iforest.mean_path(iforest.TREE_ROWS))).all()
    # Rows are scored once, however often the flags are read.
    assert "MapInPandas" not in iforest.isolation_flags(df, ["V1"], "id")._jdf.queryExecution().toString()


def test_small_table_keeps_the_score_column(spark):
    out = iforest.isolation_flags(spark.createDataFrame([(1, 2.0)], "id long, V1 double"), ["V1"], "id")
    assert out.columns == ["id", "V1", "iso_score", "isolated"] and out.first().iso_score is None


def test_search_points():
    draws = jobs.random_points(jobs.BOOST_RANGES, 5)
    assert draws == jobs.random_points(jobs.BOOST_RANGES, 5)
    assert all(30 <= p["maxIter"] <= 100 and 0.05 <= p["stepSize"] <= 0.3 for p in draws)
    assert len(jobs.grid_points({"a": range(10), "b": range(10)}, choose=7)) == 7
    assert len(jobs.grid_points({"a": range(40), "b": range(40)})) == 1600


def test_votes_score_in_a_session_that_has_observed_a_table(spark):
    df = points(spark)
    watch = Observation("rows")
    df.observe(watch, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert watch.get == {"n": 240}
    vote = SoftVote.fit(df, Pipeline(stages=[VectorAssembler(inputCols=V, outputCol="features")]), [ensembles.random_forest("class", "features", 3, 3)])
    assert vote.transform(df).filter("probability[1] BETWEEN 0 AND 1").count() == 240


def test_forests_are_fitted_on_rows_dealt_out(spark):
    rows = spark.range(0, 9000, 1, 1).select("id", (F.col("id") % 2).cast("double").alias("y"))
    parts = dealt(rows).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(parts) == 3 and sum(r["count"] for r in parts) == 9000 and max(r["count"] for r in parts) < 4000
    assert dealt(rows.limit(100)).count() == 100
    assert ensembles.random_forest("y", "f").getCacheNodeIds()


def test_description_vectors_count_only_pairs_that_may_be_kept(spark):
    """Pairs of rare words are not counted, and the vectors are those of counting all pairs; keys repeat or are null."""
    rnd = random.Random(3)
    names = ["".join(rnd.choice("bcdfghjklm") for _ in range(5)) for _ in range(500)]
    texts = [" ".join(rnd.choice(names[: rnd.choice((20, 330, 500))]) for _ in range(40)) + f" qqq www{chr(97 + i % 26)}xx" + " sss ttt" * (i % 2) for i in range(200)]
    rows = [(i // 2 if i % 9 else None, t if i % 11 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, description string")
    words = features.with_terms(df, features.clean_text(F.coalesce("description", F.lit(""))))
    of = features._words_of_pairs(features._frequencies(words, "_terms"), 200, features.DESCRIPTION_TERMS)
    assert 300 <= len(of) < 500 and "qqq" in of
    plain = features.tfidf(features.with_terms(df, features.clean_text(F.coalesce("description", F.lit(""))), pairs=True), "id", "_terms")
    shown = lambda v: sorted((str(r.id), r.term, round(r.weight, 9)) for r in v.collect())
    own = shown(features.description_vectors(df, "id"))
    assert own == shown(plain) and any(" " in r[1] for r in own)
