"""Hot-key plans against pandas on random rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.ml.split import hash_number, sample_rows
from tallyspark.plans import keyed
from tallyspark.plans.keyed import KeyedRows, ranked_values, table_quantiles


def random_rows(seed, n=600):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 30, n)),
            "t": rng.integers(0, 400, n),
            "id": rng.permutation(n),
            "v": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n).round(3)),
        }
    )


def frame(spark, pdf):
    rows = [(int(a), int(b), int(c), None if np.isnan(d) else float(d)) for a, b, c, d in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "k long, t long, id long, v double")


@pytest.mark.parametrize("limit", [7, 50, 10_000])
@pytest.mark.parametrize("reverse", [False, True])
def test_running(spark, limit, reverse):
    pdf = random_rows(limit)
    rows = KeyedRows(frame(spark, pdf), ["k"], ["t", "id"], limit)
    assert (rows.hot is None) == (limit == 10_000)
    got = rows.running(
        {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "l": ("last", F.col("v")), "m": ("max", F.col("v"))},
        reverse=reverse,
    ).toPandas()
    pdf = pdf.sort_values(["t", "id"], ascending=not reverse)
    g = pdf.groupby("k")["v"]
    want = pdf.assign(n=g.transform(lambda x: x.notna().cumsum()), s=g.transform(lambda x: x.fillna(0).cumsum()), l=g.ffill(), m=g.cummax())
    want["m"] = want.groupby("k")["m"].ffill()
    both = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(both) == len(pdf)
    assert (both["n"] == both["n_w"]).all()
    seen = both["n"] > 0
    assert np.allclose(both.loc[seen, "s"], both.loc[seen, "s_w"])
    assert both.loc[~seen, "s"].isna().all()
    for c in "lm":
        assert np.allclose(both[c], both[f"{c}_w"], equal_nan=True)


@pytest.mark.parametrize("limit", [9, 64, 10_000])
def test_exclusive_and_rolling(spark, limit):
    pdf = random_rows(limit + 1)
    rows = KeyedRows(frame(spark, pdf), ["k"], ["t", "id"], limit)
    before = rows.running({"p": ("last", F.col("id"))}, exclusive=True).toPandas()
    rolled = rows.rolling(
        5, 3, lambda w: {"a": F.count("v").over(w.rowsBetween(-5, 3)), "x": F.lead("id", 3).over(w)}
    ).toPandas()
    pdf = pdf.sort_values(["t", "id"])
    g = pdf.groupby("k")
    pdf["p"], pdf["x"] = g["id"].shift(1), g["id"].shift(-3)
    pdf["a"] = g["v"].transform(lambda x: [x.iloc[max(0, i - 5) : i + 4].notna().sum() for i in range(len(x))])
    b = before.merge(pdf, on="id", suffixes=("", "_w"))
    assert np.allclose(b["p"], b["p_w"], equal_nan=True)
    r = rolled.merge(pdf, on="id", suffixes=("", "_w"))
    assert len(r) == len(pdf)
    assert (r["a"] == r["a_w"]).all() and np.allclose(r["x"], r["x_w"], equal_nan=True)


@pytest.mark.parametrize("limit", [20, 10_000])
def test_quantiles(spark, limit):
    pdf = random_rows(5)
    df = frame(spark, pdf)
    wanted = {"a": ("v", 0.1), "b": ("v", 0.5), "c": ("v", 0.99)}
    got = KeyedRows(df, ["k"], limit=limit).quantiles(wanted).toPandas().set_index("k")
    for name, (_, p) in wanted.items():
        want = pdf.groupby("k")["v"].quantile(p)
        assert np.allclose(got[name].sort_index(), want.sort_index(), equal_nan=True)
    one = table_quantiles(df, wanted).first()
    assert np.allclose([one["a"], one["b"], one["c"]], pdf["v"].quantile([0.1, 0.5, 0.99]))


@pytest.mark.parametrize("buckets", [4, 64, 4096])
def test_values_at_ranks(spark, monkeypatch, buckets):
    """Any distribution, any number of buckets: the value a sort would put there."""
    monkeypatch.setattr(keyed, "BUCKETS", buckets)
    rnd = np.random.default_rng(buckets)
    columns = {
        "even": rnd.random(700), "heavy": np.exp(rnd.normal(0, 40, 700)), "ties": rnd.integers(0, 4, 700).astype(float), "one": np.full(700, 3.5),
        "ends": np.concatenate([[-np.inf] * 3, rnd.normal(size=690), [np.inf] * 4, [np.nan] * 3]), "wide": np.concatenate([[-1.7e308, 1.7e308, 5e-324, 0.0, 1e-323], rnd.normal(size=695)]),
    }
    rows = [tuple(float(columns[c][i]) for c in columns) for i in range(700)] + [(None,) * len(columns)] * 9
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    wanted = [(c, r) for c in columns for r in (0, 2, 3, 350, 696, 699)]
    want = [np.sort(columns[c])[r] for c, r in wanted]
    assert np.array_equal(ranked_values(df, wanted), want, equal_nan=True)
    with pytest.raises(ValueError):
        ranked_values(df, [("even", 700)])
    none = table_quantiles(df.filter("one IS NULL"), {"a": ("one", 0.5)}).first()
    assert none["a"] is None
    two = table_quantiles(df, {"a": ("even", 0.123), "b": ("ties", 0.9)}).first()
    assert np.allclose([two["a"], two["b"]], [np.quantile(columns["even"], 0.123), np.quantile(columns["ties"], 0.9)])


def test_no_task_reads_more_than_the_buckets(spark):
    """What meets behind the exchange is bounded by buckets and ranks, not by rows."""
    df = spark.range(200_000).select((F.rand(3) * 1e9).alias("v"))
    seen = []
    kind = type(df)
    real = kind.collect
    kind.collect = lambda self: seen.append(real(self)) or seen[-1]
    try:
        ranked_values(df, [("v", 100_000), ("v", 7)])
    finally:
        kind.collect = real
    assert 1 < len(seen) <= 4 and max(map(len, seen)) <= 2 * (keyed.BUCKETS + 3)


def test_sample_by_selection(spark):
    df = spark.range(5000).select((F.col("id") % 4900).alias("id"))
    want = sorted((r.h, r.id) for r in df.select("id", hash_number("42", F.col("id")).alias("h")).collect())
    for size in (0, 1, 99, 4999, 6000):
        got = sorted(r.id for r in sample_rows(df, size, "id").collect())
        assert got == sorted(i for _, i in want[:size])


def test_attach_splits_hot_keys(spark):
    df = frame(spark, random_rows(8))
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    got = KeyedRows(df, ["k"], limit=20).attach(stats)
    assert got.count() == df.count()
    assert got.groupBy("k").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c <> n").count() == 0


def skewed(kind, n=2000):
    """One hot key whose order column defeats cuts by value."""
    t = {"early outlier": [-(10**12), *range(1, n)], "all equal": [7] * n, "bursts": [i // 500 for i in range(n)]}[kind]
    return pd.DataFrame({"t": t, "id": range(n)})


@pytest.mark.parametrize("key", [3, None])
@pytest.mark.parametrize("kind", ["early outlier", "all equal", "bursts"])
def test_hot_keys_are_cut_by_position(spark, kind, key):
    pdf = skewed(kind)
    df = spark.createDataFrame([(key, int(a), int(b)) for a, b in pdf.itertuples(index=False)] + [(1, 0, -1), (1, 1, -2)], "k long, t long, id long")
    rows = KeyedRows(df, ["k"], ["t", "id"], limit=100)
    sizes = [r["count"] for r in rows.pieces().groupBy("_piece").count().collect()]
    assert sum(sizes) == len(pdf) and max(sizes) <= 200
    got = rows.running({"n": ("count", F.lit(1)), "s": ("sum", F.col("id"))}).toPandas()
    assert len(got) == len(pdf) + 2
    hot = got[got["id"] >= 0].sort_values(["t", "id"])
    assert hot["n"].tolist() == list(range(1, len(pdf) + 1))
    assert hot["s"].tolist() == hot["id"].cumsum().tolist()
    stats = df.groupBy("k").agg(F.count("*").alias("c"))
    attached = rows.attach(stats).toPandas()
    assert attached["c"].value_counts().to_dict() == {len(pdf): len(pdf), 2: 2}


def test_equal_rows_are_cut(spark):
    """Rows that agree in every order column have no order among them, but still split."""
    df = spark.range(2000).select(F.lit(1).alias("k"), F.lit(5).alias("t"))
    rows = KeyedRows(df, ["k"], ["t"], limit=100)
    assert max(r["count"] for r in rows.pieces().groupBy("_piece").count().collect()) <= 200
    assert sorted(r.n for r in rows.running({"n": ("count", F.lit(1))}).collect()) == list(range(1, 2001))
