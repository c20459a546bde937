"""Ordered per-key computation that survives hot keys.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task.  That is
the right plan while every key is small, and the wrong one when a single key holds
a large share of the table.  ``KeyedRows`` counts rows per key once (partial
aggregation, a few bytes per key).  If no key exceeds ``limit`` rows it emits the
plain window.  Otherwise only the hot keys are cut into pieces of about ``limit``
rows:

* ``running`` cuts by row position in the order (range partitions of keys, order and
  a tie breaker, so neither an early outlier nor equal order values make a large
  piece), computes each piece on its own and adds the totals of the earlier pieces
  (one row per piece);
* ``rolling`` cuts by row position and copies the few rows a frame reaches over the
  cut, so every frame is complete;
* ``quantiles`` narrows each wanted rank to a thin value range with a sketch and
  ranks only the rows inside it, exactly;
* ``attach`` joins per-key results back, broadcasting only those of hot keys.

A null key is a key like any other.

Tables that are broadcast here have at most ``rows / limit`` entries (hot keys), or a
fixed multiple of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.lineage import cut

HOT_ROWS_SETTING = "spark.tally.hotKeyRows"
HOT_ROWS_DEFAULT = 1_000_000
# Pieces per ``limit`` rows; spare pieces absorb the error of sampled range borders.
OVERSPLIT = 4
SKETCH_ACCURACY = 20_000


def hot_row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS_DEFAULT)))


def as_number(df: DataFrame, name: str) -> Column:
    """The order column on a numeric axis (microseconds for times)."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(name).cast("double")
    return F.col(name).cast("double")


class KeyedRows:
    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str] = (),
        limit: int | None = None,
    ):
        self.df = df
        self.keys = list(keys)
        self.order = list(order)
        self.limit = limit or hot_row_limit(df)
        counts = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_hk_n"))
        hot = counts.filter(F.col("_hk_n") > self.limit)
        self.hot = None if hot.isEmpty() else cut(hot)

    def on(self, df: DataFrame) -> KeyedRows:
        """The same keys over other rows of the same table; hot keys are not counted again.

        With hot keys the rows are read several times, so derived rows are checkpointed
        first; without them the plan stays one pass.
        """
        return self._like(df if self.hot is None else cut(df))

    # -- splitting -----------------------------------------------------------

    def _hot_keys(self) -> DataFrame:
        return F.broadcast(self.hot.select(*self.keys))

    def cold_rows(self) -> DataFrame:
        return self.df if self.hot is None else null_safe_join(self.df, self._hot_keys(), self.keys, "left_anti")

    def hot_rows(self) -> DataFrame:
        return null_safe_join(self.df, self._hot_keys(), self.keys, "left_semi")

    def pieces(self) -> DataFrame:
        """The rows of hot keys with ``_piece``, which rises along the order; about ``limit / OVERSPLIT`` rows each.

        The cut is checkpointed: range borders come from samples, and every reader must see the same ones.
        """
        rows = self.hot.agg(F.sum("_hk_n")).first()[0]
        count = max(1, -(-rows * OVERSPLIT // self.limit))
        tied = self.hot_rows().withColumn("_tie", F.monotonically_increasing_id())
        ranged = tied.repartitionByRange(count, *self.keys, *self.order, "_tie")
        return cut(ranged.withColumn("_piece", F.spark_partition_id()).drop("_tie"))

    # -- expanding frames ----------------------------------------------------

    def running(
        self,
        specs: dict[str, tuple[str, Column]],
        exclusive: bool = False,
        reverse: bool = False,
    ) -> DataFrame:
        """Adds one column per spec, aggregated from the key's first row to this one.

        ``specs`` maps a name to ``(kind, column)`` with kind ``sum``, ``count``,
        ``max``, ``min`` or ``last`` (latest non-null).  ``exclusive`` leaves the
        row itself out; ``reverse`` walks from the end of the key instead.
        """
        over = {
            "sum": F.sum,
            "count": F.count,
            "max": F.max,
            "min": F.min,
            "last": lambda c: F.last(c, ignorenulls=True),
        }
        direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        frame_end = -1 if exclusive else Window.currentRow
        names = [f"_in_{n}" for n in specs]
        df = self.df.withColumns({f"_in_{n}": c for n, (_, c) in specs.items()})

        def plain(rows: DataFrame) -> DataFrame:
            w = Window.partitionBy(*self.keys).orderBy(*direction).rowsBetween(Window.unboundedPreceding, frame_end)
            return rows.withColumns({n: over[k](F.col(f"_in_{n}")).over(w) for n, (k, _) in specs.items()}).drop(*names)

        if self.hot is None:
            return plain(df)
        cold = plain(self._like(df).cold_rows())
        df = self._like(df).pieces()
        w = (
            Window.partitionBy(*self.keys, "_piece")
            .orderBy(*direction)
            .rowsBetween(Window.unboundedPreceding, frame_end)
        )
        local = df.withColumns({n: over[k](F.col(f"_in_{n}")).over(w) for n, (k, _) in specs.items()})
        position = F.struct(*self.order)
        edge = F.min_by if reverse else F.max_by

        def total(kind: str, c: Column) -> Column:
            if kind == "last":
                return edge(c, F.when(c.isNotNull(), position))
            return over[kind](c)

        totals = (
            df.groupBy(*self.keys, "_piece")
            .agg(*[total(k, F.col(f"_in_{n}")).alias(f"_c_{n}") for n, (k, _) in specs.items()])
        )
        earlier = (
            Window.partitionBy(*self.keys)
            .orderBy(F.col("_piece").desc() if reverse else F.col("_piece").asc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry_kind = {"count": "sum"}
        carried = totals.withColumns(
            {f"_c_{n}": over[carry_kind.get(k, k)](F.col(f"_c_{n}")).over(earlier) for n, (k, _) in specs.items()}
        )
        # The rows are already placed by key and piece; only the totals move.
        joined = null_safe_join(local, carried, [*self.keys, "_piece"], "left")

        def combine(kind: str, here: Column, before: Column) -> Column:
            if kind == "count":
                return here + F.coalesce(before, F.lit(0))
            if kind == "sum":
                return F.when(
                    here.isNotNull() | before.isNotNull(),
                    F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)),
                )
            if kind == "max":
                return F.greatest(here, before)
            if kind == "min":
                return F.least(here, before)
            return F.coalesce(here, before)

        out = joined.withColumns({n: combine(k, F.col(n), F.col(f"_c_{n}")) for n, (k, _) in specs.items()})
        return cold.unionByName(out.drop(*names, "_piece", *[f"_c_{n}" for n in specs]))

    def _like(self, df: DataFrame) -> KeyedRows:
        """The same keys over rows that only gained columns."""
        same = KeyedRows.__new__(KeyedRows)
        same.df, same.keys, same.order, same.limit, same.hot = df, self.keys, self.order, self.limit, self.hot
        return same

    # -- bounded frames ------------------------------------------------------

    def blocks(self, before: int, after: int = 0) -> DataFrame:
        """Rows with ``_block`` and ``_halo``; cold keys are one block each.

        Blocks of hot keys hold at most ``limit`` own rows plus ``before`` copied
        rows in front and ``after`` behind; copies carry ``_halo = true``.
        """
        plain = [F.lit(0).cast("long").alias("_block"), F.lit(False).alias("_halo")]
        if self.hot is None:
            return self.df.select("*", *plain)
        size = max(self.limit, before, after)
        placed = self._like(self.hot_rows()).running({"_at": ("count", F.lit(1))}).withColumn("_at", F.col("_at") - 1)
        own = F.floor(F.col("_at") / F.lit(size))
        offset = F.col("_at") - own * size
        copies = F.array_compact(
            F.array(
                F.struct(own.alias("_block"), F.lit(False).alias("_halo")),
                F.when(offset >= size - before, F.struct((own + 1).alias("_block"), F.lit(True).alias("_halo"))),
                F.when(
                    (offset < after) & (own > 0), F.struct((own - 1).alias("_block"), F.lit(True).alias("_halo"))
                ),
            )
        )
        spread = placed.withColumn("_copy", F.explode(copies)).select(*self.df.columns, "_copy._block", "_copy._halo")
        return self.cold_rows().select("*", *plain).unionByName(spread)

    def rolling(self, before: int, after: int, build: Callable[[Window], dict[str, Column]]) -> DataFrame:
        """Adds ``build(window)`` columns whose frames stay within the given reach."""
        w = Window.partitionBy(*self.keys, "_block").orderBy(*self.order)
        out = self.blocks(before, after).withColumns(build(w))
        return out.filter(~F.col("_halo")).drop("_block", "_halo")

    # -- per-key results -----------------------------------------------------

    def attach(self, stats: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        """Left join of a table with one row per key, or a fixed number told apart by ``extra``."""
        on = [*self.keys, *extra]
        if self.hot is None:
            return null_safe_join(self.df, stats, on, "left")
        hot_stats = null_safe_join(stats, self._hot_keys(), self.keys, "left_semi")
        cold_stats = null_safe_join(stats, self._hot_keys(), self.keys, "left_anti")
        cold = null_safe_join(self.cold_rows(), cold_stats, on, "left")
        hot = null_safe_join(self.hot_rows(), F.broadcast(hot_stats), on, "left")
        return cold.unionByName(hot)

    def quantiles(self, wanted: dict[str, tuple[str, float]]) -> DataFrame:
        """Exact linear-interpolated quantiles, ``{output: (column, probability)}``."""
        if self.hot is None:
            return _small_quantiles(self.df, self.keys, wanted)
        cold = _small_quantiles(self.cold_rows(), self.keys, wanted)
        return cold.unionByName(_ranked_quantiles(self.hot_rows(), self.keys, wanted, self.limit))


def _small_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Quantiles of small groups: one value map per group and column, shared by its ranks."""
    ranks: dict[str, list[float]] = {}
    for c, p in wanted.values():
        ranks.setdefault(c, []).append(p)
    aggs = [F.percentile(c, F.array(*[F.lit(p) for p in ps])).alias(f"_q_{c}") for c, ps in ranks.items()]
    found = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    picked = [F.get(f"_q_{c}", F.lit(ranks[c].index(p))).alias(name) for name, (c, p) in wanted.items()]
    return found.select(*keys, *picked)


def _ranked_quantiles(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], least_rows: int
) -> DataFrame:
    """Quantiles of few, large groups: sketch a value range per rank, then count.

    Between two rows the formula is that of ``percentile``, so both forms round alike.
    The range is wider than the sketch's error and at least two rows wide in a group
    of ``least_rows``; a rank outside it would be an error, not a wrong value.
    """
    slack = 4.0 / SKETCH_ACCURACY + 2.0 / least_rows
    aggs = []
    for i, (c, p) in enumerate(wanted.values()):
        lo, hi = max(0.0, p - slack), min(1.0, p + slack)
        aggs.append(F.count(c).alias(f"_n{i}"))
        aggs.append(F.percentile_approx(c, [lo, hi], SKETCH_ACCURACY).alias(f"_b{i}"))
        aggs.append(F.min(c).alias(f"_min{i}"))
        aggs.append(F.max(c).alias(f"_max{i}"))
    ranges = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    items = []
    for i, (c, p) in enumerate(wanted.values()):
        lo = F.col(f"_min{i}") if p - slack <= 0 else F.element_at(f"_b{i}", 1)
        hi = F.col(f"_max{i}") if p + slack >= 1 else F.element_at(f"_b{i}", 2)
        items.append(
            F.struct(
                F.lit(i).alias("q"),
                F.col(c).cast("double").alias("v"),
                lo.cast("double").alias("lo"),
                hi.cast("double").alias("hi"),
                (F.lit(p) * (F.col(f"_n{i}") - 1)).alias("at"),
            )
        )
    # One row per hot group, so the broadcast is bounded.
    joined = df.join(F.broadcast(ranges), keys) if keys else with_scalars(df, ranges)
    inside = (
        joined.select(*keys, F.explode(F.array(*items)).alias("_i"))
        .filter(F.col("_i.v") <= F.col("_i.hi"))
        .groupBy(
            *keys,
            F.col("_i.q").alias("q"),
            F.col("_i.at").alias("at"),
            F.when(F.col("_i.v") >= F.col("_i.lo"), F.col("_i.v")).alias("v"),
        )
        .agg(F.count(F.lit(1)).alias("c"))
    )
    w = Window.partitionBy(*keys, "q").orderBy(F.col("v").asc_nulls_first())
    ranked = inside.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.floor("at"), F.ceil("at")

    def at_rank(rank: Column) -> Column:
        holds = (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
        return F.max(F.when(holds & F.col("v").isNotNull(), F.col("v")))

    picked = ranked.groupBy(*keys, "q").agg(
        at_rank(low).alias("a"), at_rank(high).alias("b"), F.max(F.col("at") - low).alias("f"), F.max(high - F.col("at")).alias("g")
    )
    checked = F.when(
        F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("quantile rank outside its range"))
    ).otherwise(F.when(F.col("f") == 0, F.col("a")).otherwise(F.col("g") * F.col("a") + F.col("f") * F.col("b")))
    outputs = [F.max(F.when(F.col("q") == i, checked)).alias(name) for i, name in enumerate(wanted)]
    return picked.groupBy(*keys).agg(*outputs) if keys else picked.agg(*outputs)


BUCKETS = 4096  # of a value range, and distinct values that are read at once


def ranked_values(df: DataFrame, wanted: Sequence[tuple[str, int]]) -> list[float]:
    """The value at each (column, 0-based rank) of a whole table's columns, as doubles, by parallel selection.

    A round cuts the value range that holds a rank into buckets and counts them, all ranks in one pass; the rank's bucket is
    the next range, as wide as its own values. A range of few rows is counted value by value. So no task sorts and the driver
    reads at most ``BUCKETS`` and a few rows per rank and round. Doubles end within a few rounds, whatever their distribution. Infinities are
    values like others, NaN is larger than all, nulls don't count; a rank the column has no row for is an error.
    """
    names = list(dict.fromkeys(c for c, _ in wanted))
    values = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)])
    infinite = float("inf")

    def finite(v: Column) -> Column:
        return ~F.isnan(v) & ~v.isin(infinite, -infinite)

    shape = values.agg(
        *[agg.alias(f"{name}{i}") for i in range(len(names)) for v in [F.col(f"_v{i}")] for name, agg in (("n", F.count(v)), ("lo", F.min(F.when(finite(v), v))), ("hi", F.max(F.when(finite(v), v))))]
    ).first()
    found: dict[tuple[int, int], float] = {}
    todo = {(names.index(c), rank): (shape[f"lo{names.index(c)}"], shape[f"hi{names.index(c)}"], 0, shape[f"n{names.index(c)}"], True) for c, rank in wanted}
    for (i, rank), (*_, n, _) in todo.items():
        if not 0 <= rank < n:
            raise ValueError(f"column {names[i]} has no rank {rank}")
    while todo:
        items = []
        for q, ((i, _), (lo, hi, _, n, whole)) in enumerate(todo.items()):
            v = F.col(f"_v{i}")
            few = n <= BUCKETS
            if lo is None or lo == hi:
                inside = F.lit(0)
            elif lo / 2 == hi / 2:  # neighbours among the smallest numbers
                inside = (v > lo).cast("int")
            else:
                place = (v / 2 - lo / 2) / (hi / 2 - lo / 2) * BUCKETS
                inside = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
            bucket = F.when(F.isnan(v), BUCKETS + 1).when(v == infinite, BUCKETS).when(v == -infinite, -1).otherwise(inside)
            here = v.isNotNull() if whole else v.between(lo, hi) & ~F.isnan(v)
            items.append(F.when(here, F.struct(F.lit(q).alias("q"), bucket.alias("b"), (v if few else F.lit(None).cast("double")).alias("same"), v.alias("v"))))
        rows = values.select(F.explode(F.array_compact(F.array(*items))).alias("x")).groupBy("x.q", "x.b", "x.same").agg(F.count("*").alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")).collect()
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r.q, []).append(r)
        after = {}
        for q, (key, (_, _, before, _, _)) in enumerate(todo.items()):
            for r in sorted(by[q], key=lambda r: (r.b, r.same is not None and r.same == r.same, r.same or 0.0)):
                if before + r.n > key[1]:
                    if r.lo == r.hi or r.lo != r.lo:
                        found[key] = r.lo
                    else:
                        after[key] = (r.lo, r.hi, before, r.n, False)
                    break
                before += r.n
        todo = after
    return [found[names.index(c), rank] for c, rank in wanted]


def table_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of exact quantiles over the whole table, interpolated like ``percentile``; null of a column without values."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    sizes = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    places = {name: p * (sizes[f"n{columns.index(c)}"] - 1) for name, (c, p) in wanted.items() if sizes[f"n{columns.index(c)}"]}
    ranks = list(dict.fromkeys((wanted[name][0], rank) for name, at in places.items() for rank in (math.floor(at), math.ceil(at))))
    value = dict(zip(ranks, ranked_values(df, ranks))) if ranks else {}
    row = []
    for name, (c, _) in wanted.items():
        if name in places:
            low, high = math.floor(places[name]), math.ceil(places[name])
            a, b = value[c, low], value[c, high]
            row.append(a if low == high else (high - places[name]) * a + (places[name] - low) * b)
        else:
            row.append(None)
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{name}` double" for name in wanted))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null equals null; the ``on`` columns come first, once."""
    renamed = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    out = left.join(renamed, all_of([F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]), how)
    rest = [c for c in out.columns if c not in on and not (c.startswith("_on_") and c[4:] in on)]
    return out.select(*on, *rest)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row, as one scalar subquery."""
    fields = one_row.columns
    packed = one_row.select(F.struct(*fields).alias("_s")).scalar()
    out = df.withColumn("_s", packed)
    return out.withColumns({f: F.col(f"_s.{f}") for f in fields}).drop("_s")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
