"""Ordered state machines over the events of a key.

Two machines are needed: ``hold`` (repeated failures block a key for a while; used
for account lockout and endpoint health) and ``limit`` (a counter with a renewing
life; used for request limits).  Both carry a count and, once blocked, the time the
block ends, so the effect of a stretch of events is a small table: the state after
it for each count before it, and for each row at which a block may end.

Keys with few events are folded as one group.  The events of a hot key are cut into
pieces by row position; each piece yields its effect table, the tables are chained in order,
and every piece is then folded from its own starting state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.keyed import KeyedRows, null_safe_join

FREE = -1  # "block ends at" of a state that is not blocked
NO_TIME = 2**62  # a null time: comes last, neither ends a block nor begins one


@dataclass(frozen=True)
class Hold:
    """Blocks for ``seconds`` at the n-th failure in a row and at each failure after it.

    Events while blocked are ignored.  A success clears the count; the end of a block
    does not.  The effect tables count to n only, which decides the same.
    """

    failures: int
    seconds: int
    output = "ignored boolean, failures long, blocked_until long"

    @property
    def span(self) -> int:
        return self.seconds * 1_000_000

    def fold(self, t: np.ndarray, ok: np.ndarray, count: int, until: int):
        n = len(t)
        ignored, counts, ends = np.zeros(n, bool), np.zeros(n, np.int64), np.full(n, FREE, np.int64)
        for i in range(n):
            if t[i] < until:
                ignored[i] = True
            elif ok[i]:
                count, until = 0, FREE
            else:
                count += 1
                until = int(t[i]) + self.span if count >= self.failures and t[i] != NO_TIME else FREE
            counts[i], ends[i] = count, until
        return {"ignored": ignored, "failures": counts, "blocked_until": ends}, (count, until)

    def effects(self, t: np.ndarray, ok: np.ndarray):
        """States after the stretch, for entering row ``j`` unblocked with each count."""
        n, k = len(t), self.failures
        resume = np.searchsorted(t, t + self.span)
        after = [[(c, FREE)] * (n + 1) for c in range(k + 1)]
        for j in range(n - 1, -1, -1):
            if ok[j]:
                for c in range(k + 1):
                    after[c][j] = after[0][j + 1]
                continue
            r = int(resume[j])
            blocked = after[k][r] if r < n else (k, int(t[j]) + self.span)
            for c in range(k + 1):
                after[c][j] = after[c + 1][j + 1] if c + 1 < k else blocked
        return [after[c][0] for c in range(k + 1)], after[k]


@dataclass(frozen=True)
class Limit:
    """Allows events while the counter is under ``size``; each allowed one renews its life."""

    requests: int
    burst: int
    seconds: int
    output = "allowed boolean, remaining long"

    @property
    def size(self) -> int:
        return max(self.requests, self.burst)

    @property
    def span(self) -> int:
        return self.seconds * 1_000_000

    def fold(self, t: np.ndarray, ok: np.ndarray, count: int, until: int):
        n = len(t)
        allowed, left = np.zeros(n, bool), np.zeros(n, np.int64)
        for i in range(n):
            if until != FREE and NO_TIME != t[i] >= until:
                count, until = 0, FREE
            if count < self.size:
                left[i] = (self.requests if count < self.requests else self.burst) - count - 1
                allowed[i], count, until = True, count + 1, int(t[i]) + self.span if t[i] != NO_TIME else FREE
        return {"allowed": allowed, "remaining": left}, (count, until)

    def effects(self, t: np.ndarray, ok: np.ndarray):
        """States after the stretch, by count at row 0 and for a fresh counter at row ``j``."""
        n, size = len(t), self.size
        gaps = np.flatnonzero(np.diff(t) >= self.span) + 1
        next_gap = np.append(gaps, n)[np.searchsorted(gaps, np.arange(n), side="right")] if n else np.array([], int)
        resume = np.searchsorted(t, t + self.span)

        def from_row(j: int, count: int, fresh):
            """Runs on from row ``j`` with ``count`` used until the next fresh start."""
            gap, last = int(next_gap[j]), j + (size - count) - 1
            if gap <= last:
                return fresh[gap] if gap < n else (count + gap - j, int(t[n - 1]) + self.span)
            r = int(resume[last])
            return fresh[r] if r < n else (size, int(t[last]) + self.span)

        fresh = [(0, FREE)] * (n + 1)
        for j in range(n - 1, -1, -1):
            fresh[j] = from_row(j, 0, fresh)
        by_count = [from_row(0, c, fresh) for c in range(size)] + [(size, FREE)]
        return by_count, fresh


def effect_table(machine, t: np.ndarray, ok: np.ndarray) -> dict:
    """Effects of a stretch as columns; rows with equal effects are kept as one run (its last row).

    A block taken over from earlier rows ends within the machine's span, so only rows
    up to there, and the one after, are listed.
    """
    by_count, by_row = machine.effects(t, ok)
    listed = min(int(np.searchsorted(t, t[0] + machine.span, side="right")) + 1, len(t))
    ends = [j for j in range(listed) if j + 1 == listed or by_row[j] != by_row[j + 1]]
    return {
        "first_t": int(t[0]),
        "count_c": [c for c, _ in by_count],
        "count_u": [u for _, u in by_count],
        "starts": [int(t[j]) for j in ends],
        "start_c": [by_row[j][0] for j in ends],
        "start_u": [by_row[j][1] for j in ends],
    }


def _entry(machine, effect: pd.Series, count: int, until: int) -> tuple[int, int]:
    """State after a piece, from its effect table and the state before it."""
    starts = effect["starts"]
    if isinstance(machine, Hold):
        count = min(count, machine.failures)
    blocked = isinstance(machine, Hold) or count >= machine.size
    if until == FREE or (not blocked and effect["first_t"] < until):
        return effect["count_c"][count], effect["count_u"][count]
    j = int(np.searchsorted(starts, until))
    if j < len(starts):
        return effect["start_c"][j], effect["start_u"][j]
    # The block outlasts the rows that were tabulated: nothing in the piece ran.
    return count, until


def fold_by_key(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, ok: str | None, machine, limit: int | None = None
) -> DataFrame:
    """Runs the machine over the rows of each key in (ts, tie) order, null times last; adds its output columns. A null ``ok`` is a failure."""
    keys = list(keys)
    slim = df.withColumns(
        {"_t": F.unix_micros(F.col(ts).cast("timestamp")), "_ok": F.coalesce(ok, F.lit(False)) if ok else F.lit(True)}
    )
    rows = KeyedRows(slim, keys, [ts, tie], limit)
    wanted = [*df.columns, *[p.split()[0] for p in machine.output.split(", ")]]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + machine.output

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([ts, tie])
        count = int(group["_count"].iloc[0]) if "_count" in group else 0
        until = int(group["_until"].iloc[0]) if "_until" in group else FREE
        out, _ = machine.fold(group["_t"].fillna(NO_TIME).to_numpy(np.int64), group["_ok"].to_numpy(bool), count, until)
        return group.assign(**out)[wanted]

    if rows.hot is None:
        return slim.groupBy(*keys).applyInPandas(run, schema)

    cold = rows.cold_rows().groupBy(*keys).applyInPandas(run, schema)
    pieces = rows.pieces()
    key_types = dict(df.dtypes)
    key_schema = ", ".join(f"`{k}` {key_types[k]}" for k in keys)

    def tabulate(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([ts, tie])
        if group["_t"].isna().any():
            raise ValueError("a key with this many rows needs a time in each")
        effect = effect_table(machine, group["_t"].to_numpy(), group["_ok"].to_numpy(bool))
        head = group.iloc[:1][[*keys, "_piece"]].copy()
        for name, value in effect.items():
            head[name] = [value]
        return head

    longs = "array<long>"
    effects = pieces.groupBy(*keys, "_piece").applyInPandas(
        tabulate,
        f"{key_schema}, _piece int, first_t long, count_c {longs}, count_u {longs}, starts {longs}, "
        f"start_c {longs}, start_u {longs}",
    )

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_piece")
        count, until, entries = 0, FREE, []
        for _, effect in group.iterrows():
            entries.append((count, until))
            count, until = _entry(machine, effect, int(count), int(until))
        out = group[[*keys, "_piece"]].copy()
        out["_count"], out["_until"] = [int(c) for c, _ in entries], [int(u) for _, u in entries]
        return out

    entries = effects.groupBy(*keys).applyInPandas(chain, f"{key_schema}, _piece int, _count long, _until long")
    started = null_safe_join(pieces, entries, [*keys, "_piece"], "inner")
    hot = started.groupBy(*keys, "_piece").applyInPandas(run, schema)
    if isinstance(machine, Hold):
        hot = _true_failures(rows.on(hot), F.coalesce(ok, F.lit(False))).select(*cold.columns)
    return cold.unionByName(hot)


def _true_failures(rows: KeyedRows, ok: Column) -> DataFrame:
    """Counts the failures since the last success again; pieces start from counts up to the limit only."""
    counted = rows.running({"_f": ("sum", F.when(~F.col("ignored") & ~ok, 1).otherwise(0))})
    cleared = rows.on(counted).running({"_s": ("last", F.when(~F.col("ignored") & ok, F.col("_f")))})
    return cleared.withColumn("failures", F.col("_f") - F.coalesce("_s", F.lit(0))).drop("_f", "_s")


# Login lockout, endpoint health.
LOCKOUT = Hold(failures=5, seconds=1800)
BREAKER = Hold(failures=5, seconds=60)


def lockouts(logins: DataFrame, machine: Hold = LOCKOUT, limit: int | None = None) -> DataFrame:
    """Adds whether each attempt was ignored, the failure count and the end of a lock."""
    return fold_by_key(logins, ["user_id"], "ts", "id", "success", machine, limit)


def rate_limited(requests: DataFrame, machine: Limit, key: str = "client", limit: int | None = None) -> DataFrame:
    """Adds whether each request was allowed and how many were left."""
    return fold_by_key(requests, [key], "ts", "id", None, machine, limit)


def endpoint_states(calls: DataFrame, machine: Hold = BREAKER, key: str = "endpoint", limit: int | None = None) -> DataFrame:
    """Adds the breaker state after each call: closed or open; trial marks half-open calls."""
    folded = fold_by_key(calls, [key], "ts", "id", "success", machine, limit)
    state = F.when(F.col("blocked_until") == FREE, "closed").otherwise("open")
    return folded.withColumn("state", state)


def state_intervals(states: DataFrame, key: str = "endpoint") -> DataFrame:
    """Start of each interval of constant state per key, and the number of calls in it."""
    rows = KeyedRows(states, [key], ["ts", "id"])
    marked = rows.running({"_before": ("last", F.col("state"))}, exclusive=True)
    starts = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("state")), 1).otherwise(0)
    numbered = rows.on(marked).running({"interval": ("sum", starts)})
    return numbered.groupBy(key, "interval").agg(
        F.min_by("state", F.struct("ts", "id")).alias("state"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_call"),
        F.count(F.lit(1)).alias("calls"),
    )
