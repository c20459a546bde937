"""Keyed state: monitors, lockouts, request limits and login risk on streams.

Each processor keeps a few values per key, so a busy key costs time but no memory.
The state is stored by the RocksDB provider.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyspark.operators.folds import FREE, Hold, Limit
from tallyspark.operators.security import (
    ADDRESS_POINTS,
    AGENT_POINTS,
    ATTEMPT_LIFE,
    ATTEMPT_LIMIT,
    ATTEMPT_POINTS,
    FAILED_LIFE,
    FAILED_LIMIT,
    FAILED_POINTS,
    KNOWN_LIFE,
    RISK_CAP,
)

PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set(PROVIDER_SETTING, PROVIDER)


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy()


def _batches(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts, ignore_index=True).sort_values(order) if parts else pd.DataFrame()


class Machine(StatefulProcessor):
    """Runs a ``Hold`` or ``Limit`` machine; state: count and end of the block."""

    def __init__(self, machine: Hold | Limit, key: str):
        self.machine, self.key = machine, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "count bigint, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batches(rows, ["ts", "id"])
        count, until = self.state.get() if self.state.exists() else (0, FREE)
        good = batch["success"].to_numpy(bool) if "success" in batch else np.ones(len(batch), bool)
        out, (count, until) = self.machine.fold(_micros(batch["ts"]), good, int(count), int(until))
        self.state.update((int(count), int(until)))
        names = [p.split()[0] for p in self.machine.output.split(", ")]
        yield pd.DataFrame({self.key: key[0], "id": batch["id"].to_numpy(), **{n: out[n] for n in names}})

    def close(self) -> None:
        pass


def run_machine(stream: DataFrame, machine: Hold | Limit, key: str, key_type: str = "long") -> DataFrame:
    """Lockout, endpoint health or request limit on a stream of (key, id, ts[, success])."""
    return stream.groupBy(key).transformWithStateInPandas(
        Machine(machine, key), f"{key} {key_type}, id long, {machine.output}", "Append", "None"
    )


class RecentValues(StatefulProcessor):
    """Keeps the newest values of a key and counts the IQR anomalies among them."""

    def __init__(self, key: str, size: int, reach: float, least: int):
        self.key, self.size, self.reach, self.least = key, size, reach, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "values array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batches(rows, ["ts"])
        held = deque(self.recent.get()[0] if self.recent.exists() else [], maxlen=self.size)
        held.extend(float(v) for v in batch["value"] if v is not None and not np.isnan(v))
        self.recent.update((list(held),))
        x = np.array(held)
        count = 0
        if len(x) >= self.least:
            q1, q3 = np.percentile(x, [25, 75])
            count = int(((x < q1 - self.reach * (q3 - q1)) | (x > q3 + self.reach * (q3 - q1))).sum())
        yield pd.DataFrame(
            {self.key: [key[0]], "ts": [batch["ts"].max()], "total_points": [len(x)], "anomaly_count": [count]}
        )

    def close(self) -> None:
        pass


def watch_values(stream: DataFrame, key: str, key_type: str = "long", size: int = 100) -> DataFrame:
    """One check per key and batch over its newest values."""
    return stream.groupBy(key).transformWithStateInPandas(
        RecentValues(key, size, 1.5, 4),
        f"{key} {key_type}, ts timestamp, total_points long, anomaly_count long",
        "Append",
        "None",
    )


class Counter(StatefulProcessor):
    """Counter per key that each event renews and that ends after ``seconds`` without one."""

    def __init__(self, key: str, seconds: int):
        self.key, self.life = key, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "count bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batches(rows, ["ts", "id"])
        count, last = self.state.get() if self.state.exists() else (0, FREE)
        counts = []
        for t in _micros(batch["ts"]):
            count = int(count) + 1 if last != FREE and t - last < self.life else 1
            last = int(t)
            counts.append(count)
        self.state.update((int(count), int(last)))
        yield pd.DataFrame({self.key: key[0], "id": batch["id"].to_numpy(), "count": counts})

    def close(self) -> None:
        pass


def live_counts(stream: DataFrame, key: str, seconds: int, key_type: str = "string") -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(
        Counter(key, seconds), f"{key} {key_type}, id long, count long", "Append", "None"
    )


class LoginRisk(StatefulProcessor):
    """Risk of a user's attempts: failures, and addresses and agents seen in a success.

    The attempt count per address belongs to another key and arrives as a column.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failed = handle.getValueState("failed", "count bigint, last bigint")
        self.seen = {
            "ip": handle.getMapState("ips", "item string", "at bigint"),
            "agent": handle.getMapState("agents", "item string", "at bigint"),
        }
        self.added = handle.getValueState("added", "ip bigint, agent bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batches(rows, ["ts", "id"])
        count, last = self.failed.get() if self.failed.exists() else (0, FREE)
        added = dict(zip(("ip", "agent"), self.added.get() if self.added.exists() else (FREE, FREE)))
        # Each item is asked for once a batch: a look at the stored map is a call to the JVM.
        known = {name: {} for name in self.seen}
        risks = []
        columns = [batch[c].to_numpy() for c in ("success", "ip", "agent", "attempt_count")]
        for t, ok, ip, agent, attempts in zip(_micros(batch["ts"]), *columns):
            t, risk = int(t), 0
            if not ok:
                count = int(count) + 1 if last != FREE and t - last < FAILED_LIFE * 1_000_000 else 1
                last = t
                risk += FAILED_POINTS if count > FAILED_LIMIT else 0
            for name, item, points in (("ip", ip, ADDRESS_POINTS), ("agent", agent, AGENT_POINTS)):
                held = known[name]
                if added[name] != FREE and t - added[name] >= KNOWN_LIFE * 1_000_000:
                    self.seen[name].clear()
                    held.clear()
                    added[name] = FREE
                if item not in held:
                    held[item] = self.seen[name].containsKey((item,))
                if not held[item]:
                    risk += points
                    if ok:
                        self.seen[name].updateValue((item,), (t,))
                        held[item] = True
                        added[name] = t
            risk += ATTEMPT_POINTS if attempts > ATTEMPT_LIMIT else 0
            risks.append(min(risk, RISK_CAP))
        self.failed.update((int(count), int(last)))
        self.added.update((int(added["ip"]), int(added["agent"])))
        yield pd.DataFrame({"user_id": key[0], "id": batch["id"].to_numpy(), "risk": risks})

    def close(self) -> None:
        pass


def login_risk(stream: DataFrame) -> DataFrame:
    """Streaming risk; expects user_id, id, ts, success, ip, agent and attempt_count."""
    return stream.groupBy("user_id").transformWithStateInPandas(
        LoginRisk(), "user_id long, id long, risk int", "Append", "None"
    )


def attempt_counts(stream: DataFrame) -> DataFrame:
    """Attempts per address within the renewing life; join to logins by id, or chain per batch."""
    return live_counts(stream.select("ip", "id", "ts"), "ip", ATTEMPT_LIFE).select(
        F.col("id"), F.col("count").alias("attempt_count")
    )
