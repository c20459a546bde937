"""State machines: fixed sequences, random sequences, batch pieces and limits.

R7 lockout, R9 request limits, R10 endpoint health.
"""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tallyspark.operators import folds

START = datetime(2024, 1, 1)
SECOND = 1_000_000


def run(machine, seconds, ok=None):
    t = np.array(seconds) * SECOND
    good = np.array(ok if ok is not None else [True] * len(t))
    return machine.fold(t, good, 0, folds.FREE)[0]


def test_fifth_failure_locks_and_expiry_keeps_the_count():
    out = run(folds.LOCKOUT, [0, 1, 2, 3, 4, 100, 1804, 1805, 3700, 3701], [False] * 5 + [True, False, True, True, False])
    # Row 5 falls into the lock; row 6 comes exactly at its end and locks again at once.
    assert out["ignored"].tolist() == [False] * 5 + [True, False, True, False, False]
    assert out["blocked_until"][4] == 1804 * SECOND
    assert out["blocked_until"][6] == 3604 * SECOND
    assert out["failures"][6] == 6
    assert out["failures"][8] == 0 and out["failures"][9] == 1


def test_four_failures_then_success_do_not_lock():
    out = run(folds.LOCKOUT, range(6), [False] * 4 + [True, False])
    assert not out["ignored"].any()
    assert out["failures"].tolist() == [1, 2, 3, 4, 0, 1]


def test_breaker_opens_tries_and_closes():
    out = run(folds.BREAKER, [0, 1, 2, 3, 4, 30, 64, 65, 130, 131], [False] * 7 + [True] * 3)
    assert out["ignored"].tolist() == [False] * 5 + [True, False, True, False, False]
    assert out["blocked_until"][8] == folds.FREE


def test_limit_burst_and_idle_window():
    m = folds.Limit(requests=2, burst=4, seconds=60)
    out = run(m, [0, 1, 2, 3, 4, 5, 62, 63, 200])
    assert out["allowed"].tolist() == [True] * 4 + [False, False, False, True, True]
    assert out["remaining"].tolist() == [1, 0, 1, 0, 0, 0, 0, 1, 1]


MACHINES = [folds.Hold(3, 20), folds.LOCKOUT, folds.Limit(3, 5, 15), folds.Limit(4, 2, 40), folds.Limit(1, 1, 7)]


@pytest.mark.parametrize("machine", MACHINES, ids=str)
def test_effects_equal_folding(machine):
    """Chaining effect tables of pieces gives the state that one long fold reaches."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 60))
        t = np.cumsum(rng.choice([0, 1, 2, 5, 11, 30], n)) * SECOND
        ok = rng.random(n) < rng.choice([0.1, 0.5])
        cuts = np.unique(t[rng.integers(0, n, 3)])
        piece = np.searchsorted(cuts, t, side="right")
        count, until = 0, folds.FREE
        real = (0, folds.FREE)
        for p in np.unique(piece):
            here = piece == p
            tp = t[here]
            effect = folds.effect_table(machine, tp, ok[here])
            count, until = folds._entry(machine, effect, count, until)
            real = machine.fold(tp, ok[here], *real)[1]
            probe = np.array([tp[-1], tp[-1] + 3 * SECOND, tp[-1] + 10**10])
            for a in (True, False):
                flags = np.array([a] * 3)
                one = machine.fold(probe, flags, count, until)[0]
                two = machine.fold(probe, flags, *real)[0]
                # tables count failures to the limit only; fold_by_key counts them again
                assert all((one[k] == two[k]).all() for k in one if k != "failures")


@pytest.mark.parametrize("machine", [folds.Hold(3, 600), folds.Limit(3, 5, 400)], ids=str)
def test_hot_key_pieces_equal_one_group(spark, machine):
    rng = np.random.default_rng(9)
    at = np.cumsum(rng.exponential(90, 700))
    rows = [(0 if rng.random() < 0.7 else 1, i, START + timedelta(seconds=float(s)), bool(rng.random() < 0.4)) for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "user long, id long, ts timestamp, success boolean")
    whole = folds.fold_by_key(df, ["user"], "ts", "id", "success", machine, limit=100_000)
    parts = folds.fold_by_key(df, ["user"], "ts", "id", "success", machine, limit=40)
    assert parts.count() == len(rows)
    assert whole.exceptAll(parts).count() == 0


def test_null_times_come_last_and_renew_nothing(spark):
    rows = [("a", 1, START, True), ("a", 2, START + timedelta(seconds=500), None), ("a", 3, None, False), ("a", 4, None, None)]
    df = spark.createDataFrame(rows, "client string, id long, ts timestamp, success boolean")
    limited = folds.fold_by_key(df, ["client"], "ts", "id", None, folds.Limit(2, 2, 400)).orderBy("id").collect()
    assert [(r.allowed, r.remaining) for r in limited] == [(True, 1), (True, 1), (True, 0), (False, 0)]
    held = folds.fold_by_key(df, ["client"], "ts", "id", "success", folds.Hold(2, 60)).orderBy("id").collect()
    assert [(r.failures, r.blocked_until) for r in held] == [(0, -1), (1, -1), (2, -1), (3, -1)]
