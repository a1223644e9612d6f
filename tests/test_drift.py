"""Cumulative sums against a loop, whole and split."""

import random
import statistics

import pytest

from gaugeline.operators import reports


def expected(xs, slack, limit):
    known = [x for x in xs if x is not None]
    mean, sigma = statistics.fmean(known), statistics.pstdev(known)
    up = down = 0.0
    for x in xs:
        if x is not None and sigma > 0:
            z = (x - mean) / sigma
            up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
        yield up, down, max(up, down) > limit


def test_drift_equals_loop(spark, any_split):
    rng = random.Random(5)
    data = {"hot": [rng.gauss(10 + (i > 40), 1) if i % 9 else None for i in range(80)], "b": [4.0] * 6,
            "c": [rng.gauss(0, 3) for _ in range(15)], "one": [1.0]}
    rows = [(k, i, x) for k, xs in data.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at int, value double")
    got = {(r.key, r.at): r for r in reports.drift_scan(df, ["key"], ["at"], slack=0.3, limit=3.0).collect()}
    assert len(got) == len(rows)
    for key, xs in data.items():
        for i, (up, down, drift) in enumerate(expected(xs, 0.3, 3.0)):
            r = got[key, i]
            assert (r.up, r.down) == pytest.approx((up, down), abs=1e-9) and r.is_drift == drift
    assert any(r.is_drift for r in got.values())


def test_drift_of_nothing(spark):
    df = spark.createDataFrame([], "key string, at int, value double")
    assert reports.drift_scan(df, ["key"], ["at"]).count() == 0
