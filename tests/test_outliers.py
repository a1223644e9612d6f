"""Record z-scores, running CF baselines and alert runs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import outliers


def stream(spark, xs, key="m"):
    return spark.createDataFrame([(key, i, float(x)) for i, x in enumerate(xs)],
                                 "key string, seq bigint, value double")


def detect(df, limit=3, **settings):
    scored = outliers.cf_online_outlier(df, ["key"], ["seq"], "value", **settings)
    rows = outliers.consecutive_alerts(scored, ["key"], ["seq"], limit).orderBy("key", "seq")
    return rows.collect()


def loop(xs, threshold, k, min_points, min_baseline):
    """The definition, reading by reading."""
    cells, out = {}, []
    for at, x in enumerate(xs):
        best = None
        for cell, vals in sorted(cells.items()):
            if len(vals) >= min_baseline:
                mean = sum(vals) / len(vals)
                var = max(sum(v * v for v in vals) / len(vals) - mean * mean, 0.0)
                scale = max(math.sqrt(var), 0.1 if at < min_points else 0.01)
                if best is None or abs(x - mean) < best[0]:
                    best = (abs(x - mean), abs(x - mean) / scale)
        out.append(best[1] if best else None)
        cells.setdefault(math.floor(x / (2 * threshold)), []).append(x)
    return out


@pytest.mark.parametrize("seed", [2])
def test_online_scores_match_the_loop(spark, any_split, seed):
    rng = random.Random(seed)
    xs = [float(rng.choice([10, 11, 12, 30, 31, 33, 70, rng.randint(0, 100)])) for _ in range(60)]
    got = detect(stream(spark, xs), threshold=4.0, min_baseline=3)
    want = loop(xs, 4.0, 3.0, 10, 3)
    assert [r.value for r in got] == xs
    for r, z in zip(got, want):
        assert (r.z_score is None) == (z is None)
        if z is not None:
            assert r.z_score == pytest.approx(z, rel=1e-9)
            assert r.is_outlier == (z > 3.0)


def test_keys_do_not_mix(spark):
    both = stream(spark, [5.0] * 20, "a").unionByName(stream(spark, [90.0] * 20, "b"))
    assert not any(r.is_outlier for r in detect(both))


def test_steady_readings_are_accepted(spark):
    xs = [5.0 + (i % 5 - 2) * 0.02 for i in range(20)]
    assert {r.suggestion for r in detect(stream(spark, xs), sigma_factor=3.0, min_points=5)} == {"accept"}


def test_one_outlier(spark):
    last = detect(stream(spark, [5.0] * 30 + [20.0]), sigma_factor=1.0)[-1]
    assert last.is_outlier and last.suggestion == "reject" and not last.alert


def test_alert_run(spark, any_split):
    rows = detect(stream(spark, [5.0] * 30 + [20.0] * 5), min_baseline=5)[30:]
    assert [r.streak for r in rows] == [1, 2, 3, 4, 5]
    assert [r.alert for r in rows] == [False, False, True, True, True]
    assert [r.suggestion for r in rows] == ["reject", "reject", "flag", "flag", "flag"]


def test_batch_of_six(spark):
    assert len(detect(stream(spark, [5.0, 5.1, 4.9, 5.2, 4.8, 100.0]))) == 6


def test_run_resets_on_a_normal_reading(spark, any_split):
    flags = [False, True, True, False, True, True, True, True, False, True]
    df = spark.createDataFrame([("k", i, f) for i, f in enumerate(flags)],
                               "key string, seq bigint, is_outlier boolean")
    rows = outliers.consecutive_alerts(df, ["key"], ["seq"]).orderBy("seq").collect()
    assert [r.streak for r in rows] == [0, 1, 2, 0, 1, 2, 3, 4, 0, 1]


def test_runs_go_on_from_an_earlier_batch(spark):
    df = spark.createDataFrame([("k", 0, True), ("k", 1, True), ("k", 2, False), ("k", 3, True)],
                               "key string, seq bigint, is_outlier boolean")
    prior = spark.createDataFrame([("k", 2)], "key string, streak bigint")
    rows = outliers.consecutive_alerts(df, ["key"], ["seq"], prior=prior).orderBy("seq").collect()
    assert [r.streak for r in rows] == [3, 4, 0, 1]


def test_summary(spark):
    rows = outliers.consecutive_alerts(outliers.cf_online_outlier(
        stream(spark, [5.0] * 30 + [20.0] * 5), ["key"], ["seq"], "value", min_baseline=5), ["key"], ["seq"])
    r = outliers.detection_summary(rows, ["key"], "seq").first()
    assert (r.total_detections, r.total_outliers, r.total_alerts, r.consecutive_outliers) == (35, 5, 3, 5)


def records(spark, *arrays):
    return spark.createDataFrame([(i, list(map(float, a))) for i, a in enumerate(arrays)],
                                 "measure_point_id int, vals array<double>")


def test_record_z_limits(spark):
    df = records(spark, [1, 1, 1, 99], [1, 1, 1, 1, 1, 1, 99], [1, 1, 1, 1, 1, 1, 1, 99], [5] * 9, [])
    hits = outliers.record_outliers_in_arrays(df).collect()
    # at most sqrt(n - 1) sigmas are possible, so seven values can never pass 2.5
    assert [(h.measure_point_id, h.value_index, h.value) for h in hits] == [(2, 7, 99.0)]
    assert hits[0].z_score == pytest.approx(math.sqrt(7))


def test_arrays_and_rows_agree(spark, any_split):
    rng = random.Random(7)
    arrays = [[rng.gauss(300, 5) + (60 if rng.random() < 0.05 else 0) for _ in range(30)] for _ in range(12)]
    df = records(spark, *arrays)
    flat = df.select("measure_point_id", F.posexplode("vals").alias("value_index", "value"))
    one = outliers.record_outliers_in_arrays(df)
    two = outliers.record_outliers(flat, ["measure_point_id"])
    key = lambda rows: sorted((r.measure_point_id, r.value_index, round(r.z_score, 9)) for r in rows.collect())
    assert key(one) == key(two) and one.count() > 0


def test_hint(spark):
    df = records(spark, [1] * 9 + [99], [1, 2, 3])
    rows = {r.measure_point_id: r for r in outliers.outlier_hint(df).collect()}
    assert rows[0].outlier_hint == "测点0 存在1个离群值" and rows[0].outlier_count == 1
    assert rows[1].outlier_hint == "" and rows[1].outliers == []


def test_history_z(spark, any_split):
    rng = random.Random(8)
    xs = [rng.gauss(50, 3) for _ in range(40)]
    rows = outliers.rolling_history_z(stream(spark, xs), ["key"], ["seq"], window=12, min_history=5)
    for r in rows.collect():
        past = xs[max(0, r.seq - 12):r.seq]
        assert r.history_n == len(past)
        if len(past) >= 5:
            mean = sum(past) / len(past)
            sd = math.sqrt(sum((p - mean) ** 2 for p in past) / len(past))
            assert r.z_score == pytest.approx(abs(r.value - mean) / sd)
        else:
            assert r.z_score is None
    assert rows.count() == 40
