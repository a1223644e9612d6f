"""Streams equal their batch twins; repeats and late rows change nothing."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import outliers
from gaugeline.streaming import jobs, sources

START = datetime(2024, 1, 1)


def rows(xs, start=0):
    return [("m", start + i, START + timedelta(minutes=start + i), float(x)) for i, x in enumerate(xs)]


SCHEMA = "key string, id bigint, ts timestamp, value double"


def detector(spark, folder, **settings):
    return jobs.OnlineDetector(spark, str(folder), ["key"], "ts", "id", "value", min_baseline=3,
                               threshold=2.0, **settings)


def batch_answer(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    scored = outliers.cf_online_outlier(df, ["key"], ["ts", "id"], "value", min_baseline=3, threshold=2.0)
    out = outliers.consecutive_alerts(scored, ["key"], ["ts", "id"])
    return sorted((r.id, r.position, r.is_outlier, r.streak, r.suggestion) for r in out.collect())


XS = [5, 5, 6, 5, 5, 6, 5, 5, 6, 5, 5, 6, 40, 40, 5, 40, 40, 40, 5, 90]


def test_state_carries_over_batches(spark, tmp_path):
    data = rows(XS)
    d = detector(spark, tmp_path)
    for b, (lo, hi) in enumerate([(0, 7), (7, 14), (14, 20)]):
        d(spark.createDataFrame(data[lo:hi], SCHEMA), b)
    got = sorted((r.id, r.position, r.is_outlier, r.streak, r.suggestion) for r in d.flags().collect())
    assert got == batch_answer(spark, data)


def test_state_is_summed_up_now_and_then(spark, tmp_path):
    data = rows(XS)
    d = detector(spark, tmp_path, compact_every=2)
    for b, (lo, hi) in enumerate([(0, 4), (4, 9), (9, 13), (13, 16), (16, 20)]):
        d(spark.createDataFrame(data[lo:hi], SCHEMA), b)
    got = sorted((r.id, r.position, r.is_outlier, r.streak, r.suggestion) for r in d.flags().collect())
    assert got == batch_answer(spark, data)


def test_repeated_batch_changes_nothing(spark, tmp_path):
    data = rows(XS)
    d = detector(spark, tmp_path)
    d(spark.createDataFrame(data[:14], SCHEMA), 0)
    for _ in range(2):
        d(spark.createDataFrame(data[14:], SCHEMA), 1)
    got = sorted((r.id, r.position, r.is_outlier, r.streak, r.suggestion) for r in d.flags().collect())
    assert got == batch_answer(spark, data)


def test_late_rows_are_marked_and_not_absorbed(spark, tmp_path):
    data = rows(XS)
    d = detector(spark, tmp_path)
    d(spark.createDataFrame(data[:14], SCHEMA), 0)
    late = [("m", 500, START, 77.0)]
    d(spark.createDataFrame(data[14:] + late, SCHEMA), 1)
    flags = d.flags().collect()
    assert [r.id for r in flags if r.late] == [500]
    got = sorted((r.id, r.position, r.is_outlier, r.streak, r.suggestion) for r in flags if not r.late)
    assert got == batch_answer(spark, data)


def test_detector_runs_as_a_stream(spark, tmp_path):
    data = rows(XS)
    folder = f"{tmp_path}/in"
    d = detector(spark, tmp_path / "out")
    for lo, hi in [(0, 9), (9, 20)]:
        spark.createDataFrame(data[lo:hi], SCHEMA).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        jobs.run_available(stream, d, f"{tmp_path}/checkpoint")
    got = sorted((r.id, r.position, r.is_outlier, r.streak, r.suggestion) for r in d.flags().collect())
    assert got == batch_answer(spark, data)


def run(spark, tmp_path, data, schema, build, mode="append"):
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/in")
    out = build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    found = []
    jobs.run_available(out, lambda b, i: found.extend(b.collect()), f"{tmp_path}/checkpoint", mode)
    return found


def test_liveness_keeps_the_exact_limit(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    beats = [("d", at(0)), ("d", at(300)), ("d", at(601)), ("d", at(99_999))]
    got = run(spark, tmp_path, beats, "dev_code string, ts timestamp", jobs.device_liveness)
    assert [(r.online_at, r.last_seen, r.heartbeats) for r in sorted(got)] == [
        (at(0), at(300), 2), (at(601), at(601), 1)]


def test_dedup(spark, tmp_path):
    data = rows([1, 2, 3]) + rows([1, 2, 3])
    got = run(spark, tmp_path, data, SCHEMA, lambda s: jobs.dedup(s, ["id"], "ts"))
    assert sorted(r.id for r in got) == [0, 1, 2]


def test_sliding_trend(spark, tmp_path):
    data = rows([10.0] * 30) + [("m", 99, START + timedelta(hours=9), 0.0)]
    got = run(spark, tmp_path, data, SCHEMA, lambda s: jobs.trend(
        s.withColumn("is_outlier", F.lit(False)), "ts", "20 minutes", "10 minutes"))
    counts = {r.bucket: r.detection_count for r in got}
    assert counts[START] == 20 and counts[START + timedelta(minutes=20)] == 10


def test_message_families(spark):
    df = spark.createDataFrame([
        ("devices/GW-00000001/shadow/reported", '{"state":{"reported":{"a":"1"}}}', START),
        ("devices/GW-00000001/telemetry", '{"cpu":{"usage_percent":12.5}}', START),
        ("devices/GW-00000001/commands", "{}", START)], sources.MESSAGE)
    named = [(r.device_code, r.family) for r in sources.with_family(df).collect()]
    assert named == [("GW-00000001", "shadow_reported"), ("GW-00000001", "telemetry"), ("GW-00000001", None)]
    assert sources.family_of(df, "telemetry").first().message.cpu.usage_percent == 12.5
    with pytest.raises(ValueError):
        sources.family_of(df, "unknown")
