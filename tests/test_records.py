"""Uploads, stored tables, record queries, devices, reports."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import scalars
from gaugeline.operators import devices as dev, records as rec, reports
from gaugeline.sources import tables, uploads

NOW = datetime(2024, 3, 1, 12, 0, 0)



def body(**fields):
    base = {"id": "7", "dev_code": "SN-00000007", "record_time": "2024-03-01T10:00:00Z",
            "data_list": [{"type": 1, "vals": [1.5, 2.5]}, {"type": 2, "vals": [3.0]}]}
    return json.dumps({**base, **fields})


def test_upload_parsing_and_report(spark):
    raw = spark.createDataFrame([("b", "1", body()), ("b", "2", body()[:-5]), ("b", "3", "{}"),
                                 ("c", "4", body(factor=0.5))], "batch string, no string, body string")
    parsed = uploads.upload_parse(raw)
    report = {r.batch: (r.total_count, r.success_count, r.failed_count)
              for r in uploads.batch_upload_report(parsed, "batch").collect()}
    assert report == {"b": (3, 1, 2), "c": (1, 1, 0)}
    assert {r.record_id for r in uploads.failed_uploads(parsed, "batch", "no").collect()} == {"2", "3"}
    items = uploads.upload_items(parsed).filter("batch = 'c'").orderBy("data_type").collect()
    assert [(r.data_type, r.vals) for r in items] == [(1, [1.5, 2.5]), (2, [3.0])]
    assert items[0].record_time == datetime(2024, 3, 1, 10) and items[0].factor == 0.5


def test_upload_files(spark, tmp_path):
    (tmp_path / "u.json").write_text(body() + "\nnot json\n")
    df = uploads.read_uploads(spark, str(tmp_path))
    ids = [r.id for r in df.select("id", "_corrupt").collect() if r._corrupt is None]
    assert ids == ["7"]


def test_inline_and_table_sources(spark):
    req = json.dumps({"id": "j", "algorithm": "kmeans", "data": [[1, 2], [3, 4]], "labels": [5, 6]})
    no_labels = json.dumps({"id": "k", "algorithm": "dbscan", "data": [[9]]})
    df = uploads.inline_source(spark.createDataFrame([(req,), (no_labels,)], "body string"))
    assert sorted((r.job_id, r.id, r.features, r.label) for r in df.collect() if r.job_id == "j") == [
        ("j", 0, [1.0, 2.0], 5), ("j", 1, [3.0, 4.0], 6)]
    assert [r.label for r in df.collect() if r.job_id == "k"] == [None]
    table = spark.createDataFrame([(1, 2.0, 3), (2, None, 4)], "k int, a double, b int")
    assert uploads.table_source(table, "k", ["a", "b"]).collect() == [(1, [2.0, 3.0])]


def stored(spark):
    rows = [(f"r{i}", i % 2, "GW-1", f"SN-{i % 3}", i % 4 + 1, NOW - timedelta(days=20 * i)) for i in range(12)]
    return spark.createDataFrame(
        rows, "record_id string, project_id int, gateway_code string, dev_code string, data_type int, "
              "record_time timestamp")


def test_month_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(stored(spark), path, "detect_data")
    end, start = NOW, NOW - timedelta(days=45)
    df = tables.read_table(spark, path, "record_time", start, end)
    assert {r.record_id for r in df.collect()} == {"r0", "r1", "r2"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ym" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert tables.read_table(spark, path, "record_time").count() == 12


def test_retention_keeps_the_edge(spark):
    df = spark.createDataFrame([(NOW - timedelta(days=367),), (datetime(2023, 3, 1, 12),), (NOW,)], "t timestamp")
    assert tables.retention_filter(df, "t", F.lit(NOW)).count() == 2


def test_latest_by_key(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("a", 2, 7), ("b", 1, 8)], "k string, t int, v int")
    assert sorted(tables.latest_by_key(df, ["k"], "t").collect()) == [("a", 3, 6), ("b", 1, 8)]


def test_record_filters(spark):
    df = stored(spark)
    assert rec.record_query(df).count() == 12
    got = rec.record_query(df, project_id=0, dev_code="SN-0", start=NOW - timedelta(days=120), end=NOW)
    assert {r.record_id for r in got.collect()} == {"r0", "r6"}


@pytest.mark.parametrize("page, size, want", [(1, 5, ["r0", "r1", "r2", "r3", "r4"]), (3, 5, ["r10", "r11"]),
                                              (0, 0, [f"r{i}" for i in range(12)]), (9, 5, [])])
def test_pages(spark, page, size, want):
    rows = rec.page_of(stored(spark), "record_time", "record_id", page, size).collect()
    assert [r.record_id for r in rows] == want and all(r.total == 12 for r in rows)


def test_grades(spark):
    df = spark.createDataFrame([(0, 10), (1, 100), (1, 20), (1, 4), (0, 0)], "o int, n int")
    rows = df.select(rec.quality_grade(F.col("o")).alias("g"),
                     rec.quality_grade(F.col("o"), F.col("n"), (0.01, 0.05, 0.2)).alias("b")).collect()
    assert [(r.g, r.b) for r in rows] == [("A", "A"), ("C", "A"), ("C", "B"), ("C", "D"), ("A", "A")]


def test_scalars(spark):
    df = spark.createDataFrame([("12ab",), (" -7",), ("x",), ("",), (None,), ("9" * 30,)], "t string")
    assert [r[0] for r in df.select(scalars.leading_int(F.col("t"))).collect()] == [12, -7, 0, 0, 0, 0]
    one = spark.range(1)
    assert one.select(scalars.split_list(F.lit(" a, ,b "))).first()[0] == ["a", "b"]
    assert one.select(scalars.ratio(F.lit(1), F.lit(0))).first()[0] == 0.0
    merged = scalars.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")),
                                F.create_map(F.lit("b"), F.lit("3")))
    assert one.select(merged).first()[0] == {"a": "1", "b": "3"}


def test_device_codes(spark):
    df = spark.createDataFrame([("GW-00000001", "", ""), ("XY-00000002", None, None),
                                ("SN-00000003", "ED", "mine"), ("gw-1", "", "")],
                               "dev_code string, type string, name string")
    rows = {r.dev_code: (r.valid, r.type, r.name) for r in dev.device_code_check(df).collect()}
    assert rows["GW-00000001"] == (True, "GW", "网关-00000001")
    assert rows["XY-00000002"] == (True, "XY", "XY-00000002")
    assert rows["SN-00000003"] == (True, "ED", "mine")
    assert rows["gw-1"][0] is False


def device_rows(spark):
    return spark.createDataFrame([
        ("a", "SN", 1, NOW - timedelta(minutes=5), NOW - timedelta(days=3)),
        ("b", "SN", 2, NOW - timedelta(minutes=5, seconds=1), NOW - timedelta(days=1)),
        ("c", "ED", 1, None, NOW - timedelta(days=2))],
        "dev_code string, type string, project_id int, last_seen timestamp, created_at timestamp")


def test_online_edge_and_list(spark):
    df = device_rows(spark)
    status = {r.dev_code: r.status for r in dev.device_status(df, F.lit(NOW)).collect()}
    assert status == {"a": "online", "b": "offline", "c": "offline"}
    assert [r.dev_code for r in dev.device_list(df, F.lit(NOW)).collect()] == ["b", "c", "a"]
    assert [r.dev_code for r in dev.device_list(df, F.lit(NOW), status="offline", project_id=1).collect()] == ["c"]
    assert dev.device_online_stats(df, F.lit(NOW)).first() == (3, 1, 2)


def beats(spark):
    at = lambda m: NOW + timedelta(minutes=m)
    return spark.createDataFrame([
        (1, "a", at(0), "1.1.1.1", "v1", {"x": "1", "y": "1"}), (2, "a", at(1), "", "", {"x": "2"}),
        (3, "a", at(2), "2.2.2.2", "", {"x": "3"}), (4, "b", at(0), "", "", {"z": "1"})],
        "event_id bigint, dev_code string, ts timestamp, ip string, version string, "
        "reported map<string,string>")


def test_latest_heartbeat_keeps_filled_fields(spark):
    rows = {r.dev_code: r for r in dev.device_latest(beats(spark)).collect()}
    assert (rows["a"].ip, rows["a"].version, rows["a"].last_seen) == ("2.2.2.2", "v1", NOW + timedelta(minutes=2))
    assert (rows["b"].ip, rows["b"].version) == (None, None)


def test_shadows(spark, any_split):
    state = {r.dev_code: r for r in dev.shadow_state(beats(spark), "ts", "event_id").collect()}
    assert state["a"].reported == {"x": "3"} and state["a"].version == 4
    merged = {r.dev_code: r for r in dev.shadow_state(beats(spark), "ts", "event_id", "merge").collect()}
    assert merged["a"].reported == {"x": "3", "y": "1"}
    versions = {r.event_id: r.version for r in dev.shadow_version(beats(spark), ["ts", "event_id"]).collect()}
    assert versions == {1: 2, 2: 3, 3: 4, 4: 2}
    with pytest.raises(ValueError):
        dev.shadow_state(beats(spark), "ts", "event_id", "other")


def test_shadow_sync(spark):
    df = spark.createDataFrame([
        ({"a": "1", "b": "2"}, {"b": "2", "a": "1"}), ({"a": "1"}, {"a": "2", "c": "3"}), (None, None),
        ({"a": "1", "x": "9"}, {"a": "1"})], "reported map<string,string>, desired map<string,string>")
    rows = dev.shadow_sync(df).collect()
    assert [r.need_sync for r in rows] == [False, True, False, True]
    assert [r.delta for r in rows] == [{}, {"a": "2", "c": "3"}, {}, {}]


def test_patch_and_lookups(spark):
    df = spark.createDataFrame([("a", "n", "SN", 1, "i", "v"), ("b", "m", "SN", 1, "i", "v")],
                               "dev_code string, name string, type string, project_id int, ip string, version string")
    patch = spark.createDataFrame([("a", "new", None, None, None, "2")], df.schema)
    rows = {r.dev_code: (r.name, r.ip, r.version) for r in dev.device_patch(df, patch).collect()}
    assert rows == {"a": ("new", "i", "2"), "b": ("m", "i", "v")}
    asked = spark.createDataFrame([("a",), ("z",)], "dev_code string")
    assert dev.unknown_devices(asked, df).collect() == [("z",)]
    assert dev.existing_devices(asked, df).collect() == [("a",)]


def test_liveness_spans(spark, any_split):
    at = lambda s: NOW + timedelta(seconds=s)
    df = spark.createDataFrame([(i, "d", at(s)) for i, s in enumerate((0, 300, 601, 700))],
                               "event_id bigint, dev_code string, ts timestamp")
    spans = sorted((r.online_at, r.last_seen, r.heartbeats) for r in dev.liveness_sessions(df).collect())
    assert spans == [(at(0), at(300), 2), (at(601), at(700), 2)]


def test_trend_and_shares(spark):
    df = spark.createDataFrame([(NOW, 1.0, True, 1), (NOW, 3.0, False, 2), (NOW - timedelta(days=40), 5.0, False, 1)],
                               "value_time timestamp, value double, is_outlier boolean, project_id int")
    rows = sorted((r.detection_count, r.outlier_count, r.avg_spacing)
                  for r in reports.detection_trend(df, "month").collect())
    assert rows == [(1, 0, 5.0), (2, 1, 2.0)]
    assert reports.detection_trend(df, "hour", project_id=2).count() == 1
    with pytest.raises(ValueError):
        reports.detection_trend(df, "year")
    assert sum(r.percentage for r in reports.share_by(df, ["project_id"]).collect()) == pytest.approx(100)


def test_rules(spark):
    metrics = spark.createDataFrame([("g", "m", 5.0), ("h", "m", 1.0)], "g string, metric string, metric_value double")
    rules = spark.createDataFrame([("high", "t", "m", ">", 4.0, 2, True), ("low", "t", "m", "<", 2.0, 1, True),
                                   ("off", "t", "m", ">", 0.0, 4, False)],
                                  "name string, rule_type string, metric string, op string, threshold double, "
                                  "severity int, enabled boolean")
    assert {(r.g, r.rule) for r in reports.alert_rules(metrics, rules).collect()} == {("g", "high"), ("h", "low")}
