"""Uploads, stored records, and their queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gaugeline.catalog.common import flagged, latest_time, rounded, scratch, text_times, tm
from gaugeline.catalog.registry import query
from gaugeline.functions.scalars import leading_int
from gaugeline.operators import outliers, records as rec
from gaugeline.sources import fixtures as fx, tables, uploads

# Uploads that are whole; see fixtures.uploads.
SOUND = "measure_point_id % 7 <> 0 AND measure_point_id % 11 <> 0 AND measure_point_id % 13 <> 0"


@query("upload_parse", f"""
    SELECT measure_point_id, dev_code, {tm('start_time')},
           data_type, value_index, value
    FROM (SELECT *, CASE WHEN measure_point_id % 17 <> 0 THEN min(record_time) OVER (
                        PARTITION BY measure_point_id, strftime(record_time, '%Y%m')) END AS start_time
          FROM readings)
    WHERE {SOUND}""", ("readings",))
def upload_parse(spark, sf_dir):
    parsed = uploads.upload_parse(fx.uploads(spark, sf_dir))
    items = uploads.upload_items(parsed).select(
        leading_int(F.col("id")).alias("measure_point_id"), "dev_code",
        F.col("record_time").alias("start_time"), "data_type", "vals")
    return text_times(rec.readings_explode(items), "start_time")


@query("batch_upload_report", f"""
    SELECT gateway_code AS batch_id, count(*) AS total_count,
           count(*) FILTER ({SOUND}) AS success_count,
           count(*) FILTER (NOT ({SOUND})) AS failed_count
    FROM (SELECT DISTINCT gateway_code, measure_point_id, strftime(record_time, '%Y%m') FROM readings)
    GROUP BY gateway_code""", ("readings",))
def batch_upload_report(spark, sf_dir):
    return uploads.batch_upload_report(uploads.upload_parse(fx.uploads(spark, sf_dir)), "batch_id")


@query("batch_upload_failed", f"""
    SELECT DISTINCT gateway_code AS batch_id,
           concat(measure_point_id, '_', strftime(record_time, '%Y%m')) AS record_id, 'invalid request' AS error
    FROM readings WHERE NOT ({SOUND})""", ("readings",))
def batch_upload_failed(spark, sf_dir):
    parsed = uploads.upload_parse(fx.uploads(spark, sf_dir))
    return uploads.failed_uploads(parsed, "batch_id", "upload_id")


@query("record_write", f"""
    SELECT record_id, project_id, gateway_code, data_type, {tm('record_time')}, factor, n_vals
    FROM records""", ("records",))
def record_write(spark, sf_dir):
    """Records written to the month-partitioned table and read back."""
    path = scratch(spark, "detect_data")
    tables.write_table(fx.records(spark, sf_dir), path, "detect_data")
    back = tables.read_table(spark, path, "record_time")
    return text_times(back.select(
        "record_id", "project_id", "gateway_code", "data_type", "record_time", "factor",
        F.size("vals").cast("bigint").alias("n_vals")), "record_time")


@query("retention_filter", f"""
    SELECT event_id, record_id, {tm('value_time')}, value FROM stream_rows
    WHERE value_time >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY""", ("stream_rows",))
def retention_filter(spark, sf_dir):
    """What is left of a stored month table at the newest time; older months are not opened."""
    path = scratch(spark, "detect_data")
    rows = fx.reading_stream(spark, sf_dir).withColumn("record_time", F.col("value_time"))
    tables.write_table(rows, path, "detect_data")
    kept = tables.retained(spark, path, "record_time", latest_time(spark, sf_dir), timedelta(days=14))
    return text_times(kept.select("event_id", "record_id", "value_time", "value"), "value_time")


@query("inline_source", """
    SELECT concat('job-', vec_id // 64) AS job_id, CAST(vec_id % 64 AS int) AS id,
           CAST(embedding[1] AS double) AS first_x, CAST(embedding[64] AS double) AS last_x, label
    FROM embeddings""")
def inline_source(spark, sf_dir):
    """Job requests of 64 vectors each as JSON text, read back as feature rows."""
    vectors = fx.features(spark, sf_dir).withColumn("job", F.floor(F.col("id") / 64))
    rows = F.array_sort(F.collect_list(F.struct("id", "features", "label")))
    bodies = vectors.groupBy("job").agg(rows.alias("r")).select(F.to_json(F.struct(
        F.concat(F.lit("job-"), "job").alias("id"), F.lit("kmeans").alias("algorithm"),
        F.col("r.features").alias("data"), F.col("r.label").alias("labels"))).alias("body"))
    return uploads.inline_source(bodies).select(
        "job_id", "id", F.col("features")[0].alias("first_x"),
        F.col("features")[63].alias("last_x"), "label")


@query("table_source", """
    SELECT o_orderkey AS id, o_totalprice AS x, CAST(o_custkey AS double) AS y FROM orders
    WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL""")
def table_source(spark, sf_dir):
    df = uploads.table_source(fx.table(spark, sf_dir, "orders"), "o_orderkey",
                              ["o_totalprice", "o_custkey"])
    return df.select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))


@query("latest_by_key", f"""
    SELECT dev_code, event_type, event_id, {tm('ts')}, k FROM (
        SELECT *, row_number() OVER (PARTITION BY dev_code, event_type ORDER BY ts DESC, event_id DESC)
                  AS r FROM heartbeats) WHERE r = 1""", ("heartbeats",))
def latest_by_key(spark, sf_dir):
    beats = fx.heartbeats(spark, sf_dir).select(
        "dev_code", "event_type", "event_id", "ts", F.col("reported")["k"].alias("k"))
    return text_times(tables.latest_by_key(beats, ["dev_code", "event_type"], "ts", "event_id"), "ts")


@query("record_query", f"""
    SELECT record_id, project_id, gateway_code, dev_code, data_type, {tm('record_time')}, factor
    FROM records, (SELECT max(ts) AS m FROM events)
    WHERE project_id = 1 AND data_type = 2
      AND record_time >= m - INTERVAL 30 DAY AND record_time <= m - INTERVAL 20 DAY""", ("records",))
def record_query(spark, sf_dir):
    """A filter over the stored record table: months are pruned, the rest is pushed to the scan."""
    path = scratch(spark, "detect_data")
    tables.write_table(fx.records(spark, sf_dir), path, "detect_data")
    end = latest_time(spark, sf_dir)
    start, end = end - timedelta(days=30), end - timedelta(days=20)
    stored = tables.read_table(spark, path, "record_time", start, end)
    df = rec.record_query(stored, project_id=1, data_type=2, start=start, end=end)
    return text_times(df.select("record_id", "project_id", "gateway_code", "dev_code", "data_type",
                                "record_time", "factor"), "record_time")


@query("record_query_device", f"""
    SELECT record_id, project_id, gateway_code, dev_code, data_type, {tm('record_time')}, factor
    FROM records WHERE gateway_code = 'GW-00000003' AND dev_code = 'SN-00000002'""", ("records",))
def record_query_device(spark, sf_dir):
    """The records of one device of one gateway."""
    df = rec.record_query(fx.records(spark, sf_dir), gateway_code="GW-00000003", dev_code="SN-00000002")
    return text_times(df.select("record_id", "project_id", "gateway_code", "dev_code", "data_type",
                                "record_time", "factor"), "record_time")


@query("record_page", f"""
    SELECT record_id, dev_code, {tm('record_time')}, factor, count(*) OVER () AS total
    FROM records ORDER BY records.record_time DESC, record_id LIMIT 20 OFFSET 20""", ("records",))
def record_page(spark, sf_dir):
    df = fx.records(spark, sf_dir).select("record_id", "dev_code", "record_time", "factor")
    return text_times(rec.page_of(df, "record_time", "record_id", page=2), "record_time")


@query("readings_explode", """
    SELECT record_id, data_type, value_index, value FROM readings""", ("readings",))
def readings_explode(spark, sf_dir):
    df = fx.records(spark, sf_dir).select("record_id", "data_type", "vals")
    return rec.readings_explode(df)


@query("values_by_type", f"""
    SELECT {tm('record_time')}, record_id, value_index, value
    FROM readings WHERE data_type = 3""", ("readings",))
def values_by_type(spark, sf_dir):
    return text_times(rec.values_by_type(fx.records(spark, sf_dir), 3), "record_time")


@query("quality_grade", """
    SELECT record_id, count(*) AS n_values, count(*) FILTER (is_outlier) AS outliers,
           CASE WHEN count(*) FILTER (is_outlier) > 0 THEN 'C' ELSE 'A' END AS quality_grade,
           CASE WHEN count(*) FILTER (is_outlier) / count(*) <= 0.02 THEN 'A'
                WHEN count(*) FILTER (is_outlier) / count(*) <= 0.06 THEN 'B'
                WHEN count(*) FILTER (is_outlier) / count(*) <= 0.1 THEN 'C' ELSE 'D' END AS band_grade
    FROM flagged GROUP BY record_id""", ("flagged",))
def quality_grade(spark, sf_dir):
    counts = flagged(spark, sf_dir).groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if("is_outlier").alias("outliers"))
    return counts.withColumns({
        "quality_grade": rec.quality_grade(F.col("outliers")),
        "band_grade": rec.quality_grade(F.col("outliers"), F.col("n_values"), (0.02, 0.06, 0.1))})


@query("record_outliers", """
    SELECT record_id, data_type, value_index, value, round(expected_mean, 6) AS expected_mean,
           round(expected_std, 6) AS expected_std, round(z_score, 6) AS z_score
    FROM flagged WHERE is_outlier""", ("flagged",))
def record_outliers(spark, sf_dir):
    rows = outliers.record_outliers(fx.readings(spark, sf_dir), ["record_id"])
    return rounded(rows.select("record_id", "data_type", "value_index", "value", "expected_mean",
                               "expected_std", "z_score"),
                   "expected_mean", "expected_std", "z_score")


BATCH_STATS = """
    SELECT *, count(*) OVER g AS n, avg(value) OVER g AS m, stddev_pop(value) OVER g AS s
    FROM readings WINDOW g AS (PARTITION BY record_id)"""


@query("record_outliers_in_arrays", f"""
    SELECT record_id, data_type, value_index, value, round(m, 6) AS expected_mean,
           round(s, 6) AS expected_std, round((value - m) / s, 6) AS z_score
    FROM ({BATCH_STATS}) WHERE n >= 5 AND s >= 0.01 AND abs((value - m) / s) > 2.5""",
       ("readings",))
def record_outliers_in_arrays(spark, sf_dir):
    rows = outliers.record_outliers_in_arrays(
        fx.records(spark, sf_dir).select("record_id", "data_type", "vals"))
    return rounded(rows, "expected_mean", "expected_std", "z_score")


@query("outlier_hint", f"""
    SELECT record_id, CAST(count(*) FILTER (hit) AS int) AS outlier_count,
           coalesce(string_agg(concat(value_index, ':', CAST(round((value - m) / nullif(s, 0) * 10000) AS bigint)), ','
                               ORDER BY value_index) FILTER (hit), '') AS details,
           CASE WHEN count(*) FILTER (hit) > 0
                THEN concat('测点', any_value(measure_point_id), ' 存在', count(*) FILTER (hit), '个离群值')
                ELSE '' END AS outlier_hint
    FROM (SELECT *, n >= 5 AND s >= 0.01 AND abs((value - m) / nullif(s, 0)) > 2.5 AS hit
          FROM ({BATCH_STATS}))
    GROUP BY record_id""", ("readings",))
def outlier_hint(spark, sf_dir):
    details = F.transform("outliers", lambda d: F.concat_ws(
        ":", d["value_index"], F.round(d["z_score"] * 10000).cast("bigint")))
    return outliers.outlier_hint(fx.records(spark, sf_dir)).select(
        "record_id", "outlier_count", F.array_join(details, ",").alias("details"), "outlier_hint")


@query("anomaly_sink", f"""
    SELECT {tm('record_time')}, gateway_code, dev_code, measure_point_id, data_type, value_index, value,
           round(expected_mean, 6) AS expected_mean, round(expected_std, 6) AS expected_std,
           round(z_score, 6) AS z_score, 'z_score' AS anomaly_type, 0 AS handled
    FROM flagged WHERE is_outlier""", ("flagged",))
def anomaly_sink(spark, sf_dir):
    """Anomalies written to their table and read back as far as they are retained, six months."""
    path = scratch(spark, "anomaly_record")
    found = outliers.record_outliers(fx.readings(spark, sf_dir), ["record_id"])
    tables.write_table(tables.anomalies(found, "z_score"), path, "anomaly_record")
    back = tables.retained(spark, path, "record_time", latest_time(spark, sf_dir), tables.ANOMALY_RETENTION)
    return text_times(rounded(back, "expected_mean", "expected_std", "z_score"), "record_time")


@query("scalar_functions", """
    SELECT event_id, event_id AS parsed_id, CAST(json_extract_string(props, '$.k') AS bigint) AS k,
           strftime(ts, '%Y%m') AS month, concat(user_id, '|', event_type) AS joined
    FROM events""")
def scalar_functions(spark, sf_dir):
    """Text and date helpers over every event: id parsing, list splitting, month, json."""
    from gaugeline.functions import scalars
    raw = fx.events(spark, sf_dir)
    parts = scalars.split_list(F.concat(F.lit(" "), F.col("user_id"), F.lit(" ,, "),
                                        F.col("event_type")))
    return raw.select(
        "event_id",
        leading_int(F.concat(F.col("event_id").cast("string"), F.lit("-x"))).alias("parsed_id"),
        leading_int(F.get_json_object("props", "$.k")).alias("k"),
        scalars.month(F.col("ts")).alias("month"),
        F.array_join(parts, "|").alias("joined"))
