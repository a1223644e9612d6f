"""Group z-scores, running CF baselines, alert runs, and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog.common import ORDER, detections, rounded, text_times, tm
from gaugeline.catalog.registry import define, query
from gaugeline.operators import cf, outliers, reports
from gaugeline.sources import fixtures as fx

define("placed", """
    SELECT *, row_number() OVER (PARTITION BY gateway_code, data_type ORDER BY value_time, event_id) - 1 AS position,
           CAST(floor(cents / 2000) AS bigint) AS cell
    FROM stream_rows""", "stream_rows")
define("baselines", """
    SELECT r.event_id, r.cents, r.position, e.cell AS nearest_cell, count(*) AS n,
           sum(e.cents) AS ls, sum(e.cents * e.cents) AS ss
    FROM placed r JOIN placed e ON e.gateway_code = r.gateway_code AND e.data_type = r.data_type
                                    AND e.position < r.position
    GROUP BY ALL HAVING count(*) >= 5""", "placed")
define("nearest", """
    SELECT * FROM (
        SELECT event_id, nearest_cell, abs(cents - ls / n) AS distance,
               abs(cents - ls / n) / greatest(sqrt(greatest(ss / n - (ls / n) * (ls / n), 0)),
                                              CASE WHEN position < 10 THEN 10.0 ELSE 1.0 END) AS z_score,
               row_number() OVER (PARTITION BY event_id ORDER BY abs(cents - ls / n), nearest_cell) AS r
        FROM baselines) WHERE r = 1""", "baselines")
define("scored", """
    SELECT p.*, nearest_cell, distance, z_score, coalesce(z_score > 3.0, false) AS is_outlier
    FROM placed p LEFT JOIN nearest USING (event_id)""", "placed", "nearest")
define("islands", """
    SELECT *, sum(CASE WHEN is_outlier THEN 0 ELSE 1 END)
                  OVER (PARTITION BY gateway_code, data_type ORDER BY position) AS island
    FROM scored""", "scored")
define("detections", """
    SELECT *, CASE WHEN is_outlier THEN CAST(sum(CASE WHEN is_outlier THEN 1 ELSE 0 END)
                  OVER (PARTITION BY gateway_code, data_type, island ORDER BY position) AS bigint) ELSE 0 END AS streak
    FROM islands""", "islands")


@query("zscore_in_group", """
    SELECT event_id, n_values, round(expected_mean, 6) AS expected_mean,
           round(expected_std, 6) AS expected_std, round(z_score, 6) AS z_score
    FROM flagged""", ("flagged",))
def zscore_in_group(spark, sf_dir):
    rows = outliers.zscore_in_group(fx.reading_stream(spark, sf_dir), ["record_id"])
    return rounded(rows.select("event_id", "n_values", "expected_mean", "expected_std", "z_score"),
                   "expected_mean", "expected_std", "z_score")


@query("cf_online_outlier", """
    SELECT event_id, record_id, position, cell, coalesce(nearest_cell, -1) AS nearest_cell, round(distance, 6) AS distance,
           round(z_score, 6) AS z_score, is_outlier
    FROM scored""", ("scored",))
def cf_online_outlier(spark, sf_dir):
    rows = detections(spark, sf_dir).select("event_id", "record_id", "position", "cell",
                                            "nearest_cell", "distance", "z_score", "is_outlier")
    return rounded(rows, "distance", "z_score").withColumn(
        "nearest_cell", F.coalesce("nearest_cell", F.lit(-1)))


@query("consecutive_alerts", """
    SELECT event_id, is_outlier, streak, streak >= 3 AS alert,
           CASE WHEN streak >= 3 THEN 'flag' WHEN is_outlier THEN 'reject' ELSE 'accept' END AS suggestion
    FROM detections""", ("detections",))
def consecutive_alerts(spark, sf_dir):
    return detections(spark, sf_dir).select("event_id", "is_outlier", "streak", "alert", "suggestion")


@query("rolling_history_z", """
    SELECT event_id, history_n, round(history_mean, 6) AS history_mean,
           round(abs(cents - history_mean) / s, 6) AS z_score,
           coalesce(abs(cents - history_mean) / s > 3.0, false) AS is_outlier
    FROM (SELECT *, CASE WHEN history_n >= 10 AND history_std > 0 THEN history_std END AS s FROM (
        SELECT *, count(*) OVER h AS history_n, avg(cents) OVER h AS history_mean,
               stddev_pop(cents) OVER h AS history_std
        FROM stream_rows WINDOW h AS (PARTITION BY gateway_code, data_type ORDER BY value_time, event_id
                                      ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)))""",
       ("stream_rows",))
def rolling_history_z(spark, sf_dir):
    rows = outliers.rolling_history_z(fx.reading_stream(spark, sf_dir),
                                      ["gateway_code", "data_type"], ORDER, "cents")
    return rounded(rows.select("event_id", "history_n", "history_mean", "z_score", "is_outlier"),
                   "history_mean", "z_score")


@query("detection_summary", """
    SELECT gateway_code, count(*) AS total_detections, count(*) FILTER (is_outlier) AS total_outliers,
           count(*) FILTER (is_outlier) / count(*) AS outlier_rate,
           count(*) FILTER (streak >= 3) AS total_alerts,
           arg_max(streak, event_id) AS consecutive_outliers
    FROM detections GROUP BY gateway_code""", ("detections",))
def detection_summary(spark, sf_dir):
    return outliers.detection_summary(detections(spark, sf_dir), ["gateway_code"], "event_id")


@query("recent_alerts", f"""
    SELECT event_id, record_id, {tm('value_time')}, streak, cents FROM detections WHERE streak >= 3
    ORDER BY detections.value_time DESC, event_id DESC LIMIT 10""", ("detections",))
def recent_alerts(spark, sf_dir):
    rows = outliers.recent_alerts(detections(spark, sf_dir), ["value_time", "event_id"])
    return text_times(rows.select("event_id", "record_id", "value_time", "streak", "cents"),
                      "value_time")


@query("gateway_rollup", """
    WITH leaves AS (SELECT DISTINCT gateway_code, data_type, cell FROM detections),
    v AS (SELECT gateway_code, data_type, grouping_id(gateway_code, data_type) AS level,
                 count(*) AS total_values, count(*) FILTER (is_outlier) AS outliers,
                 count(*) FILTER (streak >= 3) AS alerts
          FROM detections GROUP BY ROLLUP (gateway_code, data_type)),
    c AS (SELECT gateway_code, data_type, grouping_id(gateway_code, data_type) AS level,
                 count(*) AS clusters FROM leaves GROUP BY ROLLUP (gateway_code, data_type))
    SELECT coalesce(v.gateway_code, 'all') AS gateway_code, coalesce(v.data_type, 0) AS data_type,
           v.level, total_values, outliers, alerts, clusters
    FROM v JOIN c ON v.gateway_code IS NOT DISTINCT FROM c.gateway_code
      AND v.data_type IS NOT DISTINCT FROM c.data_type AND v.level = c.level""", ("detections",))
def gateway_rollup(spark, sf_dir):
    rows = fx.reading_stream(spark, sf_dir)
    leaves = cf.cf_leaves(rows, ["gateway_code", "data_type"], "cents", threshold=1000.0)
    return reports.gateway_rollup(detections(spark, sf_dir), leaves).withColumns({
        "gateway_code": F.coalesce("gateway_code", F.lit("all")),
        "data_type": F.coalesce("data_type", F.lit(0))})


@query("telemetry_rollup", """
    SELECT gateway_code, CAST(sum(n) AS bigint) AS total_points, CAST(sum(o) AS bigint) AS total_outliers,
           max(n) AS max_points, round(avg(n), 6) AS avg_points
    FROM (SELECT gateway_code, measure_point_id, count(*) AS n, count(*) FILTER (is_outlier) AS o
          FROM detections GROUP BY ALL) GROUP BY gateway_code""", ("detections",))
def telemetry_rollup(spark, sf_dir):
    points = detections(spark, sf_dir).groupBy("gateway_code", "measure_point_id").agg(
        F.count(F.lit(1)).alias("total_points"), F.count_if("is_outlier").alias("total_outliers"))
    return rounded(reports.telemetry_rollup(points), "avg_points")
