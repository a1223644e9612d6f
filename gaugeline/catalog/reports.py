"""Reports, devices, heartbeats, shadows and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline import schema
from gaugeline.catalog.common import flagged_stream, latest_time, rounded, text_times, tm
from gaugeline.catalog.registry import define, query
from gaugeline.operators import devices as dev, records as rec, reports
from gaugeline.sources import fixtures as fx

ASOF = "(SELECT max(ts) FROM events)"
define("graded", """
    SELECT record_id, any_value(project_id) AS project_id, any_value(gateway_code) AS gateway_code,
           any_value(data_type) AS data_type, any_value(measure_point_id) AS measure_point_id,
           min(record_time) AS record_time, CAST(max(cents) AS double) AS factor,
           CASE WHEN count(*) FILTER (is_outlier) > 0 THEN 'C' ELSE 'A' END AS quality_grade
    FROM flagged GROUP BY record_id""", "flagged")


def graded(spark, sf_dir):
    """One row per record with its grade and largest value (in hundredths)."""
    head = ["project_id", "gateway_code", "data_type", "measure_point_id"]
    per = flagged_stream(spark, sf_dir).groupBy("record_id", *head).agg(
        F.min("value_time").alias("record_time"), F.max("cents").alias("factor"),
        F.count_if("is_outlier").alias("outliers"))
    return per.withColumn("quality_grade", rec.quality_grade(F.col("outliers")))


@query("device_record_stats", f"""
    SELECT project_id, gateway_code, count(*) AS total_records, {tm('min(record_time)', 'first_record')},
           {tm('max(record_time)', 'last_record')}
    FROM graded GROUP BY ALL""", ("graded",))
def device_record_stats(spark, sf_dir):
    return text_times(reports.device_record_stats(graded(spark, sf_dir)),
                      "first_record", "last_record")


@query("quality_summary", """
    SELECT project_id, quality_grade, count(*) AS count, round(avg(factor), 6) AS avg_factor
    FROM graded WHERE quality_grade <> '' GROUP BY ALL""", ("graded",))
def quality_summary(spark, sf_dir):
    return rounded(reports.quality_summary(graded(spark, sf_dir)), "avg_factor")


@query("quality_distribution", """
    SELECT gateway_code, quality_grade, n AS count,
           round(n * 100.0 / CAST(sum(n) OVER (PARTITION BY gateway_code) AS double), 6) AS percentage
    FROM (SELECT gateway_code, quality_grade, count(*) AS n FROM graded GROUP BY ALL)""", ("graded",))
def quality_distribution(spark, sf_dir):
    return rounded(reports.quality_distribution(graded(spark, sf_dir), "gateway_code"), "percentage")


@query("detection_trend", """
    SELECT strftime(date_trunc('day', value_time), '%Y-%m-%d') AS bucket, count(*) AS detection_count,
           count(*) FILTER (is_outlier) AS outlier_count, round(avg(value), 5) AS avg_spacing
    FROM flagged GROUP BY ALL""", ("flagged",))
def detection_trend(spark, sf_dir):
    rows = reports.detection_trend(flagged_stream(spark, sf_dir), "day")
    return rounded(rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd")), "avg_spacing",
                   digits=5)


@query("detection_trend_week", """
    SELECT strftime(date_trunc('week', value_time), '%Y-%m-%d') AS bucket, count(*) AS detection_count,
           count(*) FILTER (is_outlier) AS outlier_count, round(avg(value), 5) AS avg_spacing
    FROM flagged WHERE project_id = 2 GROUP BY ALL""", ("flagged",))
def detection_trend_week(spark, sf_dir):
    rows = reports.detection_trend(flagged_stream(spark, sf_dir), "week", project_id=2)
    return rounded(rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd")), "avg_spacing",
                   digits=5)


@query("detection_trend_hour", """
    SELECT strftime(date_trunc('hour', value_time), '%Y-%m-%d %H') AS bucket, count(*) AS detection_count,
           count(*) FILTER (is_outlier) AS outlier_count, round(avg(value), 9) AS avg_spacing
    FROM flagged GROUP BY ALL""", ("flagged",))
def detection_trend_hour(spark, sf_dir):
    rows = reports.detection_trend(flagged_stream(spark, sf_dir), "hour")
    return rounded(rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH")), "avg_spacing", digits=9)


@query("detection_trend_month", """
    SELECT strftime(date_trunc('month', value_time), '%Y-%m-%d') AS bucket, count(*) AS detection_count,
           count(*) FILTER (is_outlier) AS outlier_count, round(avg(value), 5) AS avg_spacing
    FROM flagged GROUP BY ALL""", ("flagged",))
def detection_trend_month(spark, sf_dir):
    rows = reports.detection_trend(flagged_stream(spark, sf_dir), "month")
    return rounded(rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd")), "avg_spacing", digits=5)


@query("device_group_stats_project", """
    SELECT project_id, type, count(*) AS count,
           round(count(*) * 100.0 / CAST(sum(count(*)) OVER (PARTITION BY project_id) AS double), 6) AS percentage
    FROM devices GROUP BY project_id, type""", ("devices",))
def device_group_stats_project(spark, sf_dir):
    """Device types within each project."""
    return rounded(reports.share_by(fx.devices(spark, sf_dir), ["project_id", "type"], ["project_id"]), "percentage")


@query("overview", f"""
    SELECT d.*, n AS detections_today, o AS outliers_today, round(o / n, 6) AS outlier_rate
    FROM (SELECT count(*) AS total_devices,
                 count(*) FILTER (last_seen >= {ASOF} - INTERVAL 5 MINUTE) AS online_devices,
                 count(*) FILTER (last_seen < {ASOF} - INTERVAL 5 MINUTE) AS offline_devices,
                 count(DISTINCT project_id) AS total_projects FROM devices) d,
         (SELECT count(*) AS n, count(*) FILTER (is_outlier) AS o FROM flagged
          WHERE value_time >= date_trunc('day', {ASOF})) t""", ("devices", "flagged"))
def overview(spark, sf_dir):
    asof = F.lit(latest_time(spark, sf_dir))
    rows = reports.overview(fx.devices(spark, sf_dir), flagged_stream(spark, sf_dir), asof,
                            dev.is_online(F.col("last_seen"), asof))
    return rounded(rows, "outlier_rate")


@query("device_group_stats", f"""
    SELECT status AS name, count(*) AS count,
           round(count(*) * 100.0 / CAST(sum(count(*)) OVER () AS double), 6) AS percentage
    FROM (SELECT CASE WHEN last_seen >= {ASOF} - INTERVAL 6 HOUR THEN 'online' ELSE 'offline' END AS status
          FROM devices) GROUP BY status""", ("devices",))
def device_group_stats(spark, sf_dir):
    asof = F.lit(latest_time(spark, sf_dir))
    df = fx.devices(spark, sf_dir).withColumn("name", F.when(
        dev.is_online(F.col("last_seen"), asof, minutes=360), "online").otherwise("offline"))
    return rounded(reports.share_by(df, ["name"]), "percentage")


@query("device_status", f"""
    SELECT dev_code, CASE WHEN last_seen >= {ASOF} - INTERVAL 5 MINUTE THEN 'online' ELSE 'offline' END
           AS status FROM devices""", ("devices",))
def device_status(spark, sf_dir):
    asof = F.lit(latest_time(spark, sf_dir))
    return dev.device_status(fx.devices(spark, sf_dir), asof).select("dev_code", "status")


@query("device_online_stats", f"""
    SELECT count(*) AS total, count(*) FILTER (last_seen >= {ASOF} - INTERVAL 5 MINUTE) AS online,
           count(*) FILTER (last_seen < {ASOF} - INTERVAL 5 MINUTE) AS offline FROM devices""", ("devices",))
def device_online_stats(spark, sf_dir):
    return dev.device_online_stats(fx.devices(spark, sf_dir), F.lit(latest_time(spark, sf_dir)))


@query("device_list", f"""
    SELECT dev_code, name, type, project_id, {tm('created_at')} FROM devices
    WHERE type = 'SN' AND last_seen < {ASOF} - INTERVAL 5 MINUTE
    ORDER BY devices.created_at DESC, dev_code LIMIT 20 OFFSET 20""", ("devices",))
def device_list(spark, sf_dir):
    asof = F.lit(latest_time(spark, sf_dir))
    rows = dev.device_list(fx.devices(spark, sf_dir), asof, type="SN", status="offline", page=2)
    return text_times(rows.select("dev_code", "name", "type", "project_id", "created_at"), "created_at")


@query("device_code_check", """
    SELECT c_custkey, code AS dev_code, regexp_matches(code, '^[A-Z]{2}-\\d{8}$') AS valid,
           substr(code, 1, 2) AS type,
           concat(CASE substr(code, 1, 2) WHEN 'GW' THEN '网关' WHEN 'ED' THEN '边缘设备'
                       WHEN 'SN' THEN '传感节点' WHEN 'CM' THEN '摄像头' ELSE substr(code, 1, 2) END,
                  '-', substr(code, 4)) AS name
    FROM (SELECT c_custkey, concat(CASE c_custkey % 6 WHEN 0 THEN 'GW' WHEN 1 THEN 'ED' WHEN 2 THEN 'SN'
                                   WHEN 3 THEN 'CM' WHEN 4 THEN 'XY' ELSE 'gw' END,
                  CASE WHEN c_custkey % 11 = 0 THEN '_' ELSE '-' END,
                  lpad(CAST(c_custkey AS varchar), 8, '0')) AS code FROM customer)""")
def device_code_check(spark, sf_dir):
    key = F.col("c_custkey")
    prefix = F.element_at(F.array(*map(F.lit, ["GW", "ED", "SN", "CM", "XY", "gw"])),
                          (key % 6 + 1).cast("int"))
    asked = fx.table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("").alias("type"), F.lit("").alias("name"),
        F.concat(prefix, F.when(key % 11 == 0, "_").otherwise("-"),
                 F.lpad(key.cast("string"), 8, "0")).alias("dev_code"))
    return dev.device_code_check(asked)


@query("device_latest", f"""
    SELECT dev_code, {tm('max(ts)', 'last_seen')},
           arg_max(nullif(ip, ''), event_id) FILTER (ip <> '') AS ip,
           arg_max(nullif(version, ''), event_id) FILTER (version <> '') AS version
    FROM heartbeats GROUP BY dev_code""", ("heartbeats",))
def device_latest(spark, sf_dir):
    return text_times(dev.device_latest(fx.heartbeats(spark, sf_dir)), "last_seen")


@query("unknown_device", """
    SELECT event_id, dev_code FROM heartbeats
    WHERE dev_code NOT IN (SELECT dev_code FROM devices WHERE type = 'SN')""", ("heartbeats", "devices"))
def unknown_device(spark, sf_dir):
    known = fx.devices(spark, sf_dir).filter("type = 'SN'")
    return dev.unknown_devices(fx.heartbeats(spark, sf_dir).select("event_id", "dev_code"), known)


@query("existing_device", """
    SELECT c_custkey, concat('SN-', lpad(CAST(c_custkey AS varchar), 8, '0')) AS dev_code FROM customer
    WHERE concat('SN-', lpad(CAST(c_custkey AS varchar), 8, '0')) IN (SELECT dev_code FROM devices)""",
       ("devices",))
def existing_device(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "customer").select("c_custkey", F.concat(
        F.lit("SN-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("dev_code"))
    return dev.existing_devices(asked, fx.devices(spark, sf_dir))


@query("device_patch", """
    SELECT d.dev_code, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE d.name END AS name, d.type,
           d.project_id, CASE WHEN c_custkey IS NOT NULL THEN '10.9.9.9' ELSE d.ip END AS ip,
           CASE WHEN c_custkey % 3 = 0 THEN '2' ELSE d.version END AS version
    FROM devices d LEFT JOIN customer
      ON d.dev_code = concat('SN-', lpad(CAST(c_custkey * 2 AS varchar), 8, '0'))""", ("devices",))
def device_patch(spark, sf_dir):
    key = F.col("c_custkey")
    patches = fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("SN-"), F.lpad((key * 2).cast("string"), 8, "0")).alias("dev_code"),
        F.when(key % 2 == 0, F.col("c_name")).alias("name"),
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("bigint").alias("project_id"),
        F.lit("10.9.9.9").alias("ip"), F.when(key % 3 == 0, "2").alias("version"))
    return dev.device_patch(fx.devices(spark, sf_dir), patches).select(
        "dev_code", "name", "type", "project_id", "ip", "version")


@query("shadow_version", """
    SELECT event_id, dev_code, 1 + row_number() OVER (PARTITION BY dev_code ORDER BY ts, event_id) AS version
    FROM heartbeats""", ("heartbeats",))
def shadow_version(spark, sf_dir):
    return dev.shadow_version(fx.heartbeats(spark, sf_dir).select("event_id", "dev_code", "ts"),
                              ["ts", "event_id"]).drop("ts")


def shadows(spark, sf_dir):
    """Reported state per device against the desired state of its newest sign-up."""
    beats = fx.heartbeats(spark, sf_dir)
    wanted = beats.filter("event_type = 'signup'").groupBy("dev_code").agg(
        F.max_by("reported", F.struct("ts", "event_id")).alias("desired"))
    return dev.shadow_state(beats, "ts", "event_id").join(wanted, "dev_code", "left")


@query("shadow_sync", """
    SELECT dev_code, version, reported, coalesce(desired, '') AS desired,
           desired IS NULL OR reported <> desired AS need_sync,
           CASE WHEN desired IS NOT NULL AND reported <> desired THEN desired ELSE '' END AS delta
    FROM (SELECT dev_code, 1 + count(*) AS version, arg_max(k, event_id) AS reported,
                 arg_max(k, event_id) FILTER (event_type = 'signup') AS desired
          FROM heartbeats GROUP BY dev_code)""", ("heartbeats",))
def shadow_sync(spark, sf_dir):
    rows = dev.shadow_sync(shadows(spark, sf_dir))
    def entry(c):
        return F.coalesce(F.try_element_at(F.col(c), F.lit("k")), F.lit("")).alias(c)
    return rows.select("dev_code", "version", entry("reported"), entry("desired"), "need_sync",
                       entry("delta"))


@query("shadow_merge", """
    SELECT dev_code, 1 + count(*) AS version, arg_max(k, event_id) AS k,
           coalesce(arg_max(event_id, event_id) FILTER (event_type = 'error'), -1) AS last_error
    FROM heartbeats GROUP BY dev_code""", ("heartbeats",))
def shadow_merge(spark, sf_dir):
    """Reported state merged key by key: only errors report `last_error`."""
    beats = fx.heartbeats(spark, sf_dir)
    extra = F.when(F.col("event_type") == "error", F.create_map(
        F.lit("last_error"), F.col("event_id").cast("string"))).otherwise(
        F.create_map().cast("map<string,string>"))
    beats = beats.withColumn("reported", F.map_concat("reported", extra))
    rows = dev.shadow_state(beats, "ts", "event_id", mode="merge")
    return rows.select("dev_code", "version", F.col("reported")["k"].alias("k"), F.coalesce(
        F.try_element_at("reported", F.lit("last_error")).cast("bigint"), F.lit(-1)).alias("last_error"))


@query("reading_dims", """
    SELECT event_id, concat('user ', s.measure_point_id) AS point_name, n_name AS gateway_name,
           r_name AS project_name
    FROM stream_rows s
    JOIN nation ON gateway_code = concat('GW-', lpad(CAST(n_nationkey + 1 AS varchar), 8, '0'))
    JOIN region ON project_id = r_regionkey""", ("stream_rows",))
def reading_dims(spark, sf_dir):
    rows = fx.reading_stream(spark, sf_dir)
    points = fx.devices(spark, sf_dir).select(
        F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("measure_point_id"),
        F.regexp_replace("name", "sensor-", "user ").alias("point_name"))
    gateways = fx.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("GW-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 8, "0"))
        .alias("gateway_code"), F.col("n_name").alias("gateway_name"))
    projects = fx.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("project_id"), F.col("r_name").alias("project_name"))
    return dev.reading_dims(rows, points, gateways, projects, "inner").select(
        "event_id", "point_name", "gateway_name", "project_name")


def telemetry(spark, sf_dir):
    """Telemetry messages as JSON, one per event; some lack the gpu group."""
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.col("value")
    with_gpu = F.when(F.col("event_id") % 4 != 0, F.struct(
        value.alias("usage_percent"), (value / 2).alias("temperature_celsius"),
        k.alias("memory_used_mb"), F.lit(8192).alias("memory_total_mb")))
    body = F.to_json(F.struct(
        F.concat(F.lit("SN-"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("device_code"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.struct((k / 4).alias("usage_percent"), (k / 2).alias("temperature_celsius")).alias("cpu"),
        with_gpu.alias("gpu"),
        F.struct((k * 10).alias("used_mb"), F.lit(8192).alias("total_mb")).alias("memory"),
        F.struct((k / 8).alias("last_inference_ms"), F.col("event_id").alias("total_inferences"))
        .alias("inference"),
        F.struct(k.alias("cf_tree_size"), F.col("event_id").alias("total_points_processed"))
        .alias("clustering")))
    return fx.events(spark, sf_dir).select("event_id", F.from_json(body, schema.TELEMETRY).alias("t"))


@query("unpack_telemetry", """
    SELECT event_id AS inference_total_inferences, k / 4 AS cpu_usage_percent,
           CASE WHEN event_id % 4 <> 0 THEN k ELSE -1 END AS gpu_memory_used_mb, k * 10 AS memory_used_mb,
           k / 8 AS inference_last_inference_ms, k AS clustering_cf_tree_size, true AS no_network
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events)""")
def unpack_telemetry(spark, sf_dir):
    flat = reports.unpack_telemetry(telemetry(spark, sf_dir).select("t.*"))
    return flat.select(
        "inference_total_inferences", F.col("cpu_usage_percent").cast("double"),
        F.coalesce("gpu_memory_used_mb", F.lit(-1)).cast("bigint").alias("gpu_memory_used_mb"),
        "memory_used_mb", F.col("inference_last_inference_ms").cast("double"),
        F.col("clustering_cf_tree_size").cast("bigint").alias("clustering_cf_tree_size"),
        F.col("network_rx_mbps").isNull().alias("no_network"))


@query("envelope_defaults", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'GW-00000001' ELSE concat('GW-', event_id % 3) END
           AS gateway_code,
           CASE WHEN event_id % 2 = 0 THEN '2024-01-01T00:00:00' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END
           AS timestamp
    FROM events""")
def envelope_defaults(spark, sf_dir):
    eid = F.col("event_id")
    messages = fx.events(spark, sf_dir).select(
        "event_id",
        F.when(eid % 3 != 0, F.concat(F.lit("GW-"), (eid % 3).cast("string"))).alias("gateway_code"),
        F.when(eid % 2 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"))
    return reports.envelope_defaults(messages, F.lit("GW-00000001"), F.lit("2024-01-01T00:00:00"))


@query("alert_rules", """
    SELECT gateway_code, 'too many outliers' AS rule, rate AS metric_value, 3 AS severity
    FROM (SELECT gateway_code, round(count(*) FILTER (is_outlier) / count(*), 6) AS rate
          FROM flagged GROUP BY gateway_code) WHERE rate > 0.025
    UNION ALL
    SELECT gateway_code, 'few readings', n, 1
    FROM (SELECT gateway_code, CAST(count(*) AS double) AS n FROM flagged GROUP BY gateway_code)
    WHERE n < 1250""", ("flagged",))
def alert_rules(spark, sf_dir):
    per = flagged_stream(spark, sf_dir).groupBy("gateway_code").agg(
        F.round(F.count_if("is_outlier") / F.count(F.lit(1)), 6).alias("outlier_rate"),
        F.count(F.lit(1)).cast("double").alias("readings"))
    metrics = per.unpivot(["gateway_code"], ["outlier_rate", "readings"], "metric", "metric_value")
    rules = spark.createDataFrame([
        ("too many outliers", "outlier_threshold", "outlier_rate", ">", 0.025, 3, True),
        ("few readings", "quality_drop", "readings", "<", 1250.0, 1, True),
        ("unused", "quality_drop", "readings", ">", 0.0, 4, False),
    ], "name string, rule_type string, metric string, op string, threshold double, severity int, "
       "enabled boolean")
    return reports.alert_rules(metrics, rules).select("gateway_code", "rule", "metric_value", "severity")


@query("trend_shift", """
    SELECT gateway_code, strftime(bucket, '%Y-%m-%d') AS bucket, n,
           coalesce(round((m - pm) / nullif(sqrt((n * v + pn * pv) / (n + pn)), 0), 5), 0) AS shift,
           coalesce(abs((m - pm) / nullif(sqrt((n * v + pn * pv) / (n + pn)), 0)) > 0.3, false) AS is_shift
    FROM (SELECT *, lag(n) OVER w AS pn, lag(m) OVER w AS pm, lag(v) OVER w AS pv
          FROM (SELECT gateway_code, date_trunc('day', value_time) AS bucket, count(*) AS n,
                       avg(cents) AS m, var_pop(cents) AS v FROM stream_rows GROUP BY ALL)
          WINDOW w AS (PARTITION BY gateway_code ORDER BY bucket))""", ("stream_rows",))
def trend_shift(spark, sf_dir):
    rows = reports.trend_shift(fx.reading_stream(spark, sf_dir), ["gateway_code"], "day", "cents", 0.3)
    return rows.select("gateway_code", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "n",
                       F.coalesce(F.round("shift", 5), F.lit(0.0)).alias("shift"), "is_shift")


@query("drift_scan", """
    SELECT event_id, gateway_code, round(pu - least(min(pu) OVER w, 0), 5) AS up, round(pd - least(min(pd) OVER w, 0), 5) AS down,
           greatest(pu - least(min(pu) OVER w, 0), pd - least(min(pd) OVER w, 0)) > 8 AS is_drift
    FROM (SELECT *, sum(z - 0.25) OVER w AS pu, sum(-z - 0.25) OVER w AS pd
          FROM (SELECT event_id, gateway_code, value_time, (cents - avg(cents) OVER g) / stddev_pop(cents) OVER g AS z
                FROM stream_rows WINDOW g AS (PARTITION BY gateway_code))
          WINDOW w AS (PARTITION BY gateway_code ORDER BY value_time, event_id))
    WINDOW w AS (PARTITION BY gateway_code ORDER BY value_time, event_id)""", ("stream_rows",))
def drift_scan(spark, sf_dir):
    """Cumulative sums of every reading against its gateway's mean."""
    rows = reports.drift_scan(fx.reading_stream(spark, sf_dir), ["gateway_code"], ["value_time", "event_id"], "cents", 0.25, 8.0)
    return rounded(rows.select("event_id", "gateway_code", "up", "down", "is_drift"), "up", "down", digits=5)


@query("liveness_sessions", f"""
    SELECT dev_code, {tm('online_at')}, {tm('last_seen')}, n AS heartbeats,
           {tm('last_seen + INTERVAL 60 MINUTE', 'offline_at')}
    FROM (SELECT dev_code, span, min(ts) AS online_at, max(ts) AS last_seen, count(*) AS n
          FROM (SELECT *, sum(new) OVER (PARTITION BY dev_code ORDER BY ts, event_id) AS span
                FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY dev_code ORDER BY ts, event_id)
                                          + INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM heartbeats))
          GROUP BY ALL)""", ("heartbeats",))
def liveness_sessions(spark, sf_dir):
    """Online spans with a limit of an hour (the data holds about two events a day and device)."""
    beats = fx.heartbeats(spark, sf_dir).select("event_id", "dev_code", "ts")
    return text_times(dev.liveness_sessions(beats, minutes=60), "online_at", "last_seen", "offline_at")
