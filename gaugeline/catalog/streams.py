"""Streaming queries over the event table, each run to the end of what is there."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gaugeline.catalog.clusters import MERGE_ROUNDS, lloyd_sql
from gaugeline.catalog.common import BASELINE, ONLINE, rounded, scratch, text_times, tm
from gaugeline.catalog.features import TREE, T_CENTS, flat
from gaugeline.catalog.registry import define, query
from gaugeline.operators import cf, clustering as cl
from gaugeline.sources import fixtures as fx, snapshots
from gaugeline.streaming import jobs, sources

PARTS = 3
# Of the replayed streams; a service sets its own before the first start, for the state it expects.
STATE_PARTITIONS = 8


class Replay:
    """A table that arrives in PARTS portions, in the order of a time column.

    Each portion is written by as many tasks as it has partitions, and the stream
    is run to the end of it before the next one arrives.
    """

    def __init__(self, spark, df, order, name):
        self.spark, self.df, self.order = spark, df, order
        self.path = scratch(spark, name)
        df.limit(0).write.parquet(self.path)
        self.stream = spark.readStream.schema(df.schema).parquet(self.path)

    def arrivals(self):
        at = F.unix_micros(self.order)
        first, last = self.df.agg(F.min(at), F.max(at)).first()
        part = F.floor((at - first) / ((last - first) // PARTS + 1))
        for i in range(PARTS):
            self.df.filter(part == i).write.mode("append").parquet(self.path)
            yield i


@contextmanager
def state_partitions(spark):
    """State of a stream started inside has STATE_PARTITIONS partitions, which stay for the life of its checkpoint."""
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(STATE_PARTITIONS))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def collected(replay, stream, name, mode="append"):
    """The rows a stream over a replay sends out, with the number of their batch."""
    out = scratch(replay.spark, name)

    def keep(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/rows/b={batch_id}")

    for _ in replay.arrivals():
        with state_partitions(replay.spark):
            jobs.run_available(stream, keep, f"{out}/checkpoint", mode)
    columns = StructType([*stream.schema.fields, StructField("batch_id", IntegerType())])
    return replay.spark.read.schema(columns).parquet(f"{out}/rows/*")


def final(replay, stream, keys, name):
    """Final state of an update-mode aggregate: the newest row per key."""
    rows = collected(replay, stream, name, "update")
    values = [c for c in rows.columns if c not in [*keys, "batch_id"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(
        *keys, "v.*")


def event_stream(spark, sf_dir):
    return Replay(spark, fx.events(spark, sf_dir), "ts", "events")


@query("stream_source", f"""
    SELECT dev_code AS device_code, family, count(*) AS n, max(k) AS top, CAST(sum(k) AS bigint) AS total,
           {tm('max(ts)', 'newest')} FROM (
        SELECT dev_code, ts, CAST(k AS bigint) AS k, CASE event_type WHEN 'click' THEN 'telemetry' WHEN 'error' THEN 'heartbeat'
               WHEN 'purchase' THEN 'shadow_reported' WHEN 'signup' THEN 'cf_tree' ELSE 'detection' END AS family
        FROM heartbeats) GROUP BY ALL""", ("heartbeats",))
def stream_source(spark, sf_dir):
    """Messages of five families on their topics, split and parsed from one stream."""
    raw = fx.events(spark, sf_dir)
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    end = (F.when(kind == "click", "telemetry").when(kind == "error", "heartbeat")
           .when(kind == "purchase", "shadow/reported").when(kind == "signup", "cf_tree")
           .otherwise("detection"))
    code = F.concat(F.lit("SN-"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    body = (F.when(kind == "click", F.to_json(F.struct(F.struct(k.alias("used_mb")).alias("memory"))))
            .when(kind == "error", F.to_json(F.struct(k.alias("uptime_seconds"))))
            .when(kind == "purchase", F.to_json(F.struct(F.struct(F.create_map(
                F.lit("k"), k.cast("string")).alias("reported")).alias("state"))))
            .when(kind == "signup", F.to_json(F.struct(F.struct(k.alias("total_points")).alias("stats"))))
            .otherwise(F.to_json(F.struct(k.cast("double").alias("factor")))))
    messages = raw.select(F.concat(F.lit("devices/"), code, F.lit("/"), end).alias("topic"),
                          body.alias("body"), F.col("ts").alias("received"))
    replay = Replay(spark, messages, "received", "messages")
    value = {"telemetry": "message.memory.used_mb", "heartbeat": "message.uptime_seconds",
             "cf_tree": "message.stats.total_points", "detection": "message.factor",
             "shadow_reported": "message.state.reported.k"}
    parsed = sources.parse_messages(sources.read_messages(spark, replay.path))
    number = F.coalesce(*[F.col(v.replace("message", f, 1)).cast("bigint") for f, v in value.items()])
    rows = collected(replay, parsed.select("device_code", "family", "received", number.alias("k")), "families")
    return rows.groupBy("device_code", "family").agg(
        F.count(F.lit(1)).alias("n"), F.max("k").alias("top"), F.sum("k").alias("total"),
        F.date_format(F.max("received"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("newest"))


@query("stream_record_outliers", """
    SELECT record_id, data_type, value_index, value, round((value - m) / s, 6) AS z_score
    FROM (SELECT *, count(*) OVER g AS n, avg(value) OVER g AS m, stddev_pop(value) OVER g AS s
          FROM readings WINDOW g AS (PARTITION BY record_id))
    WHERE n >= 5 AND s >= 0.01 AND abs((value - m) / s) > 2.5""", ("readings",))
def stream_record_outliers(spark, sf_dir):
    records = fx.records(spark, sf_dir).select("record_id", "data_type", "record_time", "vals")
    replay = Replay(spark, records, "record_time", "records")
    rows = collected(replay, jobs.record_outliers(replay.stream), "record-outliers")
    return rounded(rows.select("record_id", "data_type", "value_index", "value", "z_score"), "z_score")


@query("stream_cf_leaves", """
    SELECT gateway_code, measure_point_id, data_type, leaf_id, n, ls, ss FROM leaves""", ("leaves",))
def stream_cf_leaves(spark, sf_dir):
    replay = event_stream(spark, sf_dir)
    live = jobs.cf_leaves(fx.as_stream_rows(replay.stream), TREE, "cents", T_CENTS)
    return flat(final(replay, live, [*TREE, "leaf_id"], "leaves"))


def online_flags(spark, sf_dir):
    replay = event_stream(spark, sf_dir)
    folder = scratch(spark, "detector")
    detector = jobs.OnlineDetector(spark, folder, BASELINE, "value_time", "event_id", "cents", **ONLINE)
    for _ in replay.arrivals():
        jobs.run_available(fx.as_stream_rows(replay.stream), detector, f"{folder}/checkpoint")
    return detector.flags()


@query("stream_cf_outlier", """
    SELECT event_id, is_outlier, round(z_score, 6) AS z_score, position, false AS late FROM detections""",
       ("detections",))
def stream_cf_outlier(spark, sf_dir):
    rows = online_flags(spark, sf_dir)
    return rounded(rows.select("event_id", "is_outlier", "z_score", "position", "late"), "z_score")


@query("stream_alerts", "SELECT event_id, gateway_code, data_type, streak FROM detections WHERE streak >= 3",
       ("detections",))
def stream_alerts(spark, sf_dir):
    return online_flags(spark, sf_dir).filter("alert").select("event_id", *BASELINE, "streak")


define("beat_spans", """
    SELECT dev_code, span, min(ts) AS online_at, max(ts) AS last_seen, count(*) AS n
    FROM (SELECT *, sum(new) OVER (PARTITION BY dev_code ORDER BY ts, event_id) AS span
          FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY dev_code ORDER BY ts, event_id)
                                    + INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM heartbeats))
    GROUP BY ALL""", "heartbeats")


@query("device_liveness", f"""
    SELECT dev_code, {tm('online_at')}, {tm('last_seen')}, n AS heartbeats,
           {tm('last_seen + INTERVAL 60 MINUTE', 'offline_at')} FROM beat_spans
    WHERE last_seen + INTERVAL 60 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""", ("beat_spans",))
def device_liveness(spark, sf_dir):
    """Spans that are over by the watermark, with a limit of an hour."""
    replay = event_stream(spark, sf_dir)
    beats = fx.as_heartbeats(replay.stream).select("dev_code", "ts")
    rows = collected(replay, jobs.device_liveness(beats, minutes=60), "liveness")
    return text_times(rows.drop("batch_id"), "online_at", "last_seen", "offline_at")


@query("stream_trend", """
    SELECT strftime(bucket, '%Y-%m-%d') AS bucket, detection_count, outlier_count, avg_spacing
    FROM (SELECT date_trunc('day', ts) AS bucket, count(*) AS detection_count,
                 count(*) FILTER (value > 100) AS outlier_count, round(avg(value), 5) AS avg_spacing
          FROM events GROUP BY ALL)
    WHERE bucket + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_trend(spark, sf_dir):
    """Daily windows closed by the watermark; values above 100 count as outliers."""
    replay = event_stream(spark, sf_dir)
    rows = replay.stream.withColumn("is_outlier", F.col("value") > 100)
    out = collected(replay, jobs.trend(rows, "ts", "1 day"), "trend")
    return rounded(out.select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "detection_count",
                              "outlier_count", "avg_spacing"), "avg_spacing", digits=5)


@query("stream_shadow", """
    SELECT dev_code, reported, coalesce(desired, '') AS desired, version,
           desired IS NULL OR desired <> reported AS need_sync
    FROM (SELECT dev_code, arg_max(k, event_id) AS reported, 1 + count(*) AS version,
                 arg_max(k, event_id) FILTER (event_type = 'signup') AS desired
          FROM heartbeats GROUP BY dev_code)""", ("heartbeats",))
def stream_shadow(spark, sf_dir):
    replay = event_stream(spark, sf_dir)
    beats = fx.as_heartbeats(replay.stream)
    beats = beats.withColumn("desired", F.when(F.col("event_type") == "signup", F.col("reported")))
    rows = final(replay, jobs.shadow(beats), ["dev_code"], "shadow")
    return rows.select("dev_code", F.col("reported")["k"].alias("reported"),
                       F.coalesce(F.col("desired")["k"], F.lit("")).alias("desired"), "version", "need_sync")


@query("stream_telemetry", """
    SELECT device_code, strftime(bucket, '%Y-%m-%d') AS bucket, round(cpu, 5) AS cpu, coalesce(round(gpu, 5), -1) AS gpu,
           round(inference_ms, 5) AS inference_ms, messages
    FROM (SELECT user_id AS device_code, date_trunc('day', ts) AS bucket,
                 avg(CAST(json_extract_string(props, '$.k') AS double)) AS cpu,
                 avg(CASE WHEN event_id % 4 <> 0 THEN value / 2 END) AS gpu, avg(value) AS inference_ms,
                 count(*) AS messages FROM events GROUP BY ALL)
    WHERE bucket + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_telemetry(spark, sf_dir):
    replay = event_stream(spark, sf_dir)
    flat_rows = replay.stream.select(
        F.col("user_id").alias("device_code"), "ts",
        F.get_json_object("props", "$.k").cast("double").alias("cpu_usage_percent"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") / 2).alias("gpu_usage_percent"),
        F.col("value").alias("inference_last_inference_ms"))
    rows = collected(replay, jobs.telemetry_windows(flat_rows, "ts", "1 day"), "telemetry")
    out = rows.select("device_code", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "cpu",
                      F.coalesce(F.round("gpu", 5), F.lit(-1.0)).alias("gpu"), "inference_ms", "messages")
    return rounded(out, "cpu", "inference_ms", digits=5)


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Every event sent twice, the second copy seconds later; each is kept once."""
    raw = fx.events(spark, sf_dir).select("event_id", "user_id", "ts")
    again = raw.withColumn("ts", F.col("ts") + F.expr("interval 20 seconds"))
    replay = Replay(spark, raw.unionByName(again), "ts", "twice")
    rows = collected(replay, jobs.dedup(replay.stream, ["event_id"], "ts"), "dedup")
    return rows.select("event_id", "user_id")


@query("stream_latest_snapshot", f"""
    WITH newest AS (SELECT gateway_code, leaf_id, count(*) AS n, sum(cents) AS ls, sum(cents * cents) AS ss
                    FROM celled GROUP BY ALL),
    spots AS (SELECT 1 AS one, gateway_code, n, ls, ss, ls / n AS x FROM newest),
    {lloyd_sql('spots', 'one', 3, MERGE_ROUNDS)},
    placed AS (SELECT * FROM (SELECT s.*, c.label, c.c, row_number() OVER (PARTITION BY s.k
                                     ORDER BY sqrt((s.x - c.c) * (s.x - c.c)), c.label) AS r
               FROM (SELECT *, row_number() OVER () AS k FROM spots) s JOIN c{MERGE_ROUNDS} c ON true) WHERE r = 1)
    SELECT CAST(label + 1 AS int) AS cluster_id, round(any_value(c), 4) AS centroid,
           CAST(sum(n) AS bigint) AS point_count, round(max(sqrt((x - c) * (x - c))), 4) AS radius,
           string_agg(DISTINCT gateway_code, ',' ORDER BY gateway_code) AS members, sum(ls) AS ls, sum(ss) AS ss
    FROM placed GROUP BY label""", ("celled",))
def stream_latest_snapshot(spark, sf_dir):
    """Snapshots of growing trees, the newest per gateway kept and fused to three clusters."""
    rows = fx.reading_stream(spark, sf_dir)
    first, last = rows.agg(F.min("value_time"), F.max("value_time")).first()
    docs = None
    for i in range(1, PARTS + 1):
        at = first + (last - first) * i / PARTS
        part = rows.filter(F.col("value_time") <= F.lit(at)) if i < PARTS else rows
        leaves = cf.cf_leaves(part, ["gateway_code"], "cents", threshold=T_CENTS).withColumns(
            {"measure_point_id": F.lit(0), "data_type": F.lit(0)})
        doc = snapshots.cf_to_json(leaves, F.lit(str(i)), T_CENTS).select(
            "tree_id", "body", F.lit(at).alias("record_time"))
        docs = doc if docs is None else docs.unionByName(doc)
    replay = Replay(spark, docs, "record_time", "snapshots")
    newest = final(replay, jobs.latest_snapshots(replay.stream), ["tree_id"], "latest")
    merged = cl.cf_merge_cluster(snapshots.cf_from_json(newest), 1)
    return rounded(merged.select(
        "cluster_id", F.col("centroid")[0].alias("centroid"), "point_count", "radius",
        F.array_join("member_gateways", ",").alias("members"), F.col("ls")[0].alias("ls"),
        F.col("ss")[0].alias("ss")), "centroid", "radius", digits=4)
