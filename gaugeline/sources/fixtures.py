"""The driver tables shaped into readings, records, devices and features.

`events` is the reading stream: one device and measure point is one user, and one
record holds what a device sends of one event type in one calendar month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.scalars import month
from gaugeline.plans.ordered import Running, ordered
from gaugeline.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def as_stream_rows(raw: DataFrame) -> DataFrame:
    """Readings without any per-record column: a pure projection of events."""
    kind = F.col("event_type")
    user = F.col("user_id")
    return raw.select(
        "event_id",
        F.concat_ws("_", user, kind, month(F.col("ts").cast("timestamp"))).alias("record_id"),
        (user % 3).alias("project_id"),
        gateway(user).alias("gateway_code"),
        F.concat(F.lit("SN-"), F.lpad(user.cast("string"), 8, "0")).alias("dev_code"),
        user.alias("measure_point_id"),
        F.when(kind == "click", 1).when(kind == "error", 2).when(kind == "purchase", 3)
        .when(kind == "signup", 4).otherwise(5).alias("data_type"),
        "value",
        F.round(F.col("value") * 100).alias("cents"),
        F.col("ts").alias("value_time"),
    )


def gateway(user):
    return F.concat(F.lit("GW-"), F.lpad((user % 8 + 1).cast("string"), 8, "0"))


def reading_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_stream_rows(events(spark, sf_dir))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with their place in the record and the record's start time."""
    rows = reading_stream(spark, sf_dir)
    scan = ordered(rows, ["record_id"], ["value_time", "event_id"]).running(
        value_index=Running("sum", F.lit(1), inclusive=False),
        record_time=Running("min", F.col("value_time")),
    )
    return scan.result().withColumn("value_index", F.col("value_index").cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, its values as an array in order."""
    head = ["project_id", "gateway_code", "dev_code", "measure_point_id", "data_type"]
    grouped = readings(spark, sf_dir).groupBy("record_id", *head, "record_time").agg(
        F.array_sort(F.collect_list(F.struct("value_index", "value"))).alias("pairs"),
        F.max("value").alias("factor"),
    )
    return grouped.withColumn("vals", F.col("pairs.value")).drop("pairs")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw uploads as JSON text: one per measure point and month.

    Some are broken, by measure point: divisible by 7, cut short as by a broken transfer; by 11, a
    time that is none; by 13, no device code.  Those divisible by 17 give no time at all, which is allowed.
    """
    item = F.struct(F.col("data_type").alias("type"), F.col("vals"))
    point = F.col("measure_point_id")
    per_upload = records(spark, sf_dir).groupBy(
        "gateway_code", "measure_point_id", "dev_code", month(F.col("record_time")).alias("month")
    ).agg(
        F.array_sort(F.collect_list(item)).alias("data_list"),
        F.max("factor").alias("factor"),
        F.min("record_time").alias("record_time"),
    )
    body = F.to_json(F.struct(
        point.cast("string").alias("id"),
        F.when(point % 13 != 0, F.col("dev_code")).alias("dev_code"),
        "factor",
        F.when(point % 11 == 0, "yesterday, 25:61").when(
            point % 17 != 0, F.date_format("record_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("record_time"),
        "data_list",
        F.lit(1).alias("source"),
    ))
    broken = point % 7 == 0
    return per_upload.withColumn("body", body).select(
        F.col("gateway_code").alias("batch_id"),
        F.concat_ws("_", "measure_point_id", "month").alias("upload_id"),
        F.when(broken, F.expr("left(body, length(body) - 4)")).otherwise(F.col("body"))
        .alias("body"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One heartbeat per event, with blank ip and version now and then."""
    return as_heartbeats(events(spark, sf_dir))


def as_heartbeats(raw: DataFrame) -> DataFrame:
    user = F.col("user_id")
    k = F.get_json_object("props", "$.k")
    return raw.select(
        "event_id",
        F.concat(F.lit("SN-"), F.lpad(user.cast("string"), 8, "0")).alias("dev_code"),
        "ts",
        F.when(F.col("event_id") % 5 == 0, "").otherwise(
            F.concat(F.lit("10.0.0."), (user % 250).cast("string"))).alias("ip"),
        F.when(k.cast("int") % 3 == 0, "").otherwise(k).alias("version"),
        F.create_map(F.lit("k"), k).alias("reported"),
        "event_type",
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One device per user: first and last sight, type and name as stored."""
    user = F.col("user_id")
    per_user = events(spark, sf_dir).groupBy("user_id").agg(
        F.max("ts").alias("last_seen"), F.min("ts").alias("created_at"))
    return per_user.select(
        F.concat(F.lit("SN-"), F.lpad(user.cast("string"), 8, "0")).alias("dev_code"),
        F.concat(F.lit("sensor-"), user.cast("string")).alias("name"),
        F.when(user % 4 == 0, "ED").otherwise("SN").alias("type"),
        (user % 3).alias("project_id"),
        F.concat(F.lit("10.0.0."), (user % 250).cast("string")).alias("ip"),
        F.lit("1").alias("version"),
        "last_seen",
        "created_at",
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        "label",
    )
