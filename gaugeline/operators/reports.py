"""Reports over records and readings: trends, grades, totals, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.scalars import ratio
from gaugeline.plans.groups import with_group_aggs
from gaugeline.plans.ordered import ordered

GRANULARITIES = ("hour", "day", "week", "month")


def device_record_stats(records: DataFrame) -> DataFrame:
    """Per project and gateway: record count, first and last record."""
    return records.groupBy("project_id", "gateway_code").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("record_time").alias("first_record"),
        F.max("record_time").alias("last_record"))


def quality_summary(graded: DataFrame) -> DataFrame:
    """Per project and grade: record count and mean factor; blank grades left out."""
    return (graded.filter(F.col("quality_grade") != "")
            .groupBy("project_id", "quality_grade")
            .agg(F.count(F.lit(1)).alias("count"), F.avg("factor").alias("avg_factor")))


def share_by(df: DataFrame, groups: list[str], within: list[str] | None = None) -> DataFrame:
    """Row count per group and its percentage of all rows, or of the rows of `within`.

    Both totals are taken over the counts, so over one row per group.
    """
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("count"))
    whole = (F.sum("count").over(Window.partitionBy(*within)) if within
             else counts.agg(F.sum("count")).scalar())
    return counts.withColumn("percentage", F.col("count") * 100.0 / whole)


def detection_trend(readings: DataFrame, granularity: str, time: str = "value_time",
                    project_id: object = None) -> DataFrame:
    """Detections, outliers and mean value per hour, day, week or month."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    if project_id is not None:
        readings = readings.filter(F.col("project_id") == F.lit(project_id))
    return readings.groupBy(F.date_trunc(granularity, time).alias("bucket")).agg(
        F.count(F.lit(1)).alias("detection_count"),
        F.count_if("is_outlier").alias("outlier_count"),
        F.avg("value").alias("avg_spacing"))


def quality_distribution(graded: DataFrame, group: str) -> DataFrame:
    """Grade counts and percentages within each group."""
    return share_by(graded, [group, "quality_grade"], within=[group])


def overview(devices: DataFrame, readings: DataFrame, asof: Column, online: Column) -> DataFrame:
    """One row: devices, projects, and the detections of the day of `asof`."""
    seen = devices.agg(
        F.count(F.lit(1)).alias("total_devices"),
        F.count_if(online).alias("online_devices"),
        F.count_if(~online).alias("offline_devices"),
        F.count_distinct("project_id").alias("total_projects"))
    day = F.date_trunc("day", asof)
    today = readings.filter((F.col("value_time") >= day) & (F.col("value_time") <= asof))
    done = today.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("o")))
    return seen.withColumn("__t", done.scalar()).withColumns({
        "detections_today": F.col("__t.n"), "outliers_today": F.col("__t.o"),
        "outlier_rate": ratio(F.col("__t.o"), F.col("__t.n")),
    }).drop("__t")


def gateway_rollup(detections: DataFrame, leaves: DataFrame) -> DataFrame:
    """Values, outliers, alerts and clusters by gateway and type, with totals."""
    values = detections.rollup("gateway_code", "data_type").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("total_values"),
        F.count_if("is_outlier").alias("outliers"), F.count_if("alert").alias("alerts"))
    clusters = leaves.rollup("gateway_code", "data_type").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("clusters"))
    keys = ["gateway_code", "data_type", "level"]
    match = [values[k].eqNullSafe(clusters[k]) for k in keys]
    return values.join(clusters, match, "left").select(
        *[values[k] for k in keys], "total_values", "outliers", "alerts",
        F.coalesce("clusters", F.lit(0)).alias("clusters"))


def telemetry_rollup(per_point: DataFrame, gateway: str = "gateway_code") -> DataFrame:
    """Per gateway: points and outliers summed over measure points, and the extremes."""
    return per_point.groupBy(gateway).agg(
        F.sum("total_points").alias("total_points"),
        F.sum("total_outliers").alias("total_outliers"),
        F.max("total_points").alias("max_points"),
        F.avg("total_points").alias("avg_points"))


def unpack_telemetry(telemetry: DataFrame) -> DataFrame:
    """Nested telemetry as flat columns; absent groups give nulls."""
    groups = {
        "cpu": ["usage_percent", "temperature_celsius"],
        "gpu": ["usage_percent", "temperature_celsius", "memory_used_mb", "memory_total_mb"],
        "memory": ["used_mb", "total_mb"],
        "network": ["rx_mbps", "tx_mbps"],
        "inference": ["last_inference_ms", "total_inferences", "avg_inference_ms"],
        "clustering": ["cf_tree_size", "last_cluster_ms", "total_points_processed",
                       "total_outliers_detected"],
    }
    return telemetry.select("device_code", "timestamp", *[
        F.col(f"{g}.{f}").alias(f"{g}_{f}") for g, fields in groups.items() for f in fields])


def envelope_defaults(messages: DataFrame, gateway_code: Column, timestamp: Column) -> DataFrame:
    """Gateway code and time filled in where a message lacks them."""
    return messages.withColumns({
        "gateway_code": F.coalesce("gateway_code", gateway_code),
        "timestamp": F.coalesce("timestamp", timestamp)})


def alert_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts for each enabled rule whose metric passes its threshold.

    rules: name, rule_type, metric, op ('>' or '<'), threshold, severity, enabled.
    A rule table is written by hand; the equi-join on the metric name leaves its
    placement to the optimizer.
    """
    active = rules.filter("enabled").select(
        F.col("name").alias("rule"), "rule_type", "metric", "op", "threshold", "severity")
    over = (F.col("op") == ">") & (F.col("metric_value") > F.col("threshold"))
    under = (F.col("op") == "<") & (F.col("metric_value") < F.col("threshold"))
    return metrics.join(active, "metric").filter(over | under)


def trend_shift(readings: DataFrame, keys: list[str], bucket: str = "day",
                value: str = "value", factor: float = 1.0) -> DataFrame:
    """Jump of a key's bucket mean against the bucket before, in pooled sigmas."""
    v = F.col(value)
    means = readings.groupBy(*keys, F.date_trunc(bucket, "value_time").alias("bucket")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))
    before = Window.partitionBy(*keys).orderBy("bucket")
    steps = means.withColumns({
        "prev_n": F.lag("n").over(before), "prev_mean": F.lag("mean").over(before),
        "prev_var": F.lag("var").over(before)})
    pooled = F.sqrt((F.col("n") * F.col("var") + F.col("prev_n") * F.col("prev_var"))
                    / (F.col("n") + F.col("prev_n")))
    shift = F.when(pooled > 0, (F.col("mean") - F.col("prev_mean")) / pooled)
    return steps.withColumn("shift", shift).withColumn(
        "is_shift", F.coalesce(F.abs("shift") > factor, F.lit(False)))


def drift_scan(readings: DataFrame, keys: list[str], order: list[str], value: str = "value",
               slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """Slow drift by cumulative sums: `up` adds what a value lies above the key's mean by more than `slack` sigmas,
    `down` what it lies below, in sigmas and never under 0; is_drift where one of them passes `limit`.

    Single jumps are `trend_shift`; this finds shifts too small for that, once they last.  Keys without spread, and
    rows without a value, add nothing.  `order` must be total within a key.
    """
    v = F.col(value)
    rows = with_group_aggs(readings, keys, __mean=F.avg(v), __sigma=F.stddev_pop(v))
    z = F.when(F.col("__sigma") > 0, (v - F.col("__mean")) / F.col("__sigma"))
    scan = ordered(rows.withColumn("__z", z), keys, order, size_of=readings).clipped_sum(
        up=F.col("__z") - slack, down=-F.col("__z") - slack)
    return scan.result().withColumn("is_drift", F.greatest("up", "down") > limit).drop("__mean", "__sigma", "__z")
