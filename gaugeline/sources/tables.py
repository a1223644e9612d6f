"""Stored tables: month-partitioned writes, retention, newest row per key, job lookup."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline import schema
from gaugeline.functions.scalars import month

MONTH = "ym"
# How long detections and anomalies are kept.
ANOMALY_RETENTION = timedelta(days=183)

# The column that gives the month, and the sort key, per table.
LAYOUTS = {
    "detect_data": ("record_time", ["project_id", "record_time"]),
    "cluster_result": ("created_at", ["job_id", "cluster_id"]),
    "cluster_eval": ("created_at", ["job_id", "algorithm"]),
    "cluster_job": ("created_at", ["job_id"]),
    "merge_result": ("created_at", ["job_id", "cluster_id"]),
    "cf_tree_data": ("record_time", ["gateway_code", "record_time"]),
    "anomaly_record": ("record_time", ["gateway_code", "record_time"]),
}


def write_table(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Append to a month-partitioned parquet table, sorted inside its files.

    Rows go to disk from the partitions they are in, so a large month is written
    by many tasks; sorting by month first keeps one open file per task and month.
    """
    time, order = LAYOUTS[table]
    (df.withColumn(MONTH, month(F.col(time)))
     .sortWithinPartitions(MONTH, *order)
     .write.mode(mode).partitionBy(MONTH).option("compression", "zstd").parquet(path))


def read_table(spark: SparkSession, path: str, time: str,
               start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows of a time range; the range also prunes the month partitions."""
    df = spark.read.option("basePath", path).parquet(path)
    ym = F.col(MONTH).cast("int")
    if start is not None:
        df = df.filter((F.col(time) >= F.lit(start)) & (ym >= int(f"{start:%Y%m}")))
    if end is not None:
        df = df.filter((F.col(time) <= F.lit(end)) & (ym <= int(f"{end:%Y%m}")))
    return df.drop(MONTH)


def retention_filter(df: DataFrame, time: str, asof: Column,
                     keep: str = schema.READING_RETENTION) -> DataFrame:
    """Rows not older than `keep` (such as "1 year" or "6 months") at `asof`."""
    return df.filter(F.col(time) >= asof - F.expr(f"interval {keep}"))


def retained(spark: SparkSession, path: str, time: str, asof: datetime, keep: timedelta) -> DataFrame:
    """Rows of a stored table that are not older than `keep` at `asof`; older months are not read."""
    return read_table(spark, path, time, start=asof - keep)


def latest_by_key(df: DataFrame, keys: list[str], newest: str, tie: str | None = None) -> DataFrame:
    """The newest row per key, as a replacing table keeps it.

    An aggregate, so copies of a key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[c for c in (newest, tie) if c])
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), order).alias("__row"))
            .select(*keys, "__row.*"))


def job_lookup(results: DataFrame, job_id: str, page: int = 1,
               page_size: int = schema.PAGE_SIZE, after: object = None) -> DataFrame:
    """One page of a job's stored points, in point order.

    `after` is the last point of the page before: the page then starts behind it, and no task holds the
    pages before, as it must for a page number.
    """
    rows = results.filter(F.col("job_id") == job_id)
    if after is not None:
        return rows.filter(F.col("point_id") > F.lit(after)).orderBy("point_id").limit(page_size)
    return rows.orderBy("point_id").offset((max(page, 1) - 1) * page_size).limit(page_size)


def job_row(spark: SparkSession, job_id: str, algorithm: str, params: dict[str, object], status: str,
            created_at: datetime) -> DataFrame:
    """A job in the layout of the job table."""
    return spark.createDataFrame([(job_id, algorithm, {k: str(v) for k, v in params.items()}, status, created_at)],
                                 "job_id string, algorithm string, params map<string,string>, status string, "
                                 "created_at timestamp")


def merge_results(merged: DataFrame, job_id: str, created_at: Column) -> DataFrame:
    """Fused clusters in the layout of the merge-result table."""
    return merged.select(F.lit(job_id).alias("job_id"), "cluster_id", "centroid", "point_count", "radius",
                         "member_gateways", "ls", "ss", created_at.alias("created_at"))


def cluster_results(points: DataFrame, job_id: str, created_at: Column) -> DataFrame:
    """Job points in the layout of the result table."""
    return points.select(
        F.lit(job_id).alias("job_id"), F.col("label").alias("cluster_id"),
        F.col("id").alias("point_id"), "features", "label", "distance",
        created_at.alias("created_at"))


def cluster_evals(scores: DataFrame, job_id: str, algorithm: str, params: dict[str, object],
                  created_at: Column) -> DataFrame:
    """A job's metrics in the layout of the evaluation table."""
    pairs = [F.lit(str(x)) for kv in params.items() for x in kv]
    return scores.select(
        F.lit(job_id).alias("job_id"), F.lit(algorithm).alias("algorithm"),
        F.col("silhouette" if "silhouette" in scores.columns else "silhouette_squared").alias("silhouette_score"),
        "davies_bouldin", "calinski_harabasz",
        "n_clusters", "n_points",
        F.create_map(*pairs).cast("map<string,string>").alias("params"),
        created_at.alias("created_at"))


def anomalies(outliers: DataFrame, kind: str) -> DataFrame:
    """Flagged readings in the layout of the anomaly table."""
    return outliers.select(
        "record_time", "gateway_code", "dev_code", "measure_point_id", "data_type",
        "value_index", "value", "expected_mean", "expected_std", "z_score",
        F.lit(kind).alias("anomaly_type"), F.lit(0).alias("handled"))
