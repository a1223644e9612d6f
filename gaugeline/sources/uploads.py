"""Upload records as JSON text: parsing, batch reports, inline job data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline import schema


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Upload files, one JSON object per line; bad lines land in `_corrupt`."""
    return (spark.read.schema(schema.UPLOAD + ", _corrupt string")
            .option("columnNameOfCorruptRecord", "_corrupt").json(path))


def upload_parse(raw: DataFrame, body: str = "body") -> DataFrame:
    """JSON text to typed columns; `valid` is false for text that does not parse, without a
    device code, or with a time that is none.  A missing or empty time is allowed and null."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(F.col(body), schema.UPLOAD + ", _corrupt string", options)
    kept = [c for c in raw.columns if c != body]
    return (raw.withColumn("__u", parsed)
            .select(*kept, "__u.*")
            .withColumn("__time", F.try_to_timestamp("record_time"))
            .withColumn("valid", F.col("_corrupt").isNull() & F.col("dev_code").isNotNull()
                        & (F.col("__time").isNotNull() | (F.coalesce("record_time", F.lit("")) == "")))
            .withColumn("record_time", F.col("__time"))
            .drop("_corrupt", "__time"))


def batch_upload_report(parsed: DataFrame, batch: str) -> DataFrame:
    """Total, accepted and failed uploads per batch."""
    return parsed.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("valid")).alias("success_count"),
        F.count_if(~F.col("valid")).alias("failed_count"),
    )


def failed_uploads(parsed: DataFrame, batch: str, upload_id: str) -> DataFrame:
    """The failed uploads themselves, as rows: the list may be of any length."""
    return parsed.filter(~F.col("valid")).select(
        batch, F.col(upload_id).alias("record_id"), F.lit("invalid request").alias("error"))


def upload_items(parsed: DataFrame) -> DataFrame:
    """One row per data item of each accepted upload."""
    return (parsed.filter("valid")
            .select("*", F.inline("data_list"))
            .drop("data_list")
            .withColumnRenamed("type", "data_type"))


JOB_DATA = "id string, algorithm string, data array<array<double>>, labels array<int>"


def inline_source(requests: DataFrame, body: str = "body") -> DataFrame:
    """Job requests that carry their data inline: one row per vector, with its label if given."""
    job = F.from_json(F.col(body), JOB_DATA)
    return (requests.select(job.alias("__j")).select("__j.*")
            .select(F.col("id").alias("job_id"), "algorithm", "labels",
                    F.posexplode("data").alias("id", "features"))
            .withColumn("label", F.get("labels", F.col("id")))
            .drop("labels"))


def table_source(table: DataFrame, id_column: str, features: list[str],
                 where: Column | None = None) -> DataFrame:
    """Feature vectors from named columns of a table; rows with a null are left out."""
    df = table if where is None else table.filter(where)
    df = df.dropna(subset=features)
    return df.select(F.col(id_column).alias("id"),
                     F.array(*[F.col(c).cast("double") for c in features]).alias("features"))
