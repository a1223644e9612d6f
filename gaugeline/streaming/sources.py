"""Up-link messages as streams: topics, message families, readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline import schema

# Topic suffix of each message family.
FAMILIES = {
    "telemetry": "telemetry",
    "detection": "detection",
    "cf_tree": "cf_tree",
    "heartbeat": "heartbeat",
    "shadow_reported": "shadow/reported",
}
BODIES = {
    "telemetry": schema.TELEMETRY,
    "detection": schema.UPLOAD,
    "cf_tree": schema.SNAPSHOT,
    "heartbeat": "status string, uptime_seconds bigint, clusterers int, timestamp string, "
                 "gateway_code string",
    "shadow_reported": "state struct<reported:map<string,string>>, timestamp string, "
                       "gateway_code string",
}
MESSAGE = "topic string, body string, received timestamp"


def read_messages(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A growing folder of message files (topic, body, received) as a stream."""
    reader = spark.readStream.schema(MESSAGE)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def read_kafka(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """The same messages from Kafka; needs the Kafka connector on the class path."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribePattern", topics).load())
    return raw.select("topic", F.col("value").cast("string").alias("body"),
                      F.col("timestamp").alias("received"))


def with_family(messages: DataFrame) -> DataFrame:
    """Device code and message family from topics like devices/<code>/<family>."""
    suffix = F.regexp_extract("topic", r"^devices/[^/]+/(.+)$", 1)
    family = F.lit(None).cast("string")
    for name, end in FAMILIES.items():
        family = F.when(suffix == end, name).otherwise(family)
    return messages.withColumns({
        "device_code": F.regexp_extract("topic", r"^devices/([^/]+)/", 1), "family": family})


def parse_messages(messages: DataFrame) -> DataFrame:
    """All families in one pass: family, and one parsed column per family, null for the others."""
    rows = with_family(messages).filter("family is not null")
    return rows.withColumns({
        f: F.when(F.col("family") == f, F.from_json("body", kind)) for f, kind in BODIES.items()}).drop("body")


def family_of(messages: DataFrame, family: str) -> DataFrame:
    """Messages of one family with their body parsed into `message`."""
    if family not in BODIES:
        raise ValueError(f"family must be one of {sorted(BODIES)}")
    mine = with_family(messages).filter(F.col("family") == family)
    return mine.withColumn("message", F.from_json("body", BODIES[family])).drop("family", "body")
