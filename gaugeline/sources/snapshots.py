"""CF snapshots as JSON documents: one document per tree key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import schema
from gaugeline.functions import vectors as vec
from gaugeline.operators.cf import cf_geometry

TREE = ["gateway_code", "measure_point_id", "data_type"]


def cf_to_json(leaves: DataFrame, timestamp: Column, radius_threshold: float,
               max_children: int = schema.MAX_CHILDREN) -> DataFrame:
    """One snapshot document per tree.

    A document holds the leaves of one tree, the summary a device keeps, and not
    its readings.  Columns: the tree key, tree_id, num_points, num_clusters, body.
    """
    item = F.struct("leaf_id", F.struct("n", "centroid", "radius", "diameter", "ls", "ss").alias("c"))
    trees = cf_geometry(leaves.filter("n > 0")).groupBy(*TREE).agg(
        F.sum("n").alias("num_points"), F.count(F.lit(1)).alias("num_clusters"),
        F.array_sort(F.collect_list(item)).alias("__leaves"))
    text = [F.col(c).cast("string").alias(c) for c in TREE]
    trees = trees.withColumn("tree_id", F.concat_ws("_", *text))
    body = F.to_json(F.struct(
        F.lit(schema.SNAPSHOT_VERSION).alias("version"), "tree_id", *text,
        timestamp.alias("timestamp"),
        F.struct(F.lit(float(radius_threshold)).alias("radius_threshold"),
                 F.lit(max_children).alias("max_children")).alias("config"),
        F.struct(F.col("num_points").alias("total_points_processed"),
                 F.col("num_points").alias("total_points"),
                 F.col("num_clusters").alias("total_clusters")).alias("stats"),
        F.col("__leaves.c").alias("centroids"),
        F.lit(schema.SNAPSHOT_METHOD).alias("serialization_method")))
    return trees.withColumn("body", body).drop("__leaves")


def cf_from_json(snapshots: DataFrame, body: str = "body") -> DataFrame:
    """Leaf CFs of snapshot documents; sums that are missing come from n and the centroid."""
    doc = snapshots.select(F.from_json(body, schema.SNAPSHOT).alias("d")).select("d.*")
    items = doc.select("tree_id", *TREE, "timestamp",
                       F.posexplode("centroids").alias("leaf_no", "c"))
    n = F.col("c.n")
    ls = F.coalesce("c.ls", vec.scale(F.col("c.centroid"), n))
    ss = F.coalesce("c.ss", F.transform(ls, lambda x: F.when(n > 0, x * x / n).otherwise(x * x)))
    return items.select("tree_id", *TREE, "timestamp", "leaf_no", n.alias("n"), ls.alias("ls"),
                        ss.alias("ss"))


def cf_validate(snapshots: DataFrame, body: str = "body") -> DataFrame:
    """Adds `valid` and `message`: the first field a document lacks."""
    parsed = F.from_json(F.col(body), "version string, stats string, centroids array<string>")
    items = F.col("__p.centroids")

    def lacking(field: str) -> Column:
        return F.array_position(
            F.transform(items, lambda c: F.get_json_object(c, f"$.{field}").isNull()), True)

    no_centroid, no_n = lacking("centroid"), lacking("n")
    first_centroid = (no_centroid > 0) & ((no_n == 0) | (no_centroid <= no_n))
    message = F.when(F.col("__p").isNull(), "Not a JSON object")
    for field in ("version", "centroids", "stats"):
        message = message.when(F.col(f"__p.{field}").isNull(),
                               f"Missing required field: {field}")
    message = (message
               .when(first_centroid, F.format_string("Centroid %d missing 'centroid' field",
                                                     no_centroid - 1))
               .when(no_n > 0, F.format_string("Centroid %d missing 'n' field", no_n - 1))
               .otherwise(""))
    checked = snapshots.withColumn("__p", parsed).withColumn("message", message)
    return checked.withColumn("valid", F.col("message") == "").drop("__p")


def cf_payload_size(snapshots: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """UTF-8 bytes of the documents per key."""
    size = F.octet_length(body)
    return snapshots.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"),
                                        F.sum(size).alias("bytes"), F.max(size).alias("largest"))


def snapshot_rows(snapshots: DataFrame, record_time: Column) -> DataFrame:
    """Documents in the layout of the CF snapshot table."""
    return snapshots.select("gateway_code", record_time.alias("record_time"),
                            F.col("tree_id").alias("cf_tree_id"),
                            F.col("body").alias("serialized_data"), "num_points", "num_clusters")

