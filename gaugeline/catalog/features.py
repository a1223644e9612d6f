"""Clustering features: building, merging, leaves, snapshots, deltas."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gaugeline.catalog.common import ORDER, latest_time, newest, rounded, scratch, text_times, tm
from gaugeline.catalog.registry import define, query
from gaugeline.functions import vectors as vec
from gaugeline.operators import cf
from gaugeline.sources import fixtures as fx, snapshots, tables

KEYS = ["gateway_code", "data_type"]
TREE = ["gateway_code", "measure_point_id", "data_type"]
T_CENTS = 500.0

define("celled", """
    SELECT *, CAST(floor(cents / 1000) AS bigint) AS leaf_id FROM stream_rows""", "stream_rows")
define("leaves", """
    SELECT gateway_code, measure_point_id, data_type, leaf_id, count(*) AS n, sum(cents) AS ls,
           sum(cents * cents) AS ss FROM celled GROUP BY ALL""", "celled")
define("shaped", """
    SELECT *, ls / n AS centroid, sqrt(greatest(ss / n - (ls / n) * (ls / n), 0)) AS radius,
           sqrt(greatest(2.0 * (ss - ls * ls / n) / n, 0)) AS diameter,
           CASE WHEN n > 1 THEN sqrt(greatest(2.0 * (ss - ls * ls / n) / (n - 1), 0)) ELSE 0 END AS pairwise
    FROM leaves""", "leaves")


def cents_rows(spark, sf_dir):
    return cf.as_vector(fx.reading_stream(spark, sf_dir), "cents")


def leaves(spark, sf_dir, keys=TREE):
    """Grid leaves of radius at most 5.00 per tree, in hundredths."""
    return cf.cf_leaves(fx.reading_stream(spark, sf_dir), list(keys), "cents", threshold=T_CENTS)


def flat(df):
    """One-dimensional sums as plain columns."""
    return df.withColumns({"ls": F.col("ls")[0], "ss": F.col("ss")[0]})


@query("cf_build", """
    SELECT gateway_code, data_type, count(*) AS n, sum(cents) AS ls, sum(cents * cents) AS ss
    FROM stream_rows GROUP BY ALL""", ("stream_rows",))
def cf_build(spark, sf_dir):
    return flat(cf.cf_build(cents_rows(spark, sf_dir), KEYS))


@query("cf_build_vectors", """
    SELECT label, pos - 1 AS dim, count(*) AS n, round(sum(x), 6) AS ls, round(sum(x * x), 6) AS ss
    FROM (SELECT label, unnest(range(1, 65)) AS pos, CAST(unnest(embedding) AS double) AS x FROM embeddings)
    GROUP BY ALL""")
def cf_build_vectors(spark, sf_dir):
    cfs = cf.cf_build(fx.features(spark, sf_dir), ["label"], "features", dim=64)
    long = cfs.select("label", "n", F.posexplode(F.arrays_zip("ls", "ss")).alias("dim", "c"))
    return rounded(long.select("label", F.col("dim").cast("bigint"), "n", F.col("c.ls").alias("ls"),
                               F.col("c.ss").alias("ss")), "ls", "ss")


@query("cf_merge", """
    SELECT data_type, count(*) AS n, sum(cents) AS ls, sum(cents * cents) AS ss
    FROM stream_rows GROUP BY ALL""", ("stream_rows",))
def cf_merge(spark, sf_dir):
    per = cf.cf_build(cents_rows(spark, sf_dir), KEYS)
    empty = per.select("gateway_code", "data_type", F.lit(0).cast("bigint").alias("n"),
                       F.lit(None).cast("array<double>").alias("ls"),
                       F.lit(None).cast("array<double>").alias("ss"))
    return flat(cf.cf_merge(cf.cf_union(per, empty), ["data_type"]))


@query("cf_union", """
    SELECT gateway_code, leaf_id, count(*) AS n, sum(cents) AS ls, sum(cents * cents) AS ss
    FROM celled GROUP BY ALL""", ("celled",))
def cf_union(spark, sf_dir):
    """Snapshots of two spans of time, each from its own scan, laid together and merged leaf by leaf."""
    middle = latest_time(spark, sf_dir) - timedelta(days=10)
    when = F.col("value_time")
    rows = fx.reading_stream(spark, sf_dir)
    parts = [cf.cf_leaves(rows.filter(span), ["gateway_code", "data_type"], "cents", threshold=T_CENTS)
             for span in (when < F.lit(middle), when >= F.lit(middle))]
    return flat(cf.cf_merge(cf.cf_union(*parts), ["gateway_code", "leaf_id"]))


@query("cf_geometry", """
    SELECT gateway_code, measure_point_id, data_type, leaf_id, n, round(centroid, 6) AS centroid,
           round(radius, 6) AS radius, round(diameter, 6) AS diameter,
           round(pairwise, 6) AS diameter_pairwise FROM shaped""", ("shaped",))
def cf_geometry(spark, sf_dir):
    df = cf.cf_geometry(leaves(spark, sf_dir)).withColumn("centroid", F.col("centroid")[0])
    return rounded(df.drop("ls", "ss"), "centroid", "radius", "diameter", "diameter_pairwise")


@query("cf_distance", """
    SELECT a.gateway_code, a.data_type AS a_type, b.data_type AS b_type,
           round(abs(a.ls / a.n - b.ls / b.n), 6) AS centroid_distance,
           round(sqrt(greatest(2.0 * ((a.ss + b.ss) - (a.ls + b.ls) * (a.ls + b.ls) / (a.n + b.n))
                               / (a.n + b.n), 0)), 6) AS merge_distance
    FROM (SELECT gateway_code, data_type, count(*) AS n, sum(cents) AS ls, sum(cents * cents) AS ss
          FROM stream_rows GROUP BY ALL) a
    JOIN (SELECT gateway_code, data_type, count(*) AS n, sum(cents) AS ls, sum(cents * cents) AS ss
          FROM stream_rows GROUP BY ALL) b
      ON a.gateway_code = b.gateway_code AND b.data_type = a.data_type + 1""", ("stream_rows",))
def cf_distance(spark, sf_dir):
    """Distances between the CFs of consecutive data types of a gateway."""
    per = cf.cf_build(cents_rows(spark, sf_dir), KEYS)
    whole = F.struct("n", "ls", "ss")
    a = per.select("gateway_code", F.col("data_type").alias("a_type"), whole.alias("a"))
    b = per.select("gateway_code", F.col("data_type").alias("b_type"),
                   (F.col("data_type") - 1).alias("a_type"), whole.alias("b"))
    both = a.join(b, ["gateway_code", "a_type"]).withColumns(cf.cf_distance("a", "b"))
    return rounded(both.drop("a", "b"), "centroid_distance", "merge_distance")


@query("cf_leaves", """
    SELECT gateway_code, measure_point_id, data_type, leaf_id, n, ls, ss FROM leaves""", ("leaves",))
def cf_leaves(spark, sf_dir):
    return flat(leaves(spark, sf_dir))


@query("cf_leaves_vectors", """
    SELECT label, cell, count(*) AS n, round(sum(s), 6) AS ls, round(sum(f[64]), 6) AS ls64, round(sum(q), 6) AS ss
    FROM (SELECT label, array_to_string(list_transform(f, lambda x: CAST(floor(x / 0.2) AS bigint)), ',') AS cell, f,
                 list_sum(f) AS s, list_sum(list_transform(f, lambda x: x * x)) AS q
          FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)) GROUP BY label, cell""")
def cf_leaves_vectors(spark, sf_dir):
    """Leaves of the feature vectors, in cells 0.2 wide."""
    df = cf.cf_leaves(fx.features(spark, sf_dir), ["label"], "features", dim=64, threshold=0.1 * 64 ** 0.5)
    return rounded(df.select("label", F.array_join("leaf_id", ",").alias("cell"), "n", vec.total(F.col("ls")).alias("ls"),
                             F.col("ls")[63].alias("ls64"), vec.total(F.col("ss")).alias("ss")), "ls", "ls64", "ss")


@query("cf_compact")
def cf_compact(spark, sf_dir):
    """Leaves of each gateway and type joined up to radius 10.00."""
    start = leaves(spark, sf_dir, KEYS)
    done = cf.cf_compact(start, KEYS, 2 * T_CENTS)
    shaped = cf.cf_geometry(done)
    return rounded(flat(shaped).select(*KEYS, "leaf_id", "n", "ls", "radius"), "radius")


@query("cf_tree_stats", """
    SELECT *, round(outliers / processed, 6) AS outlier_rate FROM (
        SELECT gateway_code, data_type, CAST(sum(n) AS bigint) AS total_points, count(*) AS total_clusters,
               round(avg(n), 6) AS avg_cluster_size, max(n) AS max_cluster_size, min(n) AS min_cluster_size
        FROM (SELECT gateway_code, data_type, leaf_id, count(*) AS n FROM celled GROUP BY ALL)
        GROUP BY gateway_code, data_type)
    JOIN (SELECT gateway_code, data_type, count(*) AS processed, count(*) FILTER (is_outlier) AS outliers
          FROM flagged GROUP BY ALL) USING (gateway_code, data_type)""", ("celled", "flagged"))
def cf_tree_stats(spark, sf_dir):
    from gaugeline.catalog.common import flagged_stream
    counts = flagged_stream(spark, sf_dir).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("is_outlier").alias("outliers"))
    return rounded(cf.cf_tree_stats(leaves(spark, sf_dir, KEYS), KEYS, counts),
                   "avg_cluster_size", "outlier_rate")


@query("cluster_listing", """
    SELECT gateway_code, measure_point_id, data_type, leaf_id, n AS point_count,
           row_number() OVER (PARTITION BY gateway_code, measure_point_id, data_type ORDER BY centroid) - 1
             AS cluster_id,
           round(centroid, 6) AS centroid, round(radius, 6) AS radius, round(diameter, 6) AS diameter
    FROM shaped""", ("shaped",))
def cluster_listing(spark, sf_dir):
    df = cf.cluster_listing(leaves(spark, sf_dir), TREE)
    df = df.withColumn("centroid", F.col("centroid")[0]).drop("ls", "ss", "diameter_pairwise")
    return rounded(df, "centroid", "radius", "diameter")


@query("nearest_leaf_cf", """
    SELECT event_id, leaf_id, round(distance, 6) AS distance FROM (
        SELECT event_id, s.leaf_id, abs(cents - centroid) AS distance,
               row_number() OVER (PARTITION BY event_id ORDER BY abs(cents - centroid), s.leaf_id) AS r
        FROM stream_rows e JOIN shaped s USING (gateway_code, measure_point_id, data_type)) WHERE r = 1""",
       ("shaped",))
def nearest_leaf_cf(spark, sf_dir):
    rows = fx.reading_stream(spark, sf_dir)
    near = cf.nearest_leaf(rows, leaves(spark, sf_dir), TREE, "cents", "event_id")
    return rounded(near.select("event_id", "leaf_id", "distance"), "distance")


@query("as_of_leaf_state", """
    SELECT event_id, leaf_id, CAST(row_number() OVER w - 1 AS bigint) AS n,
           coalesce(sum(cents) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ls,
           coalesce(sum(cents * cents) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ss
    FROM celled WINDOW w AS (PARTITION BY gateway_code, measure_point_id, data_type, leaf_id
                             ORDER BY value_time, event_id)""", ("celled",))
def as_of_leaf_state(spark, sf_dir):
    """State of a reading's own leaf just before the reading."""
    rows = cf.leaf_state(fx.reading_stream(spark, sf_dir), TREE, ORDER, "cents", T_CENTS)
    return rows.select("event_id", "leaf_id", "n", "ls", "ss")


@query("every_nth_snapshot", """
    SELECT measure_point_id, seq, ls, ss FROM (
        SELECT measure_point_id, row_number() OVER w AS seq, sum(cents) OVER w AS ls,
               sum(cents * cents) OVER w AS ss
        FROM stream_rows WINDOW w AS (PARTITION BY measure_point_id ORDER BY value_time, event_id))
    WHERE seq % 10 = 0""", ("stream_rows",))
def every_nth_snapshot(spark, sf_dir):
    """CF of a measure point after every tenth reading."""
    rows = cf.every_nth(fx.reading_stream(spark, sf_dir), ["measure_point_id"], ORDER, "cents", 10)
    return rows.select("measure_point_id", "seq", "ls", "ss")


def documents(spark, sf_dir):
    rows = fx.reading_stream(spark, sf_dir)
    asof = F.date_format(newest(rows, "value_time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return snapshots.cf_to_json(leaves(spark, sf_dir), asof, T_CENTS)


@query("cf_to_json", """
    SELECT concat(gateway_code, '_', measure_point_id, '_', data_type) AS tree_id,
           CAST(sum(n) AS bigint) AS num_points, count(*) AS num_clusters, '1.0' AS version,
           'birch_cf_v1' AS method, CAST(sum(ls) AS double) AS ls, CAST(sum(ss) AS double) AS ss,
           round(sum(radius), 6) AS radii, round(sum(diameter), 6) AS diameters, 500.0::DOUBLE AS threshold
    FROM shaped GROUP BY gateway_code, measure_point_id, data_type""", ("shaped",))
def cf_to_json(spark, sf_dir):
    """Snapshot documents, read with plain JSON paths."""
    def at(path):
        return F.get_json_object("body", f"$.{path}")
    items = F.from_json(at("centroids"), "array<struct<ls:array<double>,ss:array<double>,radius:double,diameter:double>>")

    def summed(value):
        return F.aggregate(items, F.lit(0.0), lambda acc, c: acc + value(c))
    df = documents(spark, sf_dir).select(
        at("tree_id").alias("tree_id"), at("stats.total_points").cast("bigint").alias("num_points"),
        F.json_array_length(at("centroids")).cast("bigint").alias("num_clusters"),
        at("version").alias("version"), at("serialization_method").alias("method"),
        summed(lambda c: c["ls"][0]).alias("ls"), summed(lambda c: c["ss"][0]).alias("ss"),
        summed(lambda c: c["radius"]).alias("radii"), summed(lambda c: c["diameter"]).alias("diameters"),
        at("config.radius_threshold").cast("double").alias("threshold"))
    return rounded(df, "radii", "diameters")


@query("cf_from_json", """
    SELECT concat(gateway_code, '_', measure_point_id, '_', data_type) AS tree_id,
           CAST(row_number() OVER (PARTITION BY gateway_code, measure_point_id, data_type ORDER BY leaf_id) - 1
                AS int) AS leaf_no, n, ls, ss FROM leaves""", ("leaves",))
def cf_from_json(spark, sf_dir):
    return flat(snapshots.cf_from_json(documents(spark, sf_dir))).select(
        "tree_id", "leaf_no", "n", "ls", "ss")


@query("cf_validate", """
    SELECT tree_id, CASE m % 4 WHEN 0 THEN 'Missing required field: stats'
                               WHEN 1 THEN 'Centroid 0 missing ''centroid'' field'
                               WHEN 2 THEN 'Missing required field: version' ELSE '' END AS message,
           m % 4 = 3 AS valid
    FROM (SELECT DISTINCT concat(gateway_code, '_', measure_point_id, '_', data_type) AS tree_id,
                 measure_point_id AS m FROM leaves)""", ("leaves",))
def cf_validate(spark, sf_dir):
    """Snapshot documents, three in four of them with a field renamed."""
    which = F.col("measure_point_id") % 4
    body = (F.when(which == 0, F.replace("body", F.lit('"stats"'), F.lit('"s"')))
            .when(which == 1, F.replace("body", F.lit('"centroid"'), F.lit('"c"')))
            .when(which == 2, F.replace("body", F.lit('"version"'), F.lit('"v"')))
            .otherwise(F.col("body")))
    checked = snapshots.cf_validate(documents(spark, sf_dir).withColumn("body", body))
    return checked.select("tree_id", "message", "valid")


@query("cf_payload_size", """
    SELECT gateway_code, count(*) AS documents, CAST(sum(strlen(body)) AS bigint) AS bytes, max(strlen(body)) AS largest
    FROM (SELECT gateway_code, CAST(to_json(list({'leaf_id': leaf_id, 'n': n, 'ls': CAST(ls AS bigint),
                 'ss': CAST(ss AS bigint)} ORDER BY leaf_id)) AS varchar) AS body
          FROM leaves GROUP BY gateway_code, measure_point_id, data_type)
    GROUP BY gateway_code""", ("leaves",))
def cf_payload_size(spark, sf_dir):
    """Bytes per gateway of documents that hold the leaves as whole numbers."""
    whole = [F.col(c)[0].cast("bigint").alias(c) for c in ("ls", "ss")]
    items = F.array_sort(F.collect_list(F.struct("leaf_id", "n", *whole)))
    docs = leaves(spark, sf_dir).groupBy(*TREE).agg(F.to_json(items).alias("body"))
    return snapshots.cf_payload_size(docs, ["gateway_code"])


@query("cf_snapshot_sink", f"""
    SELECT concat(gateway_code, '_', measure_point_id, '_', data_type) AS cf_tree_id, gateway_code,
           {tm('(SELECT max(ts) FROM events)', 'record_time')}, CAST(sum(n) AS bigint) AS num_points,
           count(*) AS num_clusters
    FROM leaves GROUP BY gateway_code, measure_point_id, data_type""", ("leaves",))
def cf_snapshot_sink(spark, sf_dir):
    """Snapshots written to their table and read back."""
    path = scratch(spark, "cf_tree_data")
    at = newest(fx.events(spark, sf_dir), "ts")
    tables.write_table(snapshots.snapshot_rows(documents(spark, sf_dir), at), path, "cf_tree_data")
    back = tables.read_table(spark, path, "record_time").drop("serialized_data")
    return text_times(back, "record_time")


@query("cf_delta", """
    WITH old AS (SELECT gateway_code, data_type, leaf_id, count(*) AS n, sum(cents) AS ls FROM celled
                 WHERE value_time < (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL),
    new AS (SELECT gateway_code, data_type, leaf_id, count(*) AS n, sum(cents) AS ls FROM celled
            WHERE value_time >= (SELECT min(ts) FROM events) + INTERVAL 2 DAY GROUP BY ALL)
    SELECT gateway_code, data_type, leaf_id, coalesce(new.n, 0) AS n, coalesce(new.ls, 0) AS ls,
           CASE WHEN old.n IS NULL THEN 'new' WHEN new.n IS NULL THEN 'removed' ELSE 'updated' END AS status
    FROM old FULL JOIN new USING (gateway_code, data_type, leaf_id)
    WHERE old.n IS DISTINCT FROM new.n OR old.ls IS DISTINCT FROM new.ls""", ("celled",))
def cf_delta(spark, sf_dir):
    """Leaves that changed between two snapshots taken over shifted spans of time."""
    rows = fx.reading_stream(spark, sf_dir)
    gap = F.expr("interval 2 days")
    first = rows.agg(F.min("value_time")).scalar()
    older = rows.filter(F.col("value_time") < newest(rows, "value_time") - gap)
    newer = rows.filter(F.col("value_time") >= first + gap)
    delta = cf.cf_delta(cf.cf_leaves(older, KEYS, "cents", threshold=T_CENTS),
                        cf.cf_leaves(newer, KEYS, "cents", threshold=T_CENTS), KEYS)
    return delta.select(*KEYS, "leaf_id", "status", F.coalesce("n", F.lit(0)).alias("n"),
                        F.coalesce(F.col("ls")[0], F.lit(0.0)).alias("ls"))
