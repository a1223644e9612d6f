"""Abnormal readings: per-record z-scores, running CF baselines, alert runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import schema
from gaugeline.plans.groups import Sizes, attach, with_group_aggs
from gaugeline.plans.ordered import HOME, Ordered, Running, ordered
from gaugeline.functions.vectors import let, total
from gaugeline.session import settle


def zscore_in_group(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, population sigma and z of each value within its group."""
    v = F.col(value)
    stats = with_group_aggs(df, keys, n_values=F.count(v), expected_mean=F.avg(v),
                            expected_std=F.stddev_pop(v))
    z = F.when(F.col("expected_std") > 0, (v - F.col("expected_mean")) / F.col("expected_std"))
    return stats.withColumn("z_score", z)


def flag_zscore(scored: DataFrame, min_n: int = schema.RECORD_MIN_VALUES,
                min_sigma: float = schema.RECORD_MIN_SIGMA,
                threshold: float = schema.RECORD_Z) -> DataFrame:
    """`is_outlier` for scored readings; small or flat groups have none."""
    hit = ((F.col("n_values") >= min_n) & (F.col("expected_std") >= min_sigma)
           & (F.abs("z_score") > threshold))
    return scored.withColumn("is_outlier", F.coalesce(hit, F.lit(False)))


def record_outliers(readings: DataFrame, keys: list[str], value: str = "value",
                    **limits: float) -> DataFrame:
    """Flagged readings only, with mean, sigma and z."""
    return flag_zscore(zscore_in_group(readings, keys, value), **limits).filter("is_outlier")


def outlier_details(vals: Column, min_n: int = schema.RECORD_MIN_VALUES,
                    min_sigma: float = schema.RECORD_MIN_SIGMA,
                    threshold: float = schema.RECORD_Z) -> Column:
    """Flagged values of one array column, without any shuffle.

    array<struct<value_index, value, expected_mean, expected_std, z_score>>
    """
    n = F.nullif(F.size(vals), F.lit(0))

    def details(mean: Column, spread: Column) -> Column:
        steep = F.when((n >= min_n) & (spread >= min_sigma), spread)
        scored = F.transform(vals, lambda x, i: F.struct(
            i.alias("value_index"), x.alias("value"), mean.alias("expected_mean"),
            spread.alias("expected_std"), ((x - mean) / steep).alias("z_score")))
        return F.filter(scored, lambda d: F.abs(d["z_score"]) > threshold)

    def spread_of(mean: Column) -> Column:
        squares = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        return F.sqrt(squares / n)

    return let(total(vals) / n, lambda mean: let(
        spread_of(mean), lambda spread: details(mean, spread)))


def record_outliers_in_arrays(records: DataFrame, vals: str = "vals", **limits: float) -> DataFrame:
    """Flagged values of records that carry their values as an array (map-only)."""
    kept = [c for c in records.columns if c != vals]
    return (records.select(*kept, outlier_details(F.col(vals), **limits).alias("__d"))
            .select(*kept, F.inline("__d")))


def outlier_hint(records: DataFrame, vals: str = "vals", **limits: float) -> DataFrame:
    """Per record: outlier count, details and the message shown to the sender."""
    details = records.withColumn("outliers", outlier_details(F.col(vals), **limits))
    count = F.size("outliers")
    point = F.col("measure_point_id").cast("string")
    return details.withColumns({
        "outlier_count": count,
        "outlier_hint": F.when(count > 0, F.format_string(schema.OUTLIER_HINT, point, count))
        .otherwise(""),
    })


# ---- running CF baseline -------------------------------------------------------------


def cf_online_outlier(
    readings: DataFrame, keys: list[str], order: list[str], value: str = "value",
    threshold: float = schema.RADIUS_THRESHOLD, sigma_factor: float = schema.SIGMA_FACTOR,
    min_points: int = schema.MIN_DETECT_POINTS, min_baseline: int = schema.MIN_BASELINE_POINTS,
    radius_floor: float = schema.RADIUS_FLOOR, sigma_floor: float = schema.SIGMA_FLOOR,
    prior: DataFrame | None = None, bound: Sizes | None = None,
) -> DataFrame:
    """Score each reading against the leaf CFs of the earlier readings of its key.

    Leaves are the grid leaves of `cf_leaves`.  A leaf is a baseline from its
    `min_baseline`-th reading on, and centroids of different cells are ordered
    like the cells, so the nearest baseline is the reading's own cell or the
    closest baseline cell below or above.  A key's baselines only change when a leaf becomes one, so
    these three are found once per (key, number of baselines so far, cell) and joined to the
    readings; their CFs come from one ordered scan over (key, cell).  The work is linear in the
    readings, plus those distinct places times the key's baselines.  Radii are taken from SS/N - mean^2, so
    values should be shifted to near zero first where they are more than some 1e6 sigmas away.

    `prior` carries the leaf CFs of all earlier readings (streams): keys, leaf_id, n, ls, ss.

    Adds: position, cell, nearest_cell, distance, z_score, is_outlier.
    """
    step = 2.0 * threshold
    v = F.col(value)
    scan = ordered(readings, keys, order, bound=bound).position("position")
    rows = scan.result().withColumn("cell", F.floor(v / step))
    if prior is not None:
        seen = prior.groupBy(*keys).agg(F.sum("n").alias("__seen"))
        rows = attach(rows, seen, keys, "left")
        rows = rows.withColumn("position", F.col("position") + F.coalesce("__seen", F.lit(0)))
        rows = rows.drop("__seen")
    rows = settle(rows)

    # 1. when does each (key, cell) become a baseline?
    own = rows.select(*keys, F.col("cell").alias("leaf"), "position", F.lit(1).alias("n"),
                      v.alias("ls"), (v * v).alias("ss"))
    if prior is not None:
        before = prior.select(*keys, F.col("leaf_id").alias("leaf"),
                              F.lit(-1).cast("bigint").alias("position"), F.col("n"),
                              F.col("ls")[0].alias("ls"), F.col("ss")[0].alias("ss"))
        own = own.unionByName(before)
    leaf_keys = [*keys, "leaf"]
    reached = (ordered(own, leaf_keys, ["position"], bound=scan.sizes)
               .running(__count=Running("sum", F.col("n")))
               .result()
               .filter(F.col("__count") >= min_baseline)
               .groupBy(*leaf_keys).agg(F.min("position").alias("since")))
    # 2. how many baselines a key has before each reading, and the candidate cells of each such place
    begins = reached.select(*keys, F.col("since").alias("position"), F.lit(1).alias("__turn"), F.col("leaf").alias("cell"),
                            F.lit(None).cast("double").alias("__v"))
    asking = rows.select(*keys, "position", F.lit(0).alias("__turn"), "cell", v.alias("__v"))
    line = settle(ordered(asking.unionByName(begins), keys, ["position", "__turn", "cell"], bound=scan.sizes)
                  .running(__epoch=Running("sum", F.col("__turn"))).result())
    # Baseline leaves of a key: the summary, cells of width 2T that hold min_baseline readings each.
    leaves = line.filter("__turn = 1").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("cell").alias("leaf"), "__epoch"))).alias("__leaves"))
    asking = line.filter("__turn = 0 and __epoch > 0").drop("__turn")
    places = attach(asking.select(*keys, "__epoch", "cell").distinct(), leaves, keys)
    ready = F.transform(F.filter("__leaves", lambda b: b["__epoch"] <= F.col("__epoch")), lambda b: b["leaf"])
    places = places.withColumn("__ready", ready).select(*keys, "__epoch", "cell", F.array_compact(F.array(
        F.array_max(F.filter("__ready", lambda c: c < F.col("cell"))),
        F.when(F.array_contains("__ready", F.col("cell")), F.col("cell")),
        F.array_min(F.filter("__ready", lambda c: c > F.col("cell"))))).alias("__near"))
    probes = attach(asking, places, [*keys, "__epoch", "cell"]).select(
        *keys, "position", "__v", F.explode("__near").alias("leaf"))

    # 3. CF of each candidate just before the reading: probes and updates in one scan
    updates = own.withColumn("__v", F.lit(None).cast("double")).withColumn("__probe", F.lit(0))
    zero = F.lit(0.0)
    asks = probes.select(*leaf_keys, "position", F.lit(0).alias("n"), zero.alias("ls"),
                         zero.alias("ss"), "__v", F.lit(1).alias("__probe"))
    timeline = updates.unionByName(asks).withColumn("__turn", 1 - F.col("__probe"))
    state = (ordered(timeline, leaf_keys, ["position", "__turn"], bound=scan.sizes)
             .running(n_before=Running("sum", F.col("n")), ls_before=Running("sum", F.col("ls")),
                      ss_before=Running("sum", F.col("ss")))
             .result().filter("__probe = 1"))
    mean = F.col("ls_before") / F.col("n_before")
    var = F.greatest(F.col("ss_before") / F.col("n_before") - mean * mean, F.lit(0.0))
    floor = F.when(F.col("position") < min_points, F.lit(float(sigma_floor))).otherwise(
        F.lit(float(radius_floor)))
    near = state.select(*keys, "position", F.abs(F.col("__v") - mean).alias("distance"),
                        F.greatest(F.sqrt(var), floor).alias("scale"),
                        F.col("leaf").alias("nearest_cell"))
    best = near.groupBy(*keys, "position").agg(
        F.min(F.struct("distance", "nearest_cell", "scale")).alias("__b"))
    scored = attach(rows, best, [*keys, "position"], "left")
    z = F.col("__b.distance") / F.col("__b.scale")
    return (scored
            .withColumn("nearest_cell", F.col("__b.nearest_cell"))
            .withColumn("distance", F.col("__b.distance"))
            .withColumn("z_score", z)
            .withColumn("is_outlier", F.coalesce(z > sigma_factor, F.lit(False)))
            .drop("__b"))


def consecutive_alerts(scored: DataFrame, keys: list[str], order: list[str],
                       limit: int = schema.CONSECUTIVE_LIMIT,
                       size_of: DataFrame | None = None,
                       prior: DataFrame | None = None, bound: Sizes | None = None) -> DataFrame:
    """Run length of outliers per key, alert flag and suggestion for each reading.

    `prior` (keys, streak) continues the runs of an earlier batch.
    """
    scan = ordered(scored, keys, order, size_of=size_of, bound=bound).position("__at")
    scan = scan.running(__reset=Running("max", F.when(~F.col("is_outlier"), F.col("__at"))))
    rows = scan.result()
    before = F.lit(0).cast("bigint")
    if prior is not None:
        carried = prior.select(*keys, F.col("streak").alias("__carried"))
        rows = attach(rows, carried, keys, "left")
        before = F.coalesce("__carried", F.lit(0))
    run = F.when(F.col("__reset").isNull(), F.col("__at") + 1 + before).otherwise(
        F.col("__at") - F.col("__reset"))
    rows = rows.withColumn("streak", F.when(F.col("is_outlier"), run).otherwise(F.lit(0)))
    rows = rows.withColumn("alert", F.col("streak") >= limit)
    suggestion = (F.when(F.col("alert"), "flag").when(F.col("is_outlier"), "reject")
                  .otherwise("accept"))
    return rows.withColumn("suggestion", suggestion).drop("__at", "__reset", "__carried")


def rolling_history_z(readings: DataFrame, keys: list[str], order: list[str],
                      value: str = "value", window: int = schema.HISTORY_WINDOW,
                      min_history: int = schema.HISTORY_MIN,
                      sigma_factor: float = schema.SIGMA_FACTOR) -> DataFrame:
    """z of each reading against the up to `window` readings before it in its key."""
    scan = ordered(readings, keys, order)
    if scan.split:
        scan = scan.position("__at")
    rows, parts = scan.blocks("__at", before=window, after=0)
    frame = Window.partitionBy(*parts).orderBy(*order).rowsBetween(-window, -1)
    v = F.col(value)
    rows = rows.withColumns({
        "history_n": F.count(v).over(frame),
        "history_mean": F.avg(v).over(frame),
        "history_std": F.stddev_pop(v).over(frame),
    }).filter(HOME)
    usable = (F.col("history_n") >= min_history) & (F.col("history_std") > 0)
    rows = rows.withColumn("z_score", F.when(
        usable, F.abs(v - F.col("history_mean")) / F.col("history_std")))
    rows = rows.withColumn("is_outlier", F.coalesce(F.col("z_score") > sigma_factor, F.lit(False)))
    return rows.drop(HOME, "_block", "__at")


def detection_summary(detections: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key: detections, outliers, rate, alerts and the current run."""
    n = F.count(F.lit(1))
    outliers = F.count_if("is_outlier")
    return detections.groupBy(*keys).agg(
        n.alias("total_detections"), outliers.alias("total_outliers"),
        (outliers / n).alias("outlier_rate"), F.count_if("alert").alias("total_alerts"),
        F.max_by("streak", order).alias("consecutive_outliers"))


def recent_alerts(detections: DataFrame, newest: list[str], keep: int = 10) -> DataFrame:
    """The newest alerts over all keys."""
    return (detections.filter("alert")
            .orderBy(*[F.col(c).desc() for c in newest]).limit(keep))
