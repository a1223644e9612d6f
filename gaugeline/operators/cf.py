"""Clustering features: N, linear sum and square sum per dimension.

A CF is the columns `n bigint, ls array<double>, ss array<double>`.  CFs add up,
so building and merging are plain aggregates with map-side combine.  Leaves are
the cells of a grid small enough that each keeps to the radius threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import schema
from gaugeline.functions import vectors as vec
from gaugeline.functions.scalars import ratio
from gaugeline.plans.ordered import Running, ordered
from gaugeline.session import settle

CF_COLUMNS = ("n", "ls", "ss")


def as_vector(df: DataFrame, column: str) -> DataFrame:
    """A scalar column as the one-element vector `features`."""
    return df.withColumn("features", F.array(F.col(column).cast("double")))


def cf_build(df: DataFrame, keys: list[str], features: str = "features", dim: int = 1) -> DataFrame:
    """CF of the vectors of each key."""
    x = F.col(features)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), vec.sum_of(x, dim).alias("ls"),
                                 vec.sum_of_squares(x, dim).alias("ss"))


def cf_merge(cfs: DataFrame, keys: list[str], dim: int = 1) -> DataFrame:
    """Sum of the CFs of each key; empty CFs (n = 0, no sums) change nothing."""
    zeros = F.array(*[F.lit(0.0)] * dim)
    ls, ss = F.coalesce("ls", zeros), F.coalesce("ss", zeros)
    return (cfs.withColumns({"ls": ls, "ss": ss}).groupBy(*keys)
            .agg(F.sum("n").alias("n"), vec.sum_of(F.col("ls"), dim).alias("ls"),
                 vec.sum_of(F.col("ss"), dim).alias("ss")))


def cf_union(*snapshots: DataFrame) -> DataFrame:
    """Leaf CFs of many trees in one table, ready for `cf_merge` or clustering."""
    out = snapshots[0]
    for other in snapshots[1:]:
        out = out.unionByName(other)
    return out


def centroid(n: Column, ls: Column) -> Column:
    return F.when(n > 0, vec.divide(ls, n))


def variance(n: Column, ls: Column, ss: Column) -> Column:
    """Sum over dimensions of max(SS/N - mean squared, 0).

    A CF holds plain sums, so digits are lost where the mean is more than some 1e6 times the
    spread; shift such values to near zero before they are summed.
    """
    parts = F.zip_with(ls, ss, lambda a, b: F.greatest(b / n - (a / n) * (a / n), F.lit(0.0)))
    return vec.total(parts)


def radius(n: Column, ls: Column, ss: Column) -> Column:
    return F.when(n > 0, F.sqrt(variance(n, ls, ss))).otherwise(0.0)


def diameter(n: Column, ls: Column, ss: Column) -> Column:
    """Root of twice the mean squared deviation, clamped at 0."""
    spread = vec.total(F.zip_with(ls, ss, lambda a, b: b - a * a / n))
    return F.when(n > 0, F.sqrt(F.greatest(2.0 * spread / n, F.lit(0.0)))).otherwise(0.0)


def diameter_pairwise(n: Column, ls: Column, ss: Column) -> Column:
    """Root mean square distance over all pairs of different points."""
    spread = vec.total(F.zip_with(ls, ss, lambda a, b: b - a * a / n))
    return F.when(n > 1, F.sqrt(F.greatest(2.0 * spread / (n - 1), F.lit(0.0)))).otherwise(0.0)


def cf_geometry(cfs: DataFrame) -> DataFrame:
    """Centroid, radius and both diameters of each CF."""
    args = [F.col(c) for c in CF_COLUMNS]
    return cfs.withColumns({
        "centroid": centroid(args[0], args[1]), "radius": radius(*args),
        "diameter": diameter(*args), "diameter_pairwise": diameter_pairwise(*args)})


def point_distance(n: Column, ls: Column, point: Column) -> Column:
    """Centroid of a CF to a point."""
    return vec.distance(vec.divide(ls, n), point)


def cf_distance(a: str, b: str) -> dict[str, Column]:
    """Centroid distance and merge distance of two CF struct columns."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    la, lb = F.col(f"{a}.ls"), F.col(f"{b}.ls")
    return {
        "centroid_distance": vec.distance(vec.divide(la, na), vec.divide(lb, nb)),
        "merge_distance": diameter(na + nb, vec.plus(la, lb),
                                   vec.plus(F.col(f"{a}.ss"), F.col(f"{b}.ss")))}


def cell_width(threshold: float, dim: int) -> float:
    """Cells of this width have radius at most `threshold`, whatever they hold."""
    return 2.0 * threshold / math.sqrt(dim)


def cf_leaves(df: DataFrame, keys: list[str], column: str, dim: int | None = None,
              threshold: float = schema.RADIUS_THRESHOLD) -> DataFrame:
    """Leaf CFs of radius at most `threshold` per key.

    `column` is a number, or a vector of `dim` numbers.  The leaf is the grid
    cell, so the result does not depend on the order of arrival, and leaves of
    parts of the data merge by `cf_merge`.
    """
    width = cell_width(threshold, dim or 1)
    x = F.col(column)
    if dim is None:
        df = df.select(*keys, F.floor(x / width).alias("leaf_id"),
                       F.array(x.cast("double")).alias("features"))
    else:
        df = df.select(*keys, F.transform(x, lambda v: F.floor(v / width)).alias("leaf_id"),
                       x.alias("features"))
    return cf_build(df, [*keys, "leaf_id"], "features", dim or 1)


def nearest_leaf(readings: DataFrame, leaves: DataFrame, keys: list[str], column: str,
                 row_id: str) -> DataFrame:
    """Nearest leaf of the same key for each reading; ties go to the lowest leaf.

    One scan instead of readings x leaves: leaves and readings are put in one
    order per key by position on the axis, and the nearest leaf is the last one
    before or the first one after.  For 1-D leaves.
    """
    spot = F.col("ls")[0] / F.col("n")
    marks = leaves.select(*keys, spot.alias("__x"), F.col("leaf_id").alias("__leaf"),
                          F.lit(0).alias("__turn"), F.lit(None).cast("bigint").alias("__id"))
    asks = readings.select(*keys, F.col(column).alias("__x"),
                           F.lit(None).cast("bigint").alias("__leaf"), F.lit(1).alias("__turn"),
                           F.col(row_id).cast("bigint").alias("__id"))
    line = marks.unionByName(asks).withColumn("__tie", F.coalesce("__id", "__leaf"))
    mark = F.when(F.col("__turn") == 0, F.struct(F.col("__x").alias("x"), F.col("__leaf").alias("leaf")))
    scan = ordered(line, keys, ["__x", "__turn", "__tie"]).running(
        __below=Running("last", mark), __above=Running("last", mark, backward=True))
    asked = scan.result().filter("__turn = 1")
    down, up = F.col("__x") - F.col("__below.x"), F.col("__above.x") - F.col("__x")
    take_up = F.col("__below").isNull() | (up < down)
    return asked.select(
        *keys, F.col("__id").alias(row_id), F.col("__x").alias(column),
        F.when(take_up, F.col("__above.leaf")).otherwise(F.col("__below.leaf")).alias("leaf_id"),
        F.when(take_up, up).otherwise(down).alias("distance"))


def cf_compact(leaves: DataFrame, keys: list[str], threshold: float,
               rounds: int | None = None) -> DataFrame:
    """Neighbouring 1-D leaves joined while the joined radius keeps to `threshold`.

    In each round a leaf joins its neighbour when each is the other's nearest and
    the joined CF is small enough; so many joins happen at once and the number of
    rounds grows with the logarithm of the leaves.  Ends when no pair is left.
    """
    current = leaves.select(*keys, "leaf_id", "n", "ls", "ss")
    done = 0
    while rounds is None or done < rounds:
        paired = settle(_pair_leaves(current, keys, threshold))
        if paired.filter("joins").limit(1).count() == 0:
            return paired.drop("joins", "target")
        merged = cf_merge(paired.withColumn("leaf_id", F.col("target")), [*keys, "leaf_id"])
        current = merged
        done += 1
    return current


def _pair_leaves(leaves: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    here = leaves.withColumn("spot", F.col("ls")[0] / F.col("n"))
    me = F.struct("leaf_id", "n", F.col("ls")[0].alias("ls"), F.col("ss")[0].alias("ss"), "spot")
    order = ["spot", "leaf_id"]
    scan = ordered(here, keys, order)
    scan = scan.neighbour(-1, left=me).neighbour(1, right=me)

    def joined_radius(other: str) -> Column:
        n = F.col("n") + F.col(f"{other}.n")
        ls = F.array(F.col("ls")[0] + F.col(f"{other}.ls"))
        ss = F.array(F.col("ss")[0] + F.col(f"{other}.ss"))
        return F.sqrt(variance(n, ls, ss))

    def reach(other: str) -> Column:
        fits = F.col(other).isNotNull() & (joined_radius(other) <= threshold)
        return F.when(fits, F.abs(F.col(f"{other}.spot") - F.col("spot")))

    to_left, to_right = reach("left"), reach("right")
    choice = (F.when(to_left.isNull() & to_right.isNull(), F.lit(0))
              .when(to_right.isNull() | (to_left <= to_right), F.lit(-1)).otherwise(F.lit(1)))
    scan = scan.with_columns(choice=choice)
    scan = scan.neighbour(-1, left_choice=F.col("choice")).neighbour(1, right_choice=F.col("choice"))
    joins_left = (F.col("choice") == -1) & (F.col("left_choice") == 1)
    joins_right = (F.col("choice") == 1) & (F.col("right_choice") == -1)
    target = F.when(joins_left, F.col("left.leaf_id")).otherwise(F.col("leaf_id"))
    return scan.result().withColumns({
        "target": target, "joins": F.coalesce(joins_left | joins_right, F.lit(False)),
    }).drop("spot", "left", "right", "choice", "left_choice", "right_choice")


def leaf_state(readings: DataFrame, keys: list[str], order: list[str], column: str,
               threshold: float = schema.RADIUS_THRESHOLD) -> DataFrame:
    """Each reading with its leaf_id and that leaf's CF (n, ls, ss as numbers) just before the reading."""
    x = F.col(column)
    rows = readings.withColumn("leaf_id", F.floor(x / cell_width(threshold, 1)))
    return ordered(rows, [*keys, "leaf_id"], order).running(
        n=Running("sum", F.lit(1).cast("bigint"), inclusive=False),
        ls=Running("sum", x, inclusive=False), ss=Running("sum", x * x, inclusive=False)).result()


def every_nth(readings: DataFrame, keys: list[str], order: list[str], column: str, step: int) -> DataFrame:
    """The CF of a key (seq, ls, ss as numbers) after every `step`-th reading."""
    x = F.col(column)
    scan = ordered(readings, keys, order).running(
        seq=Running("sum", F.lit(1).cast("bigint")), ls=Running("sum", x), ss=Running("sum", x * x))
    return scan.result().filter(F.col("seq") % step == 0)


def cf_tree_stats(leaves: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Points, leaves and leaf sizes per key; with `counts` (keys, processed, outliers) the rate."""
    stats = leaves.groupBy(*keys).agg(
        F.sum("n").alias("total_points"), F.count(F.lit(1)).alias("total_clusters"),
        F.avg("n").alias("avg_cluster_size"), F.max("n").alias("max_cluster_size"),
        F.min("n").alias("min_cluster_size"))
    if counts is None:
        return stats
    return stats.join(counts, keys, "left").withColumn(
        "outlier_rate", ratio(F.col("outliers"), F.col("processed")))


def cluster_listing(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves with geometry and a dense id by centroid order."""
    shaped = cf_geometry(leaves).withColumn("__spot", F.col("centroid"))
    return (ordered(shaped, keys, ["__spot", "leaf_id"]).position("cluster_id").result()
            .withColumnRenamed("n", "point_count").drop("__spot"))


def cf_delta(before: DataFrame, after: DataFrame, keys: list[str], full: bool = False) -> DataFrame:
    """Leaves that are new, updated or removed since the earlier snapshot.

    `full` lists every leaf of the later snapshot, changed or not.
    """
    on = [*keys, "leaf_id"]
    old = before.select(*on, F.struct(*CF_COLUMNS).alias("old"))
    new = after.select(*on, F.struct(*CF_COLUMNS).alias("new"))
    both = old.join(new, on, "full")
    status = (F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed")
              .when(F.col("old") != F.col("new"), "updated").otherwise("unchanged"))
    both = both.withColumn("status", status)
    kept = both.filter("new is not null") if full else both.filter("status <> 'unchanged'")
    return kept.select(*on, "status", "new.*")
