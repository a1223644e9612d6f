"""Parameter search: best k, neighbourhood radius, stability."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import schema
from gaugeline.operators import neighbors as nb
from gaugeline.operators.clustering import kmeans_fit
from gaugeline.operators.quality import (adjusted_rand, calinski_harabasz, davies_bouldin,
                                         silhouette_euclidean, silhouette_squared)
from gaugeline.plans.groups import attach, with_group_aggs
from gaugeline.plans.ordered import ordered
from gaugeline.session import settle

METRICS = ("silhouette", "davies_bouldin", "calinski_harabasz")


def find_optimal_k(points: DataFrame, dim: int, k_range: tuple[int, int] = (2, 10),
                   metric: str = "silhouette", euclidean: bool = False,
                   clustering: Callable[[DataFrame, int], DataFrame] = kmeans_fit) -> DataFrame:
    """Score of every k, with the best marked; of equal scores the lowest k is best.

    `clustering(points, k)` returns points with labels.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    points = settle(points.select("id", "features"))
    scores = None
    for k in range(k_range[0], k_range[1] + 1):
        labelled = settle(clustering(points, k).select("id", "features", "label"))
        if metric == "silhouette" and euclidean:
            score = silhouette_euclidean(labelled)
        elif metric == "silhouette":
            score = silhouette_squared(labelled, [], dim)  # linear; its column is still `silhouette`
        elif metric == "davies_bouldin":
            score = davies_bouldin(labelled, [], dim)
        else:
            score = calinski_harabasz(labelled, [], dim)
        row = score.select(F.lit(k).alias("k"), F.col(metric).alias("score"))
        scores = row if scores is None else scores.unionByName(row)
    scores = settle(scores)
    sign = -1 if metric == "davies_bouldin" else 1
    best = scores.agg(F.max_by("k", F.struct(F.col("score") * sign, -F.col("k")))).scalar()
    return scores.withColumns({"metric": F.lit(metric), "is_best": F.col("k") == best})


def sorted_knn_curve(points: DataFrame, keys: list[str], value: str | None, k: int = schema.KNN,
                     dim: int | None = None) -> DataFrame:
    """kNN distances of each key in ascending order with their 0-based rank.

    Points are numbers in the column `value`, or vectors of `dim` numbers, which take no keys.
    """
    if dim is not None and keys:
        raise ValueError("vectors take no keys")
    near = (nb.knn_distance(points, keys, value, k) if dim is None
            else settle(nb.knn_distance_vectors(points, k, dim)))
    distances = near.select(*keys, "id", "knn")
    return ordered(distances, keys, ["knn", "id"], size_of=points).position("rank").result()


def adaptive_eps(points: DataFrame, keys: list[str], value: str | None, k: int = schema.KNN,
                 min_samples: int = schema.DBSCAN_MIN_POINTS, dim: int | None = None) -> DataFrame:
    """DBSCAN eps per key: the knee of the sorted kNN curve, of numbers or of vectors.

    The curve is scaled to the unit square and fitted by a line; the point with
    the largest residual (of equal ones the first) gives eps.  Keys with fewer
    than min_samples + 1 points give 0 and low confidence.
    """
    tiny = 1e-10
    curve = sorted_knn_curve(points, keys, value, k, dim)
    curve = with_group_aggs(curve, keys, n=F.count(F.lit(1)), lo=F.min("knn"), hi=F.max("knn"))
    curve = curve.withColumns({
        "x": F.col("rank") / F.col("n"),
        "y": (F.col("knn") - F.col("lo")) / (F.col("hi") - F.col("lo") + tiny)})
    curve = settle(curve)
    n = F.count(F.lit(1))
    slope = F.covar_pop("x", "y") * n / (F.var_pop("x") * n + tiny)
    fits = curve.groupBy(*keys).agg(slope.alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
                                    n.alias("n_points"))
    fits = fits.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).drop("mx", "my")
    rows = attach(curve, fits, keys, "inner") if keys else curve.withColumns(
        {c: fits.select(c).scalar() for c in fits.columns})
    residual = F.abs(F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept")))
    knees = rows.withColumn("r", residual).groupBy(*keys, "n_points").agg(
        F.max_by(F.struct("rank", "knn", "r"), F.struct("r", -F.col("rank"))).alias("top"),
        F.avg("r").alias("mean_r"))
    enough = F.col("n_points") >= min_samples + 1
    eps = F.when(enough, F.col("top.knn")).otherwise(0.0)
    confidence = (F.when(~enough, "low")
                  .when((eps > 0) & (F.col("top.r") > 2 * F.col("mean_r")), "high")
                  .when((eps > 0) & (F.col("top.r") < 0.5 * F.col("mean_r")), "low")
                  .otherwise("medium"))
    return knees.select(*keys, eps.alias("suggested_eps"),
                        F.when(enough, F.col("top.rank")).alias("knee_index"),
                        confidence.alias("confidence"), "n_points")


def stability(points: DataFrame, clustering: Callable[[DataFrame], DataFrame] | Sequence[Callable[[DataFrame], DataFrame]],
              bootstraps: int = schema.BOOTSTRAPS, ratio: float = schema.BOOTSTRAP_RATIO,
              seed: int = 42, drawn: Callable[[int], Column] | None = None) -> DataFrame:
    """Mean adjusted Rand index over all pairs of subsample clusterings.

    A point is in sample b when its hash with b falls below the ratio, so samples
    repeat exactly on any cluster; `drawn(b)` may give another rule.  Two samples are compared on the
    points both hold; `pairs` counts those that share any.  A single sample agrees with itself: 1.
    `clustering` may be a list with one callable per sample.
    """
    points = settle(points)
    runs = None
    for b in range(bootstraps):
        hashed = F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(b)), F.lit(1_000_000))
        fit = clustering if callable(clustering) else clustering[b]
        labelled = fit(points.filter(drawn(b) if drawn else hashed < ratio * 1_000_000)).select(
            "id", F.col("label").alias("l"), F.lit(b).alias("b"))
        runs = labelled if runs is None else runs.unionByName(labelled)
    runs = settle(runs)
    one = runs.select("id", F.col("b").alias("b1"), F.col("l").alias("l1"))
    two = runs.select("id", F.col("b").alias("b2"), F.col("l").alias("l2"))
    pairs = one.join(two, "id").filter("b1 < b2")
    scores = adjusted_rand(pairs, ["b1", "b2"], "l1", "l2")
    return scores.agg(F.coalesce(F.avg("adjusted_rand"), F.lit(1.0)).alias("stability"),
                      F.count(F.lit(1)).alias("pairs"))
