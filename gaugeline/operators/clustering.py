"""k-means, single link, DBSCAN, the merge of CF leaves, and cluster jobs."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import schema
from gaugeline.functions import vectors as vec
from gaugeline.operators import metric, neighbors as nb
from gaugeline.plans.groups import Sizes, attach, measure, unless_small
from gaugeline.plans.ordered import Running, ordered, top_per_key
from gaugeline.session import settle


def cluster_centroids(points: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Mean vector and size of each label."""
    return points.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n"), vec.mean_of(F.col("features"), dim).alias("centroid"))


def label_counts(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(keys or []), "label").agg(F.count(F.lit(1)).alias("n"))


def distinct_labels(points: DataFrame) -> DataFrame:
    return points.select("label").distinct()


def cluster_totals(points: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters, points and noise points (label 0) per key."""
    return points.groupBy(*keys).agg(
        F.count_distinct(F.when(F.col("label") != 0, F.col("label"))).alias("n_clusters"),
        F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("label") == 0).alias("n_noise"))


def renumber_labels(points: DataFrame, keys: list[str], noise: object = None,
                    bound: Sizes | None = None) -> DataFrame:
    """Labels 1, 2, ... by the lowest id in each cluster; noise becomes 0.

    The numbers are given on a table with one row per cluster.
    """
    is_noise = F.col("label").isNull() if noise is None else F.col("label").eqNullSafe(F.lit(noise))
    clusters = points.filter(~is_noise).groupBy(*keys, "label").agg(F.min("id").alias("first_id"))
    names = (ordered(clusters, keys, ["first_id"], bound=bound).position("__at").result()
             .select(*keys, "label", (F.col("__at") + 1).alias("__new")))
    named = attach(points, names, [*keys, "label"], "left")
    return named.withColumn("label", F.coalesce("__new", F.lit(0)).cast("int")).drop("__new")


# ---- k-means ---------------------------------------------------------------------------


def kmeans_fit(points: DataFrame, k: int = schema.KMEANS_K, rounds: int = schema.KMEANS_ROUNDS,
               seed: int = 42, draw: Callable[[int], Column] | None = None) -> DataFrame:
    """k-means with D² seeding; adds label (0-based) and distance to the own centroid.

    Rounds end when no label changes, or after `rounds`; an empty cluster keeps its centroid.  Fewer distinct points than k give
    as many clusters as points; rows without features get no label, an empty table gives no rows.  `draw(i)` may give
    other uniform numbers in (0, 1) for the i-th seed than the hash of the id.
    """
    rows = settle(points.drop("label", "distance"))
    current = d2_seeds(rows, k, seed, draw)
    if not current:
        return rows.withColumns({"label": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")})
    before, x, dim = None, F.col("features"), len(current[0])
    known = rows.filter("features is not null")
    for _ in range(rounds):
        label = nb.nearest_of(x, _centroid_literal(current))["label"]
        old = F.lit(-1) if before is None else nb.nearest_of(x, _centroid_literal(before))["label"]
        sums = known.select("features", label.alias("label"), old.alias("old")).groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("old")).alias("moved"), vec.sum_of(x, dim).alias("s"))
        found = sums.collect()  # one row per cluster
        if not any(r["moved"] for r in found):
            break
        before, current = current, list(current)
        for r in found:
            current[r["label"]] = [v / r["n"] for v in r["s"]]
    best = F.when(x.isNotNull(), nb.nearest_of(x, _centroid_literal(current)))
    return rows.withColumn("__best", best).withColumns(
        {"label": F.col("__best.label"), "distance": F.col("__best.distance")}).drop("__best")


def d2_seeds(points: DataFrame, k: int, seed: int = 42, draw: Callable[[int], Column] | None = None) -> list[list[float]]:
    """k starts, each drawn with a chance in proportion to its squared distance from the starts before it.

    The draw is a race: a point arrives after -ln(u) / D², u uniform by a hash of its id, and the first to arrive is chosen; so
    a start is one distributed minimum, and the same for any partitioning.  Copies of a start are never drawn.
    """
    chosen: list[list[float]] = []
    rows, x = points.filter("features is not null"), F.col("features")
    for i in range(k):
        hashed = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        far = F.pow(nb.nearest_of(x, _centroid_literal(chosen))["distance"], 2) if chosen else F.lit(1.0)
        time = -F.ln(draw(i) if draw else hashed) / F.nullif(far, F.lit(0.0))
        first = rows.withColumn("__time", time).filter("__time is not null").agg(
            F.min_by("features", F.struct("__time", "id"))).first()[0]
        if first is None:
            break
        chosen.append(list(first))
    return chosen


def _centroid_literal(centroids: list[list[float]]) -> Column:
    """Labelled centroids as one value, so that the plan does not grow with their number and dimension."""
    text = json.dumps([{"label": i, "centroid": c} for i, c in enumerate(centroids)])
    return F.from_json(F.lit(text), "array<struct<label:int,centroid:array<double>>>")


class Mixture(NamedTuple):
    """A Gaussian mixture with one variance per component and dimension, and the mean log likelihood of each round."""

    weights: list[float]
    means: list[list[float]]
    variances: list[list[float]]
    likelihood: list[float]


def _log_densities(mixture: Mixture) -> Column:
    """Per component the log of weight times density at `features`, as array<double>."""
    parts = [{"label": i, "mean": m, "half": [0.5 / s for s in v],
              "base": math.log(w) - 0.5 * sum(math.log(2 * math.pi * s) for s in v)}
             for i, (w, m, v) in enumerate(zip(mixture.weights, mixture.means, mixture.variances)) if w > 0]
    known = F.from_json(F.lit(json.dumps(parts)), "array<struct<label:int,mean:array<double>,half:array<double>,base:double>>")
    return F.transform(known, lambda c: F.struct(
        (c["base"] - vec.total(F.zip_with(vec.squares(F.zip_with(F.col("features"), c["mean"], lambda x, m: x - m)),
                                          c["half"], lambda d, h: d * h))).alias("log"), c["label"].alias("label")))


def _shares(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """`rows` with __best (log, label), __log (log likelihood) and __parts; the largest log is taken out before exp."""
    parts = rows.withColumn("__parts", _log_densities(mixture))
    # Of equal logs the lower label is best.
    best = parts.withColumn("__best", F.array_max(F.transform("__parts", lambda c: F.struct(
        c["log"].alias("log"), (-c["label"]).alias("order")))))
    return best.withColumn("__log", F.col("__best.log") + F.ln(vec.total(
        F.transform("__parts", lambda c: F.exp(c["log"] - F.col("__best.log"))))))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column of lists, and which rows have one."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(known.sum(), -1) if known.any() else flat.reshape(0, 1), known


def _merged(a: tuple, b: tuple) -> tuple:
    """Weight, mean and squares about the mean of two sets of points together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)


def _moments(points: DataFrame, mixture: Mixture) -> DataFrame:
    """Per component its weight n among the points, mean, squares about the mean, and a part of the log likelihood."""
    parts = [(i, w, np.array(m), np.array(v)) for i, (w, m, v) in enumerate(zip(mixture.weights, mixture.means, mixture.variances)) if w > 0]
    schema = "label int, n double, log double, mean array<double>, squares array<double>"

    def rows(found: dict, log: float) -> pa.RecordBatch:
        labels = list(found)
        return pa.RecordBatch.from_arrays([
            pa.array(labels, pa.int32()), pa.array([found[i][0] for i in labels], pa.float64()),
            pa.array([log if i == labels[0] else 0.0 for i in labels], pa.float64()),
            *[pa.array([found[i][k].tolist() for i in labels], pa.list_(pa.float64())) for k in (1, 2)]],
            ["label", "n", "log", "mean", "squares"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = {}, 0.0
        for batch in batches:
            x, _ = _vectors(batch.column("features"))
            if not len(x):
                continue
            logs = np.stack([math.log(w) - 0.5 * np.log(2 * math.pi * v).sum() - ((x - m) ** 2) @ (0.5 / v) for _, w, m, v in parts], 1)
            most = logs.max(1)
            log = most + np.log(np.exp(logs - most[:, None]).sum(1))
            total += float(log.sum())
            for k, (label, *_) in enumerate(parts):
                share = np.exp(logs[:, k] - log)
                n = float(share.sum())
                if n > 0:
                    mean = share @ x / n
                    own = n, mean, share @ (x - mean) ** 2
                    found[label] = _merged(found[label], own) if label in found else own
        if found:
            yield rows(found, total)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["n"], r["log"], r["mean"]))
        whole = held[0]["n"], np.array(held[0]["mean"]), np.array(held[0]["squares"])
        for r in held[1:]:
            whole = _merged(whole, (r["n"], np.array(r["mean"]), np.array(r["squares"])))
        yield rows({held[0]["label"]: whole}, math.fsum(r["log"] for r in held))

    return points.select("features").mapInArrow(shares, schema).groupBy("label").applyInArrow(merge, schema)


def gmm_model(points: DataFrame, k: int, dim: int, rounds: int = 100, tolerance: float = 1e-6, floor: float = 1e-6,
              seed: int = 42, draw: Callable[[int], Column] | None = None) -> Mixture:
    """A mixture of k Gaussians by expectation maximisation.

    Starts: D² seeds as means, the variances of all points, equal weights.  A round is one job: each point is shared
    among the components, and every task adds up weighted means and squares about them; one row per component
    comes back.  Points are moved to the mean of all before.  A variance is at
    least `floor` times that of all points, and a component without points keeps its place with weight 0.  Ends when
    the mean log likelihood gains less than `tolerance`, or after `rounds`.  Fewer distinct points than k give as many
    components; rows without features are left out; without any point the mixture is empty.
    """
    known = points.filter("features is not null").select("id", "features")
    x = F.col("features")
    whole = known.agg(F.count(F.lit(1)).alias("n"), vec.mean_of(x, dim).alias("mean"),
                      F.array(*[F.var_pop(x[i]) for i in range(dim)]).alias("var")).first()
    if not whole["n"]:
        return Mixture([], [], [], [])
    middle = list(whole["mean"])
    moved = settle(known.withColumn("features", F.zip_with(x, F.array(*map(F.lit, middle)), lambda a, m: a - m)))
    least = [floor * v if v > 0 else floor for v in whole["var"]]
    starts = d2_seeds(moved, k, seed, draw)
    now = Mixture([1 / len(starts)] * len(starts), starts, [[max(v, low) for v, low in zip(whole["var"], least)] for _ in starts], [])
    for _ in range(rounds):
        found = _moments(moved, now).collect()  # one row per component
        weights, means, variances = [0.0] * len(starts), list(now.means), list(now.variances)
        for r in found:
            label, n = r["label"], r["n"]
            weights[label], means[label] = n / whole["n"], list(r["mean"])
            variances[label] = [max(v / n, low) for v, low in zip(r["squares"], least)]
        log = sum(r["log"] or 0.0 for r in found) / whole["n"]
        done = bool(now.likelihood) and log - now.likelihood[-1] < tolerance
        now = Mixture(weights, means, variances, [*now.likelihood, log])
        if done:
            break
    return now._replace(means=[[a + m for a, m in zip(mean, middle)] for mean in now.means])


def gmm_fit(points: DataFrame, k: int, dim: int, rounds: int = 100, seed: int = 42, **how: object) -> DataFrame:
    """Gaussian mixture zones; adds label (0-based, the likeliest component) and the probability of it.

    `how` goes to `gmm_model`.  Rows without features get neither; an empty table gives no rows.
    """
    rows = settle(points.drop("label", "probability"))
    model = gmm_model(rows, k, dim, rounds, seed=seed, **how)
    if not model.weights:
        return rows.withColumns({"label": F.lit(None).cast("int"), "probability": F.lit(None).cast("double")})
    return _shares(rows, model).withColumns({
        "label": F.when(F.col("features").isNotNull(), -F.col("__best.order")),
        "probability": F.when(F.col("features").isNotNull(), F.exp(F.col("__best.log") - F.col("__log")))}).drop(
        "__parts", "__best", "__log")


def lloyd(points: DataFrame, keys: list[str], k: int, rounds: int, dim: int,
          seeds: DataFrame | None = None) -> DataFrame:
    """k-means of each key from evenly spaced starts, so the result is fixed.

    Start i lies at (i + 0.5) / k of the diagonal of the key's bounding box.  A round attaches the k
    centroids of the key (one row per key) to the vectors and adds up the new
    means with map-side combine; an empty cluster keeps its centroid.  Stops when
    no centroid moves.  A column `weight` counts a row so many times.  Without keys, `seeds`
    (label, centroid; k rows) may give other starts.
    Returns keys, label (0-based), centroid.
    """
    x = F.col("features")
    weight = F.col("weight") if "weight" in points.columns else F.lit(1)
    grouped = settle(points.select(*keys, "features", weight.alias("weight")))
    lo = [F.min(x[i]) for i in range(dim)]
    hi = [F.max(x[i]) for i in range(dim)]
    starts = F.array(*[F.struct(F.lit(c).alias("label"), F.array(*[
        a + (c + 0.5) / k * (b - a) for a, b in zip(lo, hi)]).alias("centroid")) for c in range(k)])
    centroids = grouped.groupBy(*keys).agg(starts.alias("__all"))
    if seeds is not None:
        centroids = seeds.agg(F.collect_list(F.struct(F.col("label").cast("int").alias("label"), "centroid")).alias("__all"))
    if not keys:
        return _lloyd_of_one(grouped, centroids, rounds, dim)
    centroids = settle(centroids)
    for _ in range(rounds):
        moved = _new_means(attach(grouped, centroids, keys, "inner"), keys, dim)
        updates = moved.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
            F.struct("label", "mean"))).alias("__new"))
        after = settle(attach(centroids, updates, keys).select(
            *keys, "__all", F.transform("__all", lambda c: F.struct(
                c["label"].alias("label"), F.coalesce(F.try_element_at(
                    F.col("__new"), c["label"]), c["centroid"]).alias("centroid"))).alias("__next")))
        centroids = after.select(*keys, F.col("__next").alias("__all"))
        if after.filter(F.col("__all") != F.col("__next")).isEmpty():
            break
    return centroids.select(*keys, F.inline("__all"))


def _nearest_labels(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the lowest of equal distances."""
    low, high = metric._bounds(x, centroids)
    label = low.argmin(1)
    i, j = np.nonzero(low <= high.min(1)[:, None])
    several = (np.bincount(i, minlength=len(x)) > 1)[i]
    i, j = i[several], j[several]
    order = np.lexsort((j, metric._exact(x, centroids, i, j), i))
    first = order[np.unique(i[order], return_index=True)[1]]
    label[i[first]] = j[first]
    return label


def _label_sums(rows: DataFrame, fits: dict[int, list[list[float]]]) -> DataFrame:
    """Per task, fit and label: number n and sum s of the vectors nearest to the centroid, of those that the fit sees."""
    centroids = {fit: np.array(cs, float) for fit, cs in fits.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {fit: np.zeros(len(cs), np.int64) for fit, cs in centroids.items()}
        s = {fit: np.zeros(cs.shape) for fit, cs in centroids.items()}
        for batch in batches:
            x, known = _vectors(batch.column("features"))
            for fit, cs in centroids.items():
                seen = x[batch.column(f"in{fit}").fill_null(False).to_numpy(zero_copy_only=False)[known]]
                if len(seen):
                    label = _nearest_labels(seen, cs)
                    n[fit] += np.bincount(label, minlength=len(cs))
                    for k in range(len(cs)):
                        s[fit][k] += seen[label == k].sum(0)
        found = [(fit, k) for fit in n for k in np.flatnonzero(n[fit]).tolist()]
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array([fit for fit, _ in found], pa.int32()), pa.array([k for _, k in found], pa.int32()),
                pa.array([int(n[fit][k]) for fit, k in found], pa.int64()),
                pa.array([s[fit][k].tolist() for fit, k in found], pa.list_(pa.float64()))], ["fit", "label", "n", "s"])

    return rows.mapInArrow(add, "fit int, label int, n bigint, s array<double>")


def lloyd_fits(points: DataFrame, starts: dict[int, list[list[float]]], rounds: int,
               drawn: Callable[[int], Column] | None = None) -> dict[int, list[list[float]]]:
    """k-means of several fits at once: one scan per round for all that have not settled.

    starts: the first centroids of each fit, a few vectors that travel as one value.  `drawn(fit)` says which points a
    fit sees.  A fit has settled when none of its centroids moves; an empty cluster keeps its centroid.
    """
    current, open_fits, x = {fit: [list(c) for c in cs] for fit, cs in starts.items()}, set(starts), F.col("features")
    dim = len(next(iter(starts.values()))[0])
    rows = settle(points.select("features", *[(drawn(fit) if drawn else F.lit(True)).alias(f"in{fit}") for fit in starts]))
    for _ in range(rounds):
        after = {fit: list(current[fit]) for fit in open_fits}
        sums = _label_sums(rows, {fit: current[fit] for fit in sorted(open_fits)}).groupBy("fit", "label").agg(
            F.sum("n").alias("n"), vec.sum_of(F.col("s"), dim).alias("s"))
        for r in sums.collect():  # one row per cluster
            after[r["fit"]][r["label"]] = [v / r["n"] for v in r["s"]]
        open_fits = {fit for fit, cs in after.items() if cs != current[fit]}
        current.update(after)
        if not open_fits:
            break
    return current


def nearest_label(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """Points with the label of the nearest of a few centroids."""
    return points.withColumn("label", nb.nearest_of(F.col("features"), _centroid_literal(centroids))["label"])


def _new_means(placed: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Weighted mean of the vectors nearest to each centroid in `__all`."""
    x, w = F.col("features"), F.col("weight")
    label = nb.nearest_of(x, F.col("__all"))["label"]
    sums = placed.select(*keys, "features", "weight", label.alias("label")).groupBy(
        *keys, "label").agg(F.sum("weight").alias("n"),
                            F.array(*[F.sum(x[i] * w) for i in range(dim)]).alias("s"))
    return sums.select(*keys, "label", vec.divide(F.col("s"), F.col("n")).alias("mean"))


def _lloyd_of_one(grouped: DataFrame, starts: DataFrame, rounds: int, dim: int) -> DataFrame:
    """Rounds for one set of centroids: k vectors travel to the driver and back as literals."""
    kind = "array<struct<label:int,centroid:array<double>>>"
    session = grouped.sparkSession
    current = {c["label"]: list(c["centroid"]) for c in starts.first()[0]}
    for _ in range(rounds):
        # One value, so that the plan does not grow with k and the dimension.
        literal = F.from_json(F.lit(json.dumps([{"label": c, "centroid": m} for c, m in sorted(current.items())])), kind)
        means = _new_means(grouped.withColumn("__all", literal), [], dim).collect()
        after = {**current, **{r["label"]: list(r["mean"]) for r in means}}
        if after == current:
            break
        current = after
    return session.createDataFrame(sorted(current.items()), "label int, centroid array<double>")


def assign(points: DataFrame, centroids: DataFrame, keys: list[str]) -> DataFrame:
    """Label and distance of the nearest centroid of the point's own key."""
    if not keys:
        return nb.nearest_centroid(points, centroids)
    lists = centroids.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("__all"))
    joined = attach(points.drop("label", "distance"), lists, keys, "inner")
    best = joined.withColumn("__best", nb.nearest_of(F.col("features"), F.col("__all")))
    return best.withColumns({"label": F.col("__best.label"),
                             "distance": F.col("__best.distance")}).drop("__all", "__best")


def cf_merge_cluster(leaves: DataFrame, dim: int, k: int = schema.MERGE_K,
                     rounds: int = schema.MERGE_ROUNDS) -> DataFrame:
    """Leaf CFs of many gateways fused to k clusters.

    Clusters the leaf centroids (each counts once), then per cluster: points,
    largest centroid distance, member gateways and the merged CF.  Ids from 1.
    Fewer leaves than k give as many clusters as leaves.  A cluster lists its distinct gateways, so
    use `member_gateways` where they are too many for one value.
    """
    spots = settle(leaves.withColumn("features", vec.divide(F.col("ls"), F.col("n"))))
    k = min(k, spots.limit(k).count())
    if k == 0:
        raise ValueError("no leaves to merge")
    centroids = lloyd(spots.select("features"), [], k, rounds, dim)
    placed = nb.nearest_centroid(spots, centroids)
    merged = placed.groupBy("label").agg(
        F.sum("n").alias("point_count"), F.max("distance").alias("radius"),
        F.collect_set("gateway_code").alias("__g"),
        vec.sum_of(F.col("ls"), dim).alias("ls"), vec.sum_of(F.col("ss"), dim).alias("ss"))
    return attach(centroids, merged, ["label"], "left").select(
        (F.col("label") + 1).alias("cluster_id"), "centroid",
        F.coalesce("point_count", F.lit(0)).alias("point_count"),
        F.coalesce("radius", F.lit(0.0)).alias("radius"),
        F.sort_array(F.coalesce("__g", F.array().cast("array<string>"))).alias("member_gateways"),
        "ls", "ss")


def member_gateways(members: DataFrame, cluster: str, gateway: str = "gateway_code") -> DataFrame:
    """Distinct gateways of each cluster, one row each."""
    return members.select(cluster, gateway).distinct()


# ---- single link -----------------------------------------------------------------------


def single_link_1d(points: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """k clusters per key on a line: cut at the k - 1 widest gaps.

    Of equal gaps the one at the lower value is cut first.  Labels 0-based in
    value order.
    """
    sizes = measure(points, keys)
    values = nb.distinct_values(points, keys, value)
    scan = ordered(values, keys, ["x"], bound=sizes).neighbour(-1, before=F.col("x"))
    gaps = scan.with_columns(gap=F.col("x") - F.col("before"))
    wide = gaps._with(gaps.df.filter("gap is not null"))
    cuts = top_per_key(wide, [F.col("gap").desc(), F.col("x")], k - 1)
    per_key = cuts.groupBy(*keys).agg(F.collect_list("x").alias("__cuts"))
    joined = attach(points, per_key, keys, "left")
    label = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")),
                            lambda c: c <= F.col(value)))
    return joined.withColumn("label", label).drop("__cuts")


def eps_components(points: DataFrame, eps: float, dim: int) -> DataFrame:
    """Components of the graph of points within eps; adds `component`, the lowest id.

    Points of one cell are always connected, so the graph is one of cells.
    """
    placed = settle(nb.cell_table(points, eps, dim))
    return _component_of_cells(placed, placed, eps, dim)


def _component_of_cells(points: DataFrame, core: DataFrame, eps: float, dim: int,
                        pairs: DataFrame | None = None) -> DataFrame:
    boxes = settle(nb._box(core, ["cell"], dim))
    if pairs is None:
        pairs = nb.neighbour_cells(boxes, eps, dim)
    links = nb.linked_cells(core, pairs, eps, dim)
    ids, many = boxes.select("cell", F.col("first_id").alias("id")), boxes.count()
    a = unless_small(ids.select(F.col("cell").alias("home"), F.col("id").alias("a")), many)
    b = unless_small(ids.select(F.col("cell").alias("away"), F.col("id").alias("b")), many)
    edges = links.join(a, "home").join(b, "away").select("a", "b")
    parts = nb.connected_components(ids.select("id"), edges)
    named = ids.join(unless_small(parts, many), "id").select("cell", "component")
    return attach(points, unless_small(named, many), ["cell"], "inner")


def single_link(points: DataFrame, k: int, dim: int) -> DataFrame:
    """k clusters by single link: label 0-based by lowest id.

    Single link at height t is the component split of the graph of points within
    t.  The height is bracketed by splits with more and with at most k parts, down to a
    factor of two.  The remaining merges are taken in the order of (distance, lowest ids), each from the
    closest points of two neighbouring cells of different parts, so no pairs of
    points are listed.  Copies of one point always stay together.  Above four dimensions the
    minimum spanning tree is built over a tree of balls and loses its k - 1 longest edges.
    """
    points = settle(points.drop("label"))
    x = F.col("features")
    copies = points.groupBy("features").agg(F.min("id").alias("label"))
    if copies.count() <= k:
        return renumber_from_zero(attach(points, copies, ["features"], "inner"))
    if dim > nb.GRID_DIMS:
        return renumber_from_zero(metric.single_link_components(points, k))
    spread = points.agg(*[F.max(x[i]) - F.min(x[i]) for i in range(dim)]).first()
    low, high, many = 0.0, max(math.hypot(*spread), 1e-12) * (1 + 1e-9), None
    while many is None or high > 2 * low:
        step = (low + high) / 2 if many is not None else high / 4
        split = settle(eps_components(points, step, dim))
        parts = split.select("component").distinct().count()
        if parts == k:
            return renumber_from_zero(split.drop("cell").withColumnRenamed("component", "label"))
        if parts > k:
            low, many = step, split
        else:
            high = step
    return renumber_from_zero(_merge_nearest(many, low, high, k, dim))


def _merge_nearest(split: DataFrame, low: float, high: float, k: int, dim: int) -> DataFrame:
    """Merge the parts of a split at `low` by their closest points, up to `high`, until k are left."""
    # All points of a cell are within `low`, so a cell belongs to one part.
    boxes = settle(nb._box(split, ["cell"], dim).join(
        split.groupBy("cell").agg(F.min("component").alias("part")), "cell"))
    many = boxes.count()
    part = unless_small(boxes.select("cell", "part"), many)
    pairs = (nb.neighbour_cells(boxes, low, dim, high)
             .join(part.withColumnRenamed("part", "la"), "cell")
             .join(part.select(F.col("cell").alias("other"), F.col("part").alias("lb")), "other")
             .filter("la <> lb").select("cell", "other"))
    closest = nb.closest_between(split, settle(pairs), low, dim, high)
    links = settle(
        closest.join(part.select(F.col("cell").alias("home"), F.col("part").alias("la")), "home")
        .join(part.select(F.col("cell").alias("away"), F.col("part").alias("lb")), "away")
        .groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        .agg(F.min(F.struct("distance", "id", "other")).alias("rank")))
    labels = split.select("id", "features", F.col("component").alias("label"))
    parts = settle(labels.select(F.col("label").alias("id")).distinct())
    names = parts.withColumn("component", F.col("id"))
    chosen, many = None, parts.count()
    while True:
        names = unless_small(names, many)
        # each part takes its first link to another part; together a spanning forest
        ends = (links.join(names.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a")
                .join(names.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
                .filter("ca <> cb"))
        picks = settle(ends.select("a", "b", "rank", F.explode(F.array("ca", "cb")).alias("c"))
                       .groupBy("c").agg(F.min_by(F.struct("a", "b", "rank"), "rank").alias("e"))
                       .select("e.*").distinct())
        if picks.isEmpty():
            break
        chosen = picks if chosen is None else settle(chosen.unionByName(picks).distinct())
        names = nb.connected_components(parts, chosen)
    merges = chosen.orderBy("rank").limit(many - k)
    merged = unless_small(nb.connected_components(parts, merges).withColumnRenamed("id", "label"), many)
    return attach(labels, merged, ["label"], "inner").drop("label").withColumnRenamed(
        "component", "label")


def renumber_from_zero(points: DataFrame) -> DataFrame:
    return renumber_labels(points, []).withColumn("label", F.col("label") - 1)


# ---- DBSCAN ----------------------------------------------------------------------------


def dbscan_1d(points: DataFrame, keys: list[str], value: str, eps: float = schema.DBSCAN_EPS,
              min_points: int = schema.DBSCAN_MIN_POINTS) -> DataFrame:
    """DBSCAN per key on a line; label 0 is noise, others by lowest id.

    Runs on distinct values with weights, so copies cost nothing.  Cores are
    values with enough weight within eps; cores closer than eps form one cluster;
    a border value takes, of the clusters before and after it within eps, the one
    whose first core has the lowest id.
    """
    sizes = measure(points, keys)
    values = settle(nb.distinct_values(points, keys, value))
    values = settle(nb.eps_counts(values, keys, eps, sizes))
    cores = values.filter(F.col("neighbors") >= min_points)
    scan = ordered(cores, keys, ["x"], bound=sizes).neighbour(-1, before=F.col("x"))
    apart = F.col("before").isNull() | (F.col("x") - F.col("before") > eps)
    cores = scan.with_columns(__new=apart.cast("int")).running(
        island=Running("sum", F.col("__new"))).result().select(*keys, "x", "first_id", "island")
    parts = cores.groupBy(*keys, "island").agg(F.min("first_id").alias("first_core"))
    cores = attach(cores, parts, [*keys, "island"], "inner").select(
        *keys, "x", F.struct("x", "first_core").alias("core"))
    line = attach(values.select(*keys, "x", "first_id"), cores, [*keys, "x"], "left")
    scan = ordered(line, keys, ["x"], bound=sizes).running(
        below=Running("last", F.col("core")), above=Running("last", F.col("core"), backward=True))
    x = F.col("x")
    by_below = F.when(x - F.col("below.x") <= eps, F.col("below.first_core"))
    by_above = F.when(F.col("above.x") - x <= eps, F.col("above.first_core"))
    found = settle(scan.result().select(
        *keys, "x", F.col("first_id").alias("id"), F.least(by_below, by_above).alias("label")))
    found = renumber_labels(found, keys, bound=sizes).select(*keys, F.col("x").alias(value), "label")
    return attach(points.drop("label"), found, [*keys, value], "inner")


def dbscan(points: DataFrame, eps: float = schema.DBSCAN_EPS,
           min_points: int = schema.DBSCAN_MIN_POINTS, dim: int = 2) -> DataFrame:
    """DBSCAN in any dimension; label 0 is noise, others by lowest id.

    Cells are so small that their points are all neighbours.  A cell with
    `min_points` points is all core.  Only points of sparser cells are measured
    against the points of neighbouring cells, at most `min_points` - 1 per cell,
    so a dense cell meets few probes.  Clusters are components of core cells.  Above four
    dimensions balls around pivots take the place of cells.
    """
    if dim > nb.GRID_DIMS:
        return renumber_labels(metric.dbscan_components(points, eps, min_points), [])
    placed = settle(nb.cell_table(points, eps, dim).select("id", "features", "cell"))
    boxes = settle(nb._box(placed, ["cell"], dim))
    pairs = settle(nb.neighbour_cells(boxes, eps, dim))
    dense = boxes.filter(F.col("n") >= min_points).select("cell")
    sparse = boxes.filter(F.col("n") < min_points)
    probes = attach(placed, sparse.select("cell", F.col("n").alias("same")), ["cell"], "inner")

    def near(targets: DataFrame) -> DataFrame:
        """Probes with each target point of another cell within eps."""
        asked = probes.select("cell", F.col("id").alias("probe"), F.col("features").alias("__p")).join(
            pairs, "cell").select(F.col("other").alias("cell"), "probe", "__p")
        met = attach(targets, asked, ["cell"], "inner")
        return met.filter(vec.distance(F.col("__p"), F.col("features")) <= eps)

    outside = near(placed).groupBy("probe").agg(F.count(F.lit(1)).alias("outside"))
    counted = probes.join(outside.withColumnRenamed("probe", "id"), "id", "left")
    few_core = counted.filter(F.col("same") + F.coalesce("outside", F.lit(0)) >= min_points)
    core = settle(attach(placed, dense, ["cell"], "left_semi").unionByName(
        few_core.select("id", "features", "cell")))
    if core.isEmpty():
        return points.withColumn("label", F.lit(0))
    core_boxes = core.select("cell").distinct()
    core_pairs = pairs.join(core_boxes, "cell", "left_semi").join(
        core_boxes.withColumnRenamed("cell", "other"), "other", "left_semi").select("cell", "other")
    core = settle(_component_of_cells(core, core, eps, dim, core_pairs))
    named = core.select("id", F.col("component").alias("label"))
    # border points: the lowest component among the cores within eps, own cell included
    border = probes.join(named, "id", "left_anti").select("id", "cell")
    away = near(core).groupBy("probe").agg(F.min("component").alias("label")).select(
        F.col("probe").alias("id"), "label")
    home = border.join(core.groupBy("cell").agg(F.min("component").alias("label")), "cell").select(
        "id", "label")
    offers = away.join(border, "id", "left_semi").unionByName(home)
    named = named.unionByName(offers.groupBy("id").agg(F.min("label").alias("label")))
    labelled = points.drop("label").join(named, "id", "left")
    return renumber_labels(labelled, [])


# ---- jobs ------------------------------------------------------------------------------


class Job(NamedTuple):
    points: DataFrame
    evaluation: DataFrame


ALGORITHMS = ("kmeans", "hierarchical", "dbscan")


def cluster_job(points: DataFrame, algorithm: str, dim: int, k: int = schema.KMEANS_K,
                eps: float = schema.DBSCAN_EPS, min_points: int = schema.DBSCAN_MIN_POINTS,
                silhouette: str = "squared") -> Job:
    """Cluster the points and score the result.

    points: id, features.  Returns id, features, label and the distance to the own
    cluster's centroid (null for noise), and one row of metrics without noise.
    """
    from gaugeline.operators.quality import evaluate_clusters

    if algorithm == "kmeans":
        labelled = kmeans_fit(points, k)
    elif algorithm == "hierarchical":
        labelled = single_link(points, k, dim)
    elif algorithm == "dbscan":
        labelled = dbscan(points, eps, min_points, dim)
    else:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    noise = 0 if algorithm == "dbscan" else None
    labelled = settle(labelled.select("id", "features", "label"))
    return Job(with_own_distance(labelled, dim, noise),
               evaluate_clusters(labelled, [], dim, noise=noise, silhouette=silhouette))


def with_own_distance(points: DataFrame, dim: int, noise: int | None = None) -> DataFrame:
    """Distance of each point to the centroid of its own label."""
    centers = cluster_centroids(points, [], dim).select("label", F.col("centroid").alias("__c"))
    rows = attach(points, centers, ["label"], "inner")
    gap = vec.distance(F.col("features"), F.col("__c"))
    if noise is not None:
        gap = F.when(F.col("label") != noise, gap)
    return rows.withColumn("distance", gap).drop("__c")
