"""Distances between points: nearest centroids, neighbour counts, kNN, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import vectors as vec
from gaugeline.plans.groups import Sizes, attach, unless_small
from gaugeline.plans.ordered import HOME, Running, ordered
from gaugeline.session import settle

# Grids serve so many dimensions; in more, most cells neighbour each other, and `metric` is used.
GRID_DIMS = 4
# Cell widths keep this relative distance from eps, so that rounding in the cell
# number can neither part neighbours nor join strangers.
MARGIN = 1e-9
# A side of a cell pair with at most this many points is measured point by point.
FEW = 32
# Entries of one tree node whose pairs are compared.
NODE_ENTRIES = 1_000
# Places that a cell may hold per neighbour asked for when a kNN search starts.
KNN_CELL = 8


def nearest_of(features: Column, centroids: Column) -> Column:
    """struct<distance, label> of the nearest in array<struct<label, centroid>>.

    Equal distances go to the lowest label.
    """
    return F.array_min(F.transform(centroids, lambda c: F.struct(
        vec.distance(features, c["centroid"]).alias("distance"), c["label"].alias("label"))))


def centroid_list(centroids: DataFrame) -> Column:
    """A table of k centroids (label, centroid) as one array value.

    k is a parameter of the caller, so the value's size is bounded by k vectors.
    """
    return centroids.agg(F.array_sort(F.collect_list(F.struct("label", "centroid")))).scalar()


def nearest_centroid(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Label and distance of the nearest of k centroids for each point; no shuffle."""
    best = nearest_of(F.col("features"), F.col("__all"))
    return (points.drop("label", "distance").withColumn("__all", centroid_list(centroids))
            .withColumn("__best", best)
            .withColumns({"label": F.col("__best.label"), "distance": F.col("__best.distance")})
            .drop("__all", "__best"))


def centroid_pairs(centroids: DataFrame, keys: list[str]) -> DataFrame:
    """Distances between the different centroids of each key (one row per ordered pair)."""
    a = centroids.select(*keys, F.col("label").alias("a"), F.col("centroid").alias("ca"))
    b = centroids.select(*keys, F.col("label").alias("b"), F.col("centroid").alias("cb"))
    if not keys:
        a, b, keys = a.withColumn("__one", F.lit(1)), b.withColumn("__one", F.lit(1)), ["__one"]
    return (attach(a, b, keys).filter("a <> b")
            .withColumn("distance", vec.distance(F.col("ca"), F.col("cb")))
            .drop("ca", "cb", "__one"))


def farthest_pair(centroids: DataFrame, keys: list[str]) -> DataFrame:
    """The two most distant centroids of each key; equal distances go to the lowest labels.

    A key is one tree node: its entries are held as one array and compared there.  A node of
    more than NODE_ENTRIES entries is an error.
    """
    many = F.count(F.lit(1)) > NODE_ENTRIES
    nodes = centroids.groupBy(*keys).agg(
        F.when(many, F.raise_error(F.lit(f"a node holds more than {NODE_ENTRIES} entries")).cast("boolean")).alias("__many"),
        F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("__e"))
    pairs = F.flatten(F.transform("__e", lambda a: F.transform(
        F.filter("__e", lambda b: b["label"] > a["label"]), lambda b: F.struct(
            vec.distance(a["centroid"], b["centroid"]).alias("distance"), (-a["label"]).alias("na"),
            (-b["label"]).alias("nb"), a["label"].alias("a"), b["label"].alias("b")))))
    top = nodes.filter("__many is null").select(*keys, F.array_max(pairs).alias("__p")).filter("__p is not null")
    return top.select(*keys, "__p.a", "__p.b", "__p.distance")


def bisect(centroids: DataFrame, keys: list[str]) -> DataFrame:
    """Each centroid's side: 0 or 1 for the nearer of the farthest pair (tie: 0)."""
    seeds = farthest_pair(centroids, keys).select(*keys, "a", "b")
    spot = centroids.select(*keys, F.col("label").alias("__l"), F.col("centroid").alias("__c"))
    one = ["__one"]
    mark = (lambda df: df) if keys else (lambda df: df.withColumn("__one", F.lit(1)))
    on = keys or one
    first = attach(mark(seeds), mark(spot), on).filter("a = __l").select(
        *on, F.col("__c").alias("ca"), "b")
    both = attach(first, mark(spot), on).filter("b = __l").select(*on, "ca", F.col("__c").alias("cb"))
    sided = attach(mark(centroids), both, on)
    to_a, to_b = vec.distance(F.col("centroid"), F.col("ca")), vec.distance(F.col("centroid"), F.col("cb"))
    return sided.withColumn("side", F.when(to_a <= to_b, 0).otherwise(1)).drop("ca", "cb", "__one")


# ---- one dimension ---------------------------------------------------------------------


def distinct_values(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values with their multiplicity and lowest id; copies collapse before the shuffle."""
    return points.groupBy(*keys, F.col(value).alias("x")).agg(
        F.count(F.lit(1)).alias("weight"), F.min("id").alias("first_id"))


def eps_counts(values: DataFrame, keys: list[str], eps: float,
               bound: Sizes | None = None) -> DataFrame:
    """Number of points within eps of each distinct value, itself included.

    The count is F(x + eps) - F(x - eps) of the running weight F, so values and
    the two ends of every range go through one ordered scan.
    """
    mass = values.select(*keys, "x", F.lit(1).alias("__turn"), "weight",
                         F.lit(None).cast("double").alias("__of"), F.lit(0).alias("__sign"))
    zero = F.lit(0).cast("bigint").alias("weight")
    low = values.select(*keys, (F.col("x") - eps).alias("x"), F.lit(0).alias("__turn"), zero,
                        F.col("x").alias("__of"), F.lit(-1).alias("__sign"))
    high = values.select(*keys, (F.col("x") + eps).alias("x"), F.lit(2).alias("__turn"), zero,
                         F.col("x").alias("__of"), F.lit(1).alias("__sign"))
    line = mass.unionByName(low).unionByName(high)
    line = line.withColumn("__tie", F.coalesce("__of", F.lit(0.0)))
    scan = ordered(line, keys, ["x", "__turn", "__tie"], bound=bound)
    scan = scan.running(__f=Running("sum", F.col("weight")))
    ends = scan.result().filter("__sign <> 0")
    counts = ends.groupBy(*keys, F.col("__of").alias("x")).agg(
        F.sum(F.col("__f") * F.col("__sign")).alias("neighbors"))
    return attach(values, counts, [*keys, "x"])


def knn_distance(points: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Distance to the k-th nearest other point of the key on a line.

    The k nearest are among the k before and the k after in value order.  With
    fewer than k others the farthest counts; a lone point has distance 0.
    """
    scan = ordered(points, keys, [value, "id"])
    if scan.split:
        scan = scan.position("__at")
    rows, parts = scan.blocks("__at", before=k, after=k)
    line = Window.partitionBy(*parts).orderBy(value, "id")
    x = F.col(value)
    gaps = [x - F.lag(x, i).over(line) for i in range(1, k + 1)]
    gaps += [F.lead(x, i).over(line) - x for i in range(1, k + 1)]
    near = F.array_sort(F.array_compact(F.array(*gaps)))
    rows = rows.withColumn("__near", near).filter(HOME)
    kth = F.coalesce(F.get("__near", F.least(F.lit(k), F.size("__near")) - 1), F.lit(0.0))
    return rows.withColumn("knn", kth).drop("__near", HOME, "_block", "__at", "_chunk")


# ---- any number of dimensions ----------------------------------------------------------


def _grid_only(dim: int) -> None:
    if dim > GRID_DIMS:
        raise ValueError(f"grid operators take up to {GRID_DIMS} dimensions, not {dim}")


def _around(cell: list[Column], reach: int = 1) -> Column:
    steps = product(range(-reach, reach + 1), repeat=len(cell))
    return F.array(*[F.array(*[c + s for c, s in zip(cell, step)]) for step in steps])


def eps_neighbors(points: DataFrame, eps: float, dim: int) -> DataFrame:
    """All pairs (id, other, distance) within eps, each point with itself included.

    Grid equi-join, then the exact distance; above GRID_DIMS dimensions a tree of balls.  Equal points are one place that is
    measured once.  The result has one row per neighbour pair; operators that need only counts or components list no pairs.
    """
    if dim > GRID_DIMS:
        from gaugeline.operators import metric

        return metric.eps_neighbors(points, eps)
    width = eps * (1 + MARGIN)
    places = settle(points.select("features").distinct())
    cell = [F.floor(F.col("features")[i] / width) for i in range(dim)]
    left = places.select("features", F.array(*cell).alias("__cell"))
    right = places.select(F.col("features").alias("__f"), F.explode(_around(cell)).alias("__cell2"))
    gap = vec.distance(F.col("features"), F.col("__f"))
    near = settle(left.join(right.hint("merge"), (F.col("__cell") == F.col("__cell2")) & (gap <= eps)).select(
        "features", "__f", gap.alias("distance")))
    # Either side can be far larger than its files.
    own = points.select("id", "features").hint("merge")
    other = points.select(F.col("id").alias("other"), F.col("features").alias("__f")).hint("merge")
    return near.join(own, "features").join(other, "__f").select("id", "other", "distance")


def knn_distance_vectors(points: DataFrame, k: int, dim: int) -> DataFrame:
    """Adds `knn`: the distance to the k-th nearest other point.  Above GRID_DIMS dimensions a tree of balls is used.

    Copies count as one place with a weight.  Cells start so small that few places share one, and a place
    looks at the cells around its own.  It is done when its k-th distance is within one cell width;
    the others go on with cells twice as wide, so sparse regions take more rounds and dense ones
    never meet wide cells.  With fewer than k others the farthest counts; a lone point has 0.
    """
    if dim > GRID_DIMS:
        from gaugeline.operators import metric

        return metric.knn_distance(points, k)
    x = F.col("features")
    places = settle(points.groupBy("features").agg(F.count(F.lit(1)).alias("weight")))
    ends = places.agg(F.count(F.lit(1)), *[F.min(x[i]) for i in range(dim)], *[F.max(x[i]) for i in range(dim)]).first()
    low, high = ([v or 0.0 for v in ends[a:a + dim]] for a in (1, 1 + dim))
    spread = max(b - a for a, b in zip(low, high)) or 1.0
    width = spread * (max(1, k) / max(1, ends[0])) ** (1 / dim)

    def spot(width: float) -> list[Column]:
        return [F.floor((x[i] - low[i]) / width) for i in range(dim)]

    while True:
        cells = [c.alias(f"c{i}") for i, c in enumerate(spot(width))]
        fullest = places.groupBy(*cells).count().agg(F.max("count")).first()[0] or 0
        if fullest <= KNN_CELL * k or width < spread * 1e-12:
            break
        width /= 2
    open_places, done = places.select("features", "weight"), None
    while True:
        cell = spot(width)
        asks = open_places.select(x.alias("ask"), F.col("weight").alias("own"), F.explode(_around(cell)).alias("cell"))
        met = asks.join(places.select(F.array(*cell).alias("cell"), "features", "weight"), "cell")
        near = met.groupBy("ask", "own").agg(F.array_sort(F.collect_list(F.struct(
            vec.distance(F.col("ask"), x).alias("d"), F.when(F.col("ask") == x, F.col("weight") - 1).otherwise(
                F.col("weight")).alias("w")))).alias("near"))
        reached = F.aggregate("near", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("d")),
                              lambda s, o: F.when((s["n"] >= k) | (o["w"] == 0), s).otherwise(
                                  F.struct((s["n"] + o["w"]).alias("n"), o["d"].alias("d"))))
        whole = width > 2 * spread
        judged = settle(near.select(F.col("ask").alias("features"), F.col("own").alias("weight"), reached.alias("r")))
        sure = F.lit(whole) | ((F.col("r.n") >= k) & (F.col("r.d") <= width * (1 - MARGIN)))
        ready = judged.filter(sure).select("features", F.col("r.d").alias("knn"))
        done = ready if done is None else done.unionByName(ready)
        open_places = judged.filter(~sure).select("features", "weight")
        if whole or open_places.isEmpty():
            return attach(points, done, ["features"])
        width *= 2


def cell_table(points: DataFrame, eps: float, dim: int) -> DataFrame:
    """Points with their cell: cells so small that all points of one are within eps."""
    width = eps / math.sqrt(dim) * (1 - MARGIN)
    return points.withColumn("cell", F.transform("features", lambda v: F.floor(v / width)))


def _box(df: DataFrame, keys: list[str], dim: int) -> DataFrame:
    x = F.col("features")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"),
        F.array(*[F.min(x[i]) for i in range(dim)]).alias("lo"),
        F.array(*[F.max(x[i]) for i in range(dim)]).alias("hi"))


def _box_gap(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """Smallest possible distance of points of two boxes."""
    apart = F.zip_with(F.zip_with(lo, hi2, lambda a, b: a - b),
                       F.zip_with(lo2, hi, lambda a, b: a - b),
                       lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.sqrt(vec.total(vec.squares(apart)))


def _box_span(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """Largest possible distance of points of two boxes."""
    across = F.zip_with(F.zip_with(hi, lo2, lambda a, b: a - b),
                        F.zip_with(hi2, lo, lambda a, b: a - b),
                        lambda p, q: F.greatest(p, q))
    return F.sqrt(vec.total(vec.squares(across)))


def neighbour_cells(boxes: DataFrame, eps: float, dim: int, within: float | None = None) -> DataFrame:
    """Pairs (cell, other) of different cells whose boxes come within `within` (eps, the cells' own, by default).

    Joined on a coarse grid; a cell stands for all its points, so the work depends on
    the number of cells only.
    """
    _grid_only(dim)
    within = eps if within is None else within
    reach = math.floor(math.sqrt(dim) * (1 + 2 * MARGIN) * within / eps) + 1
    coarse = [F.floor(F.col("cell")[i] / reach) for i in range(dim)]
    left = boxes.select("cell", "lo", "hi", F.array(*coarse).alias("__c"))
    right = boxes.select(F.col("cell").alias("other"), F.col("lo").alias("lo2"),
                         F.col("hi").alias("hi2"), F.explode(_around(coarse)).alias("__c2"))
    near = _box_gap(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2")) <= within
    return (left.join(right.hint("merge"), (F.col("__c") == F.col("__c2")) & (F.col("cell") != F.col("other")) & near)
            .select("cell", "other"))


def _sides(width: float, dim: int, level: int) -> list[float]:
    """Box sides after `level` halvings, which go round the axes: always a widest side is halved."""
    return [width / 2 ** ((level + dim - 1 - i) // dim) for i in range(dim)]


def _compared(points: DataFrame, pairs: DataFrame, eps: float, dim: int, within: float, nearest: bool) -> DataFrame:
    """Cell pairs (home, away) with points within `within`; with `nearest` also their closest pair (distance, id, other).

    `points` has cell, id and features.  Boxes decide many pairs: far boxes are out; boxes that fit into `within`
    are in, or bound the closest distance.  Where one side of an open pair holds at most FEW points, these are
    measured against the other side.  Two full sides are looked at again with the widest side of every box
    cut in half, which makes at most four pairs of one, most of them far or decided.  Boxes shrink to single
    places, where gap and span agree, so every pair is decided exactly and no two full
    boxes are ever paired point by point.
    """
    width = eps / math.sqrt(dim) * (1 - MARGIN)
    open_pairs = pairs.filter("cell < other").select(
        F.col("cell").alias("home"), F.col("other").alias("away"),
        F.col("cell").alias("a"), F.col("other").alias("b"))
    both = ["home", "away"]

    def part(level: int) -> Column:
        return F.array(*[F.floor(F.col("features")[i] / s) for i, s in enumerate(_sides(width, dim, level))])

    def side(df: DataFrame) -> DataFrame:
        return unless_small(df, many)

    found, level, many = None, 0, points.count()
    while True:
        parted = points.withColumn("part", part(level))
        boxes = _box(parted, ["part"], dim).select("part", "n", "first_id", "lo", "hi")
        one, two = (boxes.select(*[F.col(c).alias(x + c) for c in boxes.columns]) for x in "ab")
        args = [F.col(c) for c in ("alo", "ahi", "blo", "bhi")]
        judged = (open_pairs.join(side(one), F.col("a") == F.col("apart")).join(side(two), F.col("b") == F.col("bpart"))
                  .withColumns({"gap": _box_gap(*args), "span": _box_span(*args)}).filter(F.col("gap") <= within)
                  .select(*both, "a", "b", "gap", "span", "afirst_id", "bfirst_id",
                          F.least("an", "bn").alias("fewer"), (F.col("an") <= F.col("bn")).alias("a_fewer")))
        judged = settle(judged)
        if nearest:
            bound = judged.groupBy(*both).agg(F.min("span").alias("bound"))
            judged = judged.join(side(bound), both).filter("gap <= bound")
            sure = judged.filter("gap = span")
            undecided = judged.filter("gap < span")
        else:
            sure = judged.filter(F.col("span") <= within)
            undecided = judged.filter(F.col("span") > within).join(side(sure.select(*both).distinct()), both, "left_anti")
        ids = [F.least("afirst_id", "bfirst_id"), F.greatest("afirst_id", "bfirst_id")]
        closest = sure.select(*both, F.struct(F.col("span").alias("distance"), ids[0].alias("id"), ids[1].alias("other")).alias("p"))
        small = undecided.filter(F.col("fewer") <= FEW).select(
            *both, F.when(F.col("a_fewer"), F.col("a")).otherwise(F.col("b")).alias("part"),
            F.when(F.col("a_fewer"), F.col("b")).otherwise(F.col("a")).alias("full"))
        probes = small.join(side(parted.select("part", F.col("features").alias("probe"), F.col("id").alias("__id"))), "part").select(
            *both, F.col("full").alias("part"), "probe", "__id")
        met = attach(parted.select("part", "features", "id"), side(probes), ["part"])
        gap = vec.distance(F.col("probe"), F.col("features"))
        met = met.filter(gap <= within).select(*both, F.struct(
            gap.alias("distance"), F.least("id", "__id").alias("id"), F.greatest("id", "__id").alias("other")).alias("p"))
        best = closest.unionByName(met).groupBy(*both).agg(F.min("p").alias("p"))
        found = best if found is None else found.unionByName(best)
        full = undecided.filter(F.col("fewer") > FEW)
        if full.isEmpty():
            return settle(found.groupBy(*both).agg(F.min("p").alias("p")).select(*both, "p.*"))
        halves = parted.select("part", part(level + 1).alias("half")).distinct()
        open_pairs = settle(
            full.join(side(halves.select(F.col("part").alias("a"), F.col("half").alias("a2"))), "a")
            .join(side(halves.select(F.col("part").alias("b"), F.col("half").alias("b2"))), "b")
            .select(*both, F.col("a2").alias("a"), F.col("b2").alias("b")))
        live = open_pairs.select(F.explode(F.array(*both)).alias("cell")).distinct()
        points = settle(attach(points, side(live), ["cell"], "left_semi"))
        level += 1


def linked_cells(points: DataFrame, pairs: DataFrame, eps: float, dim: int) -> DataFrame:
    """Those of the neighbouring cell pairs that hold two points within eps."""
    return _compared(points, pairs, eps, dim, eps, False).select("home", "away")


def closest_between(points: DataFrame, pairs: DataFrame, eps: float, dim: int, within: float) -> DataFrame:
    """Closest points (distance, id, other) of each cell pair, if within `within`; cells are those of eps.

    Of equal distances the lowest ids count.
    """
    return _compared(points, pairs, eps, dim, within, True)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers 0 to n - 1 that each one reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links that connect what the links (a, b) connect: each end to one end of its component."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _roots(at[:len(a)], at[len(a):], len(ends))
    moved = np.flatnonzero(root != np.arange(len(ends)))
    return ends[moved], ends[root[moved]]


def _fewer_links(edges: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """Links that connect what the edges (a, b) connect: every task hands on a forest of some `at_once` edges at a time."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        size = whole.num_rows
        codes = pa.chunked_array([*whole["a"].chunks, *whole["b"].chunks]).combine_chunks().dictionary_encode()
        at = codes.indices.to_numpy()
        root = _roots(at[:size], at[size:], len(codes.dictionary))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(moved)), codes.dictionary.take(pa.array(root[moved]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= at_once:
                held = [stars(held)]
                size = held[0].num_rows
                if size > at_once // 2:
                    yield held[0]
                    held, size = [], 0
        if size:
            yield stars(held)

    return edges.mapInArrow(run, edges.schema)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Component of each vertex: the lowest id in it.  A vertex given more than once comes out once.

    vertices: id; edges: a, b.  In every round a vertex takes the lowest of its own
    label, the labels offered across its edges, those offered to its root, and its
    root's root; so paths halve and rounds grow with the logarithm of the graph.
    All joins are between stored tables, so adaptive execution can split a root
    that holds most vertices.  The edges are read once and may be far more than the
    vertices: tasks hand on forests of them, which connect the same.
    """
    fewer = _fewer_links(edges.select("a", "b").filter("a <> b"))
    links = settle(fewer.select(F.inline(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    labels = settle(vertices.select("id").distinct().select("id", F.col("id").alias("component")))
    many = labels.count()
    while True:
        mine = unless_small(labels.select(F.col("id").alias("a"), F.col("component").alias("ra")), many)
        theirs = unless_small(labels.select(F.col("id").alias("b"), F.col("component").alias("rb")), many)
        across = links.join(mine, "a").join(theirs, "b").filter("rb < ra")
        best = across.select(F.explode(F.array("a", "ra")).alias("id"), "rb").groupBy("id").agg(
            F.min("rb").alias("offer"))
        to_root = best.select(F.col("id").alias("component"), F.col("offer").alias("root_offer"))
        above = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        step = (labels.join(unless_small(best, many), "id", "left").join(unless_small(to_root, many), "component", "left")
                .join(unless_small(above, many), "component", "left"))
        lowest = F.least("component", "offer", "root_offer", "above")
        labels = settle(step.select("id", lowest.alias("component"),
                                    (lowest < F.col("component")).alias("moved")))
        if labels.filter("moved").isEmpty():
            return labels.drop("moved")
        labels = labels.drop("moved")
