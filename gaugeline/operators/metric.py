"""Neighbours in any number of dimensions, over a tree of balls around pivots.

Distinct places are divided among pivots drawn from them, each place to its nearest one, and every part with more than
LEAF places is divided again by pivots of its own.  A node of the tree is a ball: its pivot and the largest distance
of its places from it.  Two nodes are looked at together only while the triangle inequality cannot decide them: balls
too far apart are left out, balls that lie within reach as a whole are taken as a whole, and the others
are replaced by their children, level by level in joins on the parents.  Only pairs of leaves that stay undecided are
measured place by place, and dense regions are decided by their balls.  Leaves are dealt to blocks in order of their
paths; a task measures all open pairs of two blocks, so a leaf is sent to a task per block and not per pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import vectors as vec
from gaugeline.operators.neighbors import connected_components, star_links
from gaugeline.plans.groups import attach
from gaugeline.plans.ordered import Running, ordered
from gaugeline.session import settle

# Pivots that divide a node, and places of a leaf at most.
FAN = 16
LEAF = 2048
# Coordinates of a block of leaves take some so many bytes; places that fill fewer blocks go to at most so many smaller ones.
BLOCK_BYTES = 16 << 20
BLOCKS = 16
# Columns of a matrix of distances, and links and counts that a task gathers, before they are worked on.
WIDE = 2048
GATHERED = 1 << 20
# Nearest places that a place keeps while a spanning tree grows.
NEAREST = 8
# Points of one place that a list of ids holds, or some more.
COPIES = 512
# Balls are compared with this relative allowance for rounding.
MARGIN = 1e-9
_LONGEST = 1e300


class Tree(NamedTuple):
    """nodes: node, parent, leaf, center, radius, weight; places: id (lowest of the copies), features, weight, node (its leaf).

    A node is the path of its slots from the root, the empty path, whose ball is all space.
    """

    nodes: DataFrame
    places: DataFrame


def pivot_tree(points: DataFrame) -> Tree:
    """The tree over the distinct vectors of `points` (id, features).  Rows without features are left out."""
    places = settle(points.filter("features is not null").groupBy("features").agg(
        F.count(F.lit(1)).alias("weight"), F.min("id").alias("id")))
    count, weight = places.agg(F.count(F.lit(1)), F.sum("weight")).first()
    nodes = places.sparkSession.createDataFrame(
        [("", None, count <= LEAF, [], _LONGEST, weight or 0)],
        "node string, parent string, leaf boolean, center array<double>, radius double, weight bigint")
    rest, done, level = places.withColumn("node", F.lit("")), None, 0
    while count > LEAF:
        drawn = F.xxhash64("features", F.lit(level))
        pivots = rest.withColumn("h", drawn).groupBy("node", F.pmod("h", F.lit(FAN)).cast("int").alias("slot")).agg(
            F.min_by("features", F.struct("h", "features")).alias("center"))
        pivots = settle(pivots.withColumn("child", F.concat("node", F.lower(F.hex("slot")))))
        lists = pivots.groupBy("node").agg(F.collect_list(F.struct("child", "center")).alias("pivots"))
        nearest = F.array_min(F.transform("pivots", lambda p: F.struct(
            vec.distance(F.col("features"), p["center"]).alias("distance"), p["child"].alias("child"))))
        parted = settle(attach(rest, lists, ["node"]).withColumn("best", nearest).select(
            "features", "weight", "id", F.col("best.child").alias("node"), "best.distance"))
        balls = parted.groupBy("node").agg(
            F.max("distance").alias("radius"), F.count(F.lit(1)).alias("places"), F.sum("weight").alias("weight"))
        made = settle(balls.join(pivots.select(F.col("node").alias("parent"), F.col("child").alias("node"), "center"), "node").select(
            "node", "parent", (F.col("places") <= LEAF).alias("leaf"), "center", "radius", "weight"))
        nodes = nodes.unionByName(made)
        parted = parted.drop("distance")
        closed = attach(parted, made.filter("leaf").select("node"), ["node"], "left_semi")
        done = closed if done is None else done.unionByName(closed)
        rest = settle(attach(parted, made.filter("not leaf").select("node"), ["node"], "left_semi"))
        level += 1
        count = LEAF + 1 if not rest.isEmpty() else 0
    return Tree(settle(nodes), settle(rest if done is None else done))


def _children(nodes: DataFrame, side: str, *more: str) -> DataFrame:
    """Node and child with the child's ball, named by side; a leaf is its own child."""
    columns = [F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("leaf", "center", "radius", *more)]]
    inner = nodes.filter("parent is not null").select(F.col("parent").alias(f"{side}_up"), *columns)
    return inner.unionByName(nodes.filter("leaf").select(F.col("node").alias(f"{side}_up"), *columns))


def _stepped(pairs: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """The pairs of children of the pairs (a, b), with gap and span: least and largest distance their places can have."""
    up = pairs.withColumnsRenamed({"a": "a_up", "b": "b_up"})
    met = up.join(_children(nodes, "a", *more), "a_up").join(_children(nodes, "b", *more), "b_up")
    apart = F.when(F.col("a") == F.col("b"), 0.0).otherwise(vec.distance(F.col("a_center"), F.col("b_center")))
    reach = F.col("a_radius") + F.col("b_radius")
    return met.withColumn("apart", apart).withColumns({
        "gap": F.col("apart") - reach - MARGIN * (F.col("apart") + reach), "span": (F.col("apart") + reach) * (1 + MARGIN)})


def _root(tree: Tree) -> DataFrame:
    root = tree.nodes.filter("node = ''")
    return root.select(F.col("node").alias("a"), F.col("node").alias("b"))


def close_nodes(tree: Tree, eps: float, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a <= b, of nodes within eps as a whole, and of leaves to be measured.

    Every two places are under exactly one of these pairs, or more than eps apart.  Without
    `whole` every pair comes down to leaves.
    """
    sure = leaves = None
    pairs = _root(tree)
    while True:
        judged = _stepped(pairs, tree.nodes).filter((F.col("a") <= F.col("b")) & (F.col("gap") <= eps))
        judged = settle(judged.select("a", "b", ((F.col("span") <= eps) & F.lit(whole)).alias("sure"),
                                      (F.col("a_leaf") & F.col("b_leaf")).alias("leaves")))
        found, ends = judged.filter("sure").select("a", "b"), judged.filter("leaves and not sure").select("a", "b")
        sure = found if sure is None else sure.unionByName(found)
        leaves = ends if leaves is None else leaves.unionByName(ends)
        pairs = judged.filter("not leaves and not sure").select("a", "b")
        if pairs.isEmpty():
            return sure, leaves


def _packs(places: DataFrame, *columns: str) -> DataFrame:
    """Per leaf its places in order of id: lists of the columns, and all coordinates in one list."""
    packed = places.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("id", "features", *columns))).alias("p"))
    return packed.select("node", F.col("p.id").alias("id"), *[F.col(f"p.{c}").alias(c) for c in columns],
                         F.flatten("p.features").alias("x"))


def _blocks(places: DataFrame) -> DataFrame:
    """The block of each leaf: neighbours in order of their paths share one, and a block has about as many places as another."""
    leaves = settle(places.groupBy("node").agg(F.count(F.lit(1)).alias("places"), F.max(F.size("features")).alias("dim")))
    total, dim = leaves.agg(F.sum("places"), F.max("dim")).first()
    rows = max(1, BLOCK_BYTES // (8 * max(1, dim or 1)))
    rows = max(1, min(rows, max(LEAF, math.ceil((total or 0) / BLOCKS))))
    at = ordered(leaves, [], ["node"]).running(at=Running("sum", F.col("places"))).result()
    return settle(at.select("node", F.floor((F.col("at") - 1) / rows).cast("int").alias("block")))


def _bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above the squared distances of two sets of vectors, apart by no more than rounding."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    slack = 4 * (x.shape[1] + 8) * np.finfo(float).eps
    both, cross = xx[:, None] + yy[None], x @ y.T
    cross *= 2
    return both * (1 - slack) - cross, both * (1 + slack) - cross


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows i of x from the rows j of y; a slice at a time."""
    out = np.empty(len(i))
    for k in range(0, len(i), 1 << 15):
        part = slice(k, k + (1 << 15))
        out[part] = np.sqrt(((x[i[part]] - y[j[part]]) ** 2).sum(-1))
    return out


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Whether rows are within eps; distances are taken where the bounds leave it open."""
    low, high = _bounds(x, y)
    near = high <= eps * eps * (1 - MARGIN)
    i, j = np.nonzero((low <= eps * eps * (1 + MARGIN)) & ~near)
    near[i, j] = _exact(x, y, i, j) <= eps
    return near


# A column of lists is all their entries and the size of each list.
Rows = dict[str, "np.ndarray | tuple[np.ndarray, np.ndarray]"]
# Two sides of places, with `parts`: (leaf, first row, last row + 1); and whether both are one leaf.
Met = Iterable[tuple[Rows, Rows, bool]]
Made = dict[str, "pa.Array | np.ndarray"]


def _column(values: pa.Array) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    if not pa.types.is_list(values.type):
        return values.to_numpy(zero_copy_only=False)
    entries = values.flatten()
    # Numbers with nulls among them would turn into floats.
    flat = np.array(entries.to_pylist(), object) if entries.null_count else entries.to_numpy(zero_copy_only=False)
    return flat, values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(sides: list[Rows]) -> Rows:
    """Some leaves as one side."""
    if len(sides) == 1:
        return sides[0]
    ends = np.cumsum([0, *[len(s["id"]) for s in sides]])
    whole = {n: tuple(map(np.concatenate, zip(*[s[n] for s in sides]))) if isinstance(own, tuple) else np.concatenate([s[n] for s in sides])
             for n, own in sides[0].items() if n != "parts"}
    return {**whole, "parts": [(s["parts"][0][0], int(a), int(b)) for s, a, b in zip(sides, ends, ends[1:])]}


def _measured(pairs: DataFrame, places: DataFrame, columns: list[str], schema: str,
              work: Callable[[Met], Iterator[Made]]) -> DataFrame:
    """Rows that `work` makes of the pairs of leaves of two blocks, which it gets one leaf and several others at a time."""
    names, wide = ["id", *columns], WIDE
    block = _blocks(places)
    sides = [block.select(F.col("node").alias(s), F.col("block").alias(f"block_{s}")) for s in "ab"]
    dealt = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b")
    both = ["block_a", "block_b"]
    asked = dealt.groupBy(*both, F.col("a").alias("node")).agg(F.collect_list("b").alias("others")).unionByName(
        dealt.select(*both, F.col("b").alias("node")).distinct().withColumn("others", F.lit(None).cast("array<string>")))
    # Tables of pairs are far larger than their files, so they are not for broadcast.
    rows = asked.hint("merge").join(_packs(places, *columns), "node")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, other = [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in ("node", "others", "x", *names)}
                held = {n: _column(row[n].values) for n in names}
                held["x"] = row["x"].values.to_numpy(zero_copy_only=False).reshape(len(held["id"]), -1)
                held["parts"] = [(row["node"].as_py(), 0, len(held["id"]))]
                if row["others"].is_valid:
                    asking.append((held, row["others"].as_py()))
                else:
                    other[row["node"].as_py()] = held

        def met() -> Met:
            for a, names in asking:
                own, held, size = a["parts"][0][0], [], 0
                if own in names:
                    yield a, a, True
                for name in sorted(n for n in names if n != own):
                    held.append(other[name])
                    size += len(other[name]["id"])
                    if size >= wide:
                        yield a, _joined(held), False
                        held, size = [], 0
                if held:
                    yield a, _joined(held), False

        for made in work(met()):
            if len(next(iter(made.values()))):
                yield pa.RecordBatch.from_pydict(made)

    return rows.groupBy(*both).applyInArrow(run, schema)


def _sides(a: Rows, b: Rows, same: bool, *matrices: np.ndarray) -> Iterator[tuple]:
    """Each side with the other one and matrices whose rows are its own."""
    yield a, b, *matrices
    if not same:
        yield b, a, *[m.T for m in matrices]


def _prefixes(node: str) -> Column:
    """All ancestors of a node, itself included."""
    return F.transform(F.sequence(F.lit(0), F.length(node)), lambda n: F.substr(F.col(node), F.lit(1), n))


def _upwards(leaves: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates over the leaves below every node."""
    return leaves.withColumn("node", F.explode(_prefixes("node"))).groupBy("node").agg(*aggregates)


def _downwards(tree: Tree, by_node: DataFrame, aggregate: Column) -> DataFrame:
    """(node, aggregate) of the rows of `by_node` at every leaf or above it."""
    leaves = tree.nodes.filter("leaf").select(F.col("node").alias("end"))
    spread = leaves.withColumn("node", F.explode(_prefixes("end")))
    return attach(spread, by_node, ["node"], "inner").groupBy(F.col("end").alias("node")).agg(aggregate)


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))


def _unordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, whichever way round it was found."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_members(points: DataFrame, tree: Tree, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places with `members`, the ids of their points, and the pairs of leaves (a, b).

    A place of many points comes in several parts of some COPIES members, under leaves of their own.
    """
    if tree.places.filter("weight > 1").isEmpty():
        return tree.places.filter("id is not null").select("node", "id", "features", F.array("id").alias("members")), pairs
    weights = tree.places.filter("id is not null").select("features", "node", F.col("id").alias("place"), "weight")
    parts = F.ceil(F.col("weight") / COPIES)
    placed = attach(points.select("id", "features"), weights, ["features"]).withColumn(
        "part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    # A list leaves out nulls, but not rows that hold one.
    held = settle(placed.groupBy("features", "node", "place", "part").agg(F.collect_list(F.struct("id")).alias("m")).select(
        F.concat_ws("/", "node", F.when(F.col("part") > 0, F.col("part"))).alias("node"), F.col("place").alias("id"), "features",
        F.col("m.id").alias("members")))
    names = held.select("node", F.substring_index("node", "/", 1).alias("leaf")).distinct()
    ends = [names.select(F.col("leaf").alias(s), F.col("node").alias(f"{s}_node")) for s in "ab"]
    apart = pairs.join(ends[0], "a").join(ends[1], "b").filter("a <> b or a_node <= b_node")
    return held, apart.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def _members_of(a: Rows, b: Rows, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, other, distance) of the points of the places i of a and j of b, some GATHERED at a time."""
    (ids, sizes), (others, widths) = a["members"], b["members"]
    if len(ids) == len(sizes) and len(others) == len(widths):
        yield ids[i], others[j], d
        return
    first, begin = (np.cumsum(n) - n for n in (sizes, widths))
    rows = sizes[i] * widths[j]
    ends = np.cumsum(rows)
    start = 0
    while start < len(i):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + GATHERED, "right")))
        n = rows[start:end]
        at = np.repeat(np.arange(start, end), n)
        within = np.arange(len(at)) - np.repeat(ends[start:end] - before - n, n)
        p, q = np.divmod(within, widths[j[at]])
        yield ids[first[i[at]] + p], others[begin[j[at]] + q], d[at]
        start = end


def eps_neighbors(points: DataFrame, eps: float) -> DataFrame:
    """All pairs (id, other, distance) within eps, each point with itself included; the pairs are the result.

    Equal points are one place that is measured once.  The tasks that measure make the rows of the result, both ways
    round, so no pairs are stored or shuffled on the way.
    """
    tree = pivot_tree(points)
    _, leaves = close_nodes(tree, eps, whole=False)
    kind = points.schema["id"].dataType.simpleString()
    places, leaves = _with_members(points, tree, leaves)

    def near(met):
        for a, b, same in met:
            low, _ = _bounds(a["x"], b["x"])
            i, j = np.nonzero(np.triu(low <= eps * eps * (1 + MARGIN)) if same else low <= eps * eps * (1 + MARGIN))
            d = _exact(a["x"], b["x"], i, j)
            hit = d <= eps
            for p, q, gap in _members_of(a, b, i[hit], j[hit], d[hit]):
                yield {"id": p, "other": q, "distance": gap}
            # A place with itself has both ways already.
            hit &= (i != j) if same else True
            for p, q, gap in _members_of(a, b, i[hit], j[hit], d[hit]):
                yield {"id": q, "other": p, "distance": gap}

    return _measured(leaves, places, ["members"], f"id {kind}, other {kind}, distance double", near)


def neighbour_counts(tree: Tree, sure: DataFrame, leaves: DataFrame, eps: float) -> DataFrame:
    """The places with `neighbors`: the points within eps, copies and the point itself included."""
    kind = tree.places.schema["id"].dataType.simpleString()

    def added(held):
        ids, at = np.unique(np.concatenate([i for i, _ in held]), return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, np.concatenate([n for _, n in held]))
        return ids, total

    def count(met):
        held, size = [], 0
        for a, b, same in met:
            for x, y, near in _sides(a, b, same, _near(a["x"], b["x"], eps)):
                i, j = np.nonzero(near)
                n = np.zeros(len(x["id"]), np.int64)
                np.add.at(n, i, y["weight"][j])
                held.append((x["id"], n))
                size += len(n)
            if size > GATHERED:
                held = [added(held)]
                size = 0
        if held:
            ids, n = added(held)
            yield {"id": ids, "n": n}

    measured = _measured(leaves, tree.places, ["weight"], f"id {kind}, n bigint", count).groupBy("id").agg(F.sum("n").alias("n"))
    weights = tree.nodes.select(F.col("node").alias("b"), "weight")
    by_node = _both_ways(sure).join(weights, "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("w"))
    whole = _downwards(tree, by_node, F.sum("w").alias("w"))
    counted = attach(tree.places.join(measured, "id", "left"), whole, ["node"], "left")
    return counted.withColumn("neighbors", F.coalesce("n", F.lit(0)) + F.coalesce("w", F.lit(0))).drop("n", "w")


def dbscan_places(points: DataFrame, eps: float, min_points: int) -> tuple[Tree, DataFrame]:
    """The tree, and (id, component) of every place in a cluster: the lowest id of the cluster's cores.

    A place within eps of cores of several clusters that is no core itself takes the lowest component.  No
    pairs of places are listed: pairs of blocks hand on sums, forests of at most as many edges as places, and minima.
    """
    tree = pivot_tree(points)
    sure, leaves = (settle(pairs) for pairs in close_nodes(tree, eps))
    kind = tree.places.schema["id"].dataType.simpleString()
    places = settle(neighbour_counts(tree, sure, leaves, eps).select(
        "id", "features", "node", (F.col("neighbors") >= min_points).alias("core")))

    def links(met):
        held, size = [], 0
        for a, b, same in met:
            p, q = np.flatnonzero(a["core"]), np.flatnonzero(b["core"])
            i, j = np.nonzero(_near(a["x"][p], b["x"][q], eps))
            held.append((a["id"][p][i], b["id"][q][j]))
            size += len(i)
            if size > GATHERED:
                held = [star_links(*map(np.concatenate, zip(*held)))]
                size = 0
        if held:
            ends = star_links(*map(np.concatenate, zip(*held)))
            yield {"a": ends[0], "b": ends[1]}

    edges = _measured(leaves, places, ["core"], f"a {kind}, b {kind}", links)
    # Nodes within eps as a whole: all cores of both are connected, if both have any.
    first = settle(_upwards(places.filter("core").groupBy("node").agg(F.min("id").alias("first")), F.min("first").alias("first")))
    ends = (sure.join(first.select(F.col("node").alias("a"), F.col("first").alias("first_a")), "a")
            .join(first.select(F.col("node").alias("b"), F.col("first").alias("first_b")), "b"))
    joined = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(first, "node")
    cores = places.filter("core").select("id", F.explode(_prefixes("node")).alias("node"))
    edges = (edges.unionByName(ends.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))
             .unionByName(attach(cores, joined, ["node"], "inner").select(F.col("id").alias("a"), F.col("first").alias("b"))))
    parts = connected_components(places.filter("core").select("id"), edges.filter("a <> b"))
    places = settle(places.join(parts, "id", "left"))

    def nearest(met):
        """Per border place the lowest component among the cores within eps."""
        best: dict = {}
        for a, b, same in met:
            for x, y in ((a, b),) if same else ((a, b), (b, a)):
                mine, cores = np.flatnonzero(~x["core"].astype(bool)), np.flatnonzero(y["core"])
                if not len(mine) or not len(cores):
                    continue
                names, rank = np.unique(y["component"][cores], return_inverse=True)
                near = _near(x["x"][mine], y["x"][cores], eps)
                least = np.where(near, rank[None], len(names)).min(1, initial=len(names))
                hit = least < len(names)
                for place, offer in zip(x["id"][mine][hit].tolist(), names[least[hit]].tolist()):
                    best[place] = min(offer, best.get(place, offer))
        yield {"id": pa.array(best.keys(), id_type), "offer": pa.array(best.values(), id_type)}

    id_type = pa.string() if kind == "string" else pa.int64()
    offers = _measured(leaves, places, ["core", "component"], f"id {kind}, offer {kind}", nearest)
    lowest = _upwards(places.filter("core").groupBy("node").agg(F.min("component").alias("c")), F.min("c").alias("c"))
    by_node = _both_ways(sure).join(lowest.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(
        F.min("c").alias("c"))
    whole = _downwards(tree, by_node, F.min("c").alias("c"))
    border = places.filter("not core").select("id", "node")
    offers = offers.unionByName(attach(border, whole, ["node"], "inner").select("id", F.col("c").alias("offer")))
    taken = offers.groupBy("id").agg(F.min("offer").alias("component"))
    return tree, places.filter("core").select("id", "component").unionByName(taken)


def dbscan_components(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """`points` with `label`: the lowest core id of the cluster, null for noise."""
    tree, found = dbscan_places(points, eps, min_points)
    named = tree.places.select("features", "id").join(found, "id").select("features", F.col("component").alias("label"))
    return attach(points.drop("label"), named, ["features"], "left")


def knn_distance(points: DataFrame, k: int) -> DataFrame:
    """Adds `knn`: the distance to the k-th nearest other point.

    A node's bound is the least span to a node that holds k other points, so far nodes are left out early, also for an
    outlier beside a dense region.  Pairs of blocks hand on the k nearest per place, which are merged leaf by leaf
    as they come.  With fewer than k others the farthest counts; a lone point has 0.
    """
    tree = pivot_tree(points)
    total = tree.nodes.filter("node = ''").select("weight").first()[0]
    k = min(k, total - 1)
    if k < 1:
        return points.withColumn("knn", F.lit(0.0))
    pairs, leaves = _root(tree).withColumn("bound", F.lit(_LONGEST)), None
    while True:
        met = settle(_stepped(pairs, tree.nodes, "weight").select("a", "b", "a_leaf", "b_leaf", "gap", "span", "b_weight", "bound"))
        others = F.col("b_weight") - F.when(F.col("a") == F.col("b"), 1).otherwise(0)
        bounds = met.groupBy("a").agg(F.min(F.when(others >= k, F.col("span"))).alias("own"))
        near = met.join(bounds, "a").withColumn("bound", F.least("bound", "own")).filter("gap <= bound")
        near = settle(near.select("a", "b", "bound", (F.col("a_leaf") & F.col("b_leaf")).alias("leaves")))
        ends = near.filter("leaves").select("a", "b")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        pairs = near.filter("not leaves").select("a", "b", "bound")
        if pairs.isEmpty():
            break

    leaves = settle(_unordered(leaves))

    def taken(x, y, low, high, weight, best):
        """The k nearest of the rows of `best` (distances, weights) and of y, for each row of x."""
        bound = best[0][:, -1]
        if not np.isfinite(bound).all():
            last = min(k, high.shape[1]) - 1
            own = np.partition(np.where(weight > 0, high, np.inf), last, 1)[:, last]
            bound = np.minimum(bound, np.sqrt(np.maximum(own, 0.0)))
        i, j = np.nonzero((low <= (bound * bound * (1 + MARGIN))[:, None]) & (weight > 0))
        i, d, w = (np.concatenate(v) for v in zip(
            (np.repeat(np.arange(len(low)), k), best[0].reshape(-1), best[1].reshape(-1)),
            (i, _exact(x, y, i, j), np.broadcast_to(weight, low.shape)[i, j])))
        order = np.lexsort((d, i))
        i, d, w = i[order], d[order], w[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        return d[keep].reshape(-1, k), w[keep].reshape(-1, k)

    def nearest(met):
        best: dict = {}
        for a, b, same in met:
            low, high = _bounds(a["x"], b["x"])
            for x, y, below, above in _sides(a, b, same, low, high):
                weight = y["weight"][None]
                if same:
                    weight = np.broadcast_to(weight, low.shape) - np.eye(len(low), dtype=np.int64)
                for name, start, end in x["parts"]:
                    part = slice(start, end)
                    ids, *so_far = best.get(name) or (
                        x["id"][part], np.full((end - start, k), np.inf), np.zeros((end - start, k), np.int64))
                    best[name] = ids, *taken(x["x"][part], y["x"], below[part], above[part], weight, so_far)
        for name, (ids, d, w) in best.items():
            ends = pa.array(np.arange(len(d) + 1) * k, pa.int32())
            yield {"a": pa.array([name] * len(d)), "id": ids, "d": pa.ListArray.from_arrays(ends, pa.array(d.reshape(-1))),
                   "w": pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))}

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for place, d, w in zip(*(batch.column(c) for c in ("id", "d", "w"))):
                d, w = d.values.to_numpy(), w.values.to_numpy()
                if place in best:
                    d, w = np.concatenate([best[place][0], d]), np.concatenate([best[place][1], w])
                order = np.argsort(d, kind="stable")[:k]
                best[place] = d[order], w[order]
        kth = [float(d[min(np.searchsorted(np.cumsum(w), k), len(d) - 1)]) for d, w in best.values()]
        yield pa.RecordBatch.from_arrays([pa.array([p.as_py() for p in best], id_type), pa.array(kth)], ["id", "knn"])

    kind = tree.places.schema["id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()
    few = _measured(leaves, tree.places, ["weight"], f"a string, id {kind}, d array<double>, w array<bigint>", nearest)
    found = few.groupBy("a").applyInArrow(merge, f"id {kind}, knn double")
    return attach(points, tree.places.select("features", "id").join(found, "id").select("features", "knn"), ["features"])


def nearest_places(tree: Tree, k: int) -> DataFrame:
    """(id, other, distance) of the k nearest other places of every place; of equal distances the lowest ids count, which the
    smaller of the two decides first.  With fewer others than k all of them."""
    kind = tree.places.schema["id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()
    held = _upwards(tree.places.groupBy("node").agg(F.count(F.lit(1)).alias("n")), F.sum("n").alias("places"))
    nodes = settle(attach(tree.nodes, held, ["node"]))
    pairs, leaves = _root(tree).withColumn("bound", F.lit(_LONGEST)), None
    while True:
        met = settle(_stepped(pairs, nodes, "places").select("a", "b", "a_leaf", "b_leaf", "gap", "span", "b_places", "bound"))
        others = F.col("b_places") - F.when(F.col("a") == F.col("b"), 1).otherwise(0)
        bounds = met.groupBy("a").agg(F.min(F.when(others >= k, F.col("span"))).alias("own"))
        near = met.join(bounds, "a").withColumn("bound", F.least("bound", "own")).filter("gap <= bound")
        near = settle(near.select("a", "b", "bound", (F.col("a_leaf") & F.col("b_leaf")).alias("leaves")))
        ends = near.filter("leaves").select("a", "b")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        pairs = near.filter("not leaves").select("a", "b", "bound")
        if pairs.isEmpty():
            break

    def least(ids, i, d, other):
        """Which entries (number of the place, distance, other place) are among the k first of theirs, in order."""
        codes = np.unique(np.concatenate([ids[i], other]), return_inverse=True)[1] if ids.dtype == object else np.concatenate([ids[i], other])
        p, q = codes[:len(i)], codes[len(i):]
        order = np.lexsort((np.maximum(p, q), np.minimum(p, q), d, i))
        return order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]

    def nearest(met):
        best: dict = {}
        for a, b, same in met:
            low, high = _bounds(a["x"], b["x"])
            if same:
                np.fill_diagonal(high, np.inf)
            for x, y, below, above in _sides(a, b, same, low, high):
                for name, start, end in x["parts"]:
                    part = slice(start, end)
                    ids = x["id"][part]
                    d, other = best.get(name, (ids, None, None))[1:]
                    if d is None:
                        d, other = np.full((end - start, k), np.inf), np.repeat(ids, k).reshape(-1, k)
                    bound = d[:, -1]
                    if above.shape[1] > k and not np.isfinite(bound).all():
                        bound = np.minimum(bound, np.sqrt(np.maximum(np.partition(above[part], k - 1, 1)[:, k - 1], 0.0)))
                    i, j = np.nonzero(below[part] <= (bound * bound * (1 + MARGIN))[:, None])
                    if same:
                        i, j = i[i != j], j[i != j]
                    gaps = _exact(x["x"][part], y["x"], i, j)
                    i, gaps, far = (np.concatenate(v) for v in (
                        (np.repeat(np.arange(end - start), k), i), (d.reshape(-1), gaps), (other.reshape(-1), y["id"][j])))
                    keep = least(ids, i, gaps, far)
                    best[name] = ids, gaps[keep].reshape(-1, k), far[keep].reshape(-1, k)
        for name, (ids, d, other) in best.items():
            there = np.isfinite(d).reshape(-1)
            yield {"a": pa.array([name] * int(there.sum()), pa.string()), "id": pa.array(np.repeat(ids, k)[there], id_type),
                   "other": pa.array(other.reshape(-1)[there], id_type), "distance": d.reshape(-1)[there]}

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        ids, i = np.unique(whole["id"].to_numpy(), return_inverse=True)
        keep = least(ids, i, whole["distance"].to_numpy(), whole["other"].to_numpy())
        yield from whole.select(["id", "other", "distance"]).take(pa.array(keep)).combine_chunks().to_batches()

    few = _measured(settle(_unordered(leaves)), tree.places, [], f"a string, id {kind}, other {kind}, distance double", nearest)
    return few.groupBy("a").applyInArrow(merge, f"id {kind}, other {kind}, distance double")


def spanning_tree(tree: Tree) -> DataFrame:
    """Minimum spanning tree of the places: (distance, id, other), of equal distances the lowest ids first.

    Boruvka rounds: components take their nearest place outside.  Every place is measured once against the others and keeps its
    NEAREST nearest.  A component's edge is known from these lists unless all entries of one of its places lead inside and
    the last is nearer than the edge.  Only when the lists settle no component, all but the largest are measured again.
    """
    tree = Tree(tree.nodes, tree.places.filter("id is not null"))
    places = settle(tree.places.select("id", "features", "node", F.col("id").alias("component")))
    total, chosen = places.count(), None
    near = settle(nearest_places(tree, NEAREST)) if total > 1 else None
    while True:
        sizes = places.groupBy("component").count()
        largest = sizes.orderBy(F.desc("count"), "component").limit(2).collect()
        if len(largest) < 2:
            return chosen if chosen is not None else places.select(F.lit(0.0).alias("distance"), "id", F.col("id").alias("other")).limit(0)
        picks = settle(_listed(near, places.select("id", "component"), total))
        if picks.isEmpty():
            picks = _picked(tree, places, largest[0]["component"])
        chosen = settle(picks if chosen is None else chosen.unionByName(picks).distinct())
        named = connected_components(tree.places.select("id"), chosen.select(F.col("id").alias("a"), F.col("other").alias("b")))
        places = settle(tree.places.select("id", "features", "node").join(named, "id"))


def _listed(near: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Edges (distance, id, other) to the nearest place outside of the components for which the lists of nearest places settle it."""
    of, to = (labels.select(F.col("id").alias(n), F.col("component").alias(f"{n}_component")) for n in ("id", "other"))
    edge = F.struct("distance", F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))
    outside = F.col("id_component") != F.col("other_component")
    by_place = near.join(of.hint("merge"), "id").join(to.hint("merge"), "other").groupBy("id", "id_component").agg(
        F.min(F.when(outside, edge)).alias("first"), F.max(edge).alias("last"))
    # All others are in the list when it is as long as that.
    unseen = F.when(F.col("first").isNull() & F.lit(total > NEAREST + 1), F.col("last"))
    best = by_place.groupBy("id_component").agg(F.min("first").alias("e"), F.min(unseen).alias("unseen"))
    return best.filter("e is not null and (unseen is null or e < unseen)").select("e.*").distinct()


def _picked(tree: Tree, places: DataFrame, passive: object) -> DataFrame:
    """Edges (distance, id, other) to the nearest place outside of every component but `passive`, measured.

    A node's bound is the least span to a node that is sure to hold a place of another component, and nodes within one
    component are passed over, as are nodes of `passive`, whose places are only looked for.
    """
    kind = tree.places.schema["id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()

    def links(met):
        """Per component of the two blocks its nearest place outside, the lowest ids of equal distances."""
        best: dict = {}
        for a, b, same in met:
            for x, y in ((a, b),) if same else ((a, b), (b, a)):
                mine = np.flatnonzero(x["component"] != passive)
                if not len(mine):
                    continue
                below, above = _bounds(x["x"][mine], y["x"])
                inside = x["component"][mine][:, None] == y["component"][None]
                below[inside] = above[inside] = np.inf
                names, code = np.unique(x["component"][mine], return_inverse=True)
                names = names.tolist()
                bound = np.array([best[c][0] ** 2 * (1 + MARGIN) if c in best else np.inf for c in names])
                np.minimum.at(bound, code, above.min(1, initial=np.inf))
                # Without any place outside there is no candidate.
                bound = np.where(np.isfinite(bound), np.maximum(bound, 0.0), -np.inf)
                i, j = np.nonzero(below <= bound[code][:, None])
                gaps, ids = _exact(x["x"][mine], y["x"], i, j), x["id"][mine][i]
                for c, d, p, q in zip(code[i].tolist(), gaps.tolist(), ids.tolist(), y["id"][j].tolist()):
                    found = (d, p, q) if p < q else (d, q, p)
                    if names[c] not in best or found < best[names[c]]:
                        best[names[c]] = found
        kinds = (id_type, pa.float64(), id_type, id_type)
        columns = list(zip(*((c, *found) for c, found in best.items()))) or [[], [], [], []]
        yield {n: pa.array(list(c), t) for n, c, t in zip(("component", "distance", "id", "other"), columns, kinds)}

    parts = settle(_upwards(
        places.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")),
        F.min("low").alias("low"), F.max("high").alias("high")))
    nodes = attach(tree.nodes, parts, ["node"])
    pairs, leaves = _root(tree).withColumn("bound", F.lit(_LONGEST)), None
    while True:
        met = _stepped(pairs, nodes, "low", "high").filter(
            ((F.col("a_low") < F.col("a_high")) | (F.col("b_low") < F.col("b_high")) | (F.col("a_low") != F.col("b_low")))
            & ((F.col("a_low") < F.col("a_high")) | (F.col("a_low") != F.lit(passive))))
        outside = (F.col("b_low") < F.col("b_high")) | ((F.col("a_low") == F.col("a_high")) & (F.col("a_low") != F.col("b_low")))
        met = settle(met.select("a", "b", "a_leaf", "b_leaf", "gap", "bound", F.when(outside, F.col("span")).alias("span")))
        bounds = met.groupBy("a").agg(F.min("span").alias("own"))
        near = met.join(bounds, "a").withColumn("bound", F.least("bound", "own")).filter("gap <= bound")
        near = settle(near.select("a", "b", "bound", (F.col("a_leaf") & F.col("b_leaf")).alias("leaves")))
        ends = near.filter("leaves").select("a", "b")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        pairs = near.filter("not leaves").select("a", "b", "bound")
        if pairs.isEmpty():
            break
    found = _measured(settle(_unordered(leaves)), places, ["component"], f"component {kind}, distance double, id {kind}, other {kind}", links)
    return settle(found.groupBy("component").agg(F.min(F.struct("distance", "id", "other")).alias("e")).select("e.*").distinct())


def single_link_components(points: DataFrame, k: int) -> DataFrame:
    """`points` with `label`, the lowest id of its cluster: the spanning tree without its k - 1 longest edges."""
    tree = pivot_tree(points)
    edges = spanning_tree(tree)
    cut = edges.orderBy(F.desc("distance"), F.desc("id"), F.desc("other")).limit(k - 1)
    kept = edges.join(cut, ["distance", "id", "other"], "left_anti")
    parts = connected_components(tree.places.select("id"), kept.select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = tree.places.select("features", "id").join(parts, "id").select("features", F.col("component").alias("label"))
    return attach(points.drop("label"), named, ["features"], "inner")
