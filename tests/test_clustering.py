"""Clusterings against plain loops on small data, hot cells and copies included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import clustering as cl, neighbors as nb


def points(spark, xs):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)],
                                 "id bigint, features array<double>")


def line(spark, xs, key=1):
    return spark.createDataFrame([(key, i, float(x)) for i, x in enumerate(xs)],
                                 "k int, id bigint, x double")


def labels(df):
    return [r.label for r in df.orderBy("id").collect()]


def bfs_dbscan(xs, eps, min_points):
    """Breadth-first DBSCAN in index order, relabelled by first appearance."""
    near = [[j for j in range(len(xs)) if math.dist(xs[i], xs[j]) <= eps] for i in range(len(xs))]
    out, cluster = [None] * len(xs), 0
    for i in range(len(xs)):
        if out[i] is not None or len(near[i]) < min_points:
            continue
        out[i], queue = cluster, [i]
        while queue:
            p = queue.pop(0)
            if len(near[p]) >= min_points:
                for q in near[p]:
                    if out[q] is None:
                        out[q] = cluster
                        queue.append(q)
        cluster += 1
    names = {}
    return [0 if c is None else names.setdefault(c, len(names) + 1) for c in out]


def link(xs, k):
    """Merge the closest pair of clusters until k are left; labels by lowest index."""
    clusters = [[i] for i in range(len(xs))]
    while len(clusters) > k:
        _, a, b = min((min(math.dist(xs[i], xs[j]) for i in clusters[a] for j in clusters[b]), a, b)
                      for a in range(len(clusters)) for b in range(a + 1, len(clusters)))
        clusters[a] += clusters.pop(b)
    out = [0] * len(xs)
    for label, members in enumerate(sorted(clusters, key=min)):
        for i in members:
            out[i] = label
    return out


@pytest.mark.parametrize("seed", [1])
def test_dbscan_1d(spark, any_split, seed):
    rng = random.Random(seed)
    xs = [rng.randint(0, 60) if rng.random() < 0.7 else 25 for _ in range(60)]
    got = labels(cl.dbscan_1d(line(spark, xs), ["k"], "x", 1.0, 4))
    assert got == bfs_dbscan([[x] for x in xs], 1.0, 4)


@pytest.mark.parametrize("dim, eps, seed", [(2, 1.5, 1), (3, 2.0, 2)])
def test_dbscan(spark, dim, eps, seed):
    rng = random.Random(seed)
    # a dense spot, copies of one point, and scattered points
    xs = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(30)]
    xs += [[5.0] * dim] * 12 + [[rng.uniform(-6, 8) for _ in range(dim)] for _ in range(40)]
    rng.shuffle(xs)
    assert labels(cl.dbscan(points(spark, xs), eps, 4, dim)) == bfs_dbscan(xs, eps, 4)


def test_dense_cells_are_joined_exactly(spark):
    """Two full cells whose closest points are just inside, and just outside, eps."""
    rng = random.Random(3)
    left = [[rng.uniform(0.0, 0.5), rng.uniform(0.0, 0.5)] for _ in range(60)] + [[0.6, 0.25]]
    for gap, parts in ((1.0, 1), (1.0001, 2)):
        right = [[0.6 + gap + rng.uniform(0.0, 0.5), 0.25] for _ in range(60)] + [[0.6 + gap, 0.25]]
        got = cl.eps_components(points(spark, left + right), 1.0, 2)
        assert got.select("component").distinct().count() == parts


def test_all_noise(spark):
    assert labels(cl.dbscan(points(spark, [[0, 0], [9, 9], [20, 0]]), 1.0, 2, 2)) == [0, 0, 0]


def test_single_link_1d(spark, any_split):
    rng = random.Random(4)
    xs = [float(x) for x in rng.sample(range(0, 400), 30)] + [7.0, 7.0]
    got = labels(cl.single_link_1d(line(spark, xs), ["k"], "x", 4))
    assert len(set(got)) == 4
    order = sorted(set(xs))
    gaps = sorted(range(1, len(order)), key=lambda i: (-(order[i] - order[i - 1]), order[i]))[:3]
    cuts = [order[i] for i in gaps]
    assert got == [sum(c <= x for c in cuts) for x in xs]


def test_four_value_groups(spark):
    xs = [c + d for c in (10, 20, 30, 40) for d in (0, 0.3, 0.5, 0.9, 1.1)]
    assert labels(cl.single_link_1d(line(spark, xs), ["k"], "x", 4)) == [i // 5 for i in range(20)]


def test_single_link(spark):
    rng = random.Random(5)
    xs = [[rng.gauss(cx, 0.6), rng.gauss(cy, 0.6)] for cx, cy in ((0, 0), (6, 0), (0, 7)) for _ in range(8)]
    assert labels(cl.single_link(points(spark, xs), 3, 2)) == link(xs, 3)


def test_single_link_with_equal_distances(spark):
    xs = [[0, 0], [1, 0], [2, 0], [3, 0], [4, 0], [5, 0]]
    got = labels(cl.single_link(points(spark, xs), 3, 2))
    assert got == link(xs, 3) == [0, 0, 0, 0, 1, 2]


def test_components(spark):
    rng = random.Random(6)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(i, i + 1) for i in range(40, 55)]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = nb.connected_components(spark.range(n), spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.id: r.component for r in got.collect()} == {i: root(i) for i in range(n)}


def test_eps_neighbors(spark):
    rng = random.Random(7)
    xs = [[rng.uniform(0, 4) for _ in range(4)] for _ in range(40)]
    got = {(r.id, r.other) for r in nb.eps_neighbors(points(spark, xs), 1.2, 4).collect()}
    assert got == {(i, j) for i in range(40) for j in range(40) if math.dist(xs[i], xs[j]) <= 1.2}


def test_eps_counts(spark, any_split):
    rng = random.Random(8)
    xs = [rng.randint(0, 30) for _ in range(50)]
    got = nb.eps_counts(nb.distinct_values(line(spark, xs), ["k"], "x"), ["k"], 2.0).collect()
    assert {r.x: r.neighbors for r in got} == {
        float(x): sum(abs(x - y) <= 2 for y in xs) for x in set(xs)}


def test_knn(spark, any_split):
    rng = random.Random(9)
    xs = [rng.randint(0, 200) for _ in range(40)]
    got = {r.id: r.knn for r in nb.knn_distance(line(spark, xs), ["k"], "x", 3).collect()}
    assert got == {i: float(sorted(abs(x - y) for y in xs)[3]) for i, x in enumerate(xs)}


def test_knn_of_few(spark):
    got = {r.id: r.knn for r in nb.knn_distance(line(spark, [1, 4]), ["k"], "x", 5).collect()}
    assert got == {0: 3.0, 1: 3.0}
    assert nb.knn_distance(line(spark, [1]), ["k"], "x", 5).first().knn == 0.0


def test_kmeans_finds_separate_blobs(spark):
    rng = random.Random(10)
    xs = [[rng.gauss(c, 0.3), rng.gauss(c, 0.3)] for c in (0, 5, 10) for _ in range(20)]
    got = labels(cl.kmeans_fit(points(spark, xs), 3))
    assert all(len(set(got[i:i + 20])) == 1 for i in (0, 20, 40)) and len(set(got)) == 3


def test_kmeans_equals_a_loop(spark):
    """Seeds by races and rounds until no label changes, in plain Python over the same drawn numbers."""
    rng = random.Random(13)
    xs = [[rng.gauss(c, 1.5), rng.gauss(-c, 1.5), rng.random()] for c in (0, 4, 8, 12) for _ in range(15)] + [[0.0] * 3] * 5
    frame = points(spark, xs)

    def draw(i):
        return (F.col("id") * 31 + i * 17) % 101 / 101 + 0.004

    seeds = []
    for i in range(4):
        gaps = [min((math.dist(x, s) ** 2 for s in seeds), default=1.0) for x in xs]
        times = [(-math.log((j * 31 + i * 17) % 101 / 101 + 0.004) / g, j) for j, g in enumerate(gaps) if g > 0]
        seeds.append(list(map(float, xs[min(times)[1]])))
    assert cl.d2_seeds(frame, 4, draw=draw) == seeds
    centers, old = seeds, None
    while True:
        now = [min(range(4), key=lambda c: (math.dist(x, centers[c]), c)) for x in xs]
        if now == old:
            break
        old = now
        mine = [[x for x, n in zip(xs, now) if n == c] for c in range(4)]
        centers = [[sum(v) / len(m) for v in zip(*m)] if m else c for m, c in zip(mine, centers)]
    rows = {r.id: r for r in cl.kmeans_fit(frame, 4, draw=draw).collect()}
    assert [rows[i].label for i in range(len(xs))] == now
    assert all(rows[i].distance == pytest.approx(math.dist(xs[i], centers[now[i]])) for i in rows)


def test_kmeans_of_few_nothing_and_any_partitioning(spark):
    assert labels(cl.kmeans_fit(points(spark, [[1, 1], [1, 1], [5, 5]]), 5)) in ([0, 0, 1], [1, 1, 0])
    assert cl.kmeans_fit(points(spark, [[1, 1]]).limit(0), 3).count() == 0
    rng = random.Random(14)
    frame = points(spark, [[rng.random(), rng.random()] for _ in range(80)])
    assert cl.d2_seeds(frame, 5) == cl.d2_seeds(frame.repartition(7), 5)
    assert cl.d2_seeds(frame, 5) != cl.d2_seeds(frame, 5, seed=43)


def test_many_fits_at_once_equal_single_ones(spark):
    rng = random.Random(15)
    frame = points(spark, [[rng.gauss(c, 2), rng.gauss(c, 2)] for c in (0, 5, 9) for _ in range(20)])
    first = [list(r.features) for r in frame.orderBy("id").limit(4).collect()]
    drawn = lambda fit: F.col("id") % 5 != fit
    fits = cl.lloyd_fits(frame, {k: first[:k] for k in (2, 3, 4)}, 50, drawn)
    for k, centers in fits.items():
        seeds = spark.createDataFrame(list(enumerate(first[:k])), "label int, centroid array<double>")
        alone = cl.lloyd(frame.filter(drawn(k)), [], k, 50, 2, seeds).orderBy("label").collect()
        for r in alone:
            assert centers[r.label] == pytest.approx(r.centroid)


def test_lloyd_by_key_and_alone(spark):
    rng = random.Random(11)
    xs = [rng.gauss(c, 1) for c in (0, 50, 100) for _ in range(15)]
    df = line(spark, xs).withColumn("features", F.array("x"))
    keyed = [r.centroid[0] for r in cl.lloyd(df, ["k"], 3, 50, 1).orderBy("label").collect()]
    alone = [r.centroid[0] for r in cl.lloyd(df, [], 3, 50, 1).orderBy("label").collect()]
    want = [sum(xs[i:i + 15]) / 15 for i in (0, 15, 30)]
    assert keyed == pytest.approx(want) and alone == pytest.approx(want)
    own = cl.assign(df, cl.lloyd(df, ["k"], 3, 50, 1), ["k"])
    assert labels(own) == [i // 15 for i in range(45)]


def test_merge_of_gateways(spark):
    rows = [("GW-1", 2, [10.0], [50.0]), ("GW-2", 1, [5.2], [27.04]), ("GW-2", 4, [400.0], [40000.0]),
            ("GW-3", 1, [205.0], [42025.0])]
    df = spark.createDataFrame(rows, "gateway_code string, n bigint, ls array<double>, ss array<double>")
    got = {r.cluster_id: r for r in cl.cf_merge_cluster(df, 1, k=3).collect()}
    assert got[1].point_count == 3 and got[1].member_gateways == ["GW-1", "GW-2"]
    assert got[1].radius == pytest.approx(0.1) and got[1].ls == [15.2]
    assert sum(r.point_count for r in got.values()) == 8


def test_farthest_pair_splits(spark):
    df = spark.createDataFrame([(1, i, [float(x)]) for i, x in enumerate([0, 2, 5, 9, 10])],
                               "k int, label int, centroid array<double>")
    pair = nb.farthest_pair(df, ["k"]).first()
    assert (pair.a, pair.b, pair.distance) == (0, 4, 10.0)
    sides = {r.label: r.side for r in nb.bisect(df, ["k"]).collect()}
    assert sides == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}


def test_job(spark):
    rng = random.Random(12)
    xs = [[rng.gauss(c, 0.3), rng.gauss(c, 0.3)] for c in (0, 6) for _ in range(15)] + [[40.0, -40.0]]
    job = cl.cluster_job(points(spark, xs), "dbscan", 2, eps=1.5, min_points=4)
    rows = {r.id: r for r in job.points.collect()}
    assert rows[30].label == 0 and rows[30].distance is None
    center = [sum(x[d] for x in xs[:15]) / 15 for d in (0, 1)]
    assert rows[3].distance == pytest.approx(math.dist(xs[3], center))
    score = job.evaluation.first()
    assert (score.n_clusters, score.n_points) == (2, 30) and score.silhouette_squared > 0.8
    with pytest.raises(ValueError):
        cl.cluster_job(points(spark, xs), "unknown", 2)


def test_components_take_few_of_many_edges(spark):
    n = 60
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in range(n) if (i < 50) == (j < 50)], "a bigint, b bigint").coalesce(2)
    assert nb._fewer_links(edges.filter("a <> b")).count() <= 2 * n
    assert nb._fewer_links(edges.filter("a <> b"), at_once=16).distinct().count() < 50 * 49
    got = {r.id: r.component for r in nb.connected_components(spark.range(n + 1), edges).collect()}
    assert got == {i: 0 if i < 50 else 50 for i in range(n)} | {n: n}
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x"), (None, "a")], "a string, b string")
    got = {r.id: r.component for r in nb.connected_components(spark.createDataFrame([(c,) for c in "abcxyz"], "id string"), names).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_plane_neighbours_broadcast_nothing_and_measure_copies_once(spark):
    xs = [[0.0, 0.0]] * 4 + [[0.5, 0.0]] * 3 + [[9.0, 9.0]]
    near = nb.eps_neighbors(points(spark, xs), 1.0, 2)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id, r.other, r.distance) for r in near.collect())
    assert got == sorted((i, j, math.dist(a, b)) for i, a in enumerate(xs) for j, b in enumerate(xs) if math.dist(a, b) <= 1.0)


def test_repeated_vertices_come_out_once(spark):
    twice = spark.range(6).unionByName(spark.range(6)).unionByName(spark.range(6))
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)] * 3, "a bigint, b bigint")
    got = sorted((r.id, r.component) for r in nb.connected_components(twice, edges).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 5)]


def test_sums_of_lloyd_rounds(spark):
    rng = random.Random(11)
    xs = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(60)] + [[1.0, 0.0, 0.0]]
    fits = {2: [[0.0, 0.0, 0.0], [2.0, 0.0, 0.0]], 3: xs[:3]}
    rows = points(spark, xs).select("features", F.lit(True).alias("in2"), F.when(F.col("id") % 2 == 0, True).alias("in3"))
    rows = rows.unionByName(rows.limit(1).withColumn("features", F.lit(None).cast("array<double>")))
    got = {}
    for r in cl._label_sums(rows, fits).collect():
        n, s = got.get((r.fit, r.label), (0, [0.0] * 3))
        got[r.fit, r.label] = n + r.n, [a + b for a, b in zip(s, r.s)]
    for fit, centroids in fits.items():
        seen = xs if fit == 2 else xs[::2]
        for k in range(len(centroids)):
            own = [x for x in seen if min(range(len(centroids)), key=lambda c: (math.dist(x, centroids[c]), c)) == k]
            assert got[fit, k][0] == len(own) and got[fit, k][1] == pytest.approx([sum(v) for v in zip(*own)])
