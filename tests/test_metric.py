"""Neighbours over the pivot tree against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import clustering as cl, metric, neighbors as nb

from test_clustering import bfs_dbscan, labels, link, points


def cloud(seed, dim, clusters=4, each=25, copies=6, strays=15):
    """Clusters of different density, copies of one point, and strays."""
    rng = random.Random(seed)
    xs = []
    for c in range(clusters):
        center = [rng.uniform(-10, 10) for _ in range(dim)]
        xs += [[v + rng.gauss(0, 0.1 * 3 ** c) for v in center] for _ in range(each)]
    xs += [xs[0]] * copies + [[rng.uniform(-20, 20) for _ in range(dim)] for _ in range(strays)]
    rng.shuffle(xs)
    return xs


@pytest.fixture
def leaf(monkeypatch):
    """Many levels of small leaves."""
    monkeypatch.setattr(metric, "LEAF", 8)
    monkeypatch.setattr(metric, "FAN", 4)


def test_tree_holds_every_place_in_its_ball(spark, leaf):
    xs = cloud(1, 6)
    tree = metric.pivot_tree(points(spark, xs))
    nodes = {r.node: r for r in tree.nodes.collect()}
    places = tree.places.collect()
    assert sorted(tuple(p.features) for p in places) == sorted(set(map(tuple, xs)))
    for p in places:
        assert nodes[p.node].leaf
        for depth in range(1, len(p.node) + 1):
            node = nodes[p.node[:depth]]
            assert math.dist(node.center, p.features) <= node.radius + 1e-9 and node.parent == p.node[:depth - 1]
    assert all(sum(p.weight for p in places if p.node.startswith(n)) == r.weight for n, r in nodes.items())
    assert all(sum(p.node == n for p in places) <= metric.LEAF for n, r in nodes.items() if r.leaf)


@pytest.mark.parametrize("eps", [0.6, 30.0])
def test_eps_neighbors(spark, leaf, eps):
    xs = cloud(2, 6)
    got = nb.eps_neighbors(points(spark, xs), eps, 6).collect()
    want = {(i, j) for i in range(len(xs)) for j in range(len(xs)) if math.dist(xs[i], xs[j]) <= eps}
    assert {(r.id, r.other) for r in got} == want and len(got) == len(want)
    assert all(abs(r.distance - math.dist(xs[r.id], xs[r.other])) < 1e-9 for r in got)


@pytest.mark.parametrize("eps, least", [(0.5, 4), (12.0, 10)])
def test_dbscan(spark, leaf, eps, least):
    xs = cloud(3, 6)
    assert labels(cl.dbscan(points(spark, xs), eps, least, 6)) == bfs_dbscan(xs, eps, least)


def test_dbscan_of_noise_copies_and_nothing(spark, leaf):
    far = [[100.0 * i] * 5 for i in range(12)]
    assert labels(cl.dbscan(points(spark, far), 1.0, 2, 5)) == [0] * 12
    assert labels(cl.dbscan(points(spark, [[1.0] * 5] * 30 + far[2:]), 1.0, 20, 5)) == [1] * 30 + [0] * 10
    empty = points(spark, far).limit(0)
    assert cl.dbscan(empty, 1.0, 2, 5).count() == 0
    assert nb.eps_neighbors(empty, 1.0, 5).count() == 0


@pytest.mark.parametrize("k", [5, 200])
def test_knn(spark, leaf, k):
    xs = cloud(4, 6) + [[1e4] * 6]
    got = {r.id: r.knn for r in nb.knn_distance_vectors(points(spark, xs), k, 6).collect()}
    assert len(got) == len(xs)
    for i, x in enumerate(xs):
        others = sorted(math.dist(x, y) for j, y in enumerate(xs) if j != i)
        assert got[i] == pytest.approx(others[min(k, len(others)) - 1], abs=1e-9)
    assert nb.knn_distance_vectors(points(spark, [[1.0] * 6]), 3, 6).first().knn == 0.0


@pytest.mark.parametrize("k", [1, 5])
def test_single_link(spark, leaf, k):
    xs = cloud(5, 6, each=10, copies=3, strays=6)
    assert labels(cl.single_link(points(spark, xs), k, 6)) == link(xs, k)


def test_single_link_with_equal_distances(spark, leaf):
    xs = [[float(i), 0, 0, 0, 0] for i in range(12)]
    assert labels(cl.single_link(points(spark, xs), 3, 5)) == link(xs, 3)


def test_one_leaf(spark):
    xs = cloud(8, 5)
    assert labels(cl.dbscan(points(spark, xs), 2.0, 5, 5)) == bfs_dbscan(xs, 2.0, 5)
    assert nb.eps_neighbors(points(spark, xs), 2.0, 5).count() == sum(math.dist(x, y) <= 2.0 for x in xs for y in xs)


def test_outlier_beside_a_dense_cluster_meets_few_leaves(spark, monkeypatch):
    monkeypatch.setattr(metric, "LEAF", 8)
    rng = random.Random(6)
    xs = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(400)] + [[1000.0] * 5]
    met = []
    measured = metric._measured
    monkeypatch.setattr(metric, "_measured", lambda pairs, *rest: met.append(pairs.groupBy("a").count()) or measured(pairs, *rest))
    frame = points(spark, xs)
    nb.knn_distance_vectors(frame, 3, 5).count()
    leaves = met[0].count()
    assert met[0].agg(F.min("count")).first()[0] < leaves / 2


def test_jobs_in_any_dimension(spark):
    xs = cloud(7, 8, clusters=2, copies=0, strays=2)
    for algorithm in ("dbscan", "hierarchical"):
        job = cl.cluster_job(points(spark, xs), algorithm, 8, k=2, eps=3.0, min_points=4)
        assert job.points.count() == len(xs) and job.evaluation.first().n_clusters >= 1


def test_a_leaf_is_sent_once_per_block_and_every_pair_is_met_once(spark, leaf, monkeypatch):
    monkeypatch.setattr(metric, "BLOCKS", 3)
    rng = random.Random(9)
    tree = metric.pivot_tree(points(spark, [[rng.gauss(0, 1) for _ in range(6)] for _ in range(300)]))
    leaves = metric.close_nodes(tree, 100.0, whole=False)[1]
    n = tree.nodes.filter("leaf").count()
    assert leaves.count() == n * (n + 1) // 2

    def work(met):
        sides, cells = set(), 0
        for a, b, same in met:
            sides |= {p[0] for p in a["parts"]} | {p[0] for p in b["parts"]}
            cells += len(a["id"]) * (len(a["id"]) + 1) // 2 if same else len(a["id"]) * len(b["id"])
        yield {"sides": np.array([len(sides)]), "cells": np.array([cells])}

    rows = metric._measured(leaves, tree.places, [], "sides bigint, cells bigint", work).collect()
    assert 1 < len(rows) <= 10 and sum(r.cells for r in rows) == 300 * 301 // 2
    assert sum(r.sides for r in rows) <= 5 * n


def test_bounds_hold_the_distances_of_far_and_equal_vectors():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 7)), 1e8 + rng.normal(size=(40, 7)) * 1e-3])
    exact = ((x[:, None] - x[None]) ** 2).sum(-1)
    low, high = metric._bounds(x, x)
    assert (low <= exact).all() and (exact <= high).all()
    for eps in (0.0, 1e-3, 3.0):
        assert (metric._near(x, x, eps) == (np.sqrt(exact) <= eps)).all()


def test_pairs_are_neither_stored_nor_shuffled(spark, monkeypatch):
    rng = random.Random(13)
    xs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(120)]
    xs += xs[:5] * 3 + [xs[7]] * 40  # copies, more of one place than a list of members holds
    expected = sorted((i, j) for i, x in enumerate(xs) for j, y in enumerate(xs) if math.dist(x, y) <= 4.0)
    stored, keep = [], metric.settle

    def watched(df):
        kept = keep(df)
        stored.append(kept.count())
        return kept

    monkeypatch.setattr(metric, "settle", watched)
    for most, copies in ((16, 8), (metric.LEAF, metric.COPIES)):
        monkeypatch.setattr(metric, "LEAF", most)
        monkeypatch.setattr(metric, "COPIES", copies)
        for points_of in (xs, xs[:120]):
            stored.clear()
            found = metric.eps_neighbors(points(spark, points_of), 4.0)
            got = sorted((r.id, r.other) for r in found.collect())
            assert got == [(i, j) for i, j in expected if max(i, j) < len(points_of)]
            assert max(stored) < len(got) // 8


def test_a_spanning_tree_measures_all_pairs_once(spark, monkeypatch):
    rng = random.Random(17)
    xs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(160)]
    calls, measured = [], metric._measured
    monkeypatch.setattr(metric, "_measured", lambda *args: calls.append(1) or measured(*args))
    assert labels(cl.single_link(points(spark, xs), 5, 6)) == link(xs, 5)
    assert len(calls) == 1
    # tight groups fill the lists of their places, so what joins the groups is measured again
    calls.clear()
    xs = [[20.0 * g + rng.gauss(0, 1) for _ in range(6)] for g in range(3) for _ in range(30)]
    assert labels(cl.single_link(points(spark, xs), 3, 6)) == link(xs, 3)
    assert 1 < len(calls) <= 3
