"""What must stay the same at any size or offset, and what a job leaves behind."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.catalog import QUERIES
from gaugeline.operators import cf, clustering as cl, neighbors as nb, outliers, quality, search
from gaugeline.session import checkpoint_dir, scope, settle
from gaugeline.sources import uploads


def points(spark, xs, label=None):
    rows = [(i, list(map(float, x)), 0 if label is None else label[i]) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label int")


def blobs(seed, centres, each, spread=1.0):
    r = random.Random(seed)
    return [[c + r.gauss(0, spread) for c in centre] for centre in centres for _ in range(each)]


def test_long_record_gives_the_same_in_both_forms(spark):
    r = random.Random(1)
    values = [(0, i, r.gauss(100, 3) + (40 if i % 97 == 0 else 0)) for i in range(700)]
    rows = spark.createDataFrame(values, "record_id int, value_index int, value double")
    flat = {(x.value_index, round(x.z_score, 6)) for x in outliers.record_outliers(rows, ["record_id"]).collect()}
    arrays = rows.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("value_index", "value"))).alias("p"))
    arrays = arrays.select("record_id", F.col("p.value").alias("vals"))
    listed = {(x.value_index, round(x.z_score, 6)) for x in outliers.record_outliers_in_arrays(arrays).collect()}
    assert flat == listed and len(flat) >= 7


def test_malformed_uploads_do_not_end_the_job(spark):
    bodies = ['{"dev_code": "a", "record_time": "2024-01-01T00:00:00Z"}', '{"dev_code": "a", "record_time": "not a time"}',
              '{"dev_code": "a", "record_time": ""}', '{"dev_code": "a"}', '{"record_time": "2024-01-01"}', '{"dev_code": "a"', "", None]
    raw = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "no int, body string")
    valid = {r.no: r.valid for r in uploads.upload_parse(raw).collect()}
    assert [k for k, v in valid.items() if v] == [0, 2, 3]


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_scores_far_from_zero(spark, offset):
    xs = blobs(2, [(0, 0), (20, 5)], 60)
    labels = [0] * 60 + [1] * 60
    near, far = points(spark, xs, labels), points(spark, [[offset + v for v in x] for x in xs], labels)
    for score in (quality.calinski_harabasz, quality.silhouette_squared, quality.davies_bouldin):
        a, b = (score(df, [], 2).first()[0] for df in (near, far))
        assert b == pytest.approx(a, rel=1e-5)


@pytest.mark.parametrize("dim", [1, 2, 3, 4])
def test_knn_of_vectors(spark, dim):
    r = random.Random(dim)
    xs = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(120)] + [[1e4] * dim] + [[0.0] * dim] * 9
    got = {x.id: x.knn for x in nb.knn_distance_vectors(points(spark, xs), 4, dim).collect()}
    for i, a in enumerate(xs):
        want = sorted(math.dist(a, b) for j, b in enumerate(xs) if j != i)[3]
        assert got[i] == pytest.approx(want)


def test_knn_of_few_points(spark):
    assert [x.knn for x in nb.knn_distance_vectors(points(spark, [[3.0, 4.0]]), 3, 2).collect()] == [0.0]
    assert sorted(x.knn for x in nb.knn_distance_vectors(points(spark, [[0.0, 0.0], [3.0, 4.0]]), 3, 2).collect()) == [5.0, 5.0]


def test_eps_of_vectors_lies_between_inside_and_outside(spark):
    xs = blobs(3, [(0, 0), (3, 3)], 50, 0.3)
    row = search.adaptive_eps(points(spark, xs), [], None, dim=2).first()
    assert 0 < row.suggested_eps < 3


def naive_single_link(xs, k):
    parts = [{i} for i in range(len(xs))]
    edges = sorted((math.dist(xs[i], xs[j]), i, j) for i in range(len(xs)) for j in range(i))
    for _, i, j in edges:
        if len(parts) == k:
            break
        a, b = (next(p for p in parts if v in p) for v in (i, j))
        if a is not b:
            parts.remove(b)
            a |= b
    return {frozenset(p) for p in parts}


@pytest.mark.parametrize("dim", [2, 3])
def test_single_link_of_dense_cells(spark, dim):
    # two blobs so dense that cells hold many points, and a bridge
    xs = blobs(4, [(0,) * dim, (4,) * dim], 90, 0.5) + [[2.0 + 0.1 * i] * dim for i in range(3)]
    got = cl.single_link(points(spark, xs).drop("label"), 4, dim).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.label, set()).add(r.id)
    assert {frozenset(p) for p in parts.values()} == naive_single_link(xs, 4)


def test_grids_refuse_many_dimensions(spark):
    df = points(spark, [[0.0] * 6])
    for call in (lambda: nb.eps_neighbors(df, 1.0, 6), lambda: nb.knn_distance_vectors(df, 1, 6),
                 lambda: cl.dbscan(df, 1.0, 2, 6)):
        with pytest.raises(ValueError, match="dimensions"):
            call()


def test_fewer_leaves_than_clusters(spark):
    leaves = spark.createDataFrame([("g", 0, 2, [2.0], [2.0]), ("h", 9, 1, [9.0], [81.0])],
                                   "gateway_code string, leaf_id bigint, n bigint, ls array<double>, ss array<double>")
    got = cl.cf_merge_cluster(leaves, 1, k=3).orderBy("cluster_id").collect()
    assert [(r.point_count, r.member_gateways) for r in got] == [(2, ["g"]), (1, ["h"])]


def test_one_sample_agrees_with_itself(spark):
    df = points(spark, blobs(5, [(0, 0), (9, 9)], 20)).select("id", "features")
    assert search.stability(df, lambda s: cl.kmeans_fit(s, 2), bootstraps=1).first().stability == 1.0


def test_a_node_of_many_entries_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nb, "NODE_ENTRIES", 5)
    rows = spark.range(6).select(F.lit(1).alias("k"), F.col("id").alias("label"), F.array(F.col("id").cast("double")).alias("centroid"))
    with pytest.raises(Exception, match="more than 5 entries"):
        nb.farthest_pair(rows, ["k"]).collect()


@pytest.mark.parametrize("name", ["record_write", "dbscan_1d", "stream_dedup"])
def test_queries_leave_nothing_behind(spark, name):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scope(spark):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert set(os.listdir(folder)) <= before


def test_a_failed_job_leaves_nothing_behind(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with pytest.raises(RuntimeError), scope(spark):
        settle(spark.range(3))
        raise RuntimeError
    assert set(os.listdir(folder)) <= before


def test_leaf_states(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7), (1, 3, 5.0), (1, 4, 0.1)], "k int, at int, v double")
    got = cf.leaf_state(rows, ["k"], ["at"], "v").orderBy("at").collect()
    assert [(r.leaf_id, r.n, r.ls) for r in got] == [(0, 0, 0.0), (0, 1, 0.5), (2, 0, 0.0), (0, 2, 1.2)]
    assert [r.seq for r in cf.every_nth(rows, ["k"], ["at"], "v", 2).orderBy("at").collect()] == [2, 4]
