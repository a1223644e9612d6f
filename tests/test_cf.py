"""Clustering features: exact small vectors, invariants, snapshots."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import cf
from gaugeline.sources import snapshots


def vectors(spark, *xs):
    return spark.createDataFrame([(1, list(map(float, x))) for x in xs], "k int, features array<double>")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_point(spark):
    r = one(cf.cf_build(vectors(spark, [1, 2, 3]), ["k"], dim=3))
    assert (r.n, r.ls, r.ss) == (1, [1, 2, 3], [1, 4, 9])


def test_add_and_centroid(spark):
    r = one(cf.cf_build(vectors(spark, [1, 2], [3, 4]), ["k"], dim=2))
    assert (r.n, r.ls, r.ss) == (2, [4, 6], [10, 20])
    r = one(cf.cf_geometry(cf.cf_build(vectors(spark, [2, 4], [4, 8]), ["k"], dim=2)))
    assert r.centroid == [3, 6]


def test_radius_and_diameters(spark):
    r = one(cf.cf_geometry(cf.cf_build(vectors(spark, [1, 0], [-1, 0]), ["k"], dim=2)))
    assert r.radius == pytest.approx(1.0)
    assert r.diameter == pytest.approx(2 ** 0.5)
    assert r.diameter_pairwise == pytest.approx(2.0)


def test_distances(spark):
    a = cf.cf_build(vectors(spark, [0, 0]), ["k"], dim=2)
    r = one(a.select(cf.point_distance(F.col("n"), F.col("ls"), F.array(F.lit(3.0), F.lit(4.0))).alias("d")))
    assert r.d == 5.0


def test_merge_with_empty(spark):
    a = cf.cf_build(vectors(spark, [1, 2], [3, 4]), ["k"], dim=2)
    empty = a.select("k", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("array<double>").alias("ls"),
                     F.lit(None).cast("array<double>").alias("ss"))
    r = one(cf.cf_merge(cf.cf_union(a, a, empty), ["k"], dim=2))
    assert (r.n, r.ls, r.ss) == (4, [8, 12], [20, 40])


def test_empty_cf_has_no_centroid(spark):
    df = spark.createDataFrame([(0, [0.0], [0.0])], "n bigint, ls array<double>, ss array<double>")
    r = one(cf.cf_geometry(df))
    assert (r.centroid, r.radius, r.diameter) == (None, 0.0, 0.0)


def values(spark, xs):
    return spark.createDataFrame([(1, float(x)) for x in xs], "k int, value double")


def test_two_groups_have_two_leaves(spark):
    leaves = cf.cf_leaves(values(spark, [1.0, 1.1, 1.2, 5.0, 5.1, 5.2]), ["k"], "value", threshold=0.5)
    assert leaves.count() >= 2


@pytest.mark.parametrize("dim", [1, 3])
def test_leaves_keep_the_radius(spark, dim):
    rng = random.Random(3)
    xs = [[rng.gauss(0, 20) for _ in range(dim)] for _ in range(300)]
    leaves = cf.cf_leaves(vectors(spark, *xs), ["k"], "features", dim=dim, threshold=4.0)
    shaped = cf.cf_geometry(leaves)
    assert shaped.agg(F.max("radius")).first()[0] <= 4.0
    assert shaped.agg(F.sum("n")).first()[0] == 300


def test_leaves_do_not_depend_on_order(spark):
    rng = random.Random(4)
    xs = [float(rng.randint(0, 200)) for _ in range(200)]
    one_way = cf.cf_leaves(values(spark, xs), ["k"], "value", threshold=3.0)
    other = cf.cf_leaves(values(spark, sorted(xs)).repartition(7), ["k"], "value", threshold=3.0)
    assert sorted(one_way.collect()) == sorted(other.collect())


def test_compact(spark, any_split):
    rng = random.Random(5)
    xs = [rng.gauss(m, 1.0) for m in (0, 30, 60) for _ in range(40)]
    leaves = cf.cf_leaves(values(spark, xs), ["k"], "value", threshold=0.5)
    done = cf.cf_compact(leaves, ["k"], 4.0)
    shaped = cf.cf_geometry(done).collect()
    assert sum(r.n for r in shaped) == 120
    assert sum(r.ls[0] for r in shaped) == pytest.approx(sum(xs))
    assert all(r.radius <= 4.0 for r in shaped)
    assert len(shaped) == 3


def test_nearest_leaf(spark, any_split):
    rng = random.Random(6)
    xs = [float(rng.randint(0, 400)) for _ in range(50)]
    leaves = cf.cf_leaves(values(spark, xs), ["k"], "value", threshold=5.0)
    probes = spark.createDataFrame([(1, i, float(rng.randint(-50, 450))) for i in range(40)],
                                   "k int, id bigint, value double")
    spots = [(r.ls[0] / r.n, r.leaf_id) for r in leaves.collect()]
    got = {r.id: r.distance for r in cf.nearest_leaf(probes, leaves, ["k"], "value", "id").collect()}
    for r in probes.collect():
        assert got[r.id] == pytest.approx(min(abs(r.value - s) for s, _ in spots))


def test_delta(spark):
    before = cf.cf_leaves(values(spark, [1, 11, 21]), ["k"], "value", threshold=5.0)
    after = cf.cf_leaves(values(spark, [1, 11, 12, 31]), ["k"], "value", threshold=5.0)
    got = {r.leaf_id: r.status for r in cf.cf_delta(before, after, ["k"]).collect()}
    assert got == {1: "updated", 2: "removed", 3: "new"}
    assert cf.cf_delta(before, after, ["k"], full=True).count() == 3


def tree(spark):
    df = spark.createDataFrame([("GW-1", 7, 1, float(x)) for x in (1, 2, 14, 15, 16)],
                               "gateway_code string, measure_point_id int, data_type int, value double")
    return cf.cf_leaves(df, ["gateway_code", "measure_point_id", "data_type"], "value", threshold=5.0)


def test_snapshot_round_trip(spark):
    leaves = tree(spark)
    docs = snapshots.cf_to_json(leaves, F.lit("2024-01-01T00:00:00"), 5.0)
    body = json.loads(one(docs).body)
    assert body["version"] == "1.0" and body["tree_id"] == "GW-1_7_1"
    assert body["stats"]["total_points"] == 5 and len(body["centroids"]) == 2
    back = snapshots.cf_from_json(docs)
    assert sorted((r.n, r.ls, r.ss) for r in back.collect()) == sorted(
        (r.n, r.ls, r.ss) for r in leaves.collect())


def test_snapshot_defaults_for_missing_sums(spark):
    body = json.dumps({"version": "1.0", "stats": {}, "centroids": [{"n": 4, "centroid": [2.5]}]})
    r = one(snapshots.cf_from_json(spark.createDataFrame([(body,)], "body string")))
    assert (r.n, r.ls, r.ss) == (4, [10.0], [25.0])


@pytest.mark.parametrize("doc, message", [
    ({"version": "1.0", "centroids": [{"n": 1, "centroid": [1.0]}], "stats": {}}, ""),
    ({"version": "1.0"}, "Missing required field: centroids"),
    ({"centroids": [], "stats": {}}, "Missing required field: version"),
    ({"version": "1", "centroids": [{"n": 1, "centroid": [1]}, {"n": 2}], "stats": {}},
     "Centroid 1 missing 'centroid' field"),
    ({"version": "1", "centroids": [{"centroid": [1]}], "stats": {}}, "Centroid 0 missing 'n' field"),
])
def test_validation(spark, doc, message):
    r = one(snapshots.cf_validate(spark.createDataFrame([(json.dumps(doc),)], "body string")))
    assert (r.valid, r.message) == (message == "", message)


def test_payload_size_counts_bytes(spark):
    docs = spark.createDataFrame([("a", "é"), ("a", "xy")], "k string, body string")
    r = one(snapshots.cf_payload_size(docs, ["k"]))
    assert (r.documents, r.bytes, r.largest) == (2, 4, 2)
