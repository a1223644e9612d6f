"""Scores against direct formulas on small data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import clustering as cl, quality, search


def labelled(spark, xs, labels):
    return spark.createDataFrame([(1, i, [float(v) for v in x], float(x[0]), int(c))
                                  for i, (x, c) in enumerate(zip(xs, labels))],
                                 "k int, id bigint, features array<double>, x double, label int")


def direct_silhouette(xs, labels, include_self=False, power=1):
    out = []
    for i, x in enumerate(xs):
        def mean(c, drop):
            d = [math.dist(x, y) ** power for j, (y, l) in enumerate(zip(xs, labels))
                 if l == c and not (drop and j == i)]
            return sum(d) / len(d) if d else None
        if labels.count(labels[i]) == 1:
            out.append(0.0)
            continue
        a = mean(labels[i], not include_self)
        b = min(mean(c, False) for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return sum(out) / len(out)


def blobs(dim, seed, n=12, centers=(0, 5, 9)):
    rng = random.Random(seed)
    xs = [[rng.gauss(c, 1.0) for _ in range(dim)] for c in centers for _ in range(n)]
    return xs, [i for i in range(len(centers)) for _ in range(n)]


@pytest.mark.parametrize("include_self, mixed", [(False, False), (True, True)])
def test_silhouette_on_a_line(spark, any_split, include_self, mixed):
    xs, labels = blobs(1, 1)
    xs = [[round(x[0])] for x in xs]
    if mixed:
        labels = [i % 3 for i in range(len(xs))]
    else:
        order = sorted({x[0] for x in xs})
        labels = [min(2, order.index(x[0]) * 3 // len(order)) for x in xs]
    got = quality.silhouette_1d(labelled(spark, xs, labels), ["k"], "x", include_self=include_self).first()
    assert got.silhouette == pytest.approx(direct_silhouette(xs, labels, include_self))


def test_silhouettes_of_vectors(spark):
    xs, labels = blobs(3, 2)
    labels[0] = 7  # a cluster of its own
    df = labelled(spark, xs, labels)
    assert quality.silhouette_euclidean(df, block_rows=8).first()[0] == pytest.approx(
        direct_silhouette(xs, labels))
    assert quality.silhouette_squared(df, [], 3).first()[0] == pytest.approx(
        direct_silhouette(xs, labels, power=2))


def test_trivial_clusterings_score_zero(spark):
    xs, labels = blobs(2, 3, n=3)
    one = labelled(spark, xs, [1] * 9)
    each = labelled(spark, xs, range(9))
    for df in (one, each):
        assert quality.silhouette_squared(df, [], 2).first()[0] == 0.0
        assert quality.silhouette_1d(df, ["k"], "x").first().silhouette == 0.0
        assert quality.calinski_harabasz(df, [], 2).first()[0] == 0.0
    assert quality.davies_bouldin(one, [], 2).first()[0] == 0.0


def test_index_formulas(spark):
    xs, labels = blobs(2, 4)
    df = labelled(spark, xs, labels)
    groups = {c: [x for x, l in zip(xs, labels) if l == c] for c in set(labels)}
    center = {c: [sum(p[d] for p in g) / len(g) for d in (0, 1)] for c, g in groups.items()}
    s = {c: sum(math.dist(p, center[c]) for p in g) / len(g) for c, g in groups.items()}
    dbi = sum(max((s[a] + s[b]) / math.dist(center[a], center[b]) for b in groups if b != a)
              for a in groups) / 3
    assert quality.davies_bouldin(df, ["k"], 2).first().davies_bouldin == pytest.approx(dbi)
    mean = [sum(x[d] for x in xs) / len(xs) for d in (0, 1)]
    for power, squared in ((2, True), (1, False)):
        b = sum(len(g) * math.dist(center[c], mean) ** power for c, g in groups.items())
        w = sum(math.dist(p, center[c]) ** power for c, g in groups.items() for p in g)
        got = quality.calinski_harabasz(df, ["k"], 2, squared=squared).first().calinski_harabasz
        assert got == pytest.approx((b / 2) / (w / (len(xs) - 3)))


def test_blob_ranges(spark):
    xs, labels = blobs(2, 5, n=20, centers=(0, 6))
    row = quality.evaluate_clusters(labelled(spark, xs, labels), [], 2, silhouette="euclidean").first()
    assert 0 < row.silhouette <= 1 and 0 < row.davies_bouldin < 2 and row.calinski_harabasz > 0
    assert (row.n_clusters, row.n_points) == (2, 40)


def test_noise_is_left_out(spark):
    xs, labels = blobs(1, 6)
    with_noise = labelled(spark, xs + [[999.0]], [l + 1 for l in labels] + [0])
    clean = labelled(spark, xs, labels)
    a = quality.evaluate_clusters(with_noise, ["k"], 1, noise=0, value="x").first()
    b = quality.evaluate_clusters(clean, ["k"], 1, value="x").first()
    assert a.silhouette == pytest.approx(b.silhouette) and a.n_points == 36


def test_adjusted_rand(spark):
    def score(a, b):
        df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
        return quality.adjusted_rand(df, [], "a", "b").first().adjusted_rand
    assert score([0, 0, 1, 1], [1, 1, 0, 0]) == 1.0
    assert score([0, 0, 1, 1], [0, 0, 1, 2]) == pytest.approx(0.5714285714)
    assert score([0, 0, 0, 0], [0, 0, 0, 0]) == 1.0


def test_drift(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (2,)], "label int")
    b = spark.createDataFrame([(3,), (4,)], "label int")
    assert quality.js_drift(a, a).first()[0] == pytest.approx(0.0)
    assert quality.js_drift(a, b).first()[0] == pytest.approx(1.0)


def test_best_k(spark):
    xs, _ = blobs(2, 7, n=15, centers=(0, 6, 12))
    df = labelled(spark, xs, [0] * 45)
    got = search.find_optimal_k(df, 2, (2, 4)).collect()
    assert [r.k for r in got if r.is_best] == [3] and len(got) == 3
    with pytest.raises(ValueError):
        search.find_optimal_k(df, 2, metric="unknown")


def test_adaptive_eps(spark, any_split):
    rng = random.Random(8)
    xs = [rng.gauss(c, 0.3) for c in (0, 3) for _ in range(20)] + [30.0]
    df = labelled(spark, [[x] for x in xs], [0] * 41)
    got = search.adaptive_eps(df, ["k"], "x", k=5).first()
    d = sorted(sorted(abs(x - y) for y in xs)[5] for x in xs)
    n = len(d)
    ux = [i / n for i in range(n)]
    uy = [(v - d[0]) / (d[-1] - d[0] + 1e-10) for v in d]
    mx, my = sum(ux) / n, sum(uy) / n
    slope = sum((a - mx) * (b - my) for a, b in zip(ux, uy)) / (sum((a - mx) ** 2 for a in ux) + 1e-10)
    res = [abs(b - (slope * a + my - slope * mx)) for a, b in zip(ux, uy)]
    at = res.index(max(res))
    assert (got.knee_index, got.suggested_eps) == (at, pytest.approx(d[at]))
    assert got.confidence == ("high" if max(res) > 2 * sum(res) / n else "medium")


def test_adaptive_eps_of_few_points(spark):
    got = search.adaptive_eps(labelled(spark, [[1], [2], [3]], [0] * 3), ["k"], "x").first()
    assert (got.suggested_eps, got.confidence) == (0.0, "low")


def test_stability_of_clear_blobs(spark):
    xs, _ = blobs(2, 9, n=15, centers=(0, 20))
    df = labelled(spark, xs, [0] * 30).select("id", "features")
    row = search.stability(df, lambda s: cl.kmeans_fit(s, 2), bootstraps=3).first()
    assert row.stability == pytest.approx(1.0) and row.pairs == 3


def test_distance_sums_keep_digits(monkeypatch):
    monkeypatch.setattr(quality, "TILE", 8)
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(30, 6)), 1e7 + rng.normal(size=(30, 6)) * 1e-3, np.ones((30, 6))):
        y = np.concatenate([x[:9], x[3:20] + 1e-9])
        want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)).sum(1)
        assert quality._distance_sums(x, y) == pytest.approx(want, rel=1e-7, abs=1e-9)


def test_blocks_of_the_silhouette_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_ROWS", 2)
    rng, met = np.random.default_rng(6), []
    df = spark.createDataFrame([(i, i % 3, (rng.normal(size=3) + 3 * (i % 3)).tolist()) for i in range(200)],
                               "id bigint, label int, features array<double>")
    whole = quality.silhouette_euclidean(df, block_rows=200).first().silhouette
    sequence = quality.F.sequence
    monkeypatch.setattr(quality.F, "sequence", lambda a, b: met.append(b) or sequence(a, b))
    assert quality.silhouette_euclidean(df).first().silhouette == pytest.approx(whole, abs=1e-12)
    assert "11" in str(met[0])  # twelve blocks, not a hundred of two rows
