"""Gaussian mixtures against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import clustering as cl


def blobs(seed=3, dim=3):
    rng = random.Random(seed)
    centers = [[5000.0 + 4.0 * c * (-1) ** (c * d) for d in range(dim)] for c in range(3)]
    return [[rng.gauss(v, 0.4 * (c + 1)) for v in centers[c]] for c in range(3) for _ in range(40 * (c + 1))]


def loop(xs, starts, rounds, tolerance=1e-6, floor=1e-6):
    """The same rounds over one array."""
    x = np.array(xs)
    middle = x.mean(0)
    x = x - middle
    k, least = len(starts), np.where(x.var(0) > 0, x.var(0) * floor, floor)
    w, m, v, history = np.full(k, 1 / k), np.array(starts) - middle, np.tile(np.maximum(x.var(0), least), (k, 1)), []

    def logs():
        return np.log(w) - 0.5 * np.log(2 * np.pi * v).sum(1) - 0.5 * ((x[:, None] - m) ** 2 / v).sum(2)

    def whole(z):
        top = z.max(1, keepdims=True)
        return (top + np.log(np.exp(z - top).sum(1, keepdims=True)))

    for _ in range(rounds):
        z = logs()
        total = whole(z)
        r = np.exp(z - total)
        n = r.sum(0)
        w, m = n / len(x), r.T @ x / n[:, None]
        v = np.maximum(r.T @ x ** 2 / n[:, None] - m ** 2, least)
        history.append(total.mean())
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
    z = logs()
    return w, m + middle, v, history, z.argmax(1), np.exp(z.max(1) - whole(z)[:, 0])


def table(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "id bigint, features array<double>")


@pytest.mark.parametrize("rounds", [1, 100])
def test_mixture_equals_loop(spark, rounds):
    xs = blobs()
    df = table(spark, xs).repartition(5)
    starts = cl.d2_seeds(df, 3)
    w, m, v, history, labels, p = loop(xs, starts, rounds)
    got = cl.gmm_model(df, 3, 3, rounds)
    assert len(got.likelihood) == len(history) and np.allclose(got.likelihood, history)
    assert np.allclose(got.weights, w) and np.allclose(got.means, m) and np.allclose(got.variances, v)
    rows = {r.id: r for r in cl.gmm_fit(df, 3, 3, rounds).collect()}
    assert [rows[i].label for i in range(len(xs))] == labels.tolist()
    assert np.allclose([rows[i].probability for i in range(len(xs))], p)


def test_likelihood_rises_and_zones_are_found(spark):
    """A start may end in a lesser optimum; the likeliest of a few starts has the zones."""
    df = table(spark, blobs())
    tries = [cl.gmm_model(df, 3, 3, seed=s) for s in range(4)]
    assert all(b > a - 1e-9 for t in tries for a, b in zip(t.likelihood, t.likelihood[1:]))
    assert sorted(round(w, 2) for w in max(tries, key=lambda t: t.likelihood[-1]).weights) == [0.17, 0.33, 0.5]


def test_odd_inputs(spark):
    assert cl.gmm_fit(table(spark, []), 2, 2).count() == 0
    one = cl.gmm_fit(table(spark, [[1.0, 2.0]] * 4 + [None]), 3, 2).orderBy("id").collect()
    assert [(r.label, r.probability) for r in one] == [(0, 1.0)] * 4 + [(None, None)]
    far = cl.gmm_fit(table(spark, [[0.0], [1e-3], [1e6], [1e6 + 1]]), 2, 1).orderBy("id").collect()
    assert far[0].label == far[1].label != far[2].label == far[3].label and all(r.probability > 0.999 for r in far)
    empty = table(spark, [[0.0]]).withColumn("label", F.lit("old"))
    assert cl.gmm_fit(empty, 1, 1).first().label == 0


def test_moments_of_one_round(spark):
    rng = np.random.default_rng(2)
    xs = rng.normal(size=(80, 3)) + 1e4
    model = cl.Mixture([0.3, 0.0, 0.7], [[1e4] * 3, [0.0] * 3, [1e4 + 1] * 3], [[1.0] * 3, [1.0] * 3, [2.0] * 3], [])
    found = {r.label: r for r in cl._moments(table(spark, xs.tolist()).repartition(3), model).collect()}
    own = np.stack([np.log(w) - 0.5 * (np.log(2 * np.pi * np.array(v)).sum() + ((xs - m) ** 2 / v).sum(1))
                    for w, m, v in zip(*model[:3]) if w], 1)
    log = np.log(np.exp(own - own.max(1)[:, None]).sum(1)) + own.max(1)
    assert set(found) == {0, 2} and sum(r.log for r in found.values()) == pytest.approx(log.sum())
    for label, share in zip((0, 2), np.exp(own - log[:, None]).T):
        mean = share @ xs / share.sum()
        assert found[label].n == pytest.approx(share.sum()) and list(found[label].mean) == pytest.approx(mean.tolist())
        assert list(found[label].squares) == pytest.approx((share @ (xs - mean) ** 2).tolist())
