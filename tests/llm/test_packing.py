from __future__ import annotations

import itertools
import random

import numpy as np

from gaugeline.llm.packing import best_bounds, pack


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_bounds_equal_brute_force():
    r = np.random.default_rng(1)
    for _ in range(30):
        n = int(r.integers(1, 9))
        lengths = np.sort(r.choice(60, n, replace=False) + 1)
        counts = r.integers(1, 20, n)
        for buckets in (1, 2, 3, 12):
            got = best_bounds(lengths, counts, buckets)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for k in range(min(buckets, n))
                       for c in itertools.combinations(lengths[:-1].tolist(), k))
            assert got == sorted(set(got)) and got[-1] == lengths[-1] and len(got) <= buckets
            assert padding(lengths, counts, got) == best


def test_batches_are_full_and_whole(docs_of, monkeypatch):
    monkeypatch.setattr("gaugeline.llm.packing.CELL_ROWS", 16)
    r = random.Random(3)
    rows = [(k, "w " * int(r.lognormvariate(3, 1))) for k in range(500)] + [(900, None), (901, ""), (902, " \n"), (903, "w " * 5_000),
            (904, "same"), (904, "same"), (None, "no id")]
    got = pack(docs_of(rows), buckets=4, budget=600).collect()
    assert sorted((str(x["doc_id"]), x["n_tokens"]) for x in got) == sorted((str(k), len((t or "").split())) for k, t in rows)
    groups = {}
    for x in got:
        if x["n_tokens"]:
            assert x["padding"] == x["bucket"] - x["n_tokens"] >= 0
            groups.setdefault(x["bucket"], {}).setdefault(x["batch"], []).append(x["slot"])
        else:
            assert x["bucket"] is x["batch"] is x["slot"] is x["padding"] is None
    assert 2 <= len(groups) <= 4
    for bucket, batches in groups.items():
        room = max(1, 600 // bucket)
        assert sorted(batches) == list(range(len(batches)))
        for number, slots in batches.items():
            assert sorted(slots) == list(range(len(slots)))
            assert len(slots) == room or number == max(batches) and len(slots) < room


def test_nothing_to_pack(docs_of):
    assert pack(docs_of([])).count() == 0
    row, = pack(docs_of({1: None})).collect()
    assert row["n_tokens"] == 0 and row["batch"] is None


def test_many_lengths_stay_few(spark, docs_of):
    from pyspark.sql import functions as F

    from gaugeline.llm.packing import rounded

    got = spark.range(1, 200_000).select("id", rounded(F.col("id")).alias("r")).filter("r < id or r > id * 65 / 64").count()
    assert got == 0
    assert spark.range(1, 200_000).select(rounded(F.col("id"))).distinct().count() < 1_024 + 128 * 8


def test_long_documents_have_the_least_padding(docs_of, monkeypatch):
    r = np.random.default_rng(5)
    lengths = np.sort(r.choice(np.arange(1_025, 6_000), 9, replace=False))
    counts = r.integers(1, 4, len(lengths))
    docs = docs_of([(i, "w " * int(x)) for i, x in enumerate(np.repeat(lengths, counts))])
    for buckets in (2, 4, 16):
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for k in range(min(buckets, len(lengths)))
                   for c in itertools.combinations(lengths[:-1].tolist(), k))
        assert sum(x["padding"] for x in pack(docs, buckets=buckets).collect()) == best
    monkeypatch.setattr("gaugeline.llm.packing.MOST_LENGTHS", 4)
    rows = pack(docs, buckets=16).collect()
    assert {x["bucket"] for x in rows} <= set(lengths.tolist()) and min(x["padding"] for x in rows) == 0


def test_more_lengths_than_are_weighed_at_once_have_the_least_padding(docs_of, monkeypatch):
    r = np.random.default_rng(7)
    lengths = np.sort(r.choice(np.arange(4_097, 4_200), 14, replace=False))
    counts = r.integers(1, 4, len(lengths))
    docs = docs_of([(i, "w " * int(x)) for i, x in enumerate(np.repeat(lengths, counts))])
    monkeypatch.setattr("gaugeline.llm.packing.MOST_LENGTHS", 4)
    for buckets in (2, 4):
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for k in range(buckets)
                   for c in itertools.combinations(lengths[:-1].tolist(), k))
        assert sum(x["padding"] for x in pack(docs, buckets=buckets).collect()) == best


def test_bounds_of_many_lengths():
    r = np.random.default_rng(6)
    lengths, counts = np.sort(r.choice(10**6, 300, replace=False) + 1), r.integers(1, 99, 300)
    cost = np.concatenate([[0], np.full(300, np.inf)])
    for _ in range(5):
        cost = np.array([0, *[min(cost[i] + int((counts[i:j] * (lengths[j - 1] - lengths[i:j])).sum()) for i in range(j))
                              for j in range(1, 301)]])
    assert padding(lengths, counts, best_bounds(lengths, counts, 5)) == cost[-1]
