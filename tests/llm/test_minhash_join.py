"""The MinHash join against all pairs of sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gaugeline.llm import minhash_join as j
from gaugeline.llm.ngram_join import distinct, shingles_of

from .conftest import prose
from .test_ngram_join import edited, got


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 3]) for i in range(len(words) - 2)}


def expected(rows):
    sets = [(k, grams(t)) for k, t in rows]
    low = {k: k for k, _ in sets if k is not None}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return sorted(((k, len(x), None if k is None else root(k)) for k, x in sets), key=str)


def corpus(seed):
    """Groups of near copies, texts around a common passage that do not link, copies, short, empty, long texts, ties."""
    r = random.Random(seed)
    common = prose(r, 40)
    rows, k = [], 0
    for group in range(6):
        base = prose(r, r.randint(40, 200))
        for _ in range(r.randint(2, 30)):
            rows.append((k, edited(r, base, r.randint(0, 4))))
            k += 1
    for _ in range(80):
        rows.append((k, f"{prose(r, r.randint(0, 30))} {common} {prose(r, r.randint(0, 30))}"))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "one two"), (k + 3, "One  two"), (k + 4, "one"), (k + 5, "a b c"), (k + 6, "a b c d"),
             (k + 7, rows[3][1].upper()), (k + 8, prose(r, 20_000)), (None, rows[3][1]), rows[5], rows[5], (k + 9, "Ä b c d e"),
             (k + 10, "ä b c d e"), (k + 11, "the " * 500), (k + 12, "the " * 700), (k + 13, " \t\x0b")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(seed, docs_of):
    rows = corpus(seed)
    assert got(j.components(docs_of(rows))) == expected(rows)


def test_other_plans_same_rows(docs_of, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(j, "if_small", lambda df, rows=0: df)
    monkeypatch.setattr(j, "MOST_ROUNDS", 0)
    assert got(j.components(docs_of(rows), known=16)) == expected(rows)


def test_group_around_no_centre(docs_of):
    """A chain: each links with the next only, so no leader reaches all."""
    r = random.Random(4)
    words = prose(r, 400).split()
    rows = [(100 - i, " ".join(words[8 * i:8 * i + 120])) for i in range(30)]
    assert got(j.components(docs_of(rows))) == expected(rows)
    assert {c for _, _, c in expected(rows)} == {71}


def test_different_texts_under_one_id(docs_of):
    r = random.Random(5)
    text, other = prose(r, 60), prose(r, 50)
    rows = [(1, text), (2, text), (2, other), (3, other), (4, None), (4, text)]
    assert got(j.components(docs_of(rows))) == sorted(
        [(1, 58, 1), (2, 58, 2), (2, 48, 2), (3, 48, 2), (4, 0, 1), (4, 58, 1)], key=str)


def test_nothing(docs_of):
    assert got(j.components(docs_of([]))) == []
    assert got(j.components(docs_of({1: None, 2: ""}))) == [(1, 0, 1), (2, 0, 2)]


def test_collisions_follow_similarity():
    r = random.Random(6)
    texts, wanted = [], []
    for _ in range(60):
        base = prose(r, 300)
        near = edited(r, base, r.randint(1, 20))
        texts += [base, near]
        x, y = grams(base), grams(near)
        wanted.append(len(x & y) / len(x | y))
    made = j.signatures(*distinct(*shingles_of(pa.array(texts), j.GRAM)))
    same = (made[::2] == made[1::2]).mean(1)
    assert abs(same - np.array(wanted)).mean() < 0.06 and abs((same - wanted).mean()) < 0.02
    assert (made[:-1:2][1:] == made[1:-2:2]).mean() < 0.001


def test_counts_of_collisions(spark):
    from pyspark.sql import functions as F
    r = np.random.default_rng(7)
    a = r.integers(0, 2**32, (50, j.COORDINATES), np.uint32)
    b = np.where(r.random(a.shape) < 0.5, a, r.integers(0, 2**32, a.shape, np.uint32))
    rows = [(i, *(m.view(np.int32).tolist() for m in (x, y)), *(j.sketches(m[None])[0].tolist() for m in (x, y)))
            for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>, sa array<bigint>, sb array<bigint>")
    counted = df.select("i", j.collisions(F.col("a"), F.col("b")), j.agreeing(F.col("sa"), F.col("sb"))).collect()
    assert {x[0]: x[1] for x in counted} == dict(enumerate((a == b).sum(1).tolist()))
    assert {x[0]: x[2] for x in counted} == dict(enumerate((a % 16 == b % 16).sum(1).tolist()))
