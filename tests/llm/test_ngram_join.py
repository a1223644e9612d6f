from __future__ import annotations

import random
import re

import pytest

from gaugeline.llm import ngram_join as j

from .conftest import prose


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    sets = [(k, grams(t)) for k, t in rows]
    low = {k: k for k, _ in sets if k is not None}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return sorted(((k, len(x), None if k is None else root(k)) for k, x in sets), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(r, text, changes):
    words = text.split()
    for _ in range(changes):
        at = r.randrange(len(words))
        words[at:at + r.randint(0, 1)] = [prose(r, 1)]
    return " ".join(words)


def corpus(seed):
    r = random.Random(seed)
    common = prose(r, 25)
    rows, k = [], 0
    for group in range(6):
        base = prose(r, r.randint(30, 150))
        for _ in range(r.randint(2, 25)):
            rows.append((k, edited(r, base, r.randint(0, 5))))
            k += 1
    for _ in range(60):
        rows.append((k, f"{prose(r, r.randint(0, 60))} {common} {prose(r, r.randint(0, 60))}"))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "one two"), (k + 3, "One  two"), (k + 4, "one"), (k + 5, "a b c d"), (k + 6, "a b c d e"),
             (k + 7, rows[3][1].upper()), (k + 8, prose(r, 20_000)), (None, rows[3][1]), rows[5], rows[5], (k + 9, "Ä b c d e"),
             (k + 10, "ä b c d e"), (k + 11, "the " * 500), (k + 12, "the " * 700)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(seed, docs_of):
    rows = corpus(seed)
    assert got(j.components(docs_of(rows))) == expected(rows)


def test_other_plans_same_rows(docs_of, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(j, "if_small", lambda df, rows=0: df)
    monkeypatch.setattr(j, "RANGE_SHINGLES", 50)
    assert got(j.components(docs_of(rows), known=16)) == expected(rows)
    monkeypatch.setattr(j, "MOST_ROUNDS", 0)
    assert got(j.components(docs_of(rows))) == expected(rows)


@pytest.mark.parametrize("matches", [1, 2, 4])
def test_any_match_length_is_whole(matches, docs_of, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(j, "best_matches", lambda own: min(matches, (80 * len(own) + 99) // 100))
    monkeypatch.setattr(j, "MOST_ROUNDS", 0)
    assert got(j.components(docs_of(rows))) == expected(rows)


def test_nothing(docs_of):
    assert got(j.components(docs_of([]))) == []
    assert got(j.components(docs_of({1: None, 2: ""}))) == [(1, 0, 1), (2, 0, 2)]


def test_stage_keeps_one_of_each(docs_of):
    rows = corpus(6)
    docs = docs_of(rows)
    kept = j.first_of_each(docs)
    assert kept.columns == docs.columns
    want = sorted(str(k) for k, _, c in expected(rows) if c is None or c == k)
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == want


def test_packed_counts_come_back():
    import numpy as np

    tokens, counts = np.array([0, 5, 4_000_000_000], np.uint32), np.array([1, 70_000, 3])
    a, b = j._unpack(j._pack(tokens, counts))
    assert a.tolist() == tokens.tolist() and b.tolist() == counts.tolist()


def test_rounds_follow_new_links_and_end_when_they_spare_little(docs_of, monkeypatch):
    """Around one passage, pairs of near copies that meet only beside a text that links with neither: a round joins
    those of which it draws one as leader, and hardly spares a pair of the whole."""
    r = random.Random(8)
    passage, start, rows = prose(r, 50), prose(r, 15), []
    for k in range(0, 240, 3):
        own = prose(r, 9)
        rows += [(k, f"{start} {passage} {own}"), (k + 1, f"{passage} {own} {prose(r, 2)}"), (k + 2, f"{passage} {own} {prose(r, 2)}")]
    rounds, followed, verified, whole = [], [], j._Join.verified, j.connected_components
    monkeypatch.setattr(j._Join, "verified", lambda self, pairs: rounds.append(1) or verified(self, pairs))
    monkeypatch.setattr(j, "connected_components", lambda ids, edges: followed.append(edges.count()) or whole(ids, edges))
    out = got(j.components(docs_of(rows)))
    assert out == expected(rows) and len({c for _, _, c in out}) == 160
    assert len(followed) > 1 and sum(followed) == 80  # each link once
    assert len(rounds) <= 3


def test_merged_equals_all_links_at_once(spark):
    r = random.Random(9)
    component, low = None, {}

    def root(k):
        while low.setdefault(k, k) != k:
            k = low[k]
        return k

    for _ in range(4):
        links = [tuple(r.sample(range(60), 2)) for _ in range(12)]
        for a, b in links:
            p, q = sorted((root(a), root(b)))
            low[q] = p
        component = j.merged(component, spark.createDataFrame(links, "a long, b long")).localCheckpoint()
        assert got(component) == sorted(((k, root(k)) for k in low), key=str)


def test_sets_are_made_for_candidates_only(docs_of, monkeypatch):
    from gaugeline.llm import common, ngram_join

    r = random.Random(11)
    own = {k: prose(r, 60).split() for k in range(12)}
    shared = [prose(r, 14) for _ in range(6)]
    # pairs share a rare passage, which puts them in common buckets; only 0 and 20 are alike
    docs = {k: " ".join([*words, shared[k // 2]]) for k, words in own.items()} | {20: " ".join([*own[0], shared[0], "end"])}
    made, put = [], common.Shelf.put

    def watched(self, df, name):
        stored = put(self, df, name)
        if name.startswith("sets"):
            made.extend(x["doc_id"] for x in stored.select("doc_id").collect())
        return stored

    monkeypatch.setattr(common.Shelf, "put", watched)
    cleaned = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        made.clear()
        table = docs_of(docs)
        before = table.sparkSession.conf.get(cleaned)
        got = {x["doc_id"]: x["component_id"] for x in ngram_join.components(table).collect()}
        assert got == {k: k for k in own} | {20: 0}
        assert {0, 20} <= set(made) and len(set(made)) <= 4
        assert table.sparkSession.conf.get(cleaned) == before
