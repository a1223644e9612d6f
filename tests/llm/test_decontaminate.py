from __future__ import annotations

import random

import pytest

from gaugeline.llm.decontaminate import clean_of, overlaps

from .conftest import prose


@pytest.fixture
def items(spark):
    r = random.Random(1)
    rows = [(k, prose(r, 30 + k)) for k in range(5)] + [(7, prose(r, 9)), (8, "too short"), (9, None), (10, "")]
    return dict(rows), spark.createDataFrame(rows, "item_id long, text string")


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_whole_changed_and_partial_passages(items, docs_of):
    texts, table = items
    r = random.Random(2)

    def within(passage):
        return f"{prose(r, 40)} {passage} {prose(r, 40)}"

    def swapped(k, step):
        words = texts[k].split()
        return " ".join("zzzz" if i % step == step - 1 else w for i, w in enumerate(words))

    docs = docs_of({
        1: within(texts[0]), 2: within(texts[1].upper().replace(" ", ",  ")), 3: within(swapped(2, 6)),
        4: within(" ".join(texts[3].split()[5:25])), 5: within(swapped(4, 2)), 6: prose(r, 400), 7: None, 8: "",
        9: within(texts[7]), 10: within(" ".join(texts[0].split()[:8])), 11: prose(r, 60_000) + " " + texts[4]})
    assert pairs(overlaps(docs, table)) == {(1, 0), (2, 1), (3, 2), (4, 3), (9, 7), (11, 4)}
    kept = clean_of(docs, table)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {5, 6, 7, 8, 10}


def test_bounds_and_count_of_one_overlap(items, docs_of):
    texts, table = items
    docs = docs_of([(1, "one two three " + texts[0] + " four")] * 2)  # a repeated row
    row, = overlaps(docs, table).collect()
    assert (row["start_word"], row["end_word"]) == (3, 33)
    assert row["n_matched"] == 30


def test_by_shuffle_as_by_broadcast(items, docs_of, monkeypatch):
    texts, table = items
    docs = docs_of({1: texts[0], 2: "nothing here " * 20, 3: texts[1] + " " + texts[2]})
    monkeypatch.setattr("gaugeline.llm.decontaminate.if_small", lambda df: df)
    assert pairs(overlaps(docs, table)) == {(1, 0), (3, 1), (3, 2)}


def test_empty_tables(items, docs_of):
    _, table = items
    assert overlaps(docs_of([]), table).count() == 0
    assert overlaps(docs_of({1: "a b c"}), table.limit(0)).count() == 0
    assert clean_of(docs_of([(None, "a"), (1, None)]), table).count() == 2


def test_four_in_five_equal_words_and_long_items(spark, docs_of):
    r = random.Random(3)
    texts = {k: prose(r, n) for k, n in enumerate((45, 15, 200, 60))}
    table = spark.createDataFrame(list(texts.items()), "item_id long, text string")

    def fifth(text):
        return " ".join("zzzz" if i % 5 == 4 else w for i, w in enumerate(text.split()))

    words = texts[3].split()
    gap = " ".join([*words[:20], *["zzzz"] * 20, *words[40:]])  # two stretches, placed alike
    docs = docs_of({k: f"{prose(r, 40)} {t} {prose(r, 40)}" for k, t in enumerate((fifth(texts[0]), fifth(texts[1]), texts[2], gap))})
    got = {(x["doc_id"], x["item_id"]): x[2:5] for x in overlaps(docs, table).collect()}
    assert got == {(0, 0): (40, 84, 36), (1, 1): (40, 54, 12), (2, 2): (40, 240, 200), (3, 3): (40, 100, 20)}


def test_seeds_travel_without_words(spark, items, docs_of, monkeypatch):
    from gaugeline.llm import decontaminate as de

    texts, table = items
    worded = table.select("item_id", de.word_hashes(table["text"]).alias("words"))
    assert de.seeds(worded, de.MASKS, "item_id").columns == ["item_id", "at", "seed"]
    # an id given to two texts, a repeated row, and items that shuffle, with and without the sieve
    docs = docs_of([(1, "one " + texts[0]), (1, "one " + texts[0]), (1, "three words before " + texts[0]), (2, texts[1]), (3, "no such words " * 9)])
    expected = sorted(overlaps(docs, table).collect())
    alone, = overlaps(docs_of([(1, "one " + texts[0])]), table).collect()
    assert [r["doc_id"] for r in expected] == [1, 2] and expected[0]["n_hits"] == 3 * alone["n_hits"]
    monkeypatch.setattr(de, "if_small", lambda df: df)
    monkeypatch.setattr(de, "BROADCAST_WORDS", 0)
    assert sorted(overlaps(docs, table).collect()) == expected
    monkeypatch.setattr(de, "BROADCAST_ROWS", 0)
    assert sorted(overlaps(docs, table).collect()) == expected


def test_a_sieve_keeps_all_keys_and_few_others(spark):
    from gaugeline.llm.decontaminate import sifted

    held = spark.range(3_000).selectExpr("id * 7 as k")
    got = {r["k"] for r in sifted(spark.range(60_000).selectExpr("id as k"), "k", held, 3_000).collect()}
    assert set(range(0, 21_000, 7)) <= got and len(got) < 3_000 + 57_000 * 0.05
