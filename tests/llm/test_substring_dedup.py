from __future__ import annotations

import random

import numpy as np
import pytest

from gaugeline.llm import substring_dedup as s

from .conftest import prose


def test_cuts_depend_on_the_last_bytes_alone():
    data = np.random.default_rng(1).integers(97, 120, 3_000).astype(np.uint8)
    own = set(s.cuts(data).tolist())
    moved = {c - 7 for c in s.cuts(np.concatenate([np.frombuffer(b"insert ", np.uint8), data])).tolist()}
    assert {c for c in own if c > 20} == {c for c in moved if c > 20}
    slow = []
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - 15):i + 1]:
            h = ((h << 1) + int(s.GEAR[b])) & 0xFFFF
        if h < 1 << (16 - s.CUT_BITS) and i + 1 < len(data):
            slow.append(i + 1)
    assert sorted(own) == [0, *slow, len(data)]


def found(docs):
    return {(r["doc_id"], r["n_words"], r["first_doc_id"]) for r in s.passages(docs).collect()}


def test_passages_at_their_exact_words(docs_of):
    r = random.Random(4)
    long, short = prose(r, 60), prose(r, 30)
    rows = {k: f"{prose(r, 80)} {long} {prose(r, 50)}" for k in (3, 5, 9)}
    rows |= {k: f"{prose(r, 80)} {short} {prose(r, 50)}" for k in (11, 12)}
    rows |= {20: prose(r, 300), 21: None, 22: "", 23: f"{long}", 24: " ".join([prose(r, 55)] * 1), 30: prose(r, 30_000) + " " + long}
    docs = docs_of(rows)
    got = s.passages(docs).collect()
    assert {(x["doc_id"], x["n_words"], x["first_doc_id"], x["kept"]) for x in got} == {
        (k, 60, 3, k == 3) for k in (3, 5, 9, 23, 30)}
    for x in got:
        assert rows[x["doc_id"]].encode()[x["start_byte"]:x["end_byte"]].decode().strip() == long
    cut = {x["doc_id"]: x["text"] for x in s.without_repeats(docs, s.passages(docs)).collect()}
    assert long in cut[3] and long not in cut[5] and len(cut[5].split()) == 130
    assert cut[23] == "" and cut[21] is None and cut[20] == rows[20]


def test_recall_of_short_passages(docs_of):
    r = random.Random(5)
    rows, n = {}, 150
    for k in range(n):
        passage = prose(r, 52)
        rows[2 * k], rows[2 * k + 1] = (f"{prose(r, 40)} {passage} {prose(r, 40)}" for _ in range(2))
    ids = {d for d, _, _ in found(docs_of(rows))}
    assert len(ids) >= 0.99 * 2 * n


def test_repeats_inside_one_document_and_rows_of_one_id_do_not_count(docs_of):
    r = random.Random(6)
    long = prose(r, 90)
    assert found(docs_of([(1, long + " " + long), (2, prose(r, 90)), (2, "x"), (None, long)])) == set()
    assert found(docs_of([])) == set()


def test_a_group_of_many_copies(docs_of):
    r = random.Random(7)
    long = prose(r, 70)
    rows = {k: long if k % 3 == 0 else prose(r, 20) for k in range(300)}
    assert found(docs_of(rows)) == {(k, 70, 0) for k in range(0, 300, 3)}


def test_a_low_near_copy_with_short_stretches_does_not_take_the_kept_one(docs_of):
    r = random.Random(8)
    for _ in range(5):
        long = prose(r, 120)
        edited = " ".join("zq" if i % 40 == 20 else w for i, w in enumerate(long.split()))
        rows = {1: f"{prose(r, 30)} {edited} {prose(r, 30)}"} | {k: f"{prose(r, 40)} {long} {prose(r, 40)}" for k in (4, 6, 8)}
        docs = docs_of(rows)
        got = s.passages(docs)
        assert {(x["doc_id"], x["n_words"], x["first_doc_id"], x["kept"]) for x in got.collect()} == {
            (k, 120, 4, k == 4) for k in (4, 6, 8)}
        assert [x["doc_id"] for x in s.without_repeats(docs, got).collect() if long in x["text"]] == [4]


def test_a_passage_stands_whole_in_one_other_document(docs_of):
    r = random.Random(9)
    rows, n = {}, 60
    for k in range(n):
        a, b = prose(r, 30), prose(r, 30)
        rows |= {10 * k: f"{prose(r, 30)} {a} {b} {prose(r, 30)}", 10 * k + 1: f"{prose(r, 30)} {a} {prose(r, 30)}",
                 10 * k + 2: f"{prose(r, 30)} {b} {prose(r, 30)}"}
    assert found(docs_of(rows)) == set()
    long = prose(r, 100).split()
    parts = {1: long, 2: long[:70], 3: long[20:]}
    got = found(docs_of({k: f"{prose(r, 30)} {' '.join(p)} {prose(r, 30)}" for k, p in parts.items()}))
    assert got == {(1, 100, 1), (2, 70, 1), (3, 80, 1)}  # a passage goes by its least holder, here document 1 itself


def test_chunks_shared_elsewhere_at_the_edges_of_a_passage(docs_of):
    r = random.Random(10)
    rows, n = {}, 60
    for k in range(n):
        passage, before, after = prose(r, 52), prose(r, 40), prose(r, 40)
        text = f"{before} {passage} {after}"
        rows |= {10 * k: text, 10 * k + 1: f"{prose(r, 40)} {passage} {prose(r, 40)}"}
        words = text.split()
        rows |= {10 * k + 2: f"{prose(r, 9)} {' '.join(words[20:60])} {prose(r, 9)}",
                 10 * k + 3: f"{prose(r, 9)} {' '.join(words[72:112])} {prose(r, 9)}"}
    got = found(docs_of(rows))
    assert {d % 10 for d, _, _ in got} == {0, 1}
    assert len({d for d, _, _ in got}) >= 0.99 * 2 * n


def test_recall_of_short_words_and_periodic_text(docs_of):
    r = random.Random(11)
    rows, want = {}, set()
    for k in range(150):
        passage = " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 3))) for _ in range(52))
        rows |= {2 * k + i: f"{prose(r, 40)} {passage} {prose(r, 40)}" for i in (0, 1)}
    for k in range(30):
        passage = " ".join([" ".join(prose(r, 2).split())] * 40)
        rows |= {1_000 + 2 * k + i: f"{prose(r, 40)} {passage} {prose(r, 40)}" for i in (0, 1)}
    got = found(docs_of(rows))
    assert {d for d, _, _ in got} == set(rows)
    assert all(n >= (80 if d >= 1_000 else 52) and first == d - d % 2 for d, n, first in got)


def test_passages_equal_a_search_of_all_windows(docs_of):
    r = random.Random(12)
    rows = {}
    for k in range(40):
        words = [f"w{r.randint(0, 9)}" for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2) if rows else 0):
            own = rows[r.choice(list(rows))].split()
            a = r.randint(0, len(own))
            words += own[a:a + r.randint(20, 90)] + [f"x{r.randint(0, 99)}"]
        rows[k] = " ".join(words)
    held = {}
    for d, text in rows.items():
        words = text.split()
        for i in range(len(words) - 49):
            held.setdefault(tuple(words[i:i + 50]), set()).add((d, i))
    want = {(d, i) for places in held.values() if len({d for d, _ in places}) > 1 for d, i in places}
    covered = set()
    for x in s.passages(docs_of(rows)).collect():
        first = len(rows[x["doc_id"]].encode()[:x["start_byte"]].split())
        covered |= {(x["doc_id"], i) for i in range(first, first + x["n_words"] - 49)}
        assert rows[x["doc_id"]].encode()[x["start_byte"]:x["end_byte"]].decode() in rows[x["first_doc_id"]]
    assert want and covered == want


def least_holders(rows):
    """(doc_id, first word, words, least holder) of every passage, from all windows of all documents."""
    held, out = {}, set()
    for d, text in rows.items():
        words = text.split()
        for i in range(len(words) - 49):
            held.setdefault(tuple(words[i:i + 50]), set()).add(d)
    for d, text in rows.items():
        words, at = text.split(), 0
        own = [min(h) if len(h := held[tuple(words[i:i + 50])]) > 1 else None for i in range(len(words) - 49)]
        while at < len(own):
            end = at
            while end < len(own) and own[end] == own[at]:
                end += 1
            if own[at] is not None:
                out.add((d, at, end - at + 49, own[at]))
            at = end
    return out


def placed(rows, docs):
    return {(x["doc_id"], len(rows[x["doc_id"]].encode()[:x["start_byte"]].split()), x["n_words"], x["first_doc_id"])
            for x in s.passages(docs).collect()}


def test_nested_repeats_go_by_the_least_holder(docs_of):
    r = random.Random(13)
    words = prose(r, 100).split()
    rows = {5: " ".join(words), 9: " ".join(words), 1: f"{prose(r, 30)} {' '.join(words[10:70])} {prose(r, 30)}"}
    docs = docs_of(rows)
    got = placed(rows, docs)
    assert got == least_holders(rows)
    assert got == {(1, 30, 60, 1)} | {(d, *p) for d in (5, 9) for p in ((0, 59, 5), (10, 60, 1), (21, 79, 5))}
    left = {x["doc_id"]: x["text"] for x in s.without_repeats(docs, s.passages(docs)).collect()}
    assert left[1] == rows[1] and left[9] == "" and left[5].split() == words[:10] + words[70:]


def test_windows_with_many_holders_in_many_settings(docs_of):
    r = random.Random(14)
    base = prose(r, 200).split()
    rows = {}
    for k in range(60):
        a, b = sorted(r.sample(range(201), 2))
        rows[k] = " ".join([*prose(r, r.randint(0, 20)).split(), *base[a:b], *prose(r, r.randint(0, 20)).split(), *base[:r.randint(0, 90)]])
    docs = docs_of(rows)
    assert placed(rows, docs) == least_holders(rows)
    left = " ".join(x["text"] for x in s.without_repeats(docs, s.passages(docs)).collect()).split()
    assert set(left) >= {w for d, at, n, _ in least_holders(rows) for w in rows[d].split()[at:at + n]}


def test_ids_of_text_and_rows_of_one_id(spark):
    r = random.Random(15)
    long = prose(r, 70)
    docs = spark.createDataFrame([("b", long, 1), ("a", f"{prose(r, 9)} {long}", 2), ("b", long, 3), (None, long, 4)],
                                 "doc_id string, text string, seed int")
    got = s.passages(docs)
    assert {(x["doc_id"], x["n_words"], x["first_doc_id"], x["kept"]) for x in got.collect()} == {
        ("a", 70, "a", True), ("b", 70, "a", False)}
