from __future__ import annotations

import hashlib

from gaugeline.llm.exact_dedup import exact_groups, keep_one_of_each


def expected(rows):
    low = [(k, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for k, t in rows]
    out = []
    for k, t in low:
        ids = [i for i, u in low if u == t]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((k, keep, len(ids), k == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_equal_brute_force(docs_of):
    rows = [(1, "Same Text"), (2, "same text"), (3, "sAme text"), (4, "ÄB"), (5, "äb"), (6, None), (7, ""), (8, " "),
            (9, "x" * 300_000), (10, "X" * 300_000), (11, "same text"), (11, "same text"), (None, "same text"),
            (12, "alone"), (None, "nobody")]
    got = sorted((tuple(r) for r in exact_groups(docs_of(rows)).collect()), key=str)
    assert got == expected(rows)


def test_one_frequent_text_and_many_small_groups(docs_of):
    rows = [(k, "hot" if k % 3 else f"t{k % 40}") for k in range(3_000)]
    got = sorted((tuple(r) for r in exact_groups(docs_of(rows)).collect()), key=str)
    assert got == expected(rows)


def test_few_counters_change_nothing(docs_of):
    rows = [(k, f"t{k % 97}") for k in range(1_000)]
    got = sorted((tuple(r) for r in exact_groups(docs_of(rows), winners=3, counters=8).collect()), key=str)
    assert got == expected(rows)


def test_empty_table(docs_of):
    assert exact_groups(docs_of([])).count() == 0
    assert keep_one_of_each(docs_of([])).count() == 0


def test_stage_keeps_columns_and_one_row_each(docs_of):
    docs = docs_of([(1, "a"), (2, "A"), (3, "b"), (3, "b"), (3, "c"), (4, None), (5, "")])
    out = keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(2, "A"), (3, "b"), (3, "c"), (5, "")]
