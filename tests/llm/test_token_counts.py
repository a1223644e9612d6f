from __future__ import annotations

import random

import pyarrow as pa

from gaugeline.llm.token_counts import build, read_vocabulary, token_counts


def greedy(word: bytes, have: set[bytes]) -> int:
    at = n = 0
    longest = max(map(len, have))
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at:at + k] in have)
        n += 1
    return n


def test_small_vocabularies_equal_greedy():
    r = random.Random(1)
    for seed in range(20):
        have = {bytes([b]) for b in range(256)} | {
            ("".join(r.choices("ab ", k=r.randint(2, 6)))).encode() for _ in range(r.randint(0, 25))}
        words = ["".join(r.choices("abcé", k=r.randint(1, 40))) for _ in range(80)] + ["a" * 700, "ab" * 400, "b"]
        got = build(sorted(have)).count(pa.array(words))
        assert got.tolist() == [greedy(b" " + w.encode(), have) for w in words], seed


def test_given_vocabulary_on_documents(docs_of):
    have = set(read_vocabulary())
    rows = {1: "Hello world, the quick brown fox!", 2: None, 3: "", 4: " \n ", 5: "ñandú 漢字 🙂 " * 50, 6: "x" * 3_000}
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts(docs_of(rows), build(sorted(have))).collect()}
    for k, text in rows.items():
        words = (text or "").split()
        assert got[k] == (len(words), sum(greedy(b" " + w.encode(), have) for w in words))


def test_empty_and_repeated_rows(docs_of):
    machine = build([bytes([b]) for b in range(256)])
    assert token_counts(docs_of([]), machine).count() == 0
    assert [tuple(r) for r in token_counts(docs_of([(1, "ab c"), (1, "ab c"), (None, "d")]), machine).collect()] == [
        (1, 2, 5), (1, 2, 5), (None, 1, 2)]
