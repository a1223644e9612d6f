"""The filter audit against a replay of every order, document by document."""

import math
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import filter_audit as audit
from gaugeline.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def replay(rows, names):
    """rows: (part, set of failed names, good, toxic)."""
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations(names):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                    sum(bool(r[2]) for r in gone), sum(bool(r[3]) for r in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def failed(text, earlier):
    text = text or ""
    words = WORD.findall(text)
    found = {"A"} if len(words) < 100 else set()
    found |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    found |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    found |= {"D"} if re.search("[#$%&*|]", text) else set()
    return found | ({"E"} if earlier else set())


def test_paths_weigh_every_order_once():
    for n in (1, 3, 5):
        edges = audit.paths(n)
        assert len(edges) == n * 2 ** (n - 1)
        assert all(sum(w for s, f, w in edges if f == g) == math.factorial(n) for g in range(n))
        assert all(w == math.factorial(bin(s).count("1")) * math.factorial(n - 1 - bin(s).count("1")) for s, _, w in edges)


def test_audit_of_random_failures(spark):
    r = random.Random(1)
    rows = [(r.choice(["x", "y"]), r.randrange(16), r.random() < 0.4, r.random() < 0.2) for _ in range(300)]
    rows += [("hot", 5, True, False)] * 200 + [("none", 0, False, False)]
    df = spark.createDataFrame(rows, "part string, fails int, good boolean, toxic boolean")
    want = replay([(p, {"abcd"[i] for i in range(4) if m >> i & 1}, g, t) for p, m, g, t in rows], "abcd")
    assert got(audit.audit(df, list("abcd"))) == want


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, None, True), ("", None, True, None)],
                               "part string, fails int, good boolean, toxic boolean")
    assert got(audit.audit(df, ["p"])) == {("", "p", 1): (1, 1, 0, 1, 0, 1, 1)}
    assert audit.audit(df.limit(0), ["p"]).count() == 0
    with pytest.raises(ValueError):
        audit.audit(df, list("abcdefgh"))


def test_conditions_and_copies(spark, docs_of):
    r = random.Random(2)
    plain = " ".join(f"w{i}" for i in range(100))
    texts = [plain, plain + " #", " ".join(["w"] * 120), "ABC " * 5, None, "", "Ä" * 9 + "A", "A" + "ä" * 9, "a b",
             "\t " + plain.replace(" ", "\n\x0b") + " \r", " ".join(f"w{i % 80}" for i in range(100)),
             " ".join(f"w{i % 79}" for i in range(100)), "long " * 30_000]
    rows = [(i, r.choice(texts)) for i in range(60)] + [(60 + i, t) for i, t in enumerate(texts)]
    rows += [(None, plain), (None, None), (3, plain), (3, plain), (500, "only"), (500, "only")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(40)] + [(3, 1, None), (None, 1, 1)]
    docs = docs_of(rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first = {}
    for k, t in rows:
        if k is not None:
            first[t or ""] = min(first.get(t or "", k), k)
    flat = [("en", failed(t, k is not None and first[t or ""] < k),
             k is not None and any(i == k and q == 1 for i, q, _ in labels),
             k is not None and any(i == k and x == 1 for i, _, x in labels)) for k, t in rows]
    assert got(audit.audit(audit.marked_documents(docs, known), list("ABCDE"))) == replay(flat, "ABCDE")
    unlabelled = audit.audit(audit.marked_documents(docs, known.limit(0)), list("ABCDE"))
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
    assert audit.audit(audit.marked_documents(docs.limit(0), known), list("ABCDE")).count() == 0


def test_query_on_the_smallest_tables(spark):
    from pathlib import Path
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test data here")
    made = audit.op12_filter_interaction_audit(spark, "/root/testdata/sf0.001")
    parts = table(spark, "/root/testdata/sf0.001", "documents").select("lang").distinct().count()
    assert made.count() == 600 * parts
