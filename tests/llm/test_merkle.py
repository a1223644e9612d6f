"""Merkle manifests against a tree built level by level in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    """The top, and the (left, right) lists of every leaf."""
    paths, spots, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i:i + 8] for i in range(0, len(level), 8)]
        for i, spot in enumerate(spots):
            run, slot = runs[spot // 8], spot % 8
            paths[i].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            spots[i] = spot // 8
        level = [h(*run) for run in runs]
    return level[0], paths


def forest(rows):
    """rows: (part, key, digest) -> {(part, key, digest): (subroot, root, path)}."""
    parts = sorted({r[0] for r in rows}, key=lambda p: (p is not None, (p or "").encode()))
    trees, leaves = {}, {}
    for p in parts:
        leaves[p] = sorted((r for r in rows if r[0] == p), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[p] = tree([r[2] for r in leaves[p]])
    root, tops = tree([trees[p][0] for p in parts])
    return {leaf: (trees[p][0], root, trees[p][1][i] + tops[k])
            for k, p in enumerate(parts) for i, leaf in enumerate(leaves[p])}


def rows_of(df):
    return {(r.part, r.key, r.digest): (r.subroot, r.root, [tuple(x) for x in r.proof]) for r in df.collect()}


def table_of(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "keep", 1) for r in rows],
                                 "part string, key long, digest string, root string, pos int").repartition(partitions)


@pytest.mark.parametrize("sizes", [[1], [8, 9], [1, 64, 65, 513], [2] * 20])
def test_forest(spark, sizes):
    r = random.Random(sum(sizes))
    names = [None, ""] + [f"p{i}ä" for i in range(20)]
    rows = [(names[k], key, h(str(key), str(k))) for k, n in enumerate(sizes) for key in r.sample(range(10**6), n)]
    assert rows_of(merkle.manifest(table_of(spark, rows), "part", ["key"], "digest")) == forest(rows)


def test_blocks_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [("x", k, h(str(k))) for k in range(600)] + [("y", k, h(str(-k))) for k in range(5)]
    made = merkle.manifest(table_of(spark, rows), "part", ["key"], "digest")
    assert rows_of(made) == forest(rows)


def test_ties_nulls_and_columns(spark):
    rows = [(None, None, h("a")), (None, 3, h("b")), (None, 3, h("c")), ("z", None, h("d"))]
    df = table_of(spark, rows)
    made = merkle.manifest(df, "part", ["key"], "digest")
    assert rows_of(made) == forest(rows)
    assert made.columns == ["part", "key", "digest", "pos", "subroot", "root", "proof"]
    repeated = merkle.manifest(df.unionByName(df).unionByName(df), "part", ["key"], "digest")
    assert repeated.count() == 12 and repeated.select("root").distinct().count() == 1
    ends = repeated.select(merkle.folded(F.col("digest"), F.col("proof")).alias("end"), "root")
    assert ends.filter("end <> root").count() == 0
    assert merkle.manifest(df.limit(0), "part", ["key"], "digest").count() == 0


def test_row_digest(spark, docs_of):
    row = docs_of([(7, "aéB"), (None, None)]).select(merkle.row_digest(*[F.col(c) for c in ("doc_id", "lang", "text")]).alias("d"))
    assert sorted(r.d for r in row.collect()) == sorted([h("1:7", "2:en", "4:aéB"), h("-", "2:en", "-")])


def test_query_finds_what_was_changed(spark, docs_of, tmp_path):
    import zlib
    rows = [(k, t) for k, t in enumerate(["Some Text", "plain", None, "", "UPPER", "Ä stays"] * 8)] + [(99, "Long " * 50_000)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    made = {r.doc_id: r for r in merkle.op11_merkle_dataset_manifest(spark, str(tmp_path)).collect()}
    assert len(made) == len(rows)
    for k, t in rows:
        changed = zlib.crc32(str(k).encode()) % 3 == 0 and t is not None and t != "".join(
            c.lower() if "A" <= c <= "Z" else c for c in t)
        assert made[k].verified == (not changed) == (made[k].folded_root == made[k].root)
    want = forest([("en", k, made[k].leaf) for k, _ in rows])
    for k, _ in rows:
        subroot, root, path = want["en", k, made[k].leaf]
        assert (made[k].subroot, made[k].root) == (subroot, root)
        assert made[k].proof_sha256 == h(*[side for pair in path for side in pair])
