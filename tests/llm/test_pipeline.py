from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gaugeline.llm import catalog, decontaminate, exact_dedup, ngram_join, quality

SF = "/root/testdata/sf0.01"


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(catalog.QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()
    assert set(catalog.SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def stages(spark):
    """The ids and texts after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append({r["doc_id"]: r["text"] for r in docs.collect()})
    return out


def test_stages_take_effect_and_run_does_all(spark, stages):
    sizes = [len(x) for x in stages]
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and sizes[-1] > 0.4 * sizes[0]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(stages[-1])


def test_no_copy_or_near_copy_is_left(stages):
    from .test_ngram_join import expected

    lowered = [t.lower() for t in stages[2].values()]
    assert len(set(lowered)) == len(lowered)
    want = {k for k, _, c in expected(list(stages[2].items())) if c == k}
    assert set(stages[3]) == want


def test_stages_bear_columns_of_their_own_names(spark):
    """Extra columns called as the stages call theirs come through, with their values."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300")
    extra = ["__id", "__ID_", "__sha", "__of", "__times", "__score", "count", "component"]
    wide = docs.selectExpr("*", *[f"doc_id + {i} AS `{name}`" for i, name in enumerate(extra)])
    model = quality.learn_quality(docs, labels, 200)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for stage in (lambda d: quality.keep_good(d, model), exact_dedup.keep_one_of_each, ngram_join.first_of_each,
                  lambda d: decontaminate.clean_of(d, items)):
        got = stage(wide)
        assert got.columns == wide.columns
        rows = got.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stage(docs).collect())
        assert all(r[name] == r["doc_id"] + i for r in rows for i, name in enumerate(extra))


def test_groups_of_null_ids(docs_of):
    got = exact_dedup.exact_groups(docs_of([(None, "Same"), (None, "same"), (3, "other"), (4, "OTHER"), (5, "alone"), (None, "x")]))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()), key=str) == sorted([
        (None, None, 2, True), (None, None, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True),
        (None, None, 1, True)], key=str)
