from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gaugeline.llm import language, quality
from gaugeline.llm.common import slices
from gaugeline.llm.ngram_join import shingle_sets
from gaugeline.llm.subword import Shape, bags, features_of, pair_buckets, train, words_of

SMALL = "/root/testdata/sf0.1"


def test_words_of_odd_white_space():
    w = words_of(pa.array([" a  b ", None, "", "\n", "b\tc a"]))
    assert [[w.unique[c].as_py() for c in w.codes[x:y]] for x, y in zip(w.bounds, w.bounds[1:])] == [["a", "b"], [], [], [], ["b", "c", "a"]]


def test_parts_of_a_batch_read_like_the_whole():
    r = random.Random(2)
    texts = ["".join(r.choices("ABcé  ñ漢\n", k=r.randint(0, 60))) for _ in range(300)] + [None, "", "x" * 5_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for source in (batch, batch.slice(7)):
        seen = []
        for part in slices(source, "text", 500):
            for lower in (False, True):
                w = words_of(part.column("text"), lower)
                got = [[w.unique[c].as_py() for c in w.codes[x:y]] for x, y in zip(w.bounds, w.bounds[1:])]
                own = [(t or "").lower() if lower else t or "" for t in part.column("text").to_pylist()]
                assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in own]
            seen += [len(s) for s in shingle_sets(part.column("text"))]
        own = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in source.column("text").to_pylist()]
        assert seen == [len({tuple(x.lower() if x.isascii() else x for x in w[i:i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0
                        for w in [["".join(c.lower() if c.isascii() else c for c in x) for x in w] for w in own]]


@pytest.mark.parametrize("pairs", [False, True])
def test_scores_equal_the_average_of_vectors(pairs):
    shape = Shape(bits=10, pairs=pairs)
    r = random.Random(1)
    texts = [" ".join(r.choices(["aa", "bb", "cé", "dd", "x"], k=r.randint(0, 15))) for _ in range(40)]
    made = bags(pa.array(texts), shape, 10_000)
    model = train(made, [t.count("a") > 2 for t in texts], shape, rounds=2)
    slow = [(w @ model.table[i] if len(i) else 0) + model.bias for i, w in made]
    # Pairs are counted in stretches of 20 words for learning; these texts are shorter.
    assert np.allclose(model.logits(pa.array(texts)), slow, atol=1e-5)


def test_no_words_has_no_features():
    of, bucket, whole = features_of(pa.array([], pa.string()), Shape())
    assert len(of) == len(bucket) == len(whole) == 0
    assert len(pair_buckets(np.array([0, 0]), np.array([5], np.uint64), Shape())) == 1


@pytest.fixture(scope="module")
def languages(spark):
    return language.op2_language_id(spark, SMALL).join(
        spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").toPandas()


def test_language_of_held_out_rows(languages):
    held = languages[languages.held_out & languages.lang.notna()]
    assert len(held) > 2_000
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert languages.score.between(0, 1).all()
    accepted = held[held.accepted]
    assert len(accepted) > 0.8 * len(held) and (accepted.lang_pred == accepted.lang).mean() > 0.98


def test_language_of_odd_texts(spark, docs_of):
    model = language.learn(spark.read.parquet(f"{SMALL}/documents.parquet").limit(400))
    docs = docs_of([(1, None), (2, ""), (3, "123 -- 456"), (4, "the " * 100_000), (4, "the"), (None, "und der die"), (5, "é")])
    got = language.identify(docs, model).collect()
    assert [(r["doc_id"], r["lang_pred"] == "und") for r in got] == [
        (1, True), (2, True), (3, True), (4, False), (4, False), (None, False), (5, False)]
    assert [r["score"] for r in got][:3] == [0.0] * 3 and not got[0]["accepted"]
    assert language.identify(docs_of([]), model).count() == 0


def test_quality_of_held_out_rows(spark):
    got = quality.op10_quality_classifier(spark, SMALL).join(
        spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out & got.quality.notna()]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.85


def test_quality_keeps_rows_and_columns(spark, docs_of):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.learn_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), 600)
    odd = docs_of([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y " * 200_000)])
    scored = quality.scores(odd, model)
    assert scored.columns == [*odd.columns, "__score"] and scored.filter("__score between 0 and 1").count() == 5
    assert quality.keep_good(odd, model, 0.0).columns == odd.columns
    assert quality.keep_good(docs_of([]), model).count() == 0


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(10_000).withColumnRenamed("id", "doc_id")
    a, b = (sorted(r[0] for r in language.sample(d, "doc_id", 500).collect()) for d in (df, df.repartition(7)))
    assert a == b and 350 < len(a) <= 700
    assert language.sample(df.limit(5), "doc_id", 500).count() == 5


def test_nothing_to_learn_from(spark, docs_of):
    model = language.learn(docs_of([]))
    got = language.identify(docs_of([(1, "some text"), (2, None)]), model).collect()
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in got] == [("und", 0.0, False)] * 2
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.learn_quality(docs_of({1: "a b"}), labels)
    assert [r["__score"] for r in quality.scores(docs_of({1: "a b", 2: None}), model).collect()] == [0.5, 0.5]
    assert quality.keep_good(docs_of({1: "a b", 2: None}), model).count() == 2


def test_one_label_only(spark, docs_of):
    docs = docs_of({k: "word text" for k in range(12)})
    labels = spark.createDataFrame([(k, 1) for k in range(12)], "doc_id long, quality int")
    assert {r["__score"] for r in quality.scores(docs, quality.learn_quality(docs, labels)).collect()} == {1.0}


def test_a_rare_language_is_learned_beside_a_frequent_one(spark, monkeypatch, tmp_path):
    r = random.Random(21)
    rows = [(k, " ".join(r.choices(["mo", "lat", "perin", "sola", "duvet"], k=12)), "aa") for k in range(6_000)]
    rows += [(k, " ".join(r.choices(["xyk", "wrj", "zzoq", "qhyx", "jjw"], k=12)), "bb") for k in range(6_000, 6_030)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("gaugeline.llm.language.LEARN_ROWS", 100)
    known = spark.read.parquet(f"{tmp_path}/documents.parquet")
    picked = {x["lang"]: x["count"] for x in language.sample_languages(known, "doc_id", 100).groupBy("lang").count().collect()}
    assert picked["bb"] == 30 and 60 < picked["aa"] < 140
    got = language.op2_language_id(spark, str(tmp_path)).filter("doc_id >= 6000").collect()
    assert len(got) == 30 and {x["lang_pred"] for x in got} == {"bb"}
