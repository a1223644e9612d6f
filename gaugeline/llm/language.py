"""Language identification with averaged hashed subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import slices, table
from gaugeline.llm.subword import Model, Shape, bags, train

SHAPE = Shape(bits=16, grams=(1, 2, 3, 4), lower=True)
# The model learns from about so many rows by the languages' shares, at least so many of each language (or all it has;
# fewer when there are many languages), and so many words of each.
LEARN_ROWS = 3_000
LEARN_LEAST = 60
LEARN_WORDS = 400


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1


def sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most about `rows` rows, chosen by a hash of the id; the same for any partitioning."""
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1_000_000)) < rows * 1_000_000 // total)


def sample_languages(df: DataFrame, id_col: str, rows: int, lang_col: str = "lang", least: int = LEARN_LEAST) -> DataFrame:
    """About `rows` rows by the languages' shares, where a language with fewer than `least` among them has `least`, or all its
    rows; twice `rows` at most while there are no more languages than `rows`.  Chosen by a hash of the id; the same for
    any partitioning.  A rare language's share is so raised, also for the score and its rejection bound."""
    counts = df.groupBy(F.col(lang_col).alias("__lang")).agg(F.count("*").alias("__rows"))
    total, languages = counts.agg(F.sum("__rows"), F.count("*")).first()
    if not total or total <= rows:
        return df
    wanted = F.greatest(F.lit(rows / total) * F.col("__rows"), F.lit(float(min(least, max(1, rows // languages)))))
    rates = counts.select("__lang", (wanted / F.col("__rows")).alias("__rate"))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(10**12)) < F.col("__rate") * 1e12
    return df.join(F.broadcast(rates), F.col(lang_col) == F.col("__lang")).filter(drawn).select(*df.columns)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shape: Shape = SHAPE,
          most_words: int = LEARN_WORDS, id_col: str = "doc_id") -> Model:
    """A model from the texts and labels of `docs`, which has a bounded number of rows.

    Texts become bags of hashed features in the tasks, so that only those reach the driver, where they
    stay in Arrow's arrays: some 25 kB a row at most.
    """
    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = bags(part.column("text"), shape, most_words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("lang"),
                     pa.array([x.astype(np.int32) for x, _ in made], pa.list_(pa.int32())),
                     pa.array([w for _, w in made], pa.list_(pa.float32()))], ["id", "lang", "ids", "weights"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    made = rows.mapInArrow(bag, "id string, lang string, ids array<int>, weights array<float>").toArrow().combine_chunks()
    made = made.filter(pc.greater(pc.list_value_length(made["ids"]), 0))
    made = made.take(pc.sort_indices(made, [("id", "ascending"), ("lang", "ascending")])).combine_chunks()
    samples = [(i.values.to_numpy(), w.values.to_numpy()) for i, w in zip(made["ids"], made["weights"])]
    return train(samples, made["lang"].to_pylist(), shape)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, accepted.

    score is the calibrated probability of lang_pred, and `accepted` says whether it reaches the
    model's rejection bound.  Null or empty texts and texts without a letter are `und` with
    score 0, not accepted.  Repeated rows come out repeated; null ids stay null; other columns are not read.
    """
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.classes, "und"], object)
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.probabilities(model.logits(part.column("text")))
                lettered = pc.fill_null(pc.match_substring_regex(part.column("text"), r"\pL"), False).to_numpy(False)
                if not model.classes:  # nothing was learned
                    p, lettered = np.zeros((len(p), 1)), np.zeros(len(p), bool)
                best = np.where(lettered, p.argmax(1), len(model.classes))
                score = np.where(lettered, p.max(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score),
                     pa.array(lettered & (score >= model.accept))], ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(label, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 3 is not 1, predicts every row.  Where no such row has a language,
    nothing is learned and every row is `und`."""
    docs = table(spark, sf_dir, "documents")
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    model = learn(sample_languages(known, "doc_id", LEARN_ROWS))
    return identify(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
