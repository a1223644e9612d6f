"""Quality classifier: supervised subword embeddings averaged per document, softmax, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gaugeline.llm.common import Shelf, slices, small_batches, table, unused
from gaugeline.llm.language import held_out, learn, sample
from gaugeline.llm.subword import Model, Shape

SHAPE = Shape(bits=18, grams=(1, 2, 3, 4), pairs=True)
LEARN_ROWS = 4_000
LEARN_WORDS = 600


def learn_quality(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Model:
    """From `rows` labelled documents that are not held out, the rarer label being sampled as often as the other.

    labels: doc_id, quality (0 or 1; null is no label).  The sampled ids are bounded, so they are broadcast.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    chosen = sample(known.filter("label = 0"), "id", rows // 2).unionByName(
        sample(known.filter("label = 1"), "id", rows // 2)).dropDuplicates(["id"])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return learn(texts.dropDuplicates(["doc_id"]), "text", "label", SHAPE, LEARN_WORDS)


def scores(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """`docs` with a column `name`, the probability of label 1 from the whole text.

    Null and empty texts get the score of a text without words.  All rows and columns stay as they are.  A model
    that has seen no label scores 0.5, one that has seen a single label 1 or 0.
    """
    column = model.classes.index("1") if "1" in model.classes else None
    unknown = 0.0 if model.classes else 0.5

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.probabilities(model.logits(part.column("text")))
                made = np.full(len(p), unknown) if column is None else p[:, column]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made)], [*part.schema.names, name])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows that score `least` or more, with their columns, whatever their names.

    All columns pass through Python, so they go there in small batches, and the result is stored while that setting holds.
    """
    name = unused("__score", docs)
    with small_batches(docs.sparkSession):
        return Shelf(docs.sparkSession).put(scores(docs, model, name).filter(F.col(name) >= least).drop(name), "good")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"))
