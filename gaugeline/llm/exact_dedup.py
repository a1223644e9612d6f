"""Exact duplicate removal with the frequent texts split off before the shuffle.

A Misra-Gries summary (Spark's `approx_top_k`, a bounded counter table that is built per
task and merged) names the digests that may be frequent.  An exact count verifies them.  The verified
winners, at most `winners` rows, are broadcast and decide their copies on the map side;
all other digests are counted by an ordinary shuffle, partial counts first, and those that
repeat are joined to their rows, so that no group is bound to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import Shelf, ascii_lower, if_small, table, unused

WINNERS = 1_000
COUNTERS = 16_384


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 winners: int = WINNERS, counters: int = COUNTERS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; equality is that of SHA-256.  Null
    text counts as empty, so null and empty texts form one group.  Of a group the largest id
    stays.  Repeated rows count one each, and all rows with the largest id are `kept`.  Null ids
    lose to any other id; a group of null ids only keeps a null id.  Other columns
    are not read.  An empty table gives no rows.

    The counter table misses no digest with more than about 1/2000 of the rows.  Whatever it
    misses or names wrongly only moves work between the two ways, never a result.
    """
    shelf = Shelf(docs.sparkSession)
    rows = shelf.put(docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(ascii_lower(F.col(text_col)), 256).alias("text_sha256")), "digests")
    named = rows.agg(F.expr(f"approx_top_k(text_sha256, {winners}, {counters})").alias("top")).selectExpr(
        "inline(top)").select(F.col("item").alias("text_sha256"))
    verified = shelf.put(
        rows.join(F.broadcast(named), "text_sha256", "left_semi")
        .groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1"), "winners")
    frequent = rows.join(F.broadcast(verified), "text_sha256")
    rest = rows.join(F.broadcast(verified.select("text_sha256")), "text_sha256", "left_anti")
    repeated = rest.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    others = rest.join(repeated, "text_sha256", "left").withColumns({
        "keep_id": F.coalesce("keep_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return frequent.unionByName(others).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, one per group of equal texts; a repeated row stays once.

    Columns are those of `docs`, whatever their names; ids and texts are in doc_id and text.  Texts are
    shuffled only for ids that occur twice.
    """
    shelf = Shelf(docs.sparkSession)
    own, sha, of, times = (unused(name, docs) for name in ("__id", "__sha", "__of", "__times"))
    stay = shelf.put(exact_groups(docs).filter("kept").groupBy(
        F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(times)), "stay")
    signed = docs.withColumn(of, F.sha2(ascii_lower(docs["text"]), 256))
    same = docs["doc_id"].eqNullSafe(F.col(own)) & (F.col(of) == F.col(sha))
    once = signed.join(if_small(stay.filter(F.col(times) == 1)), same, "left_semi")
    twice = stay.filter(F.col(times) > 1)
    if not twice.isEmpty():
        once = once.unionByName(signed.join(if_small(twice), same, "left_semi").dropDuplicates(["doc_id", of]))
    return once.drop(of)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)"""
