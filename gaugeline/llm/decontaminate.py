"""Benchmark decontamination by spaced seeds.

A mask such as 1110111 is laid over the words at every position of a text; the words under
its ones are hashed and the word under a zero may be anything.  Seeds of documents meet seeds
of benchmark items in a join, without the words; the few texts with hits are read again.  Document and item, laid over each
other as hits have them, are compared word by word along the whole item, once for all hits that lay them alike, and the
stretches with at least 80 % equal words are found.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import BROADCAST_ROWS, Shelf, if_small, sifted, table, those_of, unused

MASKS = ("1110111", "11011011", "1011001101")
MIN_MATCH = 12
ITEM_SHARE = 0.8
#: Words of all items that may be broadcast: some 16 MB.
BROADCAST_WORDS = 2_000_000


def word_hashes(text: Column) -> Column:
    """One 64-bit hash per run of letters and digits, without case; null text has none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, masks: tuple[str, ...], *carried: str) -> DataFrame:
    """A row (seed, at) for every mask and position of the array `words`."""
    shortest = min(map(len, masks))
    starts = F.when(F.size("words") >= shortest, F.sequence(F.lit(0), F.size("words") - shortest))
    placed = rows.select(*carried, "words", F.explode(starts).alias("at"))
    under = [F.when(F.col("at") + len(mask) <= F.size("words"),
                    F.xxhash64(F.lit(m), *[F.get("words", F.col("at") + k) for k, bit in enumerate(mask) if bit == "1"]))
             for m, mask in enumerate(masks)]
    return placed.select(*carried, "at", F.explode(F.array(*under)).alias("seed")).filter("seed is not null")


def _stretches(equal: Column, needed: Column) -> Column:
    """Stretches from one equal word to another with ITEM_SHARE (four in five) equal words and `needed` of them: an array
    of (start, end, matched) with the longest from each start.

    equal: ascending places of the equal words.  From the i-th to the j-th of them 5 (j - i + 1) >= 4 (place j -
    place i + 1), so 5 j - 4 place j may be less by one at most than 5 i - 4 place i.
    """
    lead = F.transform(equal, lambda place, i: 5 * i - 4 * place)

    def longest(own: Column, i: Column) -> Column:
        last = F.array_max(F.transform(lead, lambda v, j: F.when(v + 1 >= own, j)))
        return F.struct(F.get(equal, i).alias("start"), (F.get(equal, last) + 1).alias("end"), (last - i + 1).alias("matched"))

    whole = F.get(lead, F.size(equal) - 1) + 1 >= F.get(lead, F.lit(0))
    found = F.when(whole, F.array(F.struct(
        F.get(equal, F.lit(0)).alias("start"), (F.element_at(equal, -1) + 1).alias("end"), F.size(equal).alias("matched"))))
    return F.when(F.size(equal) >= needed, F.filter(
        found.otherwise(F.transform(lead, longest)), lambda s: s["matched"] >= needed))


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, min_match: int = MIN_MATCH,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and benchmark item that share a passage: doc_id, item_id, start_word, end_word,
    n_matched, n_hits.

    items: item_id, text.  A passage counts when a stretch with 80 % equal words, placed as a seed has it, holds
    `min_match` equal words, or for shorter items 80 % of the item.  start_word and end_word (exclusive) span
    all such stretches of the pair; n_matched is the largest number of equal words of one; n_hits counts the seeds
    placed so.  Items with fewer words than the shortest mask cannot be found.
    Null or empty texts, null ids and empty tables give no rows.  Repeated items count once
    each id; other columns are not read.

    The item side is broadcast only when counted and small.  Beyond that the seeds of documents go through a sieve, and
    what is left meets by a shuffle, which adaptive execution splits at frequent seeds.
    """
    shelf = Shelf(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    right = shelf.put(items.select("item_id", word_hashes(F.col("text")).alias("item")).filter("item_id is not null").distinct(), "items")
    their = shelf.put(seeds(right.withColumnRenamed("item", "words"), masks, "item_id")
                      .select("seed", "item_id", F.col("at").alias("item_at")).distinct(), "seeds")

    def worded(rows: DataFrame) -> DataFrame:
        """`own` tells the different texts of one id apart."""
        return rows.select("doc_id", word_hashes(F.col("text")).alias("words")).withColumn("own", F.xxhash64("words"))

    ours, many = seeds(worded(texts), masks, "doc_id", "own"), their.count()
    if many > BROADCAST_ROWS:
        ours = sifted(ours, "seed", their.select("seed"), many)
    # Rows repeated under one id have the same hits, which each of them counts below.
    hits = ours.join(if_small(their), "seed").select(
        "doc_id", "own", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "at", "seed").distinct()
    found = shelf.put(hits.groupBy("doc_id", "own", "item_id", "shift").agg(F.count("*").alias("n")), "found")

    held = worded(those_of(texts, "doc_id", shelf.put(found.select("doc_id").distinct(), "ids")))
    few_words = (right.agg(F.sum(F.size("item"))).first()[0] or 0) <= BROADCAST_WORDS
    # Items too wide for a broadcast meet the hits first, so that no texts are shuffled for them.
    laid = (held.join(if_small(found), ["doc_id", "own"]).join(if_small(right), "item_id") if few_words
            else held.join(found.join(right, "item_id"), ["doc_id", "own"]))
    low, item_low = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    both = F.least(F.size("words") - low, F.size("item") - item_low)
    laid = laid.select(
        "doc_id", "item_id", low.alias("low"), F.size("item").alias("item_words"), "n",
        F.filter(F.sequence(F.lit(0), both - 1), lambda k: F.get("words", low + k) == F.get("item", item_low + k)).alias("equal"))
    needed = F.least(F.lit(min_match), F.ceil(F.col("item_words") * ITEM_SHARE)).cast("int")
    scored = laid.select("doc_id", "item_id", "low", "n", _stretches(F.col("equal"), needed).alias("s")).filter("size(s) > 0")
    return scored.groupBy("doc_id", "item_id").agg(
        F.min(F.col("low") + F.array_min("s.start")).alias("start_word"),
        F.max(F.col("low") + F.array_max("s.end")).alias("end_word"),
        F.max(F.array_max("s.matched")).alias("n_matched"), F.sum("n").alias("n_hits"))


def clean_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that share no passage with any item, with all their columns.  Rows without id stay."""
    own = unused("__id", docs)
    leaked = Shelf(docs.sparkSession).put(overlaps(docs, items).select(F.col("doc_id").alias(own)).distinct(), "leaked")
    return docs.join(if_small(leaked), docs["doc_id"] == F.col(own), "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
