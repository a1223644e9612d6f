"""Packing by optimal length buckets.

The global histogram of exact document lengths goes to the driver, where dynamic programming finds the bucket bounds with
the least padding.  T tokens make at most sqrt(2 T) different lengths, so the histogram stays far smaller than the corpus.
Inside a bucket, batches of equal padded length are filled up to a token budget by a numbering that needs no task to hold
a bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import Shelf, table

BUCKETS = 16
BUDGET = 32_768
EXACT_LENGTHS = 1_024
#: Choices of a bound that the driver weighs at a time; those of one length are not parted.
MOST_LENGTHS = 200_000
CELL_ROWS = 4_096
MOST_CELLS = 65_536


def token_count(text: Column) -> Column:
    """Words divided by ASCII white space; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rounded(length: Column) -> Column:
    """Lengths up to 1024 as they are, longer ones rounded up by less than 1/64: at most
    1024 + 128 per doubling distinct values, however long the texts."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - 7).cast("long")
    return F.when(length <= EXACT_LENGTHS, length).otherwise(F.ceil(length / step).cast("long") * step)


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bounds, the last being the longest length, that minimise sum(count * (bound - length)).

    lengths: ascending.  cost[j] is the least padding of the first j lengths; a further bucket from i to j adds
    bound_j * rows - tokens of that stretch.  The best i never falls as j grows, so the middle j of a part halves the
    choice for those on both sides of it; the parts of one level are weighed together.
    """
    lengths = np.asarray(lengths)
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    n = len(lengths)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        best, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int32)
        best[0] = 0
        first, last, low, high = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(first):
            j = (first + last) // 2
            ends = np.cumsum(np.minimum(j, high + 1) - low)  # of the choices of each j, one behind the other
            start = 0
            while start < len(j):
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + MOST_LENGTHS, "right")))
                part, begins = j[start:end], np.append(before, ends[start:end - 1]) - before
                sizes = ends[start:end] - before - begins
                i = np.arange(ends[end - 1] - before) + np.repeat(low[start:end] - begins, sizes)
                to = np.repeat(part, sizes)
                total = cost[i] + lengths[to - 1] * (rows[to] - rows[i]) - (tokens[to] - tokens[i])
                best[part] = np.minimum.reduceat(total, begins)
                least = np.flatnonzero(total == np.repeat(best[part], sizes))
                cut[part] = i[least[np.searchsorted(least, begins)]]
                start = end
            left, right = first < j, j < last
            first, last, low, high = (np.concatenate(x) for x in (
                (first[left], j[right] + 1), (j[left] - 1, last[right]), (low[left], cut[j[right]]), (cut[j[left]], high[right])))
        cost = best
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = cut[j]
    return bounds[::-1]


def histogram(full: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Every length of `n_tokens`, ascending, and the documents of each."""
    found = full.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    lengths, counts = (found[c].to_numpy() for c in ("n_tokens", "n"))
    order = np.argsort(lengths)
    return lengths[order], counts[order]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, bucket, batch, slot, padding.

    `bucket` is the padded length, the smallest bound that holds the document.  A batch of a bucket holds
    budget // bucket documents (at least one, so a document longer than the budget is a batch of its
    own, whole), all batches but the last being full.  `slot` counts from 0 in the batch.  Documents without a
    word (null or empty text too) need no room: bucket, batch, slot and padding are null.
    Repeated rows and null ids are packed like others.  Other columns are not read.
    """
    shelf = Shelf(docs.sparkSession)
    sized = shelf.put(docs.select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).alias("n_tokens")), "sizes")
    empty = sized.filter("n_tokens = 0").select(
        "doc_id", "n_tokens", *[F.lit(None).cast("long").alias(c) for c in ("bucket", "batch", "slot", "padding")])
    full = sized.filter("n_tokens > 0")
    lengths, counts = histogram(full)
    if not len(lengths):
        return empty
    bounds = best_bounds(lengths, counts, buckets)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds]).cast("long")
    # A bucket is cut into cells by hash, each small enough to be numbered in one task.
    per_cell = max(CELL_ROWS, int(counts.sum()) // MOST_CELLS)
    held = {b: int(counts[(lengths <= b) & (lengths > low)].sum()) for low, b in zip([0, *bounds], bounds)}
    cells = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(-(-n // per_cell))) for b, n in held.items()])
    split = full.withColumn("bucket", bucket).withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(8)), cells))
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    first = split.groupBy("bucket", "cell").count().select("bucket", "cell", F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("doc_id", "n_tokens"))
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    at = F.col("first") + F.col("row") - 1
    numbered = split.withColumn("row", inside).join(F.broadcast(first), ["bucket", "cell"])
    return numbered.select(
        "doc_id", "n_tokens", "bucket", F.floor(at / per_batch).cast("long").alias("batch"),
        F.pmod(at, per_batch).cast("long").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding")
    ).unionByName(empty)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
