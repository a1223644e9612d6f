"""What the corpus operators share: tables, bounded broadcasts, row selection by id."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.session import kept_path

# Rows of a few numbers each that may be broadcast: some 16 MB.
BROADCAST_ROWS = 500_000
# A sieve has at most so many blocks of 512 bits, 16 bits a key up to 8 million keys: some 26 MB.
MOST_BLOCKS = 1 << 18
SIEVE_WORDS, SIEVE_BITS = 8, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters that a task holds as separate words at a time.
SLICE_CHARS = 2_000_000
# Texts, and bytes, that Spark hands to a task's Python at a time.
TEXT_ROWS, BATCH_BYTES = 1_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast only when it is counted and small enough."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(name: str, df: DataFrame) -> str:
    """`name`, with underscores added until no column of `df` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sifted(rows: DataFrame, key: str, held: DataFrame, many: int) -> DataFrame:
    """The rows whose `key` is among those of `held`, some `many`, and a few others: a broadcast Bloom filter, each key in one block."""
    blocks = max(1, min(MOST_BLOCKS, many // 32))
    names = [unused(c, rows) for c in ("__block", "__bits")]
    block = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).alias(names[0])
    places = [F.shiftright(F.xxhash64(key, F.lit(2)), 9 * k).bitwiseAND(511).cast("int") for k in range(SIEVE_BITS)]
    word, bit = ([f(p) for p in places] for f in (lambda p: F.shiftright(p, 6), lambda p: p.bitwiseAND(63)))

    def set_in(w: int) -> Column:
        ones = [F.when(x == w, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(0) for x, b in zip(word, bit)]
        return F.bit_or(reduce(lambda x, y: x.bitwiseOR(y), ones))

    sieve = held.groupBy(block).agg(F.array(*[set_in(w) for w in range(SIEVE_WORDS)]).alias(names[1]))
    passed = [F.bit_get(F.get(names[1], x), b) == 1 for x, b in zip(word, bit)]
    met = rows.withColumn(names[0], block).join(F.broadcast(sieve), names[0])
    return met.filter(reduce(lambda x, y: x & y, passed)).drop(*names)


def those_of(rows: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """The rows whose `key` is in `held`, a stored table of different keys, without a shuffle of `rows`: by broadcast when
    counted and small; else by a sieve, and a few others come along."""
    many = held.count()
    if many > BROADCAST_ROWS:
        return sifted(rows, key, held, many)
    return rows.join(F.broadcast(held), key, "left_semi")


class Shelf:
    """Tables that a job writes to the shared folder and drops when it has read them; the rest go with `session.release`."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = kept_path(spark, "shelf")

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings inside, and what they were after."""
    before = {setting: spark.conf.get(setting) for setting in wanted}
    try:
        for setting, value in wanted.items():
            spark.conf.set(setting, value)
        yield
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs inside go when the job ends, not when the driver happens to collect its garbage."""
    with _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs inside hand at most `rows` rows, and some BATCH_BYTES, at a time to Python, for rows that may be wide."""
    with _set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
                      "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
        yield


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS):
    """Parts of a batch with some `limit` bytes of text each, one row at least.  Whole rows, all of them.

    Parts are copies: string kernels misread a view into a batch after a cast.  What a part has
    freed goes back to the system, as a worker lives on for other tasks.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        held = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, held + limit, "right")))
        yield batch.take(pa.array(np.arange(start, end)))
        pa.default_memory_pool().release_unused()
        start = end
