"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeline import schema
from gaugeline.functions.scalars import entries
from gaugeline.operators import cf, outliers
from gaugeline.plans.groups import attach, measure
from gaugeline.session import delete, settle


def record_outliers(records: DataFrame, **limits: float) -> DataFrame:
    """Flagged values of a stream of records; stateless, rows pass straight through."""
    return outliers.record_outliers_in_arrays(records, **limits)


def cf_leaves(readings: DataFrame, keys: list[str], column: str, threshold: float) -> DataFrame:
    """Live leaf CFs; the state is one row per (key, leaf)."""
    return cf.cf_leaves(readings, keys, column, threshold=threshold)


def trend(readings: DataFrame, time: str, width: str, slide: str | None = None,
          late: str = "1 hour") -> DataFrame:
    """Counts, outliers and mean per window; rows later than `late` are left out."""
    return (readings.withWatermark(time, late)
            .groupBy(F.window(time, width, slide))
            .agg(F.count(F.lit(1)).alias("detection_count"),
                 F.count_if("is_outlier").alias("outlier_count"), F.avg("value").alias("avg_spacing"))
            .select(F.col("window.start").alias("bucket"), "detection_count", "outlier_count",
                    "avg_spacing"))


def device_liveness(heartbeats: DataFrame, time: str = "ts", minutes: int = schema.ONLINE_MINUTES,
                    late: str = "1 hour") -> DataFrame:
    """Online spans per device, sent out once a span is over.

    A heartbeat exactly at the limit still belongs to the span, hence the extra
    microsecond of the session gap.
    """
    gap = f"{minutes} minutes 1 microsecond"
    return (heartbeats.withWatermark(time, late)
            .groupBy("dev_code", F.session_window(time, gap).alias("s"))
            .agg(F.max(time).alias("last_seen"), F.count(F.lit(1)).alias("heartbeats"))
            .select("dev_code", F.col("s.start").alias("online_at"), "last_seen", "heartbeats",
                    (F.col("last_seen") + F.expr(f"interval {minutes} minutes")).alias("offline_at")))


def shadow(updates: DataFrame, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Newest reported and desired state per device, version, and whether they differ."""
    at = F.struct(time, tie)

    def newest(column: str):
        return F.max_by(column, F.when(F.col(column).isNotNull(), at)).alias(column)

    state = updates.groupBy("dev_code").agg(
        newest("reported"), newest("desired"), (F.count(F.lit(1)) + 1).alias("version"))
    return state.withColumn("need_sync", ~entries(F.col("reported")).eqNullSafe(
        entries(F.col("desired"))))


def telemetry_windows(flat: DataFrame, time: str, width: str, late: str = "1 hour") -> DataFrame:
    """Mean load and inference time per device and window."""
    return (flat.withWatermark(time, late)
            .groupBy("device_code", F.window(time, width))
            .agg(F.avg("cpu_usage_percent").alias("cpu"), F.avg("gpu_usage_percent").alias("gpu"),
                 F.avg("inference_last_inference_ms").alias("inference_ms"),
                 F.count(F.lit(1)).alias("messages"))
            .select("device_code", F.col("window.start").alias("bucket"), "cpu", "gpu",
                    "inference_ms", "messages"))


def dedup(messages: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """Each message once: repeats of the keys within the delay are dropped."""
    return messages.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def latest_snapshots(snapshots: DataFrame, tree: str = "tree_id", time: str = "record_time",
                     body: str = "body") -> DataFrame:
    """Newest CF document of each tree."""
    return snapshots.groupBy(tree).agg(F.max_by(body, time).alias("body"),
                                       F.max(time).alias("record_time"))


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> None:
    """Process everything that is there now, batch by batch, and return."""
    query: StreamingQuery = (df.writeStream.outputMode(mode).foreachBatch(sink)
                             .option("checkpointLocation", checkpoint)
                             .trigger(availableNow=True).start())
    query.awaitTermination()


class OnlineDetector:
    """Online CF outliers and alerts over a stream, with the state in tables.

    The state is the leaf CFs per key and, per key, the current run and the last
    time seen.  CFs add up, so a batch writes only what its own readings add, under
    its own number; every `compact_every` batches the sum of all so far is written
    as well, and reading the state means that sum and the few batches after it.  A
    repeated batch overwrites its own output and nothing else.  Readings not after
    the last time of their key are written as late and change no state.

    State tables are parted by a hash of the key, so a batch reads the parts of its own keys.
    What a finished batch leaves that no later one reads is deleted when the next batch starts.
    """

    PARTS = 64

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], time: str, tie: str,
                 value: str, limit: int = schema.CONSECUTIVE_LIMIT, compact_every: int = 16,
                 **settings: float) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.keys = keys
        self.time, self.tie, self.value = time, tie, value
        self.limit = limit
        self.compact_every = compact_every
        self.settings = settings

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.PARTS)).cast("int")

    def _base(self, last: int) -> int:
        """The batch up to which the state after `last` is in one sum, or -1."""
        return (last + 1) // self.compact_every * self.compact_every - 1

    def _parts(self, kind: str, last: int, touched: list[int] | None = None) -> DataFrame | None:
        """The tables that together hold the state after batch `last`; of `touched` parts only, if given."""
        if last < 0:
            return None
        base = self._base(last)
        paths = [f"{self.folder}/{kind}/sum/{base}"] if base >= 0 else []
        paths += [f"{self.folder}/{kind}/batch/{b}" for b in range(base + 1, last + 1)]
        out = None
        for path in paths:
            one = self.spark.read.parquet(path)
            one = one if touched is None else one.filter(F.col("part").isin(touched))
            out = one.drop("part") if out is None else out.unionByName(one.drop("part"))
        return out

    def _store(self, table: DataFrame, path: str) -> None:
        table.withColumn("part", self._part()).repartition("part").write.mode("overwrite").partitionBy(
            "part").parquet(f"{self.folder}/{path}")

    def _clean(self, done: int) -> None:
        """Delete what batch `done`, which is finished, and those before it leave and nobody reads."""
        base, every = self._base(done), self.compact_every
        old = [f"input/{done}"]
        for kind in ("leaves", "runs"):
            if done == base:  # the batches that are in the new sum, and the sum before it
                old += [f"{kind}/batch/{b}" for b in range(max(0, base - every + 1), base + 1)]
                old += [f"{kind}/sum/{base - every}"] if base >= every else []
        delete(self.spark, [f"{self.folder}/{path}" for path in old])

    def _leaves(self, last: int, touched: list[int]) -> DataFrame | None:
        parts = self._parts("leaves", last, touched)
        return None if parts is None else cf.cf_merge(parts, [*self.keys, "leaf_id"])

    def _runs(self, last: int, touched: list[int]) -> DataFrame | None:
        parts = self._parts("runs", last, touched)
        return None if parts is None else parts.groupBy(*self.keys).agg(
            F.max_by("streak", "last").alias("streak"), F.max("last").alias("last"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        keys, order = self.keys, [self.time, self.tie]
        if batch_id:
            self._clean(batch_id - 1)
        place = F.struct(self.time, self.tie)
        # Read the source once; from here on the work is a batch job of the main
        # session, with adaptive execution, which streams run without.
        arrived = f"{self.folder}/input/{batch_id}"
        batch.write.mode("overwrite").parquet(arrived)
        batch = self.spark.read.schema(batch.schema).parquet(arrived)
        sizes = measure(batch, keys)
        present = batch.select(*keys).distinct()
        touched = [r[0] for r in present.select(self._part().alias("part")).distinct().collect()]
        leaves, runs = self._leaves(batch_id - 1, touched), self._runs(batch_id - 1, touched)
        rows = batch.withColumn("late", F.lit(False))
        if runs is not None:
            leaves = attach(leaves, present, keys, "left_semi")
            runs = settle(attach(runs, present, keys, "left_semi"))
            last = runs.select(*keys, F.col("last").alias("__last"))
            rows = attach(rows.drop("late"), last, keys, "left").withColumn(
                "late", F.coalesce(place <= F.col("__last"), F.lit(False))).drop("__last")
        late = rows.filter("late")
        fresh = rows.filter(~F.col("late")).drop("late")
        scored = outliers.cf_online_outlier(fresh, keys, order, self.value, prior=leaves,
                                            bound=sizes, **self.settings)
        flags = outliers.consecutive_alerts(scored, keys, order, self.limit, size_of=fresh,
                                            prior=runs, bound=sizes)
        path = f"{self.folder}/flags/batch={batch_id}"
        flags.withColumn("late", F.lit(False)).unionByName(
            late, allowMissingColumns=True).write.mode("overwrite").parquet(path)
        self._write_state(self.spark.read.parquet(path).filter("not late"), batch_id, place)

    def _write_state(self, done: DataFrame, batch_id: int, place) -> None:
        threshold = float(self.settings.get("threshold", schema.RADIUS_THRESHOLD))
        added = cf.cf_leaves(done, self.keys, self.value, threshold=threshold)
        newest = done.groupBy(*self.keys).agg(F.max_by("streak", place).alias("streak"),
                                              F.max(place).alias("last"))
        for kind, table in (("leaves", added), ("runs", newest)):
            self._store(table, f"{kind}/batch/{batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            for kind, parts in (("leaves", self._all_leaves), ("runs", self._all_runs)):
                self._store(parts(batch_id), f"{kind}/sum/{batch_id}")

    def _before_sum(self, kind: str, batch_id: int) -> DataFrame:
        """The earlier sum, if any, and the batches since, `batch_id` included."""
        own = self.spark.read.parquet(f"{self.folder}/{kind}/batch/{batch_id}").drop("part")
        earlier = self._parts(kind, batch_id - 1)
        return own if earlier is None else earlier.unionByName(own)

    def _all_leaves(self, batch_id: int) -> DataFrame:
        return cf.cf_merge(self._before_sum("leaves", batch_id), [*self.keys, "leaf_id"])

    def _all_runs(self, batch_id: int) -> DataFrame:
        return self._before_sum("runs", batch_id).groupBy(*self.keys).agg(
            F.max_by("streak", "last").alias("streak"), F.max("last").alias("last"))

    def flags(self) -> DataFrame:
        """All flags written so far."""
        return self.spark.read.parquet(f"{self.folder}/flags").drop("batch")
