"""Session settings the operators rely on, and the tables they keep in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Times are in UTC, and stored so that row groups can be skipped by time.  A join whose partitions
# are split for a hot key may cost one more shuffle.
NEEDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
_KEPT: list[str] = []


def build_session(app: str = "gaugeline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides any setting."""
    settings = {
        **NEEDED,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """The needed settings on a session made elsewhere."""
    for key, value in NEEDED.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and hand-over tables.

    The cluster names it in ``spark.checkpoint.dir``, and a cluster without that setting is an error.  Only a
    local session, whose driver and executors are one process, gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gaugeline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def kept_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by `release`."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _KEPT.append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Compute `df` once, as a parquet table in the shared folder.

    Cuts the lineage, survives lost executors, and gives later joins a scan with
    column pruning and a known size.
    """
    path = kept_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables, wherever the shared folder is; missing ones are passed over."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables kept in this process; call it when a job's results are stored."""
    delete(spark, _KEPT[since:])
    del _KEPT[since:]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside are deleted at the end, also after a failure.  Read results before that."""
    since = len(_KEPT)
    try:
        yield
    finally:
        release(spark, since)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _KEPT and spark is not None and spark._jsc is not None and not spark._jsc.sc().isStopped():
        release(spark)
