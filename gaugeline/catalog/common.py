"""Shorthands of the query definitions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import outliers
from gaugeline.session import kept_path
from gaugeline.sources import fixtures as fx

ORDER = ["value_time", "event_id"]
# Baseline scoring in hundredths of the value, so that all sums are exact.
ONLINE = {"threshold": 1000.0, "min_baseline": 5, "radius_floor": 1.0, "sigma_floor": 10.0}
# One running baseline per gateway and data type.
BASELINE = ["gateway_code", "data_type"]
DIGITS = 6


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def text_times(df: DataFrame, *columns: str) -> DataFrame:
    """Times as text, so that both engines print them alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


def newest(df: DataFrame, column: str) -> Column:
    """The table's own 'now': its newest time, as a scalar subquery."""
    return df.agg(F.max(column)).scalar()


def latest_time(spark: SparkSession, sf_dir: str) -> datetime:
    return fx.events(spark, sf_dir).agg(F.max("ts")).first()[0]


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.readings(spark, sf_dir)
    return outliers.flag_zscore(outliers.zscore_in_group(rows, ["record_id"]))


def flagged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `flagged`, without the place in the record (no ordered scan)."""
    rows = fx.reading_stream(spark, sf_dir)
    return outliers.flag_zscore(outliers.zscore_in_group(rows, ["record_id"]))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings scored online, with runs and alerts."""
    rows = fx.reading_stream(spark, sf_dir)
    scored = outliers.cf_online_outlier(rows, BASELINE, ORDER, "cents", **ONLINE)
    return outliers.consecutive_alerts(scored, BASELINE, ORDER, size_of=rows)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table under the shared folder."""
    return kept_path(spark, name)


def tm(column: str, name: str | None = None) -> str:
    """SQL twin of `text_times`."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {name or column}"
