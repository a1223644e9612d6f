"""Record queries: filters, pages, and the long form of value arrays."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import schema


def record_query(df: DataFrame, project_id: object = None, gateway_code: str | None = None,
                 dev_code: str | None = None, data_type: int | None = None,
                 start: datetime | Column | None = None,
                 end: datetime | Column | None = None) -> DataFrame:
    """Records that match every given filter; both time bounds are inclusive."""
    equal = {"project_id": project_id, "gateway_code": gateway_code,
             "dev_code": dev_code, "data_type": data_type}
    for column, wanted in equal.items():
        if wanted is not None:
            df = df.filter(F.col(column) == F.lit(wanted))
    if start is not None:
        df = df.filter(F.col("record_time") >= (start if isinstance(start, Column) else F.lit(start)))
    if end is not None:
        df = df.filter(F.col("record_time") <= (end if isinstance(end, Column) else F.lit(end)))
    return df


def page_bounds(page: int, page_size: int) -> tuple[int, int]:
    """(offset, limit) with the defaults for values below 1."""
    size = page_size if page_size > 0 else schema.PAGE_SIZE
    return (max(page, 1) - 1) * size, size


def page_of(df: DataFrame, newest: str, tie: str, page: int = 1,
            page_size: int = schema.PAGE_SIZE) -> DataFrame:
    """One newest-first page plus the total row count on every row."""
    offset, size = page_bounds(page, page_size)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(F.col(newest).desc(), F.col(tie)).offset(offset).limit(size)
    return rows.withColumn("total", total.scalar())


def readings_explode(records: DataFrame, values: str = "vals") -> DataFrame:
    """One row per value of each record, with its place in the array."""
    kept = [c for c in records.columns if c != values]
    return (records.select(*kept, F.posexplode(values).alias("value_index", "value")))


def values_by_type(records: DataFrame, data_type: int) -> DataFrame:
    """All values of one data type with their reading order as columns."""
    long = readings_explode(records.filter(F.col("data_type") == data_type))
    return long.select("record_time", "record_id", "value_index", "value")


def quality_grade(outlier_count: Column, value_count: Column | None = None,
                  bands: tuple[float, float, float] | None = None) -> Column:
    """C with any outlier, else A; with `bands`, A to D by outlier share."""
    if bands is None:
        return F.when(outlier_count > 0, "C").otherwise("A")
    share = F.coalesce(outlier_count / F.nullif(value_count, F.lit(0)), F.lit(0.0))
    a, b, c = bands
    return F.when(share <= a, "A").when(share <= b, "B").when(share <= c, "C").otherwise("D")
