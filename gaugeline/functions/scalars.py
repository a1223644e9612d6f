"""Scalar expressions: guarded ratio, id parsing, time text, state maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def leading_int(text: Column) -> Column:
    """The integer a text starts with; 0 for anything else."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def split_list(text: Column) -> Column:
    """Items of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def entries(m: Column) -> Column:
    """A map as a sorted entry array, so two maps can be compared."""
    return F.array_sort(F.map_entries(or_empty(m)))


def or_empty(m: Column) -> Column:
    return F.coalesce(m, F.create_map().cast("map<string,string>"))


def merge_maps(old: Column, new: Column) -> Column:
    """Keys of `new` replace those of `old`."""
    kept = F.map_filter(or_empty(old), lambda k, v: ~F.map_contains_key(or_empty(new), k))
    return F.map_concat(kept, or_empty(new))
