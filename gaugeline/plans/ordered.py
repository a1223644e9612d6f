"""Ordered scans inside keys: positions, running values, neighbours, trailing frames.

A key may hold a large share of all rows, so no window is allowed to span an
unbounded key.  `ordered` measures the largest key first.  If one task can hold
it, plain windows over the key are used.  If not, the rows are range-split on
(key, order) into chunks, the chunks are settled once in the shared folder (so
that every reader sees the same split), windows run inside (key, chunk), and a
table with one row per (key, chunk) carries the values across chunk borders.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.plans.groups import Sizes, attach, group_limit, measure
from gaugeline.session import settle

CHUNK = "_chunk"
BLOCK = "_block"
HOME = "_home"


@dataclass(frozen=True)
class Running:
    """A running value: `kind` is sum, min, max or last (last non-null)."""

    kind: str
    value: Column
    inclusive: bool = True
    backward: bool = False


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool
    limit: int
    sizes: Sizes
    stored: bool = False  # whether reading `df` again costs no more than a scan of a settled table

    @property
    def parts(self) -> list[str]:
        return [*self.keys, CHUNK] if self.split else self.keys

    def _rows(self) -> Window:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def _with(self, df: DataFrame, stored: bool | None = None) -> "Ordered":
        return replace(self, df=df, stored=self.stored if stored is None else stored)

    def _settled(self) -> "Ordered":
        """Ready for a step that reads the rows twice, so that m steps read 2m tables and not 2^m."""
        return self if self.stored else self._with(settle(self.df), True)

    def with_columns(self, **columns: Column) -> "Ordered":
        return self._with(self.df.withColumns(columns))

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)

    def position(self, name: str) -> "Ordered":
        """0-based place of each row in its key."""
        ones = self.running(**{name: Running("sum", F.lit(1).cast("bigint"), inclusive=False)})
        return ones

    def running(self, **specs: Running) -> "Ordered":
        if self.split and not self.stored:
            return self._settled().running(**specs)
        local = self.df.withColumns({
            n: _over(s, s.value, self._rows()) for n, s in specs.items()
        })
        if not self.split:
            return self._with(local.withColumns({
                n: F.coalesce(F.col(n), F.lit(0)) for n, s in specs.items() if s.kind == "sum"
            }))
        place = F.struct(*self.order)
        totals = self.df.groupBy(*self.parts).agg(*[
            _total(s, place).alias(f"__{n}") for n, s in specs.items()
        ])
        chunks = Window.partitionBy(*self.keys).orderBy(CHUNK)
        carried = totals.select(*self.parts, *[
            _over(replace(s, inclusive=False), F.col(f"__{n}"), chunks).alias(f"__carry_{n}")
            for n, s in specs.items()
        ])
        joined = attach(local, carried, self.parts)
        joined = joined.withColumns({
            n: _combine(s, F.col(n), F.col(f"__carry_{n}")) for n, s in specs.items()
        })
        return self._with(joined.drop(*[f"__carry_{n}" for n in specs]), False)

    def clipped_sum(self, **values: Column) -> "Ordered":
        """Running sums that never fall below 0: s = max(0, s before + value).

        Such a sum is the plain running sum less its lowest point so far, so it is two scans whose carries are sums
        and minima.  Nulls add nothing.
        """
        plain = self.running(**{n: Running("sum", F.coalesce(v.cast("double"), F.lit(0.0))) for n, v in values.items()})
        lowest = plain.running(**{f"__low_{n}": Running("min", F.col(n)) for n in values})
        return lowest._with(lowest.df.withColumns({
            n: F.col(n) - F.least(F.col(f"__low_{n}"), F.lit(0.0)) for n in values}).drop(*[f"__low_{n}" for n in values]))

    def neighbour(self, step: int, **values: Column) -> "Ordered":
        """Values of the previous (-1) or next (+1) row of the key."""
        if self.split and not self.stored:
            return self._settled().neighbour(step, **values)
        shift = F.lag if step < 0 else F.lead
        rows = self._rows()
        local = self.df.withColumns({n: shift(v).over(rows) for n, v in values.items()})
        if not self.split:
            return self._with(local)
        local = local.withColumn("__inside", shift(F.lit(True)).over(rows))
        place = F.struct(*self.order)
        pick = F.max_by if step < 0 else F.min_by
        edges = self.df.groupBy(*self.parts).agg(*[
            pick(v, place).alias(f"__{n}") for n, v in values.items()
        ])
        chunks = Window.partitionBy(*self.keys).orderBy(CHUNK)
        carried = edges.select(*self.parts, *[
            shift(F.col(f"__{n}")).over(chunks).alias(f"__edge_{n}") for n in values
        ])
        joined = attach(local, carried, self.parts).withColumns({
            n: F.when(F.col("__inside"), F.col(n)).otherwise(F.col(f"__edge_{n}")) for n in values
        })
        return self._with(joined.drop("__inside", *[f"__edge_{n}" for n in values]), False)

    def blocks(self, position: str, before: int, after: int) -> tuple[DataFrame, list[str]]:
        """Rows ready for a bounded frame of `before` and `after` rows.

        Returns the frame and its window keys.  In split mode each key is cut by
        `position` into blocks of equal size, and the rows a frame can reach from
        the next block are copied there with `_home` false.
        """
        if not self.split:
            return self.df.withColumn(HOME, F.lit(True)), self.keys
        size = max(self.limit, before, after)
        block = F.floor(F.col(position) / size)
        place = F.col(position) % size
        reach = F.array_compact(F.array(
            block,
            F.when(place >= size - before, block + 1),
            F.when((place < after) & (block > 0), block - 1),
        ))
        spread = (self.df.drop(CHUNK)
                  .withColumn("__own", block)
                  .withColumn(BLOCK, F.explode(reach))
                  .withColumn(HOME, F.col(BLOCK) == F.col("__own"))
                  .drop("__own"))
        return spread, [*self.keys, BLOCK]


def ordered(df: DataFrame, keys: list[str], order: list[str],
            size_of: DataFrame | None = None, bound: Sizes | None = None) -> Ordered:
    """Prepare `df` for ordered scans; `order` must be total within a key.

    `size_of` may name a cheaper frame with the same keys to measure.  `bound` is
    what was measured for the same rows by the same or coarser keys: where that
    needs no split, neither does this, and nothing is measured again.
    """
    limit = group_limit(df)
    if bound is not None and bound.largest <= limit:
        return Ordered(df, keys, order, False, limit, bound)
    sizes = measure(df if size_of is None else size_of, keys)
    if sizes.largest <= limit:
        return Ordered(df, keys, order, False, limit, sizes)
    pieces = math.ceil(sizes.total / limit)
    chunked = (df.repartitionByRange(pieces, *keys, *order)
               .withColumn(CHUNK, F.spark_partition_id()))
    return Ordered(settle(chunked), keys, order, True, limit, sizes, True)


def top_per_key(scan: Ordered, by: list[Column], keep: int) -> DataFrame:
    """The first `keep` rows of each key in the order `by`, reduced inside chunks first."""
    df = scan.df
    if scan.split:
        inner = Window.partitionBy(*scan.parts).orderBy(*by)
        df = df.withColumn("__r", F.row_number().over(inner)).filter(F.col("__r") <= keep)
    window = Window.partitionBy(*scan.keys).orderBy(*by)
    return (df.withColumn("__r", F.row_number().over(window))
            .filter(F.col("__r") <= keep).drop("__r", CHUNK))


def _over(spec: Running, value: Column, rows: Window) -> Column:
    edge = 0 if spec.inclusive else 1
    frame = (rows.rowsBetween(edge, Window.unboundedFollowing) if spec.backward
             else rows.rowsBetween(Window.unboundedPreceding, -edge))
    if spec.kind == "last":
        pick = F.first if spec.backward else F.last
        return pick(value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "min": F.min, "max": F.max}[spec.kind](value).over(frame)


def _total(spec: Running, place: Column) -> Column:
    if spec.kind == "last":
        pick = F.min_by if spec.backward else F.max_by
        return pick(spec.value, F.when(spec.value.isNotNull(), place))
    return {"sum": F.sum, "min": F.min, "max": F.max}[spec.kind](spec.value)


def _combine(spec: Running, local: Column, carry: Column) -> Column:
    if spec.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if spec.kind == "last":
        return F.coalesce(local, carry)
    return (F.greatest if spec.kind == "max" else F.least)(local, carry)
