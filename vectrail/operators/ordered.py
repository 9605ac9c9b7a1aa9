"""Numbers and running sums over all rows in order, without one task that holds them all.

Rows are cut into ranges of the order and written. Each range is summed by itself, the totals of the ranges (as many rows
as there are ranges) are summed up in order, and a window within each range adds its own start. Equal rows of the order
must have a further column that tells them apart where numbers are to be the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.sources.shared import stored

PART = "_range"


def in_ranges(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``, which rises with ``order``; written, so that later passes see the same ranges."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return stored(dealt.withColumn(PART, F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with a column per entry of ``sums``: its total over all rows up to this one in ``order``. Null counts as 0."""
    value = {c: F.coalesce(x, F.lit(0)) for c, x in sums.items()}
    d = in_ranges(df.withColumns({f"_own_{c}": x for c, x in value.items()}), order, ranges)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    starts = d.groupBy(PART).agg(*[F.sum(f"_own_{c}").alias(c) for c in sums]).select(F.col(PART).alias("_range_of"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    within = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(starts), F.col(PART) == F.col("_range_of"))
    return d.withColumns({c: F.col(f"_before_{c}") + F.sum(f"_own_{c}").over(within) for c in sums}).drop(PART, "_range_of", *[f"_own_{c}" for c in sums], *[f"_before_{c}" for c in sums])


def numbered(df: DataFrame, order: list[Column], name: str = "n", first: int = 0, ranges: int | None = None) -> DataFrame:
    """``df`` with dense numbers from ``first`` in ``order``."""
    return running(df, order, {name: F.lit(1).cast("long")}, ranges).withColumn(name, F.col(name) + (first - 1))


def with_neighbour(df: DataFrame, order: list[Column], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the ``value`` of the row before in ``order``, null for the first."""
    d = in_ranges(df.withColumn("_neighbour", value), order, ranges)
    # the last value of the nearest range before that has rows
    ends = d.groupBy(PART).agg(F.max_by(F.struct("_neighbour"), F.struct(*order)).alias("end"))
    ends = ends.select(F.col(PART).alias("_range_of"), F.lag("end").over(Window.orderBy(PART)).alias("_range_end"))
    within = Window.partitionBy(PART).orderBy(*order)
    own = F.lag(F.struct("_neighbour")).over(within)
    return d.join(F.broadcast(ends), F.col(PART) == F.col("_range_of")).withColumn(name, F.coalesce(own, F.col("_range_end"))["_neighbour"]).drop(PART, "_range_of", "_neighbour", "_range_end")
