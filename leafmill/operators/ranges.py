"""Ranks and percentiles of a whole table, worked out on ranges of its order: no task holds all rows or all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def _ranged(df: DataFrame, *order) -> DataFrame:
    """``df`` written in ranges of the order, with ``__part``, the number of a row's range."""
    return materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with the place of every row in the whole order, from 1; rows of equal order are numbered in any order.

    A row's rank is its place within its range and the number of rows in ranges before; the ranges' counts are few.
    """
    rows = _ranged(df, *order)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.withColumn("__place", place).join(before, "__part").withColumn(name, F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")


def counted_up(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, upto, total``: for each distinct value the number of rows of its key up to it, and of the key at all.

    Rows are counted by value first, so a key's rows never come together; nulls of ``value`` do not count.
    """
    counts = _ranged(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n")), *keys, value)
    parts = counts.groupBy("__part", *keys).agg(F.sum("__n").alias("__sum"))
    of = Window.partitionBy(*keys)
    parts = parts.select("__part", *keys, F.coalesce(F.sum("__sum").over(of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__sum").over(of).alias("total"))
    inside = F.sum("__n").over(Window.partitionBy("__part", *keys).orderBy(value))
    on = F.col("c.__part") == F.col("p.__part")
    for k in keys:
        on &= F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}"))
    rows = counts.withColumn("__inside", inside).alias("c").join(parts.alias("p"), on)
    return rows.select(*[F.col(f"c.{k}").alias(k) for k in keys], F.col(f"c.{value}").alias(value), (F.col("__inside") + F.col("__before")).alias("upto"), "total")


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys, n`` and for each of ``shares`` (share by name) the least value that so many of the key's rows reach at most."""
    c = counted_up(df, keys, value)
    at = [F.min(F.when(F.col("upto") >= F.ceil(share * F.col("total")), F.col(value))).alias(name) for name, share in shares.items()]
    return c.groupBy(*keys).agg(*at, F.first("total").alias("n"))


def middle(df: DataFrame, value: str) -> DataFrame:
    """``median, n`` of a column, one row: the mean of the two middle values; null and 0 for no rows."""
    c = counted_up(df.select(F.lit(0).alias("__all"), value), ["__all"], value)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    reach = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(value)))
    return c.agg(((reach(low) + reach(high)) / 2).alias("median"), F.coalesce(F.max("total"), F.lit(0)).alias("n"))
