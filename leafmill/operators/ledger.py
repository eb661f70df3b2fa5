"""Quota ledger: live grants, balances, and allocation in expiry order as prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(starts: Column, expires: Column, revoked: Column, now: Column) -> Column:
    """Started, not expired (null: never), not revoked."""
    return (starts <= now) & (expires.isNull() | (expires > now)) & revoked.isNull()


def allocate(grants: DataFrame, owed: DataFrame, key: str) -> DataFrame:
    """Takes ``owed(key, owed)`` from ``grants(key, id, remaining, expires_at, starts_at)``, the first to expire first.

    Adds ``take`` and ``left``; what no grant covers stays owed.
    """
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("expires_at"), "starts_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("remaining").over(order), F.lit(0))
    rows = grants.withColumn("before", before).join(owed, key, "left")
    take = F.greatest(F.lit(0), F.least(F.col("remaining"), F.coalesce("owed", F.lit(0)) - F.col("before")))
    return rows.withColumn("take", take).withColumn("left", F.col("remaining") - F.col("take")).drop("before")


def trailing_count(calls: DataFrame, key: str, ts: str, seconds: int) -> Column:
    """Calls of the same key in the trailing window that ends at the row."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.count("*").over(Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0))


def largest_remainder(parts: DataFrame, key: str, weight: str, total: Column, *order: str) -> DataFrame:
    """Splits ``total`` in proportion to ``weight``: floors, then one each to the largest remainders, first on ties."""
    whole = Window.partitionBy(key)
    exact = total * F.col(weight) / F.sum(weight).over(whole)
    rows = parts.withColumn("floor", F.floor(exact)).withColumn("rest", total * F.col(weight) - F.floor(exact) * F.sum(weight).over(whole))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rest"), *order))
    rows = rows.withColumn("rank", rank).withColumn("short", total - F.sum("floor").over(whole))
    return rows.withColumn("share", F.col("floor") + F.when(F.col("rank") <= F.col("short"), 1).otherwise(0)).drop("floor", "rest", "rank", "short")
