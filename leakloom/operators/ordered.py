"""Order-dependent columns within groups of any size.

A plain window puts a whole group into one task. Here rows are range-partitioned
by (group, order) first, so a hot group is cut into slices that different tasks
handle; windows run per slice. What must cross slice borders is one row per
group that continues into a slice. Rows are sorted by group first, so at most one
group enters each slice from the one before: that table has no more rows than
there are slices and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakloom.session import cut

SLICE = "_slice"


def _sliced(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with their slice number, fixed on storage so that retries agree."""
    ranged = df.repartitionByRange(*[F.col(c) for c in (*group, *order)])
    return cut(ranged.withColumn(SLICE, F.spark_partition_id()))


def _carry(sliced: DataFrame, group: Sequence[str], partial: Column, combine) -> DataFrame:
    """Combined partial results of all earlier slices, for groups that span slices."""
    per_slice = sliced.groupBy(*group, SLICE).agg(partial.alias("_part"))
    earlier = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_slice.withColumn("_carried", combine(F.col("_part")).over(earlier))
        .where(F.col("_carried").isNotNull())
        .drop("_part")
    )


def _with_carry(sliced: DataFrame, carry: DataFrame, group: Sequence[str]) -> DataFrame:
    renamed = carry.select(F.col(SLICE).alias("_cs"), F.col("_carried"), *[F.col(c).alias(f"_c_{c}") for c in group])
    same = F.col(SLICE) == F.col("_cs")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return sliced.join(F.broadcast(renamed), same, "left").drop("_cs", *[f"_c_{c}" for c in group])


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "seq") -> DataFrame:
    """Position of each row in its group, from 1; `order` must be unique in a group."""
    sliced = _sliced(df, group, order)
    carry = _carry(sliced, group, F.count("*"), F.sum)
    local = Window.partitionBy(SLICE, *group).orderBy(*order)
    return (
        _with_carry(sliced.withColumn("_local", F.row_number().over(local)), carry, group)
        .withColumn(out, F.col("_local") + F.coalesce("_carried", F.lit(0)))
        .drop(SLICE, "_local", "_carried")
    )


def last_before(df: DataFrame, group: Sequence[str], order: str, value: Column, out: str) -> DataFrame:
    """Largest non-null `value` among the earlier rows of the group.

    For values that grow with the order this is the latest one.
    """
    sliced = _sliced(df.withColumn("_value", value), group, [order])
    carry = _carry(sliced, group, F.max("_value"), F.max)
    earlier = Window.partitionBy(SLICE, *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        _with_carry(sliced.withColumn("_local", F.max("_value").over(earlier)), carry, group)
        .withColumn(out, F.coalesce("_local", "_carried"))
        .drop(SLICE, "_local", "_carried", "_value")
    )
