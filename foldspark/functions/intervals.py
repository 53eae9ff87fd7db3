"""Sets of integers as disjoint intervals in rows, cut at multiples of a cell's width so that no group of them grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Integers in a cell. A key's rows with integers of one cell meet in one task, and no more of them.
CELL = 1 << 14


def cell_of(column: str) -> Column:
    """The cell that an integer column's value is in."""
    return F.floor(F.col(column) / CELL).cast("bigint")


def merge_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell, lo, hi): the union of (keys, cell, lo, hi) intervals, those that touch or overlap as one."""
    turn = Window.partitionBy(*keys, "cell").orderBy("lo", "hi")
    before = F.max("hi").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    begun = rows.withColumn("_new", (F.coalesce(F.col("lo") > before + 1, F.lit(True))).cast("int"))
    island = begun.withColumn("_island", F.sum("_new").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "cell", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def as_intervals(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, cell, lo, hi) of the rows' values; null values are in no interval."""
    some = rows.where(F.col(value).isNotNull()).select(*keys, cell_of(value).alias("cell"), F.col(value).alias("lo"), F.col(value).alias("hi"))
    return merge_intervals(some, keys)


def unseen(rows: DataFrame, intervals: DataFrame | None, keys: list[str], value: str) -> DataFrame:
    """One row for each (keys, value) that no interval holds; which of several equal ones stays is undefined.

    Intervals are disjoint, so the nearest one that begins at or before a value decides. Null keys are equal, and so are null
    values of a key, which no interval holds.
    """
    once = rows.dropDuplicates([*keys, value]).withColumn("_row", F.struct(*rows.columns))
    asked = once.select(*keys, cell_of(value).alias("_cell"), F.col(value).alias("_at"), F.lit(None).cast("bigint").alias("_hi"), "_row")
    if intervals is None:
        return once.drop("_row")
    held = intervals.select(*keys, F.col("cell").alias("_cell"), F.col("lo").alias("_at"), F.col("hi").alias("_hi"), F.lit(None).cast(once.schema["_row"].dataType).alias("_row"))
    # at one place an interval comes before the row that asks
    turn = Window.partitionBy(*keys, "_cell").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.unionByName(held).withColumn("_seen", F.last("_hi", ignorenulls=True).over(turn))
    return both.where(F.col("_row").isNotNull() & (F.col("_seen").isNull() | (F.col("_seen") < F.col("_at")) | F.col("_at").isNull())).select("_row.*")


def members(intervals: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the integers of each key's intervals, as one sorted array."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda i: F.sequence(i["lo"], i["hi"]))
    return intervals.groupBy(*keys).agg(F.flatten(parts).alias(name))
