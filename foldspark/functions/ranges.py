"""Row numbers and neighbours in long ordered groups, found range by range so that no task sorts a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range should hold.
RANGE_ROWS = 1 << 20
#: Ranges at most; beyond them ranges grow, and sorting inside one spills.
MOST_RANGES = 4096


def dealt(rows: DataFrame, key: str, size: int, part_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows dealt by the hash of a key, where their number `size` asks for more partitions than the session's.

    What is sorted and folded by that key after it is about `part_rows` rows a task, however large the table is; smaller
    tables are left to the session and to adaptive execution.
    """
    parts = -(-size // part_rows)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _range_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts are below the value, by runs of cuts and then inside one run; null is -1."""
    if not cuts:
        return F.when(value.isNull(), -1).otherwise(0)
    run = math.isqrt(len(cuts) - 1) + 1
    runs = [cuts[k : k + run] for k in range(0, len(cuts), run)]
    number = F.array(*(F.lit(float(c)) for c in cuts))
    ends = F.array(*(F.lit(float(r[-1])) for r in runs))
    full = F.size(F.filter(ends, lambda c: c < value)) * run
    inside = F.size(F.filter(F.slice(number, full + 1, F.lit(run)), lambda c: c < value))
    return F.when(value.isNull(), -1).otherwise(full + inside)


def with_ranges(rows: DataFrame, column: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add `_range`: ascending with the numeric column, about `range_rows` rows each, equal values together.

    The cuts are approximate quantiles of all rows, as many as the number of rows asks for.
    """
    ranges = min(MOST_RANGES, -(-rows.count() // range_rows))
    cuts = sorted(set(rows.approxQuantile(column, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    return rows.withColumn("_range", _range_of(F.col(column), cuts))


def with_row_number(rows: DataFrame, name: str, order: list[str], by: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add column `name`: 1, 2, ... in the given order, the first column of which is numeric, for each value of `by`.

    Rows are counted by range, numbered inside their range, and moved up by the ranges before. A null of `by` is a group
    of its own; null order values come first.
    """
    group = F.col(by) if by else F.lit(0)
    dealt = with_ranges(rows, order[0], range_rows).withColumn("_group", group)
    counts = dealt.groupBy("_group", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_range")
    before = counts.select(F.col("_group").alias("_g"), F.col("_range").alias("_r"), (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_group", "_range").orderBy(*order))
    placed = dealt.withColumn("_within", within).join(before, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return placed.withColumn(name, F.col("_before") + F.col("_within")).drop("_group", "_range", "_g", "_r", "_before", "_within")
