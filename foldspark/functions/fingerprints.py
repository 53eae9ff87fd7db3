"""Comparing two tables by fingerprints: only where these differ are rows held against each other.

Rows are dealt into buckets by a hash of all their values, and a bucket's fingerprint is the number of its rows and two sums
over other hashes of them, in which neither order nor partitioning matters. A difference of a few rows is a difference of as
many buckets, so the comparison that follows reads their share of the tables and shuffles nothing else. The buckets of
2 ** bits make a tree: those whose numbers end alike add up to a bucket of fewer bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14


def _hash(rows: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in rows.columns))


def bucketed(rows: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """Add column `name`, the bucket that follows from a row's values. Maps have no hash, so no column may be one."""
    return rows.withColumn(name, _hash(rows, 0).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))


def fingerprints(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(bucket, n, s1, s2) of each bucket with rows; at most 2 ** bits rows, which each task adds up before they are shuffled."""
    wide = "decimal(38,0)"
    parts = rows.select(_hash(rows, 0).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("bucket"), _hash(rows, 1).alias("h1"), _hash(rows, 2).alias("h2"))
    return parts.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("h1").cast(wide)).cast(wide).alias("s1"), F.sum(F.col("h2").cast(wide)).cast(wide).alias("s2"))


def coarser(prints: DataFrame, bits: int) -> DataFrame:
    """The fingerprints of the buckets of fewer bits, from those of more."""
    wide = "decimal(38,0)"
    up = prints.withColumn("bucket", F.col("bucket").bitwiseAND(F.lit((1 << bits) - 1)))
    return up.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(c).cast(wide).alias(c) for c in ("s1", "s2")))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket): the buckets whose fingerprints differ."""
    other = b.select(F.col("bucket").alias("_b"), *(F.col(c).alias(f"_{c}") for c in ("n", "s1", "s2")))
    both = a.join(other, F.col("bucket") == F.col("_b"), "full_outer")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("s1").eqNullSafe(F.col("_s1")) & F.col("s2").eqNullSafe(F.col("_s2"))
    return both.where(~same).select(F.coalesce("bucket", "_b").alias("bucket"))


def difference(a: DataFrame, b: DataFrame, sides: tuple[str, str] = ("left", "right"), bits: int = BITS) -> DataFrame:
    """Rows that one table has more often than the other, with column `side`; none if both hold the same rows.

    Columns are matched by name and have the names of `a`. Equal fingerprints of different buckets have a chance of about
    2 ** -128 and would hide their difference.
    """
    b = b.select(*(F.col(f"`{c}`") for c in a.columns))
    odd = differing(fingerprints(a, bits), fingerprints(b, bits))
    name = "_bucket"
    some_a, some_b = (bucketed(x, name, bits).join(odd.withColumnRenamed("bucket", name), name, "left_semi").drop(name).select(*(F.col(f"`{c}`") for c in a.columns)) for x in (a, b))
    more_a, more_b = some_a.exceptAll(some_b), some_b.exceptAll(some_a)
    return more_a.withColumn("side", F.lit(sides[0])).unionByName(more_b.withColumn("side", F.lit(sides[1])))
