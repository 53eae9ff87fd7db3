"""Ordered logs: reading after a checkpoint, sequences, windows of records, redelivery and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.functions.expressions import clamp
from foldspark.functions.ranges import RANGE_ROWS, with_row_number


def read_after(log: DataFrame, checkpoint: int, n: int = 100) -> DataFrame:
    """The next n records after the checkpoint, by ascending seq."""
    return log.where(F.col("seq") > checkpoint).orderBy("seq").limit(n)


def assign_sequence(rows: DataFrame, head: int, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Number rows head + 1, head + 2, ... in the order of the given columns, the first of which must be numeric.

    Rows are numbered range by range, with about range_rows rows in a range, so no task sorts them all.
    """
    return with_row_number(rows, "_place", order, range_rows=range_rows).withColumn("seq", F.lit(head) + F.col("_place")).drop("_place")


def append_summary(appended: DataFrame, by: list[str]) -> DataFrame:
    """(by..., records, first_seq, last_seq) of appended records."""
    return appended.groupBy(*by).agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def redeliver(log: DataFrame, times: str) -> DataFrame:
    """Identical copies of each record, as many as column `times` says, but one at least and ten at most."""
    return log.withColumn("_copy", F.explode(F.sequence(F.lit(1), clamp(F.coalesce(F.col(times), F.lit(1)), 1, 10).cast("int")))).drop("_copy")


def count_windows(log: DataFrame, n: int, shard: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(shard, window_no, records, first_seq, last_seq): consecutive windows of n records in each shard; the last may be short.

    Records are numbered range by range, so a shard with most of the log isn't one task's work.
    """
    numbered = with_row_number(log.select(shard, "seq"), "_place", ["seq"], by=shard, range_rows=range_rows).withColumn("window_no", F.floor((F.col("_place") - 1) / n))
    return numbered.groupBy(shard, "window_no").agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def status(log: DataFrame, checkpoints: DataFrame, shard: str) -> DataFrame:
    """(shard, records, last_seq, checkpoint, lag); a shard without a checkpoint is at 0."""
    seen = log.groupBy(shard).agg(F.count("*").alias("records"), F.max("seq").alias("last_seq"))
    return seen.join(checkpoints, shard, "left").withColumn("checkpoint", F.coalesce("checkpoint", F.lit(0).cast("bigint"))).withColumn("lag", F.col("last_seq") - F.col("checkpoint"))


def read_recorded(logs: dict[str, DataFrame]) -> DataFrame:
    """Union of recorded logs (topic, body, sequence) with their source; order holds inside a source only."""
    frames = [log.select(F.lit(source).alias("source"), "topic", "body", "sequence") for source, log in logs.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
