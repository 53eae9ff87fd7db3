"""OHLC bars over at-least-once deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.functions.fingerprints import difference

VALUES = ["open", "high", "low", "close", "volume", "sequences"]


def ohlc(deliveries: DataFrame, dedupe: bool = True) -> DataFrame:
    """(symbol, bar, open, high, low, close, volume, sequences) of (seq, symbol, price, size, bar) ticks.

    With dedupe a sequence counts once, so that replays change nothing; without it volume and sequences count every
    delivery. Open and close are the prices of the first and the last sequence.
    """
    ticks = deliveries.dropDuplicates(["symbol", "bar", "seq"]) if dedupe else deliveries
    return ticks.groupBy("symbol", "bar").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume"), F.array_sort(F.collect_list("seq")).alias("sequences")
    )


def inflation(deliveries: DataFrame) -> DataFrame:
    """(symbol, bar, volume, naive_volume) of the bars that redelivery inflates."""
    right = ohlc(deliveries).select("symbol", "bar", "volume")
    naive = ohlc(deliveries, dedupe=False).select("symbol", "bar", F.col("volume").alias("naive_volume"))
    return right.join(naive, ["symbol", "bar"]).where("volume <> naive_volume")


def rebuild_diff(live: DataFrame, log: DataFrame) -> DataFrame:
    """Rows (side, ...) in which live bars and the bars rebuilt from the whole log differ; none if they agree."""
    return difference(live, ohlc(log), ("live", "rebuilt"))
