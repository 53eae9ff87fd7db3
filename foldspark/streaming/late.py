"""Rolling bars by event time that lose no late row.

A watermark says when a bar counts as closed: `delay` behind the latest event time of the micro-batches before. Rows of a
closed bar go to a table of their own as well, so that who has read the bar knows what changed, and they are merged into
the bar like all others. So the bars are those of the batch form, and the table of late rows explains every correction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldspark.sources.run_store import RunStore
from foldspark.sources.sinks import append_idempotent, read_appended
from foldspark.streaming import incremental


def _watermarks(spark: SparkSession, out: str) -> RunStore:
    return RunStore(spark, f"{out}/watermark", ["of"], lambda rows: rows.groupBy("of").agg(F.max("upto").alias("upto")))


def with_bar(ticks: DataFrame, time: str, bar: str) -> DataFrame:
    """Add `bar`, the start of the tick's window of event time, and `bar_end`."""
    at = F.window(F.col(time).cast("timestamp"), bar)
    return ticks.withColumn("_w", at).withColumns({"bar": F.col("_w.start"), "bar_end": F.col("_w.end")}).drop("_w")


class LateBars:
    """Bars of `bar` by the event time in column `time`; tables under `out`."""

    def __init__(self, spark: SparkSession, time: str, bar: str, delay: str, out: str):
        self.spark, self.time, self.bar, self.delay, self.out = spark, time, bar, delay, out.rstrip("/")

    def watermark(self, upto: int | None = None):
        """The event time up to which bars are closed, by the micro-batches up to a number; None before the first."""
        found = _watermarks(self.spark, self.out).read(upto)
        return None if found is None else found.first().upto

    def step(self, batch: DataFrame, batch_id: int) -> None:
        rows = with_bar(batch, self.time, self.bar).persist()
        try:
            closed = self.watermark(batch_id - 1)
            late = rows.where(F.lit(False)) if closed is None else rows.where(F.col("bar_end") <= F.lit(closed))
            append_idempotent(late, batch_id, f"{self.out}/late")
            incremental.apply(rows.where("bar is not null").select("seq", "symbol", "price", "size", "bar"), batch_id, f"{self.out}/bars", incremental.BARS)
            moved = rows.agg((F.max(F.col(self.time).cast("timestamp")) - F.expr(f"INTERVAL {self.delay}")).alias("upto")).where("upto is not null")
            _watermarks(self.spark, self.out).append(moved.select(F.lit("all").alias("of"), "upto"), batch_id)
        finally:
            rows.unpersist()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def late(self) -> DataFrame | None:
        """The rows that came after their bar had closed, with the number of their micro-batch."""
        return read_appended(self.spark, f"{self.out}/late")

    def bars(self) -> DataFrame | None:
        """All bars with all their rows; `closed` says whether the watermark has passed a bar, `late` how many late rows it got.

        A late row that is a redelivery counts as late and changes nothing else.
        """
        found = incremental.read(self.spark, f"{self.out}/bars", incremental.BARS)
        if found is None:
            return None
        late = self.late().groupBy(F.col("symbol").alias("_symbol"), F.col("bar").alias("_bar")).agg(F.count("*").alias("late"))
        both = found.join(late, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("bar") == F.col("_bar")), "left").drop("_symbol", "_bar")
        closed = F.col("bar") + F.expr(f"INTERVAL {self.bar}") <= F.lit(self.watermark())
        return both.withColumns({"late": F.coalesce("late", F.lit(0).cast("long")), "closed": closed})
