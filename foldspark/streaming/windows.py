"""Progress by windows of n records, whatever files or micro-batches bring them.

The records of a shard are counted off in the order of their positions. A full window is handled and then committed by the
positions that it ends at; if a window fails, the micro-batch comes again and the records of the windows before it are passed
over, so what is read twice is less than a window a shard and never more. What doesn't fill a window waits, in a table, for
the next micro-batch. The k-th windows of all shards are handled together.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldspark.functions.ranges import with_row_number
from foldspark.sources.run_store import RunStore
from foldspark.sources.sinks import append_idempotent, drop_appended, read_appended
from foldspark.streaming.outcomes import Outcomes

#: handle(records of one window of each shard, number of the window). A number comes again with the same records if its first
#: time failed, so what is written under it must be replaced.
Handle = Callable[[DataFrame, int], Any]


class Windows:
    """The windows of size `size` of rows with an integer `position` in their `shard`; the state is under `out`."""

    def __init__(self, spark: SparkSession, shard: str, position: str, size: int, handle: Handle, out: str, run: str = ""):
        self.spark, self.shard, self.position, self.size, self.handle, self.out, self.run = spark, shard, position, max(1, size), handle, out.rstrip("/"), run
        self.positions = RunStore(spark, f"{self.out}/positions", [shard], lambda rows: rows.groupBy(shard).agg(F.max("through").alias("through")))
        self.outcomes = Outcomes(spark, f"{self.out}/outcomes")

    def committed(self) -> DataFrame | None:
        """(shard, through): the position up to which each shard's records are handled; None before the first window."""
        return self.positions.read()

    def _waiting(self, below: int) -> DataFrame | None:
        return read_appended(self.spark, f"{self.out}/waiting", last=below - 1)

    def _fresh(self, rows: DataFrame) -> DataFrame:
        """Each record once that no committed window has. A record without a position is in no window."""
        rows, done = rows.where(F.col(self.position).isNotNull()).dropDuplicates([self.shard, self.position]), self.committed()
        if done is None:
            return rows
        done = done.select(F.col(self.shard).alias("_of"), "through")
        left = rows.join(done, F.col(self.shard).eqNullSafe(F.col("_of")), "left")
        return left.where(F.col("through").isNull() | (F.col(self.position) > F.col("through"))).drop("_of", "through")

    def step(self, batch: DataFrame, batch_id: int, last: bool = False) -> None:
        """Handle the full windows of a micro-batch and of what waits; with `last` also those that aren't full."""
        rows, waiting = batch, self._waiting(batch_id)
        if waiting is not None:
            rows = batch.unionByName(waiting.select(batch.columns))
        fresh = self._fresh(rows).persist()  # it is counted, cut into ranges and numbered
        numbered = with_row_number(fresh, "_n", [self.position], by=self.shard)
        numbered = numbered.withColumn("_window", F.expr(f"(_n - 1) div {self.size}")).persist()
        try:
            full = F.lit(0) if last else F.lit(self.size)
            counts = numbered.groupBy(self.shard, "_window").agg(F.count("*").alias("n")).where(F.col("n") >= full)
            windows = counts.agg(F.max("_window")).first()[0]
            for k in range(0 if windows is None else windows + 1):
                of = counts.where(F.col("_window") == k).select(F.col(self.shard).alias("_of"))
                one = numbered.where(F.col("_window") == k).join(of, F.col(self.shard).eqNullSafe(F.col("_of")), "left_semi").select(batch.columns)
                self._window(one, batch_id)
            if not last:
                append_idempotent(self._fresh(numbered.select(batch.columns)), batch_id, f"{self.out}/waiting")
                drop_appended(self.spark, f"{self.out}/waiting", batch_id - 1)
        finally:
            numbered.unpersist()
            fresh.unpersist()

    def _window(self, rows: DataFrame, batch_id: int) -> None:
        number = (self.positions.versions()[-1:] or [-1])[0] + 1
        ends = rows.groupBy(self.shard).agg(F.max(self.position).alias("through"), F.count("*").alias("n")).persist()
        try:
            shards = self._told(ends)
            try:
                self.handle(rows, number)
            except Exception as e:
                self.outcomes.record([(self.run, batch_id, unit, before, before, n, 0, None, True, str(e)) for unit, before, _, n in shards])
                raise
            self.positions.append(ends.drop("n"), number)
            self.outcomes.record([(self.run, batch_id, unit, before, after, n, n, None, False, None) for unit, before, after, n in shards])
        finally:
            ends.unpersist()

    def _told(self, ends: DataFrame) -> list[tuple[str, str | None, str, int]]:
        """(shard, position before, position after, records) of one window: a row a shard comes to the driver."""
        done = self.committed()
        if done is None:
            both = ends.withColumn("before", F.lit(None).cast("long"))
        else:
            before = done.select(F.col(self.shard).alias("_of"), F.col("through").alias("before"))
            both = ends.join(before, F.col(self.shard).eqNullSafe(F.col("_of")), "left")
        rows = both.select(F.col(self.shard).cast("string"), F.col("before").cast("string"), F.col("through").cast("string"), "n").collect()
        return [(r[0] if r[0] is not None else "", r[1], r[2], r[3]) for r in rows]

    def flush(self) -> None:
        """Handle what waits for a full window, as after the last micro-batch."""
        waiting = read_appended(self.spark, f"{self.out}/waiting", last=None)
        if waiting is not None:
            self.step(waiting.drop("batch_id").limit(0), 1 << 62, last=True)


def count_windows(stream: DataFrame, shard: str, position: str, size: int, handle: Handle, out: str, checkpoint: str, run: str = "") -> StreamingQuery:
    """Start handling a stream by windows of `size` records of each shard. `Windows.flush` handles the rest when it has ended."""
    windows = Windows(stream.sparkSession, shard, position, size, handle, out, run)
    return stream.writeStream.foreachBatch(windows.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
