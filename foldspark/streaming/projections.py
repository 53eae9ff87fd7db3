"""Streaming projections, relay, whole-batch mode and stateful aggregations.

Bars, positions and the tenants' view are kept by merging partial states (`incremental`). `project` is for folds that have no
such states: micro-batches go to an append-only log in buckets, and the touched keys' rows are folded again from it. Neither
cares for order or repetition, so a replayed micro-batch changes nothing and late rows need no watermark; the live view always
equals a rebuild.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import NumericType

from foldspark.functions.ranges import with_row_number
from foldspark.operators import outbox
from foldspark.sources.sinks import append_bucketed, append_idempotent, by_keys, read_buckets, upsert_view, with_bucket
from foldspark.streaming import incremental

Fold = Callable[[DataFrame], DataFrame]


def project(stream: DataFrame, keys: list[str], fold: Fold, out: str, checkpoint: str, before: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a projection: the log is in out/log, the view in out/view. `before` may look at a batch, or refuse it by raising.

    Both are bucketed by a hash of the keys. A micro-batch reads, folds and writes the buckets of its own keys, whatever else
    the log and the view hold.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if before is not None:
            before(batch, batch_id)
        rows = with_bucket(batch, keys).persist()
        try:
            buckets = [r.bucket for r in rows.select("bucket").distinct().collect()]
            if not buckets:
                return
            append_bucketed(rows, batch_id, f"{out}/log")
            log = read_buckets(batch.sparkSession, f"{out}/log", buckets, batch_id).drop("bucket")
            touched = rows.select(*keys).distinct()
            upsert_view(fold(by_keys(log, touched, keys, "left_semi")), batch_id, f"{out}/view", keys)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(stream: DataFrame, projection: incremental.Projection, out: str, checkpoint: str, before: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a projection that merges partial states; `incremental.read` reads its view. `before` may refuse a batch by raising."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if before is not None:
            before(batch, batch_id)
        incremental.apply(batch, batch_id, out, projection)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tick_bars(stream: DataFrame, out: str, checkpoint: str, before: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """OHLC bars of a tick stream. For progress by a number of records, whatever the batches hold, see `windows`."""
    return merged(stream, incremental.BARS, out, checkpoint, before)


def book_positions(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Positions of a trade stream."""
    return merged(stream, incremental.POSITIONS, out, checkpoint)


def tenant_view(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The tenants-with-users view of a stream of (topic, body, sequence) records."""
    return merged(stream, incremental.TENANTS, out, checkpoint)


def grouped_batches(stream: DataFrame, key: str, order: str, out: str, checkpoint: str, step: Fold | None = None) -> StreamingQuery:
    """Whole-batch mode: a micro-batch is grouped by key with each key's order kept, and committed as one.

    `step` gets the batch with `place`, the row's number among those of its key, and gives what is written: a window, an
    ordered fold or an aggregation by key. If it raises, nothing of the batch is committed and all of it comes again. With a
    numeric `order` rows are numbered range by range, so a key with most of the batch's rows is no single task's work.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if isinstance(batch.schema[order].dataType, NumericType):
            rows = batch.persist()  # it is counted and cut into ranges before it is numbered
            placed = with_row_number(rows, "place", [order], by=key)
        else:
            rows, placed = batch, batch.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))
        try:
            append_idempotent(placed if step is None else step(placed), batch_id, out)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def relay(changes: DataFrame, out: str, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Publish order-created events of a change stream; if publishing raises, the batch isn't committed and comes again.

    Rows published before the failure come again too, under the same event ids, so consumers dedupe by event_id.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        events = outbox.to_order_created(batch)
        (publish or (lambda rows, number: append_idempotent(rows, number, out)))(events, batch_id)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe(stream: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once: for ever, or within a delay of event time, which bounds the state."""
    if delay is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def rolling_bars(stream: DataFrame, time: str, bar: str = "1 hour", delay: str | None = None) -> DataFrame:
    """OHLC bars as a stateful aggregation over event time: update mode, or append mode with a bounded delay."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = dedupe(rows, ["seq"], time, delay)
    return rows.groupBy("symbol", F.window(time, bar).alias("bar")).agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume"))


def batch_report(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """(batch_id, checkpoint_before, checkpoint_after, read, applied, late, failed, reason) of a query's micro-batches.

    The checkpoints are the sources' offsets; applied is what the sink says it wrote, or what was read where it doesn't say.
    late counts the rows that its stateful steps dropped because the watermark had passed them.
    An error is the last row, whose batch moved no checkpoint. Spark remembers as many batches as
    spark.sql.streaming.numRecentProgressUpdates says.
    """
    rows = []
    for p in query.recentProgress:
        before, after = ("; ".join(str(s[k]) for s in p["sources"]) for k in ("startOffset", "endOffset"))
        wrote = p["sink"]["numOutputRows"]
        late = sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
        rows.append((p["batchId"], before, after, p["numInputRows"], wrote if wrote is not None and wrote >= 0 else p["numInputRows"], late, False, None))
    error = query.exception()
    if error is not None:
        at = rows[-1][2] if rows else None
        rows.append((rows[-1][0] + 1 if rows else 0, at, at, None, 0, 0, True, str(error)))
    return spark.createDataFrame(rows, "batch_id long, checkpoint_before string, checkpoint_after string, read long, applied long, late long, failed boolean, reason string")
