"""Deliveries that come again: retries in later batches with a dead-letter table, and claims that a failure releases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foldspark.operators.reactions import Reaction, settle
from foldspark.sources.sinks import append_idempotent, drop_appended, read_appended


class Redelivery:
    """A reaction whose failed events come again with a later batch, `max_attempts` times in all.

    Under `out` are `journal`, a row for each attempt with its outcome, `dead`, the events whose last attempt failed, and
    `retry`, the events that the next batch brings again. A batch that is replayed finds the same `retry` and writes the same
    folders again. An event is known by its event_id, and without such a column by all its values.
    """

    def __init__(self, spark: SparkSession, react: Reaction, out: str, max_attempts: int = 2):
        self.spark, self.react, self.out, self.max_attempts = spark, react, out.rstrip("/"), max_attempts

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """React to a batch's events and to those that failed before."""
        known = batch if "event_id" in batch.columns else batch.withColumn("event_id", F.sha2(F.to_json(F.struct(*batch.columns)), 256))
        events = known.withColumn("attempt", F.lit(1))
        due = read_appended(self.spark, f"{self.out}/retry", last=batch_id - 1)
        if due is not None:
            events = events.unionByName(due.select(events.columns))
        events = events.persist()
        attempts = events.groupBy(F.col("event_id").alias("_event")).agg(F.max("attempt").alias("attempt"))
        told = self.react(events.drop("attempt"))
        results = told.join(attempts, F.col("event_id").eqNullSafe(F.col("_event"))).drop("_event")
        results = settle(results, self.max_attempts).persist()
        try:
            # an event fails if any row of its reaction does
            of = results.where("outcome <> 'done'").select(F.col("event_id").alias("_event"), "outcome").distinct()
            failed = events.join(of, F.col("event_id").eqNullSafe(F.col("_event"))).drop("_event")
            append_idempotent(results, batch_id, f"{self.out}/journal")
            append_idempotent(failed.where("outcome = 'dead-letter'").drop("outcome"), batch_id, f"{self.out}/dead")
            append_idempotent(failed.where("outcome = 'retry'").drop("outcome").withColumn("attempt", F.col("attempt") + 1), batch_id, f"{self.out}/retry")
            drop_appended(self.spark, f"{self.out}/retry", batch_id - 1)
        finally:
            results.unpersist()
            events.unpersist()

    def drain(self) -> int:
        """Bring again what waits, with no new events, until nothing does; the number of batches that this took."""
        batches = 0
        while (due := read_appended(self.spark, f"{self.out}/retry", last=None)) is not None and not due.isEmpty():
            last = due.agg(F.max("batch_id")).first()[0]
            self.step(due.drop("batch_id", "attempt").limit(0), last + 1)
            batches += 1
        return batches

    def read(self, table: str) -> DataFrame | None:
        """The table journal, dead or retry; the last one holds what the next batch brings again."""
        return read_appended(self.spark, f"{self.out}/{table}", **({"last": None} if table == "retry" else {}))

    def start(self, stream: DataFrame, checkpoint: str, name: str | None = None) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return (writer.queryName(name) if name else writer).start()


#: Does an effect for a delivery and says whether it succeeded; raising counts as a failure. It runs on executors, one
#: delivery at a time, and again if its micro-batch comes again, so the effect itself must be known by the delivery's key.
Effect = Callable[[dict[str, Any]], bool]

CLAIMED = "key string, delivery long, outcome string"


class _Claims(StatefulProcessor):
    """Of a (topic, body): the delivery that holds its claim."""

    def __init__(self, effect: Effect, time_to_live_ms: int):
        self.effect, self.time_to_live_ms = effect, time_to_live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claim = handle.getValueState("claim", "delivery long", self.time_to_live_ms or None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            out = []
            for r in part.sort_values("delivery").to_dict("records"):
                if self.claim.exists():
                    out.append((key[0], int(r["delivery"]), "duplicate"))
                    continue
                self.claim.update((int(r["delivery"]),))
                try:
                    done = self.effect(r)
                except Exception:
                    done = False
                if not done:
                    self.claim.clear()  # a later delivery may succeed
                out.append((key[0], int(r["delivery"]), "done" if done else "failed"))
            yield pd.DataFrame(out, columns=["key", "delivery", "outcome"])

    def close(self) -> None:
        pass


def claimed(deliveries: DataFrame, effect: Effect, time_to_live_ms: int = 0) -> DataFrame:
    """(key, delivery, outcome) of a stream of (topic, body, delivery) rows: done, failed or duplicate.

    A delivery takes the claim of its (topic, body) before its effect and keeps it if that succeeds, so deliveries after it are
    duplicates; if it fails the claim is released. A claim ends after `time_to_live_ms`, which bounds the state; 0 keeps it
    for ever. The stream needs the RocksDB state store provider, and with a time to live under a trigger that ends, no
    batches without data (spark.sql.streaming.noDataMicroBatches.enabled false).
    """
    keyed = deliveries.withColumn("key", F.sha2(F.concat_ws("\x1f", "topic", "body"), 256))
    return keyed.groupBy("key").transformWithStateInPandas(_Claims(effect, time_to_live_ms), CLAIMED, "Append", "ProcessingTime" if time_to_live_ms else "None")
