"""Change feeds and outbox: inserts, published events, dedupe statistics and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "decimal(18,2)"


def _usable() -> Column:
    image = F.col("new_image")
    return (F.col("op") == "INSERT") & image["order_id"].isNotNull() & image["customer"].isNotNull() & image["total"].try_cast(TOTAL).isNotNull()


def inserts(changes: DataFrame) -> DataFrame:
    """(seq, order_id, customer, total) of the usable insert records."""
    image = F.col("new_image")
    return changes.where(_usable()).select("seq", image["order_id"].alias("order_id"), image["customer"].alias("customer"), image["total"].try_cast(TOTAL).alias("total"))


def skipped(changes: DataFrame) -> DataFrame:
    """(seq, reason) of the records that are acknowledged and not used."""
    image = F.col("new_image")
    reason = F.when(~(F.col("op") == "INSERT"), "not an insert").when(image["order_id"].isNull() | image["customer"].isNull() | image["total"].isNull(), "missing attribute").otherwise("bad total")
    return changes.where(~F.coalesce(_usable(), F.lit(False))).select("seq", reason.alias("reason"))


def to_order_created(changes: DataFrame) -> DataFrame:
    """(event_id, order_id, customer, total); the event's id is the change's own, the same on every retry."""
    return inserts(changes).select(F.col("seq").cast("string").alias("event_id"), "order_id", "customer", "total")


def delivery_stats(deliveries: DataFrame, by: str) -> DataFrame:
    """(by, deliveries, events, duplicates) of at-least-once deliveries with an event_id."""
    each = deliveries.groupBy(by, "event_id").agg(F.count("*").alias("n"))
    return each.groupBy(by).agg(F.sum("n").alias("deliveries"), F.count("*").alias("events"), (F.sum("n") - F.count("*")).alias("duplicates"))


def reconcile(orders: DataFrame, events: DataFrame) -> DataFrame:
    """(order_id, kind): committed orders without an event, and events without an order."""
    lost = orders.join(events, "order_id", "left_anti").select("order_id", F.lit("order_without_event").alias("kind"))
    ghost = events.join(orders, "order_id", "left_anti").select("order_id", F.lit("event_without_order").alias("kind"))
    return lost.unionByName(ghost).distinct()
