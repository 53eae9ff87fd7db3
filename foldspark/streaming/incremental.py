"""Projections kept by merging: a micro-batch's partial states are added to those of its keys, and no history is read again.

A sum must not count a redelivered row again, so the sequences that a projection has seen are kept as intervals, and what
is in them is left out before partial states are formed. Bars and positions are sums and firsts and lasts over the rest;
the tenants' view needs only maxima, which repetition doesn't change. Both kinds are the same however the rows are cut
into batches, so the live view equals a rebuild.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.functions.intervals import as_intervals, cell_of, members, merge_intervals, unseen
from foldspark.operators import positions, views
from foldspark.sources.run_store import RunStore

Rows = Callable[[DataFrame], DataFrame]


class Part(NamedTuple):
    """One table of partial states: `partial` makes them from a batch's rows, `merge` from partial states."""

    keys: list[str]
    partial: Rows
    merge: Rows


class Projection(NamedTuple):
    """Tables of partial states; `seen` are the columns that tell rows apart, the last of which is an integer, or nothing
    where repetition changes nothing. `view` makes the view from the merged tables, among them `seen` as intervals."""

    parts: dict[str, Part]
    seen: list[str]
    view: Callable[[dict[str, DataFrame]], DataFrame]


def stores(spark: SparkSession, out: str, projection: Projection, **sizes: int) -> dict[str, RunStore]:
    """The tables of a projection under `out`."""
    tables = {name: RunStore(spark, f"{out}/{name}", p.keys, p.merge, **sizes) for name, p in projection.parts.items()}
    if projection.seen:
        *keys, _ = projection.seen
        tables["seen"] = RunStore(spark, f"{out}/seen", [*keys, "cell"], lambda rows: merge_intervals(rows, keys), ("lo", "hi"), **sizes)
    return tables


def apply(batch: DataFrame, version: int, out: str, projection: Projection, **sizes: int) -> int:
    """Merge a micro-batch into a projection's tables as this version, and say how many rows were written.

    Applying a version again, after the failure of its first time, starts from the versions before it.
    """
    tables, rows = stores(batch.sparkSession, out, projection, **sizes), batch
    if projection.seen:
        *keys, value = projection.seen
        asked = batch.select(*keys, cell_of(value).alias("cell"))
        low, high = batch.agg(F.min(value), F.max(value)).first()
        held = tables["seen"].candidates(asked, version - 1, low, high) if low is not None else None
        rows = unseen(batch, held, keys, value)
    rows = rows.persist()
    try:
        written = sum(tables[name].append(p.partial(rows), version) for name, p in projection.parts.items())
        if projection.seen:
            written += tables["seen"].append(as_intervals(rows, keys, value), version)
        return written
    finally:
        rows.unpersist()


def read(spark: SparkSession, out: str, projection: Projection) -> DataFrame | None:
    """The view at the newest version that all its tables have; None before the first one."""
    tables = stores(spark, out, projection)
    newest = [t.versions()[-1:] for t in tables.values()]
    some = [v[0] for v in newest if v]
    if not some or (projection.seen and len(some) < len(tables)):
        return None
    upto = min(some) if projection.seen else None  # tables that are only maxima may be empty, or some versions apart
    return projection.view({name: rows for name, t in tables.items() if (rows := t.read(upto)) is not None})


def _bars_merged(rows: DataFrame) -> DataFrame:
    least, most = F.struct("first_seq", "open"), F.struct("last_seq", "close")
    ends = rows.groupBy("symbol", "bar").agg(F.min(least).alias("_first"), F.max(most).alias("_last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
    return ends.select("symbol", "bar", "_first.first_seq", "_first.open", "_last.last_seq", "_last.close", "high", "low", "volume")


def _bars_of(ticks: DataFrame) -> DataFrame:
    return _bars_merged(ticks.select("symbol", "bar", *(F.col("seq").alias(c) for c in ("first_seq", "last_seq")), *(F.col("price").alias(c) for c in ("open", "close", "high", "low")), F.col("size").alias("volume")))


def _bars_view(tables: dict[str, DataFrame]) -> DataFrame:
    held = members(tables["seen"], ["symbol", "bar"], "sequences").select(F.col("symbol").alias("_symbol"), F.col("bar").alias("_bar"), "sequences")
    same = F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("bar").eqNullSafe(F.col("_bar"))
    return tables["bars"].join(held, same).select("symbol", "bar", "open", "high", "low", "close", "volume", "sequences")


#: OHLC bars of (seq, symbol, price, size, bar) ticks, as `bars.ohlc` has them.
BARS = Projection({"bars": Part(["symbol", "bar"], _bars_of, _bars_merged)}, ["symbol", "bar", "seq"], _bars_view)


def _positions_merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book", "symbol").agg(F.sum("net_quantity").cast("decimal(38,2)").alias("net_quantity"), F.sum("realized_cash").cast(positions.AMOUNT).alias("realized_cash"))


#: Positions of (book, version, symbol, side, quantity, price) trades, as `positions.project` has them.
POSITIONS = Projection({"positions": Part(["book", "symbol"], positions.project, _positions_merged)}, ["book", "version"], lambda tables: tables["positions"])


def _tenants_merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant_id").agg(F.max("latest").alias("latest"))


def _users_merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant_id", "user_id").agg(F.max("email").alias("email"))


def _tenants_of(records: DataFrame) -> DataFrame:
    events = views.tenant_events(records)
    return _tenants_merged(events.select("tenant_id", F.struct("version", "arrival", "company").alias("latest")))


def _users_of(records: DataFrame) -> DataFrame:
    return _users_merged(views.user_events(records))


def _tenants_view(tables: dict[str, DataFrame]) -> DataFrame:
    some = next(iter(tables.values())).sparkSession
    latest = tables["tenants"].select("tenant_id", "latest.company", "latest.version") if "tenants" in tables else some.createDataFrame([], "tenant_id bigint, company string, version bigint")
    users = tables["users"] if "users" in tables else some.createDataFrame([], "tenant_id bigint, user_id string, email string")
    return views.tenant_users(latest, users)


#: Tenants with their users of recorded (topic, body, sequence) events, as `views.rebuild` has them.
TENANTS = Projection({"tenants": Part(["tenant_id"], _tenants_of, _tenants_merged), "users": Part(["tenant_id", "user_id"], _users_of, _users_merged)}, [], _tenants_view)
