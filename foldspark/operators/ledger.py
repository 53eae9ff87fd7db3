"""Event-sourced accounts: decoding, upcasting, balances now and then, snapshots, command adjudication."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldspark.functions.column_fold import Arrays, Decision, column_fold
from foldspark.functions.expressions import blank

OPENED, DEPOSITED, WITHDRAWN, DEPOSITED_V1 = "account:opened", "money:deposited", "money:withdrawn", "money:deposited:v1"
#: Payload schema of each event type; types that aren't here are tolerated and have no payload.
REGISTRY = {
    OPENED: "account_id string, holder string, currency string",
    DEPOSITED: "pence bigint, currency string, reference string",
    DEPOSITED_V1: "pence bigint, reference string",
    WITHDRAWN: "pence bigint, currency string, reference string",
}


def read(events: DataFrame, stream_ids: list | None = None, from_version: int = 0) -> DataFrame:
    """Events above from_version (exclusive), of the given streams or all."""
    out = events.where(F.col("version") > from_version)
    return out if stream_ids is None else out.where(F.col("stream_id").isin(stream_ids))


def decode(events: DataFrame, registry: dict[str, str] = REGISTRY) -> DataFrame:
    """Add `known` and the payload's members of all registered types; what can't be parsed is null."""
    members: dict[str, list[Column]] = {}
    types: dict[str, str] = {}
    for kind, schema in registry.items():
        parsed = F.when(F.col("event_type") == kind, F.from_json("payload", schema, {"mode": "PERMISSIVE"}))
        for field in StructType.fromDDL(schema):
            members.setdefault(field.name, []).append(parsed[field.name])
            types[field.name] = field.dataType.simpleString()
    known = F.col("event_type").isin(list(registry)) & F.from_json("payload", "map<string,string>").isNotNull()
    return events.select("stream_id", "version", "event_type", known.alias("known"), *(F.coalesce(*cols).alias(name) for name, cols in members.items()))


def _deposit_in_pounds(payload: Column) -> Column:
    body = F.from_json(payload, "pence bigint, reference string")
    return F.to_json(F.struct(body["pence"].alias("pence"), F.lit("GBP").alias("currency"), body["reference"].alias("reference")))


#: What turns an old event into the next form: its type -> (next type, next payload of a payload).
Casters = dict[str, tuple[str, Callable[[Column], Column]]]
CASTERS: Casters = {DEPOSITED_V1: (DEPOSITED, _deposit_in_pounds)}


def hops(casters: Casters) -> int:
    """The most steps from any type to its last form. A chain that comes back to a type is an error before any row is read."""
    longest = 0
    for kind in casters:
        seen = [kind]
        while seen[-1] in casters:
            seen.append(casters[seen[-1]][0])
            if seen[-1] in seen[:-1]:
                raise ValueError(f"event types are cast in a circle: {' -> '.join(seen)}")
        longest = max(longest, len(seen) - 1)
    return longest


def upcast(events: DataFrame, casters: Casters = CASTERS) -> DataFrame:
    """Old events in their last form, step by step along the chains of `casters`. Stored rows stay as they are.

    By default an old deposit loses its type's suffix and gets the currency GBP. Other types pass unchanged.
    """
    for _ in range(hops(casters)):
        kind, payload = F.col("event_type"), F.col("payload")
        next_kind, next_payload = kind, payload
        for old, (new, cast) in casters.items():
            next_kind = F.when(kind == old, new).otherwise(next_kind)
            next_payload = F.when(kind == old, cast(payload)).otherwise(next_payload)
        events = events.withColumns({"payload": next_payload, "event_type": next_kind})
    return events


def _change() -> Column:
    deposit = F.col("event_type").isin(DEPOSITED, DEPOSITED_V1)
    return F.when(deposit, F.col("pence")).when(F.col("event_type") == WITHDRAWN, -F.col("pence")).otherwise(F.lit(0)).cast("bigint")


def balances(events: DataFrame) -> DataFrame:
    """(stream_id, exists, balance, version, events_read) of each stream.

    An open resets the balance, so only what follows the last one counts; unknown types only move the version. The last open
    comes from a window without an order, so events that lie by stream already are neither shuffled, sorted nor read again.
    """
    opened = F.max(F.when(F.col("event_type") == OPENED, F.col("version"))).over(Window.partitionBy("stream_id"))
    rows = events.select("stream_id", "version", "event_type", "pence", opened.alias("opened_at"))
    counted = F.when(F.col("version") > F.coalesce("opened_at", F.lit(0)), _change()).otherwise(F.lit(0).cast("bigint"))
    return rows.groupBy("stream_id").agg(F.max("opened_at").isNotNull().alias("exists"), F.sum(counted).alias("balance"), F.max("version").alias("version"), F.count("*").alias("events_read"))


def as_of(events: DataFrame, version: int) -> DataFrame:
    """Balances at a version; zero or less, or beyond the head, means the head. Snapshots are never used."""
    return balances(events if version <= 0 else events.where(F.col("version") <= version))


def balance_history(events: DataFrame) -> DataFrame:
    """(stream_id, version, balance) after every event."""
    so_far = Window.partitionBy("stream_id").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.sum(F.when(F.col("event_type") == OPENED, 1).otherwise(0)).over(so_far)
    inside = Window.partitionBy("stream_id", "opens").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("opens", opens).select("stream_id", "version", F.sum(_change()).over(inside).alias("balance"))


def history(events: DataFrame, stream_id: int | str | None = None) -> DataFrame:
    """Events as written, not upcast, with the number of each stream's events."""
    rows = events if stream_id is None else events.where(F.col("stream_id") == stream_id)
    total = rows.groupBy("stream_id").agg(F.count("*").alias("events"))
    return rows.join(total, "stream_id").select("stream_id", "version", "event_type", "payload", "events")


def snapshot(events: DataFrame, version: int | None = None) -> DataFrame:
    """(stream_id, version, balance) of the existing accounts; a cache that can be dropped."""
    return balances(events if version is None else events.where(F.col("version") <= version)).where("exists").select("stream_id", "version", "balance")


def current(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Balances from snapshots and the events after them; events_read counts the tail only."""
    base = snapshots.where("stream_id is not null").select("stream_id", F.col("version").alias("from_version"), F.col("balance").alias("from_balance"))
    tail = events.select("stream_id", "version", "event_type", "pence").join(base.select("stream_id", "from_version"), "stream_id", "left").where("version > coalesce(from_version, 0)").drop("from_version")
    folded = balances(tail)
    both = folded.join(base, "stream_id", "full_outer")
    kept = F.when(F.col("exists"), F.lit(0)).otherwise(F.coalesce("from_balance", F.lit(0)))  # an open in the tail resets the balance
    return both.select(
        "stream_id", (F.coalesce("exists", F.lit(False)) | F.col("from_version").isNotNull()).alias("exists"), (kept + F.coalesce("balance", F.lit(0))).cast("bigint").alias("balance"), F.greatest(F.coalesce("version", F.lit(0)), F.coalesce("from_version", F.lit(0))).alias("version"), F.coalesce("events_read", F.lit(0)).alias("events_read")
    )


def assign_versions(new: DataFrame, heads: DataFrame, order: list[str]) -> DataFrame:
    """Add `version`: head + 1, head + 2, ... in each stream; a stream without a head starts at 1."""
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy(*order))
    return new.withColumn("_n", number).join(heads.select("stream_id", F.col("version").alias("_head")), "stream_id", "left").withColumn("version", (F.coalesce("_head", F.lit(0)) + F.col("_n")).cast("bigint")).drop("_n", "_head")


_KINDS, _STATUS = ("open", "deposit", "withdraw"), ("ok", "validation-error", "conflict", "not-found")
_ERRORS = ("blank", "exists", "pence", "account", "insufficient-funds", "version")
#: The refusals in the order in which they are tried: (status, error), as codes.
_REFUSED = ((1, 0), (2, 1), (1, 2), (3, 3), (1, 4), (2, 5))


def _decide(state: Arrays, row: dict[str, np.ndarray]) -> tuple[Arrays, Arrays]:
    exists, balance, head = state
    opens, pence = row["kind"] == 0, row["pence"]
    stale = row["expected_version?"] & (row["expected_version"] > 0) & (row["expected_version"] != head)
    moves = ~opens
    fails = [opens & row["invalid"], opens & (head != 0), moves & ~(row["pence?"] & (pence > 0)), moves & ~exists, (row["kind"] == 2) & (balance < pence), moves & stale]
    status, error = (np.select(fails, [r[k] for r in _REFUSED], none) for k, none in ((0, 0), (1, -1)))
    ok = status == 0
    balance = np.where(ok, np.where(opens, 0, balance + np.where(row["kind"] == 1, pence, -pence)), balance)
    head = head + ok
    return (exists | (ok & opens), balance, head), (status, error, balance, head)


def _decide_one(state: tuple, row: dict) -> tuple[tuple, tuple]:
    exists, balance, head = state
    kind, pence, expected = row["kind"], row["pence"], row["expected_version"]
    failed = None
    if kind == 0:
        failed = 0 if row["invalid"] else 1 if head else None
        if failed is None:
            exists, balance = True, 0
    elif not row["pence?"] or pence <= 0:
        failed = 2
    elif not exists:
        failed = 3
    elif kind == 2 and balance < pence:
        failed = 4
    elif row["expected_version?"] and expected > 0 and expected != head:
        failed = 5
    else:
        balance += pence if kind == 1 else -pence
    if failed is None:
        head += 1
    status, error = (0, -1) if failed is None else _REFUSED[failed]
    return (exists, balance, head), (status, error, balance, head)


#: Commands on an account, whose state at first is what the row says of it.
COMMANDS = Decision(
    ["kind", "pence", "expected_version", "invalid", "exists", "balance", "head"], "status string, error string, new_balance bigint, new_version bigint",
    {"kind": _KINDS, "status": _STATUS, "error": _ERRORS}, lambda row: (row["exists"].astype(bool), row["balance"].astype(np.int64), row["head"].astype(np.int64)), _decide, _decide_one,
)


def adjudicate(commands: DataFrame, events: DataFrame) -> DataFrame:
    """Decide (account_id, arrival, kind, pence, expected_version, holder) commands in order of arrival, account by account.

    Adds status, error, new_balance and new_version (the account's after the command). An accepted command is exactly one
    event at the head plus one; a refusal changes nothing.
    """
    now = balances(events).select(F.col("stream_id").alias("account_id"), "exists", "balance", "version")
    rows = commands.join(now, "account_id", "left").select("account_id", "arrival", "kind", "pence", "expected_version", (blank(F.col("account_id").cast("string")) | blank(F.col("holder"))).alias("invalid"), F.coalesce("exists", F.lit(False)).alias("exists"), F.coalesce("balance", F.lit(0).cast("bigint")).alias("balance"), F.coalesce("version", F.lit(0).cast("bigint")).alias("head"))
    return column_fold(rows, "account_id", ["arrival"], COMMANDS).drop("invalid", "exists", "balance", "head")


def accepted_events(results: DataFrame) -> DataFrame:
    """The events of accepted commands."""
    kind = F.when(F.col("kind") == "open", OPENED).when(F.col("kind") == "deposit", DEPOSITED).otherwise(WITHDRAWN)
    return results.where("status = 'ok'").select(F.col("account_id").alias("stream_id"), F.col("new_version").alias("version"), kind.alias("event_type"), "pence")
