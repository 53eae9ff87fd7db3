"""Fan-out reactions to published events: journals, dedupe, bounded retry, late subscribers, correlation traces."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A reaction turns events (tenant_id, company, email, plan, correlation_id, ...) into (what, correlation_id, status) rows,
#: which also keep the events' event_id where they have one.
Reaction = Callable[[DataFrame], DataFrame]


def _rows(events: DataFrame, template: str, status: Column | None = None) -> DataFrame:
    """One entry an event; the template names columns in braces, and what is null there is left out."""
    parts = [F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    own = [c for c in events.columns if c == "event_id"]
    return events.select(F.concat(*parts).alias("what"), "correlation_id", (status if status is not None else F.lit("ok")).alias("status"), *own)


def analytics(events: DataFrame) -> DataFrame:
    return _rows(events, "signup: {company} on {plan}")


def cache_warmer(events: DataFrame) -> DataFrame:
    return _rows(events, "warmed {tenant_id}")


def trial_clock(events: DataFrame) -> DataFrame:
    """Only the standard plan has a trial; for the others there is nothing to do."""
    return _rows(events.where(F.lower("plan") == "standard"), "trial started for {tenant_id} (14 days)")


def welcome_email(events: DataFrame) -> DataFrame:
    """Mail to companies whose name starts with `bounce` fails, and the journal says so."""
    bounces = F.coalesce(F.lower("company").startswith("bounce"), F.lit(False))
    good, bad = _rows(events.where(~bounces), "welcomed {email}"), _rows(events.where(bounces), "FAILED to email {email}", F.lit("FAILED"))
    return good.unionByName(bad)


REGISTRY: dict[str, Reaction] = {"analytics": analytics, "cache-warmer": cache_warmer, "trial-clock": trial_clock, "welcome-email": welcome_email}


def journal(events: DataFrame, registry: dict[str, Reaction] = REGISTRY) -> DataFrame:
    """(reaction, what, correlation_id, status) of every reaction to every event; no reaction sees another's rows."""
    return reduce(DataFrame.unionByName, (react(events).withColumn("reaction", F.lit(name)) for name, react in registry.items())).select("reaction", "what", "correlation_id", "status")


def dedupe(deliveries: DataFrame) -> DataFrame:
    """The first successful delivery of each (topic, body); a failed one releases its claim, so a retry can succeed."""
    key = F.sha2(F.concat_ws("\x1f", "topic", "body"), 256)
    return deliveries.where("status = 'ok'").withColumn("key", key).groupBy("key").agg(F.min_by("topic", "delivery").alias("topic"), F.min_by("body", "delivery").alias("body"), F.min("delivery").alias("delivery"))


def settle(results: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Add outcome: done, retry, or dead-letter at the last attempt; nothing else is rolled back."""
    return results.withColumn("outcome", F.when(F.col("status") == "ok", "done").when(F.col("attempt") < max_attempts, "retry").otherwise("dead-letter"))


def with_retries(events: DataFrame, react: Reaction, max_attempts: int = 2) -> DataFrame:
    """(what, correlation_id, status, event_id, attempt, outcome) rows of all attempts: what fails is tried again, at most so often.

    An event is known by its event_id, and without such a column by all its values; correlation ids may be null or shared.
    """
    whole = F.sha2(F.to_json(F.struct(*events.columns)), 256)
    out, todo = [], events if "event_id" in events.columns else events.withColumn("event_id", whole)
    for attempt in range(1, max_attempts + 1):
        done = settle(react(todo).withColumn("attempt", F.lit(attempt)), max_attempts)
        out.append(done)
        failed = done.where("outcome = 'retry'").select(F.col("event_id").alias("_failed"))
        todo = todo.join(failed, F.col("event_id").eqNullSafe(F.col("_failed")), "left_semi")
    return reduce(DataFrame.unionByName, out)


def subscribe(events: DataFrame, since: int, from_log: bool = False) -> DataFrame:
    """What a reaction added at `since` sees: later events only, unless it reads a durable log."""
    return events if from_log else events.where(F.col("seq") > since)


def _expected(events: DataFrame, entries: DataFrame, expected: list[str]) -> DataFrame:
    """(reaction, correlation_id, _there) of every emitted id and every expected reaction; _there is null without an entry."""
    ids = events.select("correlation_id").distinct()
    wanted = ids.select("correlation_id", F.explode(F.array(*map(F.lit, expected))).alias("reaction"))
    have = entries.select("correlation_id", "reaction").distinct().withColumn("_there", F.lit(1))
    return wanted.join(have, ["correlation_id", "reaction"], "left")


def trace(events: DataFrame, entries: DataFrame, expected: list[str]) -> DataFrame:
    """(reaction, emitted, found, missing): how many emitted correlation ids are in each expected reaction's journal."""
    both = _expected(events, entries, expected)
    return both.groupBy("reaction").agg(F.count("*").alias("emitted"), F.count("_there").alias("found"), (F.count("*") - F.count("_there")).alias("missing"))


def missing(events: DataFrame, entries: DataFrame, expected: list[str]) -> DataFrame:
    """(reaction, correlation_id): each emitted id that an expected reaction's journal lacks."""
    return _expected(events, entries, expected).where("_there is null").select("reaction", "correlation_id")
