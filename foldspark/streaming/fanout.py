"""Fan-out of one event stream to independent reactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldspark.operators.reactions import REGISTRY, Reaction
from foldspark.streaming.redelivery import Redelivery


def reactions(stream: DataFrame, out: str, registry: dict[str, Reaction] = REGISTRY, max_attempts: int = 2) -> dict[str, Redelivery]:
    """Each reaction with its journal, dead letters and retries under out/<reaction>."""

    def named(name: str, react: Reaction) -> Reaction:
        return lambda events: react(events).withColumn("reaction", F.lit(name))

    return {name: Redelivery(stream.sparkSession, named(name, react), f"{out}/{name}", max_attempts) for name, react in registry.items()}


def start(stream: DataFrame, out: str, checkpoints: str, registry: dict[str, Reaction] = REGISTRY, max_attempts: int = 2) -> dict[str, StreamingQuery]:
    """One query and one checkpoint a reaction, so a slow or failing one holds up no other.

    Each writes its journal to out/<reaction>/journal, a row an attempt, with outcome done, retry or dead-letter. What fails comes
    again with a later batch; `Redelivery.drain` brings it again when no more events come.
    """
    return {name: r.start(stream, f"{checkpoints}/{name}", f"reaction {name}") for name, r in reactions(stream, out, registry, max_attempts).items()}
