"""Watch lists over a live tick stream, with the state of each symbol in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, session_id long, seq long, price double, kind string"
#: At one seq a watch ends before the tick, and one that begins has the tick as its snapshot.
ENDS, TICK, BEGINS = 0, 1, 2


def _delivered(key: str, sessions: np.ndarray, seq: np.ndarray, price: np.ndarray, kind: str) -> pd.DataFrame:
    """Each tick for each session."""
    n = len(sessions)
    return pd.DataFrame({"key": key, "session_id": np.tile(sessions, len(seq)), "seq": np.repeat(seq, n), "price": np.repeat(price, n), "kind": kind})


class _Watchers(StatefulProcessor):
    """Of a shard of a symbol: the last tick, and the sessions that watch it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, price double")
        self.watching = handle.getMapState("watching", "session_id long", "since long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["seq", "turn"], kind="stable")
        turn, seq, price, session = (rows[c].to_numpy() for c in ("turn", "seq", "price", "session_id"))
        sessions = {int(s[0]): None for s in self.watching.keys()}  # in the order of watching
        last = self.last.get() if self.last.exists() else None
        out, begin = [], 0
        for end in [*np.flatnonzero(turn != TICK).tolist(), len(rows)]:
            if end > begin:  # a run of ticks between two changes of the sessions
                if sessions:
                    out.append(_delivered(key[0], np.fromiter(sessions, np.int64), seq[begin:end], price[begin:end], "tick"))
                last = (int(seq[end - 1]), float(price[end - 1]))
            begin = end + 1
            if end == len(rows):
                break
            one = int(session[end])
            if turn[end] == ENDS and one in sessions:
                del sessions[one]
                self.watching.removeKey((one,))
            elif turn[end] == BEGINS and one not in sessions:
                sessions[one] = None
                self.watching.updateValue((one,), (int(seq[end]),))
                if last is not None:
                    out.append(_delivered(key[0], np.array([one]), np.array([last[0]]), np.array([float(last[1])]), "snapshot"))
        if last is not None:
            self.last.update((int(last[0]), float(last[1])))
        yield pd.concat(out) if out else pd.DataFrame({"key": [], "session_id": [], "seq": [], "price": [], "kind": []}).astype({"key": str, "session_id": "int64", "seq": "int64", "price": float, "kind": str})

    def close(self) -> None:
        pass


def watchlist(ticks: DataFrame, watches: DataFrame, shards: int = 1) -> DataFrame:
    """What each watch delivers, as a stream: a snapshot when it starts, then every tick until it ends.

    ticks: (seq, symbol, price); watches: (seq, session_id, symbol, unwatch). Symbols match ignoring case. A symbol's sessions are
    dealt over `shards` states, each of which gets the symbol's ticks, so the deliveries of a symbol that most sessions watch
    are the work of so many tasks; a tick is sent once a shard and not once a session. Changing `shards` needs a new
    checkpoint. The stream needs the RocksDB state store provider.
    """
    some = max(1, shards)
    left = ticks.select(F.upper("symbol").alias("key"), "seq", F.col("price").cast("double").alias("price"), F.lit(TICK).alias("turn"), F.lit(-1).cast("bigint").alias("session_id"), F.explode(F.sequence(F.lit(0), F.lit(some - 1))).alias("shard"))
    turn = F.when(F.col("unwatch"), ENDS).otherwise(BEGINS)
    session = F.col("session_id").cast("bigint")
    right = watches.select(F.upper("symbol").alias("key"), "seq", F.lit(0.0).alias("price"), turn.alias("turn"), session.alias("session_id"), F.pmod(F.xxhash64(session), F.lit(some)).cast("int").alias("shard"))
    return left.unionByName(right).groupBy("key", "shard").transformWithStateInPandas(_Watchers(), OUTPUT, "Append", "None")
