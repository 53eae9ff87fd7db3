"""A table of mergeable partial states: micro-batches append runs, runs are merged by size, and buckets split as they grow.

Each micro-batch adds one run of its own partial states, so what it writes follows the batch and not what the table holds.
When a level has FANOUT runs they are merged into one of the next level; a row is so rewritten once a level, and a table of
N batches has some FANOUT * log(N) runs. A run's rows lie in buckets by a hash of the keys, under a directory of their own:
a bucket that would hold more than BUCKET_ROWS rows is split by one more bit of the hash, wherever it is in the directory.

What belongs to the table is said by a manifest for each version, written whole and then renamed: a reader sees the version
before or the one after, and never a mix. A replayed micro-batch starts from the versions before its own, so it changes
nothing. Runs that neither of the newest manifests names are deleted.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8
BUCKET_ROWS = 1 << 20
#: Manifests that stay, for readers and replays.
KEPT_VERSIONS = 3


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def split_buckets(counts: dict[int, int], depth: int, limit: int) -> dict[str, int]:
    """Rows of each bucket `<bits>-<lowest bits of the hash>`: those above the limit are split, down to `depth` bits."""
    out: dict[str, int] = {}

    def place(bits: int, low: int, inside: dict[int, int]) -> None:
        if sum(inside.values()) > limit and bits < depth:
            for bit in (0, 1):
                place(bits + 1, low | bit << bits, {h: n for h, n in inside.items() if h >> bits & 1 == bit})
        elif inside:
            out[f"{bits}-{low}"] = sum(inside.values())

    place(0, 0, counts)
    return out


class RunStore:
    """A table under `path`, keyed by `keys`; `merge` turns the rows of any runs into one row for each key.

    merge must not care for the order of its rows, and merging what has been merged must be the same as merging all at once.
    `zone` names two columns, of which each run's least and largest values are known to readers.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], zone: tuple[str, str] | None = None, fanout: int = FANOUT, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.keys, self.merge, self.zone = spark, path.rstrip("/"), keys, merge, zone
        self.fanout, self.bucket_rows = fanout, bucket_rows

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        """Versions that are there, ascending."""
        fs, where = _files(self.spark, f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def runs(self, upto: int | None = None) -> list[dict]:
        """The runs of the newest version, or of the newest one up to a number."""
        found = [v for v in self.versions() if upto is None or v <= upto]
        if not found:
            return []
        fs, where = _files(self.spark, f"{self.path}/versions/{found[-1]}")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, runs: list[dict]) -> None:
        fs, draft = _files(self.spark, f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(runs), "utf-8"))
        stream.close()
        _, final = _files(self.spark, f"{self.path}/versions/{version}")
        fs.delete(final, False)  # of a replay; readers have the version before
        if not fs.rename(draft, final):
            raise OSError(f"version {version} of {self.path} could not be written")
        # versions above this one came from a history that is being replayed
        kept = [v for v in self.versions() if v <= version][-KEPT_VERSIONS:]
        named = {r["folder"] for v in kept for r in self.runs(v)}
        for v in self.versions():
            if v not in kept:
                fs.delete(_files(self.spark, f"{self.path}/versions/{v}")[1], False)
        _, where = _files(self.spark, f"{self.path}/runs")
        for f in fs.listStatus(where) if fs.exists(where) else []:
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)

    # ------------------------------------------------------------ writing

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def _write(self, rows: DataFrame, level: int) -> dict | None:
        """Write one run; None if there are no rows. Of the keys' hashes some counts come to the driver, four a bucket."""
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            ends = [F.min(self.zone[0]), F.max(self.zone[1])] if self.zone else [F.lit(None), F.lit(None)]
            n, low, high = rows.agg(F.count("*"), *ends).first()
            if not n:
                return None
            folder, buckets = uuid.uuid4().hex, {"0-0": n}
            parts = rows.withColumn("_bucket", F.lit("0-0"))
            if n > self.bucket_rows:
                depth = math.ceil(math.log2(n / self.bucket_rows)) + 2
                bits = F.lit((1 << depth) - 1)
                counts = dict(rows.groupBy(self._hash().bitwiseAND(bits).alias("h")).count().collect())
                buckets = split_buckets(counts, depth, self.bucket_rows)
                parts = rows.withColumn("_bucket", _bucket_of(self._hash(), buckets))
            shuffled = parts.repartition(min(len(buckets), 1 << 14), "_bucket") if len(buckets) > 1 else parts.coalesce(1)
            shuffled.write.partitionBy("_bucket").parquet(f"{self.path}/runs/{folder}")
            return {"folder": folder, "level": level, "rows": n, "low": low, "high": high, "buckets": buckets}
        finally:
            rows.unpersist()

    def append(self, rows: DataFrame, version: int) -> int:
        """Add a micro-batch's partial states as this version, and merge the levels that are full. Gives the rows written."""
        runs = self.runs(version - 1)
        new = self._write(rows, 0)
        if new is None:
            return 0
        written, level = new["rows"], 0
        runs.append(new)
        while len(full := [r for r in runs if r["level"] == level]) >= self.fanout:
            merged = self._write(self.merge(self._read(full)), level + 1)
            written += merged["rows"]
            runs = [r for r in runs if r["level"] != level] + [merged]
            level += 1
        self._commit(version, runs)
        return written

    # ------------------------------------------------------------ reading

    def _read(self, runs: list[dict], only: list[list[str]] | None = None) -> DataFrame:
        """The rows of some runs, of all buckets or the named ones of each; the schema is that of the first run."""
        names = only or [list(r["buckets"]) for r in runs]
        folders = [f"{self.path}/runs/{r['folder']}/_bucket={b}" for r, some in zip(runs, names, strict=True) for b in some]
        return self.spark.read.parquet(*folders)

    def read(self, upto: int | None = None) -> DataFrame | None:
        """One row a key: the newest version, or the newest one up to a number. None if there is nothing yet."""
        runs = self.runs(upto)
        return self.merge(self._read(runs)) if runs else None

    def candidates(self, touching: DataFrame, upto: int, low: Any = None, high: Any = None) -> DataFrame | None:
        """Unmerged rows among which are all with keys of `touching` whose zone meets low to high; None if there are none.

        Runs of another zone and buckets of other keys aren't read. For this, of the keys' hashes at most as many different
        endings come to the driver as the largest directory has.
        """
        runs = [r for r in self.runs(upto) if low is None or not self.zone or (r["low"] <= high and low <= r["high"])]
        if not runs:
            return None
        depth = max(int(b.split("-")[0]) for r in runs for b in r["buckets"])
        if not depth:
            return self._read(runs)
        ends = [r[0] for r in touching.select(self._hash().bitwiseAND(F.lit((1 << depth) - 1))).distinct().collect()]
        only = []
        for r in runs:
            sizes = sorted({int(b.split("-")[0]) for b in r["buckets"]})
            only.append(sorted({b for e in ends for k in sizes if (b := f"{k}-{e & (1 << k) - 1}") in r["buckets"]}))
        some = [(r, b) for r, b in zip(runs, only, strict=True) if b]
        return self._read([r for r, _ in some], [b for _, b in some]) if some else None


def _bucket_of(hashed: Column, buckets: dict[str, int]) -> Column:
    """The bucket of a hash under a directory: an array with an entry for each ending of the deepest bucket's length."""
    depth = max(int(b.split("-")[0]) for b in buckets)
    entry = ["-"] * (1 << depth)
    for b in buckets:
        bits, low = map(int, b.split("-"))
        for high in range(1 << (depth - bits)):
            entry[high << bits | low] = b
    directory = F.split(F.lit(",".join(entry)), ",")
    return F.get(directory, hashed.bitwiseAND(F.lit((1 << depth) - 1)).cast("int"))
