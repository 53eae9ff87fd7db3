"""Exact deduplication over a sharded cuckoo-filter index of live digests.

A text is identified by its SHA-256 digest. Digests are first combined inside each Arrow batch, so a text with many
copies sends one row a batch to its shard. A shard is one task with an index: a cuckoo filter of 16-bit fingerprints
says "surely new" for most digests; a hit is verified against the content bucket, which holds the full digests. When an
insertion finds no place, the filter doubles and is rebuilt from the stored digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import U64, map_arrow, materialise, mix64, unused_name

SLOTS = 4
MAX_KICKS = 200
#: Digests that one shard's task is meant to hold; the number of shards follows the input.
SHARD_DIGESTS = 200_000


class CuckooIndex:
    """Live digests (32 bytes each) with a largest id and a number of copies each.

    insert() adds copies, delete() takes copies away and removes a digest whose last copy goes, contains() asks.
    All take n x 32 byte arrays; the digests of one call must differ.
    """

    def __init__(self, capacity: int = 1024, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(capacity, 16) / (SLOTS * 0.9)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.digests = np.zeros((max(capacity, 16), 32), np.uint8)
        self.ids = np.zeros(len(self.digests), np.int64)
        self.has_id = np.zeros(len(self.digests), bool)
        self.copies = np.zeros(len(self.digests), np.int64)
        self.used = 0
        self.content: dict[int, list[int]] = {}
        self.resizes = 0

    # -- filter

    def _place(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and first bucket of each digest."""
        words = np.ascontiguousarray(digests).view(U64)
        fp = (words[:, 1] & U64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        return fp, (words[:, 2] & U64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return (bucket ^ (mix64(fp.astype(U64)) & U64(self.buckets - 1)).astype(np.int64)) & (self.buckets - 1)

    def _maybe(self, fp: np.ndarray, b1: np.ndarray) -> np.ndarray:
        b2 = self._other(b1, fp)
        return (self.table[b1] == fp[:, None]).any(1) | (self.table[b2] == fp[:, None]).any(1)

    def _add(self, fp: np.ndarray, bucket: np.ndarray) -> bool:
        """Place fingerprints round by round: those without a free slot evict a random one, which moves on."""
        tried = np.zeros(len(fp), bool)
        for _ in range(MAX_KICKS):
            if not len(fp):
                return True
            _, one = np.unique(bucket, return_index=True)  # one newcomer a bucket and round
            wait = np.ones(len(fp), bool)
            wait[one] = False
            free = self.table[bucket[one]] == 0
            can = free.any(1)
            self.table[bucket[one[can]], free[can].argmax(1)] = fp[one[can]]
            full = one[~can]
            first = full[~tried[full]]  # try the other bucket before evicting
            kick = full[tried[full]]
            slot = self.rng.integers(0, SLOTS, len(kick))
            out = self.table[bucket[kick], slot].copy()
            self.table[bucket[kick], slot] = fp[kick]
            fp, bucket, tried = (
                np.r_[fp[wait], fp[first], out],
                np.r_[bucket[wait], self._other(bucket[first], fp[first]), self._other(bucket[kick], out)],
                np.r_[tried[wait], np.ones(len(first) + len(kick), bool)],
            )
        return not len(fp)

    def _grow(self) -> None:
        """Double the filter until every stored digest has a place; content buckets follow the new size."""
        live = np.flatnonzero(self.copies[: self.used] > 0)
        while True:
            self.buckets *= 2
            self.resizes += 1
            self.table = np.zeros((self.buckets, SLOTS), np.uint16)
            fp, b = self._place(self.digests[live])
            if self._add(fp, b):
                break
        self.content = {}
        for at, k in zip(b.tolist(), live.tolist(), strict=True):
            self.content.setdefault(at, []).append(k)

    # -- content

    def _find(self, digests: np.ndarray, fp: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Row of each live digest, or -1: filter first, then the full digest in its content bucket."""
        at = np.full(len(digests), -1, np.int64)
        for i in np.flatnonzero(self._maybe(fp, b1)).tolist():
            for k in self.content.get(int(b1[i]), ()):
                if (self.digests[k] == digests[i]).all():
                    at[i] = k
        return at

    def contains(self, digests: np.ndarray) -> np.ndarray:
        return self._find(digests, *self._place(digests)) >= 0

    def insert(self, digests: np.ndarray, ids: np.ndarray, has_id: np.ndarray, copies: np.ndarray) -> None:
        fp, b = self._place(digests)
        at = self._find(digests, fp, b)
        old = at >= 0
        k = at[old]
        self.ids[k] = np.where(has_id[old] & (~self.has_id[k] | (ids[old] > self.ids[k])), ids[old], self.ids[k])
        self.has_id[k] |= has_id[old]
        self.copies[k] += copies[old]
        new = np.flatnonzero(~old)
        rows = np.arange(self.used, self.used + len(new))
        while self.used + len(new) > len(self.digests):
            more = len(self.digests)
            self.digests = np.r_[self.digests, np.zeros((more, 32), np.uint8)]
            self.ids, self.copies = (np.r_[x, np.zeros(more, np.int64)] for x in (self.ids, self.copies))
            self.has_id = np.r_[self.has_id, np.zeros(more, bool)]
        self.digests[rows], self.ids[rows], self.has_id[rows], self.copies[rows] = digests[new], ids[new], has_id[new], copies[new]
        self.used += len(new)
        for bucket, row in zip(b[new].tolist(), rows.tolist(), strict=True):
            self.content.setdefault(bucket, []).append(row)
        if self.used > 0.92 * self.buckets * SLOTS or not self._add(fp[new], b[new]):
            self._grow()

    def delete(self, digests: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Take copies away; True for digests that were live. Only verified digests leave the filter."""
        fp, b = self._place(digests)
        at = self._find(digests, fp, b)
        for i in np.flatnonzero(at >= 0).tolist():
            k = int(at[i])
            self.copies[k] -= copies[i]
            if self.copies[k] <= 0:
                self.copies[k] = 0
                self.content[int(b[i])].remove(k)
                for bucket in (int(b[i]), int(self._other(b[i : i + 1], fp[i : i + 1])[0])):
                    slot = np.flatnonzero(self.table[bucket] == fp[i])
                    if len(slot):
                        self.table[bucket, slot[0]] = 0
                        break
        return at >= 0

    def live(self) -> np.ndarray:
        return np.flatnonzero(self.copies[: self.used] > 0)


_ENTRY = "digest binary, keep_id long, group_size long"


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _entries(digests: np.ndarray, ids: np.ndarray, has_id: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(ids, pa.int64(), mask=~has_id), pa.array(copies, pa.int64())], names=["digest", "keep_id", "group_size"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each digest of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d = _digests(batch.column(0))
        ids = batch.column(1)
        has = ~np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0))
        keys, inverse = np.unique(np.ascontiguousarray(d).view("V32").ravel(), return_inverse=True)
        largest = np.full(len(keys), np.iinfo(np.int64).min)
        np.maximum.at(largest, inverse[has], ids[has])
        any_id = np.bincount(inverse[has], minlength=len(keys)) > 0
        yield _entries(keys.view(np.uint8).reshape(-1, 32), np.where(any_id, largest, 0), any_id, np.bincount(inverse, minlength=len(keys)))


def _index_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Build one shard's index from partial entries and give its live entries."""
    index = CuckooIndex()
    for batch in batches:
        if not batch.num_rows:
            continue
        d, ids, copies = _digests(batch.column(0)), batch.column(1), np.asarray(batch.column(2))
        has = ~np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0))
        order = np.argsort(np.ascontiguousarray(d).view("V32").ravel(), kind="stable")  # repeated digests go in later calls
        key = np.ascontiguousarray(d).view("V32").ravel()[order]
        begins = np.r_[True, key[1:] != key[:-1]]
        turn = np.arange(len(d)) - np.maximum.accumulate(np.where(begins, np.arange(len(d)), 0))
        by_turn = np.argsort(turn, kind="stable")
        for rows in np.split(order[by_turn], np.cumsum(np.bincount(turn))[:-1]):
            index.insert(d[rows], ids[rows], has[rows], copies[rows])
    live = index.live()
    for at in range(0, len(live), 10_000):
        k = live[at : at + 10_000]
        yield _entries(index.digests[k], index.ids[k], index.has_id[k], index.copies[k])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text in UTF-8; null counts as empty."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"))


def build_index(hashed: DataFrame, shards: int) -> DataFrame:
    """Live entries (digest, keep_id, group_size) of (doc_id, digest) rows: each text's largest doc_id and its rows."""
    partial = map_arrow(hashed.select("digest", F.col("doc_id").alias("keep_id")), _combine, _ENTRY)
    return map_arrow(partial.repartition(shards, "digest"), _index_shard, _ENTRY)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical; a null text equals the empty text. keep_id is the largest doc_id of the
    group and kept says that the row has it. A null doc_id never beats another one; a group of null ids keeps null.
    Rows that repeat a doc_id and its text all count in group_size and share kept. An empty table gives no rows. Only
    doc_id and text are read, so other columns can have any name.
    """
    hashed = materialise(digests(docs), "digests")
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hashed.count() // SHARD_DIGESTS))
    index = build_index(hashed, shards)
    return hashed.join(index, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that `exact_dedup` keeps, with all their columns; of rows that repeat doc_id and text, any one."""
    decided = materialise(exact_dedup(docs).where("group_size > 1"), "exact-decisions")
    mine, of_id, of_text = (unused_name(docs, c) for c in ("own_sha256", "of_id", "of_sha256"))
    hashed = docs.withColumn(mine, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    on = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(mine) == F.col(of_text))

    def rows(which: DataFrame) -> DataFrame:
        # a row a document, so without a bound: never to be broadcast
        return which.select(F.col("doc_id").alias(of_id), F.col("text_sha256").alias(of_text)).distinct().hint("merge")

    out = hashed.join(rows(decided.where(~F.col("kept"))), on, "left_anti")
    repeated = decided.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not repeated.isEmpty():
        once = hashed.join(rows(repeated), on, "left_semi").dropDuplicates(["doc_id", mine])
        out = out.join(rows(repeated), on, "left_anti").union(once)
    return out.select(*docs.columns)
