"""Exact top-k search by integer inner products over an impact-ordered index, a score at a time.

A vector's components become integers. A shard's index holds a list of postings for each dimension, ordered by impact and
cut into segments of one quantised impact. A query's impacts are shifted so that none is negative: in a dimension where its
weight is negative the list is read from the other end. It takes the segments of all dimensions by falling contribution and
adds them to the accumulators of their members. What a member can still gain is bounded by the contribution that comes
next; a query stops only when so few members can still reach its lowest wanted score that these are scored exactly, and
whoever is left out is proven to be below it.

Identical vectors are one class that holds its k + 1 smallest ids, because no more of them can be in a result. Classes are
dealt into shards and queries into blocks, and each pair of them is one group of bounded size. A first part of the shards
gives each query a score that k + 1 rows reach; the rest returns only rows that reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import map_arrow, materialise

#: Cells (vectors x components) of a shard and of a block of queries.
SHARD_CELLS = 1 << 22
QUERY_CELLS = 1 << 21
#: Vectors of a shard at least, as long as there are fewer shards than shuffle partitions.
SHARD_ROWS = 4096
#: One shard of so many, one at least, belongs to the first part.
FIRST_PART = 64
#: Segments of a dimension in a shard, about.
LEVELS = 64
#: Parts of the postings after which a query looks whether it may stop, and the part of the members that it rescores then.
ROUNDS = 16
FEW = 1 / 8
#: Integers beyond this have no exact sums here.
LARGEST = 1 << 24


def integers(vectors: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """floor(256 * x) of each component, without the zeros at a vector's end, and which vectors take part.

    A vector that is null or has a null, non-finite or too large component takes no part.
    """
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    ok = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(size)
    for d in np.unique(size[ok & (size > 0)]).tolist():
        which = np.flatnonzero(ok & (size == d))
        x = vectors.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)  # null components become nan
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(256 * x)
            good = (np.abs(x) <= LARGEST).all(1)
        ok[which[~good]] = False
        whole = np.where(good[:, None], x, 0).astype(np.int32)
        last = np.where((whole != 0).any(1), d - (whole[:, ::-1] != 0).argmax(1), 0)
        for i, v, n in zip(which[good].tolist(), whole[good], last[good].tolist(), strict=True):
            out[i] = v[:n]
    return out, ok


def packed(x: np.ndarray) -> bytes:
    """A vector of integers as bytes, in the fewest bytes a component that all of them fit; equal vectors are equal bytes."""
    narrow = not len(x) or int(np.abs(x).max()) < 1 << 15
    return (b"\2" + x.astype("<i2").tobytes()) if narrow else (b"\4" + x.astype("<i4").tobytes())


def unpacked(rows: pa.ChunkedArray | pa.Array, dim: int = 0) -> np.ndarray:
    """The vectors of packed rows as a matrix with `dim` columns at least; shorter ones end in zeros."""
    each = [np.frombuffer(b, f"<i{b[0]}", offset=1) for b in rows.to_pylist()]
    size = np.array([*map(len, each)], np.int64)
    x = np.zeros((len(each), max(dim, int(size.max(initial=0)))), np.int32)
    if len(each):
        x[np.arange(x.shape[1]) < size[:, None]] = np.concatenate(each)
    return x


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, ok = integers(batch.column(1))
        keep = np.flatnonzero(ok)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([packed(x[i]) for i in keep.tolist()], pa.binary())], names=["vec_id", "x"])


class ImpactIndex:
    """A shard's postings: for each dimension its members by rising value, and where values of one quantised impact begin."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        self.low, self.high = x.min(0).astype(np.int64), x.max(0).astype(np.int64)
        self.members = np.empty(x.T.shape, np.intp)
        self.segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # begin (and the end of all), least and largest value
        for t in range(x.shape[1]):
            order = np.argsort(x[:, t], kind="stable")
            self.members[t] = order
            values = x[order, t].astype(np.int64)
            level = (values - self.low[t]) // max(1, int(self.high[t] - self.low[t]) // LEVELS)
            begin = np.r_[0, np.flatnonzero(np.diff(level)) + 1]
            self.segments.append((np.r_[begin, len(values)], values[begin], values[np.r_[begin[1:], len(values)] - 1]))
        self.exact_in_floats = x.shape[1] * max(1, int(np.abs(x).max(initial=0))) ** 2 < 1 << 53

    def scores(self, which: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        if self.exact_in_floats and self.x.shape[1] * max(1.0, float(np.abs(self.x).max(initial=0))) * max(1, int(np.abs(q).max(initial=0))) < 1 << 53:
            return (self.x[which] @ q.astype(float)).astype(np.int64)
        return (self.x[which].astype(np.int64) * q.astype(np.int64)).sum(1)

    def reach(self, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Members that may be among the k best, all of at least `least`, with their exact scores.

        The k-th best exact score known so far, or `least`, is what a member must be able to reach.
        """
        n = len(self.x)
        dims = np.flatnonzero(q)
        # a segment's contribution: weight x (largest value - lowest value), or from the other end for a negative weight
        parts = []
        for t in dims.tolist():
            begin, small, large = self.segments[t]
            w = int(q[t])
            gain = w * (large - int(self.low[t])) if w > 0 else -w * (int(self.high[t]) - small)
            parts.append((np.full(len(gain), t), begin[:-1], begin[1:], gain))
        if not parts:
            every = np.arange(n)
            return every, np.zeros(n, np.int64)
        dim, begin, end, gain = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(-gain, kind="stable")
        dim, begin, end, gain = dim[order], begin[order], end[order], gain[order].astype(float)
        base = int(np.where(q > 0, q.astype(np.int64) * self.low, q.astype(np.int64) * self.high)[dims].sum())
        most = np.zeros(len(q))  # the largest contribution of each dimension
        np.maximum.at(most, dim, gain)
        size = end - begin
        taken = np.cumsum(size)
        # one accumulator holds a member's contributions and, above them, how many there are
        one = float(1 << int(most.sum()).bit_length())
        both, added = one * (len(dims) + 1) < 1 << 53, np.zeros(n)
        total, seen = np.zeros(n), np.zeros(n)
        at = 0
        for r in range(1, ROUNDS + 1):
            to = max(at + 1, int(np.searchsorted(taken, taken[-1] * r / ROUNDS))) if r < ROUNDS else len(gain)
            where = np.concatenate([self.members[t, s:e] for t, s, e in zip(dim[at:to].tolist(), begin[at:to].tolist(), end[at:to].tolist(), strict=True)]) if to > at else np.zeros(0, np.intp)
            if both:
                added += np.bincount(where, np.repeat(gain[at:to] + one, size[at:to]), minlength=n)
                seen = np.floor(added / one)
                total = added - seen * one
            else:
                total += np.bincount(where, np.repeat(gain[at:to], size[at:to]), minlength=n)
                seen += np.bincount(where, minlength=n)
            at = to
            follows = float(gain[at]) if at < len(gain) else 0.0
            # a member's dimensions that are still to come contribute no more than `follows` each, nor than their most
            bound = total + (np.minimum(most[dims], follows).sum() - follows * seen) + base
            if least == -math.inf and n >= k:
                some = np.argpartition(-bound, k - 1)[:k]
                least = float(np.partition(self.scores(some, q), len(some) - k)[len(some) - k])
            possible = np.flatnonzero(bound >= least)
            if len(possible) <= max(4 * k, FEW * n) or at == len(gain):
                break
        score = self.scores(possible, q)
        if len(score) > k:
            least = max(least, float(np.partition(score, len(score) - k)[len(score) - k]))
        best = score >= least
        return possible[best], score[best]


_FOUND = "rep long, mark long, vec_id long, score long"


def _search(classes: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best (by falling score, then vec_id) of a shard for each query of a block, among those that reach its least score."""
    out: list[list[int]] = [[], [], [], []]
    if classes.num_rows and queries.num_rows:
        order = pc.sort_indices(classes.column("first"))
        classes = classes.take(order)
        x = unpacked(classes.column("x"))
        ids = classes.column("ids").to_pylist()
        q = unpacked(queries.column("x"), x.shape[1])
        x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
        index = ImpactIndex(x)
        for weights, rep, mark, least in zip(q, queries.column("rep").to_pylist(), queries.column("mark").to_pylist(), queries.column("least").to_pylist(), strict=True):
            which, score = index.reach(weights, k, -math.inf if least is None else least)
            near = sorted((-s, i) for c, s in zip(which.tolist(), score.tolist(), strict=True) for i in ids[c])[:k]
            out[0] += [rep] * len(near)
            out[1] += [mark] * len(near)
            out[2] += [i for _, i in near]
            out[3] += [-s for s, _ in near]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("rep", "mark", "vec_id", "score"), out, strict=True)})


def _pairs(classes: DataFrame, queries: DataFrame, shards: range, blocks: int, k: int) -> DataFrame:
    """Results of all queries in some shards: a group for each pair of a shard and a block of queries."""
    left = classes.where(F.col("shard").between(shards.start, shards.stop - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(shards.start), F.lit(shards.stop - 1))))
    left, right = left.select("shard", "block", "x", "first", "ids"), right.select("shard", "block", "x", "rep", "mark", "least")
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(partial(_search, k=k), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("rep", "mark").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates are the rows with another vec_id. A component x counts
    as floor(256 * x); a vector that is null or holds a null, a non-finite or a component of more than 2^16 in magnitude
    takes no part, and neither does a row without vec_id. Vectors of different length are compared as if the shorter one
    ended in zeros, so an empty vector scores 0. Repeated rows count once; a vec_id with several vectors stands for each of
    them, as a query too. With fewer than k candidates all are returned; an empty table gives no rows. Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialise(map_arrow(rows, _pack, "vec_id long, x binary"), "integer-vectors")
    asked = rows.where(F.col("vec_id") % every == 0).distinct()

    some = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    classes = some.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialise(classes.select("x", "ids", F.col("ids")[0].alias("first")), "vector-classes")
    queries = asked.groupBy("x").agg(F.min("vec_id").alias("rep")).withColumn("mark", F.xxhash64("x"))
    queries = materialise(queries, "query-classes")
    n, widest = classes.agg(F.count("*"), F.max(F.length("x"))).first()
    cells = max(1, (widest or 1) // 2)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(1, math.ceil(n * cells / SHARD_CELLS), min(parts, math.ceil(n / SHARD_ROWS)))
    blocks = max(1, math.ceil(queries.count() * cells / QUERY_CELLS))
    classes = classes.withColumn("shard", F.pmod(F.xxhash64("x", F.lit(1)), F.lit(n_shards)).cast("int"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("x", F.lit(2)), F.lit(blocks)).cast("int"))

    first = math.ceil(n_shards / FIRST_PART)
    found = materialise(_best(_pairs(classes, queries.withColumn("least", F.lit(None).cast("double")), range(first), blocks, k + 1), k + 1).drop("place"), "first-results")
    if first < n_shards:
        least = found.groupBy("rep", "mark").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("size")).where(F.col("size") > k).drop("size")
        rest = _pairs(classes, queries.join(least, ["rep", "mark"], "left"), range(first, n_shards), blocks, k + 1)
        found = found.union(rest)
    lists = _best(found, k + 1).groupBy("rep", "mark").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    member = asked.withColumnRenamed("vec_id", "query_id").join(queries.select("x", "rep", "mark"), "x").select("query_id", "rep", "mark")
    near = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    out = member.join(lists, ["rep", "mark"]).select("query_id", F.posexplode(near).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
