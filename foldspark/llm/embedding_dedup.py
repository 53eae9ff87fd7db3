"""Embedding near-dedup: Euclidean p-stable hashing of normalised vectors, then exact cosines.

Each of TABLES tables concatenates WIDTH quantised random projections floor((a . x + b) / CELL). Vectors of one label that
share a bucket in any table are compared by their cosine in double precision. A pair counts in the first table where it
meets, so links are counted without ever being listed; large buckets are dealt into pairs of blocks. Of buckets with the
same members one is compared, so close groups, which meet in most tables, are sent once. Identical vectors of a label are
one class, whose copies are counted and not compared.

At a cosine of 0.93 two vectors share a projection with probability 0.80 and meet in some table with 0.997; at 0.96 with
more than 0.9999.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from foldspark.llm.common import U64, connected_components, map_arrow, materialise, mix64

TABLES = 80
WIDTH = 12
#: A power of two above TABLES: a bucket's number holds its table below it.
LOW = 128
CELL = 1.5
SIMILARITY = 0.93
BLOCK_MEMBERS = 512
PAIRS_AT_ONCE = 1 << 15
#: Bytes of vectors that a partition of compared groups should get.
PART_BYTES = 64 << 20
SEED = 23


@lru_cache(maxsize=8)
def _projections(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, TABLES * WIDTH)), rng.random(TABLES * WIDTH) * CELL


def bucket_hashes(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The 32-bit bucket of each normalised vector in each table (n x TABLES)."""
    a, b = _projections(unit.shape[1], seed)
    cells = np.floor((unit @ a + b) / CELL).astype(np.int64).view(U64).reshape(len(unit), TABLES, WIDTH)
    h = np.full(cells.shape[:2], U64(seed))
    for k in range(WIDTH):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return (h >> U64(32)).astype(np.uint32)


def _normalised(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = x.astype(float)
    x /= np.abs(x).max(1)[:, None]  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1))[:, None]


_READ = "vec_id long, label string, dim int, f1 long, f2 long, raw binary"


def _read(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Components of the usable vectors as bytes, and their digest; dim 0 marks the others."""
    for batch in batches:
        n, vectors = batch.num_rows, batch.column(2)
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        size = np.where(batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False), size, 0)
        dim = np.zeros(n, np.int32)
        raw: list[bytes | None] = [None] * n
        prints = np.zeros((n, 2), np.int64)
        for d in np.unique(size[size > 0]).tolist():
            which = np.flatnonzero(size == d)
            x = vectors.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)  # null components become nan
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            dim[which[ok]] = d
            for i, v in zip(which[ok].tolist(), x[ok].astype(kind), strict=True):
                raw[i] = v.tobytes()
                prints[i] = np.frombuffer(hashlib.blake2b(raw[i], digest_size=16).digest(), np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(dim), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "f1", "f2", "raw"]
        )


def _hash(batches: Iterator[pa.RecordBatch], kind: str, seed: int) -> Iterator[pa.RecordBatch]:
    """Add the bucket hashes of each vector."""
    for batch in batches:
        dim, raw = batch.column("dim").to_numpy(), batch.column("raw").to_pylist()
        tables = np.zeros((batch.num_rows, TABLES), np.uint32)
        for d in np.unique(dim).tolist():
            which = np.flatnonzero(dim == d)
            x = np.frombuffer(b"".join(raw[i] for i in which.tolist()), kind).reshape(-1, d)
            tables[which] = bucket_hashes(_normalised(x), seed)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TABLES), pa.array(tables.view(np.int32).ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "tables"])


def _compare(batches: Iterator[pa.RecordBatch], similarity: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Links inside each group (one bucket, one pair of blocks) of rows that come group by group.

    Buckets and labels of a pair are compared again, so groups or buckets whose hashes agree by chance add nothing.
    Gives (rep, links, null) counts of linked rows and (rep, null, other) links that join what the group's links join.
    """
    held: pa.Table | None = None

    def finish(t: pa.Table) -> pa.RecordBatch:
        key = np.asarray(t.column("group").combine_chunks())
        rep, copies, block, one, bucket = (np.asarray(t.column(k).combine_chunks()) for k in ("rep", "copies", "block", "one", "bucket"))
        label = np.asarray(t.column("label").combine_chunks().dictionary_encode().indices)
        table = bucket & (LOW - 1)
        shared = t.column("shared").combine_chunks()
        buckets = np.full((len(key), TABLES), -1, np.int64)  # the kept buckets of each vector, by table; none is -1
        codes = np.asarray(shared.flatten())
        buckets[np.repeat(np.arange(len(key)), shared.value_lengths().to_numpy()), codes & (LOW - 1)] = codes
        raw = [np.frombuffer(x.as_buffer(), kind) for x in t.column("raw")]
        dim = np.array([len(v) for v in raw])
        links: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        root: dict[tuple[int, int], tuple[int, int]] = {}

        def find(c: tuple[int, int]) -> tuple[int, int]:
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        x = np.zeros((len(key), int(dim.max(initial=0))))
        for d in np.unique(dim).tolist():
            which = np.flatnonzero(dim == d)
            x[which, :d] = _normalised(np.array([raw[i] for i in which.tolist()]))
        step = 1
        while step < len(key):
            left = np.flatnonzero(key[:-step] == key[step:])
            if not len(left):
                break
            right = left + step
            alike = (bucket[left] == bucket[right]) & (label[left] == label[right]) & (dim[left] == dim[right])
            left = left[alike & (one[left] | (block[left] != block[right]))]  # two blocks: only across them
            for at in range(0, len(left), PAIRS_AT_ONCE):
                i = left[at : at + PAIRS_AT_ONCE]
                j = i + step
                close = np.einsum("ij,ij->i", x[i], x[j]) >= similarity
                i, j = i[close], j[close]
                earlier = (buckets[i] == buckets[j]) & (buckets[i] >= 0) & (np.arange(TABLES) < table[i][:, None])
                fresh = ~earlier.any(1)
                for p, q in zip(i[fresh].tolist(), j[fresh].tolist(), strict=True):
                    links[p] = links.get(p, 0) + int(copies[q])
                    links[q] = links.get(q, 0) + int(copies[p])
                    c, d = find((int(key[p]), p)), find((int(key[q]), q))
                    if c != d:
                        root[max(c, d)] = min(c, d)
                        edges.append((int(rep[p]), int(rep[q])))
            step += 1
        a = [int(rep[p]) for p in links] + [e for e, _ in edges]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([*links.values(), *[None] * len(edges)], pa.int64()), pa.array([None] * len(links) + [e for _, e in edges], pa.int64())], names=["a", "links", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        key = np.asarray(t.column("group").combine_chunks())
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if cut:
            yield finish(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield finish(held)


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, seed: int = SEED) -> DataFrame:
    """One row for each vector: (vec_id, n_links, component_id, kept).

    Vectors are linked when their labels are equal and not null, they have the same number of components, and their
    cosine in double precision is at least `similarity`. n_links counts the other rows linked directly, component_id is
    the smallest vec_id that links reach, kept says that it is the row's own. A vector that is null, empty, zero or holds
    a null or non-finite component, and a row without vec_id or label, links with nothing and is its own component.
    Repeated rows link with each other; different vectors under one vec_id are one node. An empty table gives no rows. Only vec_id, embedding and label are read.
    """
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    read = materialise(map_arrow(rows, partial(_read, kind=kind), _READ), "read-vectors")
    usable = read.where("dim > 0")
    same = ["label", "dim", "f1", "f2"]
    classes = usable.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("raw").alias("raw"))
    reps = materialise(map_arrow(classes, partial(_hash, kind=kind, seed=seed), StructType([*classes.schema, StructField("tables", ArrayType(IntegerType()))])), "vector-classes")

    # a bucket's number: a hash of label, dim and place, with the table in its low bits
    number = F.transform("tables", lambda h, t: F.xxhash64("label", "dim", t, h).bitwiseAND(F.lit((1 << 63) - LOW)).bitwiseOR(t.cast("long")))
    placed = reps.select("rep", F.explode(number).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    member = materialise(placed.join(sizes, "bucket"), "bucket-members")
    # of buckets with the same members only the first table's counts: each pair in it met there already
    prints = member.groupBy("bucket").agg(F.first("size").alias("size"), F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2"))
    kept = prints.groupBy("size", "low", "x1", "x2").agg(F.min_by("bucket", F.col("bucket").bitwiseAND(F.lit(LOW - 1))).alias("bucket")).select("bucket")
    member = materialise(member.join(kept, "bucket"), "kept-members")
    shared = member.groupBy("rep").agg(F.collect_set("bucket").alias("shared"))  # TABLES at most
    spread = member.withColumn("blocks", F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, second = F.least("block", "partner"), F.greatest("block", "partner")
    dealt = spread.select("rep", "bucket", "block", (first == second).alias("one"), F.xxhash64("bucket", first, second).alias("group"))
    dealt = dealt.join(reps.select("rep", "label", "copies", "raw").join(shared, "rep"), "rep")
    # a group is one task's work, so partitions follow the bytes that are dealt and aren't left to adaptive execution
    sent = spread.agg(F.count("*")).first()[0] * (reps.agg(F.avg(F.length("raw"))).first()[0] or 0.0)
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(sent / PART_BYTES))
    found = map_arrow(dealt.repartition(parts, "group").sortWithinPartitions("group", "rep"), partial(_compare, similarity=similarity, kind=kind), "a long, links long, b long")
    found = materialise(found, "vector-links")

    counts = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    component = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    known = reps.select(*same, "rep", "copies").join(counts, "rep", "left").join(component, "rep", "left")
    known = known.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.select("vec_id", *same).join(known, same).select("vec_id", "n_links", "component_id")
    alone = read.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
