"""Shared by the training-data operators: scratch tables, byte-level word scanning, connected components."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that a task handles at a time, one text at least.
CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch, where the session has Spark's own default.
BATCH_BYTES = 4 << 20


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="foldspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/foldspark/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage, and lost executors need no recomputation.

    The files go when the driver's JVM ends, or before that by `release`.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    fs, where = _files(df.sparkSession, path)
    fs.deleteOnExit(where)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def unused_name(df: DataFrame, name: str) -> str:
    """The name, with marks appended until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    if (path := getattr(df, "_scratch", None)) is not None:
        fs, where = _files(df.sparkSession, path)
        fs.delete(where, True)


# ---------------------------------------------------------------- bounded memory of the tasks


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end after BATCH_BYTES; a session that has a bound of its own keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def trimmed(rows: Iterator) -> Iterator:
    """The same items; after the last one, memory that this worker has freed goes back to the system."""
    import pyarrow as pa

    yield from rows
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, step, schema) -> DataFrame:
    """`mapInArrow` with bounded batches, whose workers give their memory back after each task."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        return trimmed(step(batches))

    return df.mapInArrow(run, schema)


class Memo:
    """What a worker remembers of words that it has seen: at most `most` of them and those of one call.

    There are two generations. When the new one is half of all it becomes the old one, and a word of the old one that is
    asked for again moves on, so frequent words stay.
    """

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """The words that aren't known; the others are in `new` until the next call, and these are meant to join them."""
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        rest = words.difference(self.new)
        again = {w: self.old[w] for w in rest if w in self.old}
        self.new.update(again)
        return sorted(rest.difference(again))


# ---------------------------------------------------------------- hashing and words


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public SplitMix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = U64(0xD6E8FEB86659FD93)
#: Bytes of a word that are hashed all words at a time; a longer word is digested on its own.
WORD_BYTES = 48


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string or binary array; a null has no bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` bytes of text, one row at least."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word `[^\\x20\\x09-\\x0D]+`; no word spans two rows."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) and the number of words of each row."""
    start, end = word_spans(data, offsets)
    size = end - start
    h = size.astype(U64)
    going = np.flatnonzero(size <= WORD_BYTES)
    for k in range(int(size[going].max(initial=0))):
        going = going[size[going] > k]
        h[going] = (h[going] ^ _BYTE[_LOWER[data[start[going] + k]]]) * _STEP
    h = mix64(h)
    for i in np.flatnonzero(size > WORD_BYTES).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(_LOWER[data[start[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    return h, np.diff(np.searchsorted(start, offsets))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of each shingle of `width` words; a shorter row has its whole word sequence as the only one."""
    row_of_word = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    left = ends[row_of_word] - np.arange(len(words))  # words from here to the row's end
    within = np.arange(len(words)) - (ends - counts)[row_of_word]
    take = (left >= width) | (within == 0)
    at = np.flatnonzero(take)
    size = np.minimum(left[at], width)
    h = np.full(len(at), U64(0x2545F4914F6CDD1D)) + size.astype(U64)
    for k in range(width):
        more = size > k
        if more.all():
            h = mix64(h * U64(0x9E3779B97F4A7C15) + words[at + k])
        else:
            h[more] = mix64(h[more] * U64(0x9E3779B97F4A7C15) + words[at[more] + k])
    return row_of_word[at], h


def distinct_by_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs of ascending rows, ordered by row and then hash."""
    h = h.copy()
    cuts = np.r_[0, np.flatnonzero(np.diff(row)) + 1, len(row)]
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        h[s:e].sort()
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


# ---------------------------------------------------------------- connected components


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges: longs (a, b). Returns (node, component), component being the smallest node that is reachable; a node
    without a link to another one isn't listed. Each round is two joins on the node, written to the shared folder,
    so neither the driver nor one task ever holds a component. Self-links are ignored and repeated links are harmless.
    """
    cur = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = _fingerprint(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = _symmetric(cur)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cur.join(low.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).distinct()
        large = materialise(large, "cc")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select("a", "b", "m")
        small = small.select(F.col("b").alias("x"), "m").union(small.select(F.col("a").alias("x"), "m")).where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        nxt = materialise(small, "cc")
        now = _fingerprint(nxt)
        release(cur)
        release(large)
        cur, done, seen = nxt, now == seen, now
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = cur.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.union(roots)
