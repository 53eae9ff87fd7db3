"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

Each source has a weight; the targets share the size of the whole corpus and no target exceeds MAX_EPOCHS times its
source. Documents are dealt by hash into shards of about SHARD_DOCS. A source is dealt over as many of them as give it
SHARD_BLOCKS blocks in each, one at least. A source that asks a shard for much gets blocks of BLOCK_WORDS words there, and one
that asks for little gets smaller ones, by halves down to a word, so rounding to blocks is a small part of any quota; among
the sources with equal blocks a shard's blocks go to the highest quotients of what the targets ask of it, which gives
integer quotas. A source's documents in a shard are laid end to end in a seeded order, and the quota is a cyclic run of
blocks from a seeded one: all but the two documents at the run's ends are taken whole. In the mixed corpus, where all are whole, a document is there as often as the
run passes its middle word, whose chance is the run's share of the source for documents of any length. Only one row a
source comes to the driver.

Rows that repeat one another are counted first and dealt in bundles of BUNDLE_ROWS, so no shard gets more of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from foldspark.llm.common import _SPACE, U64, map_arrow, materialise, mix64, row_chunks, text_bytes, unused_name

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK_WORDS = 64
SHARD_DOCS = 512
SHARD_BLOCKS = 64
#: What a source asks of a shard is this many of its blocks at least, as long as blocks can be halved.
FINE_BLOCKS = 512
BUNDLE_ROWS = 64
#: Copies of one row that a task writes out.
COPIES_AT_ONCE = 1024
SEED = 17


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of `[^\\x20\\x09-\\x0D]+` in each text; null: 0."""
    data, offsets = text_bytes(column)
    out = np.zeros(len(column), np.int64)
    for s, e in row_chunks(offsets):
        at = offsets[s : e + 1] - offsets[s]
        inside = ~_SPACE[data[offsets[s] : offsets[e]]]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = at[:-1][np.diff(at) > 0]
        begins[first] = inside[first]
        out[s:e] = np.diff(np.r_[0, np.cumsum(begins)][at])
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(word_counts(batch.column(3)))], names=["doc_id", "source", "key", "size"])


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> dict[str | None, float]:
    """Target of each source. Sources by code point, null last, weigh `weights`, repeating, and share the sum of sizes.

    A target stops at `most` times its source's size and the excess is shared again by weight until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, rest = list(order), float(sum(sizes.values()))
    while free:
        share = rest / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        free = [s for s in free if s not in out]
        rest = max(rest, 0.0)
    return out


def sainte_lague(claims: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients claim / (2 k + 1); ties go to the earlier claim."""
    claims = np.asarray(claims, float)
    out = np.zeros(len(claims), np.int64)
    if seats <= 0 or claims.sum() <= 0:
        return out
    some = int((claims > 0).sum())
    if seats > some / 2:  # at this divisor the rounded claims are at most the seats, and no claim loses one later
        out = np.floor(claims / (claims.sum() / (seats - some / 2)) + 0.5 - 1e-9).clip(0).astype(np.int64)
        out[claims <= 0] = 0
    heap = [(-c / (2 * k + 1), i) for i, (c, k) in enumerate(zip(claims.tolist(), out.tolist(), strict=True)) if c > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-claims[i] / (2 * out[i] + 1), i))
    return out


def block_words(claims: np.ndarray, most: int) -> np.ndarray:
    """The words in each claim's blocks: `most`, halved until the claim has FINE_BLOCKS of them or a block is a word."""
    out = np.full(len(claims), most, np.int64)
    while (large := (out > 1) & (claims < out * FINE_BLOCKS)).any():
        out[large] //= 2
    return out


def take_run(sizes: np.ndarray, quota: int, start: int) -> np.ndarray:
    """Words taken of each document when `quota` words run cyclically from word `start` of the documents laid end to end."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(sizes), np.int64)
    whole, rest = divmod(quota, total)
    ends = np.cumsum(sizes)
    begins = ends - sizes

    def overlap(a: int, b: int) -> np.ndarray:
        return (np.minimum(ends, b) - np.maximum(begins, a)).clip(0)

    return whole * sizes + overlap(start, min(start + rest, total)) + overlap(0, max(0, start + rest - total))


def passes(words: np.ndarray, total: int, quota: int, start: int) -> np.ndarray:
    """How often the run of `take_run` passes each of the given words of all `total`."""
    whole, rest = divmod(quota, total)
    return whole + ((words - start) % total < rest)


def _mix_shard(table: pa.Table, block: int, most: int, seed: int) -> pa.Table:
    """Taken words and whole copies of one shard's rows; a row of the table stands for `rows` of them."""
    rows = np.asarray(table.column("rows").combine_chunks())
    table = table.take(pa.array(np.repeat(np.arange(len(rows)), rows)))
    doc_id, source, key, words, ratio, shard = (table.column(k).combine_chunks() for k in ("doc_id", "source", "key", "size", "ratio", "shard"))
    names = sorted({s for s in source.to_pylist() if s is not None}) + ([None] if source.null_count else [])
    number = {s: k for k, s in enumerate(names)}
    code = np.array([number[s] for s in source.to_pylist()], np.int64)
    words, ratio, shard = np.asarray(words), np.asarray(ratio), int(shard[0].as_py())
    ids = np.asarray(doc_id.fill_null(-1))
    claims = np.bincount(code, weights=words * ratio, minlength=len(names))
    blocks, quotas = block_words(claims, block), np.zeros(len(names), np.int64)
    for size in np.unique(blocks).tolist():  # equal blocks compete with each other
        alike = blocks == size
        quotas[alike] = sainte_lague(claims[alike], round(claims[alike].sum() / size)) * size
    taken, copies = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for k in range(len(names)):
        at = np.flatnonzero(code == k)
        at = at[np.lexsort((words[at], ids[at], np.asarray(key)[at]))]
        size, total = words[at], int(words[at].sum())
        quota, step = int(quotas[k]), int(blocks[k])
        r = int(mix64(np.array([seed * 1_000_003 + shard * 8191 + k], U64))[0])
        run = min(quota, most * total), r % -(-total // step) * step
        taken[at] = take_run(size, *run)
        copies[at] = passes(np.cumsum(size) - size + size // 2, total, *run)
    return pa.table([doc_id, key, pa.array(words), table.column("source_size"), table.column("target"), pa.array(taken), pa.array(copies)], names=["doc_id", "key", "size", "source_size", "target", "taken", "copies"])


def _taken(docs: DataFrame, key: Column, weights: tuple[int, ...], most: int, block: int, seed: int) -> DataFrame:
    """(doc_id, key, size, source_size, target, taken, copies): a row for each document."""
    spark = docs.sparkSession
    measured = map_arrow(docs.select("doc_id", "source", key.alias("key"), "text"), _sizes, "doc_id long, source string, key long, size long")
    measured = materialise(measured, "sizes")
    stats = measured.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n")).collect()
    size = {r["source"]: int(r["size"]) for r in stats}
    goal = targets(size, weights, most)
    shards = max(1, -(-sum(r["n"] for r in stats) // SHARD_DOCS))
    spread = {s: max(1, min(shards, int(goal[s] // (SHARD_BLOCKS * block)))) for s in size}
    rows = [(s, size[s], goal[s], goal[s] / size[s] if size[s] else 0.0, spread[s]) for s in size]
    facts = spark.createDataFrame(rows, "of string, source_size long, target double, ratio double, spread long")  # a row a source

    def with_facts(rows: DataFrame) -> DataFrame:
        return rows.join(facts, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def mix_shard(table: pa.Table) -> pa.Table:
        return _mix_shard(table, block, most, seed)

    counted = measured.where("size > 0").groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n"))
    bundle = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {BUNDLE_ROWS}"))).alias("bundle")
    dealt = with_facts(counted.select("doc_id", "source", "key", "size", "n", bundle))
    dealt = dealt.withColumn("rows", F.least(F.lit(BUNDLE_ROWS), F.col("n") - F.col("bundle") * BUNDLE_ROWS))
    place = F.pmod(F.xxhash64("key", "bundle"), "spread") + F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(shards))
    out = "doc_id long, key long, size long, source_size long, target double, taken long, copies long"
    mixed = dealt.withColumn("shard", F.pmod(place, F.lit(shards))).groupBy("shard").applyInArrow(mix_shard, out)
    nothing = F.lit(0).cast("long")
    empty = with_facts(measured.where("size = 0")).select("doc_id", "key", "size", "source_size", "target", nothing.alias("taken"), nothing.alias("copies"))
    return mixed.unionByName(empty)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row for each document: (doc_id, size, source_size, target, taken).

    size is the number of words `[^\\x20\\x09-\\x0D]+`; null and empty texts have 0 and nothing of them is taken. taken is
    the number of words that the mix takes of the document, repeats counted; it never exceeds `most` times size. A null
    source is a source. Repeated rows count each, and what is taken of them together doesn't depend on their order. Equal
    hashes are ordered by doc_id and size, so reruns agree. An empty table gives no rows. Only doc_id, text and source are
    read. A text of any length is one document. The sources' names must fit in memory.
    """
    return _taken(docs, F.xxhash64(F.lit(seed), "doc_id", "text"), weights, most, block, seed).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with all its columns.

    Documents at the two ends of a shard's run, or longer than it, are taken in part; such a one counts as taken once more if
    its middle word is. So a document's expected copies are its source's target by its source's size, however long it is.
    Of rows that are the same in all columns (but maps, which have no hash), the copies are added up.
    """
    own, key, n, part = (unused_name(docs, c) for c in ("mix_key", "of_key", "copies", "part"))
    hashed = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    row = F.xxhash64(F.lit(seed), *map(_quoted, hashed))
    taken = _taken(docs, row, weights, most, block, seed)
    often = taken.where("copies > 0").groupBy("key").agg(F.sum("copies").alias("n"), F.count("*").alias("rows"))
    often = materialise(often.select(F.col("key").alias(key), F.col("n").alias(n), "rows"), "copies")
    keyed = docs.withColumn(own, row)
    on = F.col(own) == F.col(key)
    columns = list(map(_quoted, docs.columns))
    # a row a document: never to be broadcast
    single = keyed.join(often.where("rows = 1").drop("rows").hint("merge"), on).withColumn(part, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*columns)
    repeated = often.where("rows > 1").drop("rows")
    if repeated.isEmpty():
        return single
    # rows that repeat one another meet before the shuffle, and their copies are written out in parts
    once = keyed.join(repeated.hint("merge"), on, "left_semi").groupBy(own).agg(*(F.first(_quoted(c)).alias(c) for c in docs.columns))
    parts = once.join(repeated.hint("merge"), on).withColumn(part, F.explode(F.sequence(F.lit(0), F.expr(f"(`{n}` - 1) div {COPIES_AT_ONCE}"))))
    parts = parts.repartition(own, part).withColumn(part, F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES_AT_ONCE), F.col(n) - F.col(part) * COPIES_AT_ONCE))))
    return single.unionByName(parts.select(*columns))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
