"""MinHash near-duplicate detection: SuperMinHash signatures, banding, exact verification, distributed union-find.

Documents with one and the same shingle set are one class, and one document of a class goes on. Classes that
share a band bucket are candidates. Inside a bucket the classes are first held against one hub, which settles most of a
group of thousands of near copies with as many pairs as it has members. Members of one bucket that the links so far leave
in different components are then compared with each other: as pairs in small buckets, and in large ones block against
block inside a task, which counts common shingles of the full sets and gives out no more links than join its components.
The pairs of rows are confirmed on the full shingle sets as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import U64, connected_components, distinct_by_row, map_arrow, materialise, mix64, release, row_chunks, shingle_hashes, text_bytes, unused_name, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 75  # per cent of the union
SLOTS = 128
BANDS = 32  # of 4 slots: a pair at 0.75 shares no band with probability 5e-6
SMALL_BUCKET = 32  # members of a bucket that are compared as pairs of rows
BLOCK_MEMBERS = 512
BLOCK_ITEMS = 1 << 18  # shingles that a block is meant to hold
COLUMNS = 4096
_GOLDEN = U64(0x9E3779B97F4A7C15)


def super_minhash(row: np.ndarray, h: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (rows x slots) of distinct element hashes h that belong to ascending rows.

    Every element draws a random permutation of the slots and, at step j, offers j + r to the slot that the permutation
    names j-th. The ranks of one element are thus correlated over the slots, which lowers the variance. Step j offers
    nothing below j, so a row stops as soon as all its slots are below the next step. Empty rows stay infinite.
    """
    sig = np.full((rows, slots), np.inf)
    flat = sig.reshape(-1)
    row, h = row.copy(), h.copy()
    perm = None
    for j in range(slots):
        z = mix64(h + U64((2 * j + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        rank = (z >> U64(11)).astype(np.float64) * 2.0**-53 + j
        k = j + ((mix64(z) >> U64(32)) * U64(slots - j) >> U64(32)).astype(np.int64)
        at = np.arange(len(h))
        slot = k if perm is None else perm[at, k].astype(np.int64)
        np.minimum.at(flat, row * slots + slot, rank)
        if j + 1 == slots:
            break
        open_rows = sig.max(1) > j + 1
        keep = open_rows[row]
        if not keep.any():
            break
        if perm is None:
            perm = np.empty((int(keep.sum()), slots), np.uint8 if slots <= 256 else np.int32)
            perm[:] = np.arange(slots)
            k, slot = k[keep], slot[keep]
            at = np.arange(len(k))
            perm[at, k], perm[at, 0] = 0, slot
            row, h = row[keep], h[keep]
        else:
            perm[at, k], perm[at, j] = perm[:, j].copy(), slot
            if keep.sum() < 0.8 * len(keep):
                perm, row, h = perm[keep], row[keep], h[keep]
    return sig


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit bucket a band for each signature; the band's number is part of the bucket."""
    bits = sig.view(U64).reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * _GOLDEN, bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        out = mix64(out * _GOLDEN + bits[:, :, k])
    return out


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row inside the chunk, distinct shingle hash) chunk by chunk."""
    data, offsets = text_bytes(column)
    for at, end in row_chunks(offsets):
        words, counts = word_hashes(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        yield (at, end, *distinct_by_row(*shingle_hashes(words, counts, width)))


_SIGNATURE = "doc_id long, row_hash long, n long, digest binary, bands array<long>"


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Size, digest and band buckets of each text's shingle set. Equal digests (128 bits of BLAKE2 over all shingles in
    order) stand for equal sets."""
    for batch in batches:
        for at, end, row, h in _sets(batch.column(2), width):
            cuts = np.searchsorted(row, np.arange(end - at + 1))
            digests = [hashlib.blake2b(h[s:e].tobytes(), digest_size=16).digest() for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            bands = band_hashes(super_minhash(row, h, end - at)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, end - at),
                    batch.column(1).slice(at, end - at),
                    pa.array(np.diff(cuts)),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), pa.array(bands.ravel())),
                ],
                names=["doc_id", "row_hash", "n", "digest", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, row, h in _sets(batch.column(1), width):
            cuts = np.searchsorted(row, np.arange(end - at + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h.view(np.int64)))], names=["node", "shingles"])


def _compare_blocks(table: pa.Table, similarity: int) -> pa.Table:
    """Links that join different components, between two blocks of a bucket or within one; counted on the full sets."""
    node, n, component, block = (np.asarray(table.column(k).combine_chunks()) for k in ("node", "n", "component", "block"))
    first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
    sides = [np.flatnonzero(block == k) for k in (first, second)]
    found: list[tuple[int, int]] = []
    if len(np.unique(component)) > 1 and all(map(len, sides)):
        flat = [table.column("shingles").take(pa.array(side)).combine_chunks() for side in sides]
        value = [np.asarray(f.flatten()) for f in flat]
        owner = [np.repeat(np.arange(len(side)), n[side]) for side in sides]
        common = np.intersect1d(*value)
        for k in range(2):  # only what both sides have can count
            place = np.searchsorted(common, value[k]).clip(0, max(0, len(common) - 1))
            held = common[place] == value[k] if len(common) else np.zeros(len(place), bool)
            value[k], owner[k] = place[held], owner[k][held]
        both = np.zeros((len(sides[0]), len(sides[1])))
        for at in range(0, len(common), COLUMNS):
            a, b = (np.zeros((len(side), min(COLUMNS, len(common) - at)), np.float32) for side in sides)
            for m, p, o in zip((a, b), value, owner, strict=True):
                k = np.flatnonzero((p >= at) & (p < at + COLUMNS))
                m[o[k], p[k] - at] = 1
            both += a @ b.T
        x, y = sides
        link = (100 * both >= similarity * (n[x][:, None] + n[y][None] - both)) & (component[x][:, None] != component[y][None])
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        for i, j in zip(*np.nonzero(link), strict=True):
            c, d = find(int(component[x[i]])), find(int(component[y[j]]))
            if c != d:
                root[max(c, d)] = min(c, d)
                found.append((int(node[x[i]]), int(node[y[j]])))
    return pa.table({"a": pa.array([max(f) for f in found], pa.int64()), "b": pa.array([min(f) for f in found], pa.int64())})


def _verify(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b, ok) of candidate pairs (a, b), from the full sets."""
    left = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a")
    both = left.join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    common = F.size(F.array_intersect("x", "y"))
    counted = both.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), common.alias("common"))
    return materialise(counted.select("a", "b", (100 * F.col("common") >= similarity * (F.col("sizes") - F.col("common"))).alias("ok")), "verified")


def _row_hash() -> Column:
    return F.xxhash64("text")


def _grouped(docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """(doc_id, row_hash, n, component): component numbers the group and is null for a row that links with nothing.

    Rows are told apart by doc_id and text, so a doc_id that occurs with two texts is two documents here.
    """
    texts = docs.select("doc_id", _row_hash().alias("row_hash"), "text")
    sigs = materialise(map_arrow(texts, partial(_signatures, width=width), _SIGNATURE), "signatures")
    usable = sigs.where("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "row_hash")).alias("first")
    each = usable.groupBy("n", "digest").agg(first, F.first("bands").alias("bands"))  # equal sets have equal bands
    # written once, so the numbers stay
    classes = materialise(each.select("n", "digest", "first.doc_id", "first.row_hash", "bands", F.monotonically_increasing_id().alias("node")), "classes")
    placed = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"), F.sum("n").alias("items")).where("low < high").drop("high")
    members = materialise(placed.join(shared, "bucket"), "members")

    wanted = classes.select("doc_id", "row_hash", "node").join(members.select("node").distinct(), "node", "left_semi").hint("merge")
    once = texts.groupBy("doc_id", "row_hash").agg(F.first("text").alias("text"))  # repeated rows meet before the shuffle
    needed = once.join(wanted, ["doc_id", "row_hash"]).select("node", "text")
    sets = materialise(map_arrow(needed, partial(_full_sets, width=width), "node long, shingles array<long>"), "sets")

    stars = members.where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    tried = _verify(stars, sets, similarity)
    component = materialise(connected_components(tried.where("ok").select("a", "b")), "components")

    at = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    torn = at.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("bucket")
    at = materialise(at.join(torn, "bucket").select("bucket", "size", "items", "node", "n", "component"), "torn")
    small = at.where(F.col("size") <= SMALL_BUCKET)
    other = small.select("bucket", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
    comparable = F.least("n", "m") * 100 >= F.greatest("n", "m") * similarity
    apart = small.join(other, "bucket").where(F.expr("node > b and component <> other") & comparable).select(F.col("node").alias("a"), "b").distinct()
    apart = apart.join(tried.select("a", "b"), ["a", "b"], "left_anti")

    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_MEMBERS, F.col("items") / BLOCK_ITEMS)).cast("int")
    large = at.where(F.col("size") > SMALL_BUCKET).withColumn("blocks", blocks)
    large = large.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(sets, "node")
    dealt = large.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("block", "partner").alias("first"), F.greatest("block", "partner").alias("second"), "block", "node", "n", "component", "shingles")

    def compare_blocks(table: pa.Table) -> pa.Table:
        return _compare_blocks(table, similarity)

    found = materialise(dealt.groupBy("bucket", "first", "second").applyInArrow(compare_blocks, "a long, b long").distinct(), "block-links")
    fresh = materialise(_verify(apart, sets, similarity).where("ok").select("a", "b").union(found), "links")
    if not fresh.isEmpty():
        known = component.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        component = materialise(connected_components(known.union(fresh)), "components")
    release(sets)
    known = classes.select("n", "digest", "node").join(component, "node", "left").select("n", "digest", F.coalesce("component", "node").alias("component"))
    linked = usable.join(known, ["n", "digest"]).select("doc_id", "row_hash", "n", "component")
    alone = sigs.where("n = 0 or doc_id is null").select("doc_id", "row_hash", "n", F.lit(None).cast("long").alias("component"))
    return linked.union(alone)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row for each document: (doc_id, n_shingles, component_id, kept).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set has its distinct shingles of `width` words,
    or its whole word sequence if it has fewer words. Documents are linked when 100 * intersection >= similarity * union.
    component_id is the smallest doc_id that links reach and kept says that it is the document's own. A null text or one
    without words has n_shingles 0 and links with nothing, and so does a row without doc_id (its component_id is null).
    Rows with one doc_id and different texts are documents of their own, each in the group of its text. Repeated rows
    each get the same result; an empty table gives no rows. Only doc_id and text are read. A text is hashed whole,
    however long it is.
    """
    rows = materialise(_grouped(docs, width, similarity), "grouped")
    smallest = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    out = rows.join(smallest, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = SHINGLE_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one with the smallest doc_id, and of several
    texts with that doc_id the one whose hash is smallest. Of rows that repeat doc_id and text, any one stays. Documents
    without doc_id, text or words all stay."""
    rows = materialise(_grouped(docs, width, similarity).where("component is not null"), "grouped")
    place = F.struct("doc_id", "row_hash")
    groups = rows.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("rows"), F.count_distinct(place).alias("documents"))
    groups = materialise(groups.where("rows > 1"), "groups")
    mine, of_id, of_row = (unused_name(docs, c) for c in ("row_hash", "of_id", "of_row"))
    hashed = docs.withColumn(mine, _row_hash())
    on = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(mine) == F.col(of_row))

    def named(which: DataFrame) -> DataFrame:
        # a row a document, so without a bound: never to be broadcast
        return which.select(F.col("doc_id").alias(of_id), F.col("row_hash").alias(of_row)).distinct().hint("merge")

    gone = rows.join(groups, "component").where(place != F.col("first"))
    out = hashed.join(named(gone), on, "left_anti")
    repeated = groups.where("rows > documents").join(rows, "component").where(place == F.col("first")).groupBy("doc_id", "row_hash").count().where("count > 1")
    if not repeated.isEmpty():
        once = hashed.join(named(repeated), on, "left_semi").dropDuplicates(["doc_id", mine])
        out = out.join(named(repeated), on, "left_anti").union(once)
    return out.select(*docs.columns)
