"""Byte-level BPE over length-bucketed numpy matrices, and the exact way back.

A task splits whole texts into pieces, merges each distinct piece once and keeps its ids for the task's later texts, up
to a bound. Distinct pieces are put into matrices of about equal length, one piece a row. Each round looks up the rank of
every adjacent pair in a hash table, merges the leftmost lowest-ranked pair of every row, and compacts the row; rows
without a mergeable pair leave the matrix. A piece of more than LONG_BYTES is a matrix of its own: its row is wrapped into
blocks, each with its lowest rank, and a round looks at the blocks' lowest ranks and compacts one block only.
"""

from __future__ import annotations

import base64
import hashlib
import math
import sys
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foldspark.llm.common import Memo, map_arrow, row_chunks, text_bytes

#: Distinct pieces whose ids a worker keeps.
MEMO_PIECES = 300_000
#: Bytes beyond which a piece is merged in blocks.
LONG_BYTES = 2048
#: Cells of one padded matrix.
MATRIX_CELLS = 1 << 18
_NONE = np.int32(1 << 30)


class PairTable:
    """Open-addressing hash table from a pair of ids to (rank of the merge), as two numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(rank) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        key, todo = left.astype(np.int64) << 32 | right, np.arange(len(rank))
        at = self._home(key)
        while len(todo):  # each round one newcomer takes a free cell, the others step on
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.ranks[at[won]] = key[todo[won]], rank[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], at[rest] + 1 & (1 << self.bits) - 1
        runs = np.diff(np.flatnonzero(np.r_[True, self.keys < 0, True]))
        self.probes = int(runs.max())

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above every rank."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._home(key)
        out = np.where(self.keys[at] == key, self.ranks[at], _NONE)
        miss = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(miss):
                break
            at[miss] = at[miss] + 1 & (1 << self.bits) - 1
            there = self.keys[at[miss]]
            hit = there == key[miss]
            out[miss[hit]] = self.ranks[at[miss[hit]]]
            miss = miss[~hit & (there >= 0)]
        return out


class ByteBpe:
    """A byte-level BPE vocabulary: token bytes by rank, ids being ranks."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        # Every way to cut a token into two tokens is a pair that may merge into it.
        pairs = [(self.rank[t[:k]], self.rank[t[k:]], i) for t, i in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        self.pairs = PairTable(*np.array(pairs, np.int64).T.reshape(3, -1))
        self.memo = Memo(MEMO_PIECES)  # ids as 32-bit integers
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.r_[0, np.cumsum(self.lengths)]

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by merging the leftmost lowest-ranked pair of every piece round by round."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        for k in np.flatnonzero(size > LONG_BYTES):
            out[k] = self._merge_blocks(pieces[k])
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= LONG_BYTES]
        at = int(np.searchsorted(size[order], 1))
        while at < len(order):
            width = int(size[order[at]])
            end = at + 1
            while end < len(order) and size[order[end]] <= max(width * 5 // 4, width + 1) and (end - at + 1) * size[order[end]] <= MATRIX_CELLS:
                end += 1
            self._merge_bucket(pieces, order[at:end], int(size[order[end - 1]]), out)
            at = end
        return out

    def _merge_bucket(self, pieces: list[bytes], which: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        n = np.array([len(pieces[i]) for i in which], np.int64)
        ids = np.full((len(which), width), -1, np.int32)
        cells = np.arange(width) < n[:, None]
        ids[cells] = self.byte_id[np.frombuffer(b"".join(pieces[i] for i in which), np.uint8)]
        ranks = self._ranks(ids, n)
        while len(which):
            rows = np.arange(len(which))
            best = ranks.argmin(1)
            low = ranks[rows, best]
            done = low == _NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[which[r]] = ids[r, : n[r]].copy()
                go = ~done
                which, n, best, low = which[go], n[go], best[go], low[go]
                if not len(which):
                    break
                ids, ranks = ids[go, : n.max()], ranks[go, : n.max()]
                rows = np.arange(len(which))
            # compact: what stands right of the merged pair moves one to the left
            col = np.arange(ids.shape[1])
            col = np.minimum(col + (col > best[:, None]), ids.shape[1] - 1)
            ids, ranks = np.take_along_axis(ids, col, 1), np.take_along_axis(ranks, col, 1)
            n = n - 1
            ids[rows, best] = low
            ranks[rows, n - 1] = _NONE  # the last id begins no pair
            for side in (best - 1, best):  # only the two pairs around the merged one change
                ok = (side >= 0) & (side + 1 < n)
                ranks[rows[ok], side[ok]] = self.pairs.get(ids[rows[ok], side[ok]], ids[rows[ok], side[ok] + 1])

    def _ranks(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        ranks = np.full((len(ids), ids.shape[1]), _NONE, np.int32)
        there = np.arange(1, ids.shape[1]) < n[:, None]
        left, right = ids[:, :-1][there], ids[:, 1:][there]
        inner = ranks[:, :-1]
        inner[there] = self.pairs.get(left, right)
        return ranks

    def _merge_blocks(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the same rounds over a row that is wrapped into about as many blocks as a block has cells."""
        tokens, rank = self.tokens, self.rank
        row = self.byte_id[np.frombuffer(piece, np.uint8)]
        while True:
            width = max(32, math.isqrt(len(row)))
            count = [min(width, len(row) - at) for at in range(0, len(row), width)]
            ids, ranks = np.full((len(count), width), -1, np.int32), np.full(len(count) * width, _NONE, np.int32)
            ids.reshape(-1)[: len(row)] = row
            ranks[: len(row) - 1] = self.pairs.get(row[:-1], row[1:])
            ranks = ranks.reshape(ids.shape)
            low = ranks.min(1)
            for _ in range(len(row) // 2):
                b = int(low.argmin())
                new = int(low[b])
                if new == _NONE:
                    return np.concatenate([x[:n] for x, n in zip(ids, count, strict=True)])
                k = int(ranks[b].argmin())
                # compact: the pair's second cell goes, which may be the first one of the next block with cells
                c, gone = b, k + 1
                if gone == count[b]:
                    c, gone = next(i for i in range(b + 1, len(count)) if count[i]), 0
                n = count[c] = count[c] - 1
                ids[c, gone:n], ranks[c, gone:n] = ids[c, gone + 1 : n + 1], ranks[c, gone + 1 : n + 1]
                ranks[c, n] = _NONE
                ids[b, k] = new
                # only the two pairs around the merged one change
                after = int(ids[b, k + 1]) if k + 1 < count[b] else next((int(ids[i, 0]) for i in range(b + 1, len(count)) if count[i]), None)
                ranks[b, k] = _NONE if after is None else rank.get(tokens[new] + tokens[after], _NONE)
                p, q = (b, k - 1) if k else next(((i, count[i] - 1) for i in range(b - 1, -1, -1) if count[i]), (-1, 0))
                if p >= 0:
                    ranks[p, q] = rank.get(tokens[ids[p, q]] + tokens[new], _NONE)
                for i in {b, c, p} - {-1}:
                    low[i] = ranks[i].min()
            row = np.concatenate([x[:n] for x, n in zip(ids, count, strict=True)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (32 bits) of each whole text; null is empty."""
        split = [self.split(t) if t else [] for t in texts]
        fresh = self.memo.missing(set(chain.from_iterable(split)))
        memo, known = self.memo.new, self.rank
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        whole = [known.get(b) for b in raw]  # a piece that is a token is its own encoding
        for p, i in zip(fresh, whole, strict=True):
            if i is not None:
                memo[p] = i.to_bytes(4, sys.byteorder)
        rest = [k for k, i in enumerate(whole) if i is None]
        for k, ids in zip(rest, self.merge([raw[k] for k in rest]), strict=True):
            memo[fresh[k]] = ids.astype(np.int32).tobytes()
        return [np.frombuffer(b"".join(map(memo.__getitem__, pieces)), np.int32) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        size = self.lengths[ids]
        if not len(ids):
            return b""
        ends = np.cumsum(size)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - size), size)].tobytes()


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank from a rank file (lines of base64 and rank)."""
    with open(path, "rb") as f:
        rows = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f) if a)
    return [t for _, t in rows]


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """The vocabulary of a rank file, once in a worker. The file is part of an installed package on every machine."""
    return ByteBpe(read_ranks(path), pattern)


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encodings(batches: Iterator[pa.RecordBatch], bpe: ByteBpe) -> Iterator[tuple[pa.RecordBatch, list[str | None], list[np.ndarray]]]:
    """(rows, texts, ids) of some texts after the other, with a bound on their bytes."""
    for batch in batches:
        for at, end in row_chunks(text_bytes(batch.column(1))[1]):
            part = batch.slice(at, end - at)
            texts = part.column(1).to_pylist()
            yield part, texts, bpe.encode(texts)


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    for part, _, ids in _encodings(batches, bpe):
        size = pa.array([len(x) for x in ids], pa.int64())
        digests = [pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()) for rows in ((x.astype("<u4").tobytes() for x in ids), map(bpe.decode, ids))]
        yield pa.RecordBatch.from_arrays([part.column(0), size, *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for part, _, ids in _encodings(batches, load(path, pattern)):
        yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], names=["doc_id", "ids"])


def _checked(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    for part, texts, ids in _encodings(batches, bpe):
        for t, x in zip(texts, ids, strict=True):
            if bpe.decode(x) != (t or "").encode("utf-8", "surrogatepass"):
                raise ValueError("the ids of a text do not decode to it")
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), _lists(ids)], names=["doc_id", "n_tokens", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    for batch in batches:
        rows = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "data"])


def default_vocabulary() -> tuple[str, str]:
    """Path of the public 50k rank file and the pattern that splits texts for it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _with_vocabulary(docs: DataFrame, step, schema: str, path: str | None, pattern: str | None) -> DataFrame:
    known = default_vocabulary()
    return map_arrow(docs, partial(step, path=path or known[0], pattern=pattern or known[1]), schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every whole text, without special tokens; a null text has no ids."""
    return _with_vocabulary(docs.select("doc_id", "text"), _encoded, "doc_id long, ids array<int>", path, pattern)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, data): the bytes of (doc_id, ids) rows; null or no ids give no bytes."""
    return _with_vocabulary(encoded.select("doc_id", "ids"), _decoded, "doc_id long, data binary", path, pattern)


def encode_checked(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text, each decoded again and compared with its text."""
    return _with_vocabulary(docs.select("doc_id", "text"), _checked, "doc_id long, n_tokens long, ids array<int>", path, pattern)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each document: (doc_id, n_tokens, ids_sha256, decoded_sha256), encoded and decoded again.

    ids are digested as little-endian unsigned 32-bit integers, the decoded bytes as they are. A null text is empty; rows
    are independent, so repeated rows repeat their results; an empty table gives no rows. Only doc_id and text are read. A
    text, or a piece of one, may be of any length; the task that has it holds it as a whole.
    """
    return _with_vocabulary(docs.select("doc_id", "text"), _round_trip, _SCHEMA, path, pattern)
