"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes, and links between them.

A text, with a space before it, is encoded by a byte-level BPE (A) and by a BPE with byte fallback that adds the space
itself (B). The cumulative ends of both id lists go into dictionaries from end to index; the sorted common keys slice the
lists into groups, and each slice is expanded into its links: the pairs of tokens that end together.

Both vocabularies end a token before a space that stands between two plain characters, so the text there is cut into units,
and a unit is encoded and aligned once for all its occurrences that a worker sees, as long as it is remembered. With a
vocabulary for which that doesn't hold, the unit is the whole text.

Corpus counts need no row a link: the texts of a task form blocks, whose links are counted before the shuffle; the counts of
the whole corpus come back as one dictionary a block and meet the block's documents there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import Memo, map_arrow, materialise, row_chunks, text_bytes

#: Distinct units whose alignment a worker keeps.
MEMO_UNITS = 300_000
#: Bytes of text in a block, whose links are counted together; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Units that the libraries get at a time.
UNITS_AT_ONCE = 4096
#: Characters that are neither white space nor changed together with a neighbour by any Unicode normal form.
PLAIN = "[!-~À-ɏЀ-҂Ҋ-ӿ]"

def common_ends(sizes_a: Iterable[int], sizes_b: Iterable[int]) -> list[tuple[int, int]]:
    """For each byte offset where a token of A and one of B end: how many tokens of A and of B end up to there."""
    ends_a, ends_b = dict(zip(accumulate(sizes_a), count(1))), dict(zip(accumulate(sizes_b), count(1)))
    return [(ends_a[end], ends_b[end]) for end in sorted(ends_a.keys() & ends_b.keys())]


def links(sizes_a: list[int], sizes_b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places in a group's slices whose tokens end together: the last ones, and before tokens without bytes also those."""
    p, q = len(sizes_a) - 1, len(sizes_b) - 1
    while p and not sizes_a[p]:
        p -= 1
    while q and not sizes_b[q]:
        q -= 1
    return [(x, y) for x in range(p, len(sizes_a)) for y in range(q, len(sizes_b))]


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Tokens:
    """The bytes of a vocabulary's tokens, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([*map(len, tokens)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: list[list[int]], size: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Whether each list of ids spells its own part of `data`, the parts having these sizes."""
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        sizes = self.sizes[flat]
        row = np.repeat(np.arange(len(ids)), [*map(len, ids)])
        got = np.bincount(row, sizes, minlength=len(ids)).astype(np.int64)
        ok = got == size
        flat, sizes, row = flat[ok[row]], sizes[ok[row]], row[ok[row]]
        ends = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts[flat] - (ends - sizes), sizes)
        differ = self.bytes[at] != data[np.repeat(ok, size)]
        ok[np.repeat(row, sizes)[differ]] = False
        return ok


class Aligner:
    """Two vocabularies, and the units of text that they have aligned."""

    def __init__(self, path_a: str, path_b: str, units: int = MEMO_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = _Tokens(self.bytes_a), _Tokens(self.bytes_b)
        self.size_a, self.size_b = self.a_bytes.sizes.tolist(), self.b_bytes.sizes.tolist()
        self.text_a, self.text_b = [str(i) for i in range(len(self.bytes_a))], [f"|{i}" for i in range(len(self.bytes_b))]
        self.bare = not all(self.size_a) or not all(self.size_b)  # is there a token without bytes?
        cut = spec["pre_tokenizer"] or {}
        by_space = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and spec["normalizer"] is None and spec["post_processor"] is None
        by_space = by_space and all(p is None for p in (spec["truncation"], spec["padding"])) and not spec["model"].get("dropout")
        if by_space and not any("▁" in p.lstrip("▁") for p in pieces):
            self.split = re.compile(f" (?={PLAIN})(?<={PLAIN} )").split
        else:
            self.split = lambda text: [text]
        self.memo = Memo(units)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each unit by both vocabularies, a space before it counted in."""
        return [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)], self.b.encode(units, num_threads=1) if units else []

    def align(self, ids_a: list[int], ids_b: list[int]) -> tuple[int, int, int, str, bytes]:
        """(tokens of A, of B, groups, the groups as text, links as 64-bit pairs)."""
        sizes_a, sizes_b, text_a, text_b = self.size_a, self.size_b, self.text_a, self.text_b
        text, pairs = [], []
        i = j = 0
        for k, m in common_ends(map(sizes_a.__getitem__, ids_a), map(sizes_b.__getitem__, ids_b)):
            if k == i + 1 and m == j + 1:
                text.append(text_a[ids_a[i]] + text_b[ids_b[j]])
            else:
                text.append(f"{','.join([text_a[x] for x in ids_a[i:k]])}|{','.join([text_b[x][1:] for x in ids_b[j:m]])}")
            if self.bare:
                pairs += [ids_a[i + x] << 32 | ids_b[j + y] for x, y in links([sizes_a[x] for x in ids_a[i:k]], [sizes_b[x] for x in ids_b[j:m]])]
            else:
                pairs.append(ids_a[k - 1] << 32 | ids_b[m - 1])
            i, j = k, m
        return len(ids_a), len(ids_b), len(text), ";".join(text), array("q", pairs).tobytes()

    def faithful(self, ids_a: list[list[int]], ids_b: list[list[int]], raw: list[bytes]) -> np.ndarray:
        """Whether the bytes of each unit's tokens are its own, by both vocabularies."""
        size = np.array([*map(len, raw)], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        return self.a_bytes.spell(ids_a, size, data) & self.b_bytes.spell(ids_b, size, data)

    def aligned(self, texts: list[str | None]) -> list[list[tuple]]:
        """The aligned units of each text, in turn; none for a text that has no tokens."""
        split = [self.split(t) if t else [] for t in texts]
        fresh = self.memo.missing(set(chain.from_iterable(split)))
        known = self.memo.new
        for at in range(0, len(fresh), UNITS_AT_ONCE):
            some = fresh[at : at + UNITS_AT_ONCE]
            a, b = self.encode(some)
            for u, x, y, same in zip(some, a, b, self.faithful(a, b, [b" " + u.encode() for u in some]).tolist(), strict=True):
                known[u] = self.align(x, y) if same else None
        out = []
        for text, units in zip(texts, split, strict=True):
            rows = [known[u] for u in units]
            if None in rows:  # then the text as a whole decides
                a, b = (list(chain.from_iterable(ids)) for ids in self.encode(units))
                rows = [self.align(a, b)] if self.faithful([a], [b], [b" " + text.encode()])[0] else []
            out.append(rows)
        return out


@lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> Aligner:
    """Both vocabularies, once in a worker. The files are part of an installed package on every machine."""
    return Aligner(path_a, path_b)


def default_vocabularies() -> tuple[str, str]:
    """Paths of the public byte-level and byte-fallback vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- groups of each text

_GROUPS = "doc_id long, groups array<struct<ids_a: array<int>, ids_b: array<int>>>"


def _grouped(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    aligner = load(path_a, path_b)
    kind = pa.list_(pa.struct([("ids_a", pa.list_(pa.int32())), ("ids_b", pa.list_(pa.int32()))]))
    for batch in batches:
        for at, end in row_chunks(text_bytes(batch.column(1))[1]):
            part = batch.slice(at, end - at)
            rows = [[dict(zip(("ids_a", "ids_b"), ([*map(int, ids.split(","))] for ids in g.split("|")), strict=True)) for u in units for g in u[3].split(";")] for units in aligner.aligned(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "groups"])


def groups(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, groups) of every whole text: the ids of each group by both vocabularies, in order; none without tokens."""
    a, b = paths or default_vocabularies()
    return map_arrow(docs.select("doc_id", "text"), partial(_grouped, path_a=a, path_b=b), _GROUPS)


# ---------------------------------------------------------------- blocks of texts and their links

_BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, codes binary, code int, a int, b int, n long"
_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_KINDS = [_TYPES[c.split()[1]] for c in _BLOCKS.split(", ")]


def _rows(**columns) -> pa.RecordBatch:
    """A batch with the given columns; the others are null."""
    n = len(columns["block"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def _width(entries: int) -> str:
    return "<u2" if entries <= 1 << 16 else "<u4"


def _blocked(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """Rows of documents, whose links are codes, and rows of each block's dictionary (code, pair, number of links)."""
    aligner, task = load(path_a, path_b), TaskContext.get().partitionId()
    held: list[tuple] = []
    size = number = 0

    def finish() -> Iterator[pa.RecordBatch]:
        block = task << 32 | number
        pairs, code, n = np.unique(np.frombuffer(b"".join(h[5] for h in held), np.int64), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent pairs get small codes
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[code].astype(_width(len(pairs)))
        ends = np.cumsum([0, *(len(h[5]) // 8 for h in held)])
        codes = [code[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
        yield _rows(block=[block] * len(held), **{c: [h[k] for h in held] for k, c in enumerate(("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"))}, n_links=np.diff(ends), codes=codes)
        pairs, n = pairs[order], n[order]
        yield _rows(block=np.full(len(pairs), block), code=np.arange(len(pairs), dtype=np.int32), a=(pairs >> 32).astype(np.int32), b=(pairs & 0xFFFFFFFF).astype(np.int32), n=n)

    for batch in batches:
        offsets = text_bytes(batch.column(1))[1]
        for at, end in row_chunks(offsets):
            more = int(offsets[end] - offsets[at])
            if held and size + more > BLOCK_BYTES:
                yield from finish()
                held, size, number = [], 0, number + 1
            part = batch.slice(at, end - at)
            for doc_id, units in zip(part.column(0).to_pylist(), aligner.aligned(part.column(1).to_pylist()), strict=True):
                n_a, n_b, n_groups, text, pairs = zip(*units, strict=True) if units else ((),) * 5
                held.append((doc_id, sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(";".join(text).encode()).hexdigest() if units else "", b"".join(pairs)))
            size += more
    if held:
        yield from finish()


def _blocks(docs: DataFrame, paths: tuple[str, str] | None) -> DataFrame:
    a, b = paths or default_vocabularies()
    return materialise(map_arrow(docs.select("doc_id", "text"), partial(_blocked, path_a=a, path_b=b), _BLOCKS), "token-links")


def _counted(blocks: DataFrame) -> DataFrame:
    counts = blocks.where("code is not null").groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(a, b, count, best): how many links of all documents hold each id pair, and whether that is the most of its B id."""
    return _counted(_blocks(docs, paths))


_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
    """Sums of the corpus counts over the links of one block's documents."""
    code = dictionary.column("code").to_numpy()
    count, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    count[code], best[code] = dictionary.column("count").to_numpy(), dictionary.column("best").to_numpy().astype(np.int64)
    n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
    for k, raw in enumerate(docs.column("codes")):
        own = np.frombuffer(raw.as_buffer(), _width(len(code)))
        n_best[k], count_sum[k] = best[own].sum(), count[own].sum()
    done = docs.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
    return done.select([c.split()[0] for c in _SCORED.split(", ")])


def score(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row for each document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    n_a and n_b count tokens, n_groups the groups, n_links the pairs of occurrences that end together; n_best counts the links
    whose id pair is the most frequent of its B id in all documents (ties included), count_sum adds up the links' counts.
    groups_sha256 digests the groups as `a1,a2|b1;a3|b2,b3`. A text that is null, empty or not given back byte by byte by
    both vocabularies has no tokens: zeros and ''. Special tokens' strings are plain text. Rows are independent, so repeated
    rows repeat their results and count in the corpus each time; an empty table gives no rows. Only doc_id and text are
    read. A text of any length is held whole by the task that has it.
    """
    blocks = _blocks(docs, paths)
    pairs = blocks.where("code is not null").select("block", "code", "a", "b")
    dictionary = pairs.join(_counted(blocks), ["a", "b"]).select("block", "code", "count", "best")
    rows = blocks.where("code is null").select(F.col("block").alias("own_block"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes")
    return rows.groupBy("own_block").cogroup(dictionary.groupBy("block")).applyInArrow(_score, _SCORED)
