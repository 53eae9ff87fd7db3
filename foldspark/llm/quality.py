"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer.

Ten heuristics vote good, bad or nothing on each whole text. They overlap and none is trusted: expectation-maximisation
estimates how accurate each is for good and for bad texts from the counts of the vote patterns of all documents (at most
3**10 rows). The posteriors of a bounded sample of SAMPLE_DOCS texts (an expected number; the choice hashes the text, and
equal texts count once) train a logistic scorer on hashed byte trigrams and the heuristics' binned measures, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import _SPACE, distinct_by_row, map_arrow, materialise, row_chunks, shingle_hashes, text_bytes, word_hashes

BITS = 16
SAMPLE_DOCS = 4000
RANKS = 1 << 62
SCALE = 20.0
EPOCHS = 4
RATE = 0.3
PENALTY = 1e-4
#: Documents whose score is below this are not kept.
THRESHOLD = 0.5

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_ASCII_LETTER = _LETTER & (_BYTES < 128)
_SYMBOL = np.isin(_BYTES, np.frombuffer(b"#$%&*|<>{}[]=~^_\\/@+", np.uint8))
_LOUD = np.isin(_BYTES, np.frombuffer(b"!?", np.uint8))
_STOP = _BYTES == ord(".")

#: Of each measure: below or above what it is bad, and within what it is good (low bad, low good, high good, high bad).
LIMITS = {
    "letters": (0.8, 0.9, 1.01, 1.02),
    "upper": (-1.0, -1.0, 0.15, 0.5),
    "symbols": (-1.0, -1.0, 0.1, 0.4),
    "lone_symbols": (-1.0, -1.0, 0.02, 0.2),
    "loud": (-1.0, -1.0, 0.1, 0.3),
    "fresh_phrases": (0.5, 0.8, 1.01, 1.02),
    "fresh_words": (0.03, 0.1, 1.01, 1.02),
    "word_length": (2.0, 3.0, 9.0, 14.0),
    "stops": (0.0005, 0.01, 0.35, 0.7),
    "words": (1.0, 20.0, 1e12, 1e13),
}


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The measures (rows x len(LIMITS)) of UTF-8 texts; a text without words has nan in most of them.

    Short texts are headings as often as not, so for them missing full stops say nothing.
    """
    rows = len(offsets) - 1

    def share(table: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(table[data])][offsets]).astype(float)

    hashes, words = word_hashes(data, offsets)
    some = np.where(words > 0, words, np.nan)
    visible = np.where(words > 0, share(~_SPACE), np.nan)
    edge = np.ones(len(data) + 2, bool)
    edge[1:-1] = _SPACE[data]
    lone = np.diff(np.r_[0, np.cumsum(_SYMBOL[data] & edge[:-2] & edge[2:])][offsets])
    phrases = [shingle_hashes(hashes, words, k) for k in (3, 1)]
    fresh = [np.bincount(distinct_by_row(*p)[0], minlength=rows) / np.where(words > 0, np.bincount(p[0], minlength=rows), np.nan) for p in phrases]
    return np.stack([share(_LETTER) / visible, share(_UPPER) / np.maximum(share(_ASCII_LETTER), 1) + 0 * some, share(_SYMBOL) / some, lone / some, share(_LOUD) / some, fresh[0], fresh[1], visible / some, np.where(words < 20, 0.005, share(_STOP) / some), words.astype(float)], 1)


def votes(m: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 none, for each measure; a measure that is missing votes bad."""
    low_bad, low_good, high_good, high_bad = np.array(list(LIMITS.values())).T
    out = np.where((m >= low_good) & (m <= high_good), 1, np.where((m < low_bad) | (m > high_bad) | np.isnan(m), 0, -1))
    return out.astype(np.int8)


def pattern(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def unpattern(code: np.ndarray, k: int = len(LIMITS)) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(k) % 3 - 1).astype(np.int8)


class WeakLabels:
    """Share of good texts and each labeller's accuracy on good and on bad ones, fitted on (votes, count) patterns.

    A heuristic for one kind of bad text sees few of the other kinds, but seldom calls a good text bad. So the accuracies
    have Beta priors that count for PRIOR_SHARE of the texts: 0.99 on good texts, 0.4 on bad ones. Without them the
    likelihood is best served by taking the kind with the most overlapping heuristics for all that is bad.
    """

    PRIOR_SHARE = 0.25
    PRIOR_MEANS = np.array([[0.4], [0.99]])

    def __init__(self, v: np.ndarray, n: np.ndarray, rounds: int = 200):
        self.prior, self.right = 0.8, np.repeat(self.PRIOR_MEANS, v.shape[1], 1)  # right[1]: on good texts, right[0]: on bad ones
        weight = self.PRIOR_SHARE * n.sum() * np.array([[0.1], [1.0]]) + 10
        voted = v >= 0
        for _ in range(rounds):
            before = self.right.copy()
            p = self.posterior(v)
            good, bad = p * n, (1 - p) * n
            agree, said = np.stack([bad @ (v == 0), good @ (v == 1)]), np.stack([bad @ voted, good @ voted])
            self.right = ((agree + weight * self.PRIOR_MEANS) / (said + weight)).clip(0.01, 0.999)
            self.prior = float((good.sum() + 8) / (n.sum() + 10))
            if np.abs(self.right - before).max() < 1e-7:
                break

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that each row's text is good."""
        log = np.log(self.prior / (1 - self.prior)) + np.where(v == 1, np.log(self.right[1] / (1 - self.right[0])), np.where(v == 0, np.log((1 - self.right[1]) / self.right[0]), 0.0)).sum(1)
        return 1 / (1 + np.exp(-log))


def features(data: np.ndarray, offsets: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the byte trigrams, one at each byte; buckets of the binned measures, rows x measures)."""
    b = np.r_[np.zeros(2, np.uint32), data.astype(np.uint32)]
    row_start = np.zeros(len(data), bool)
    row_start[offsets[:-1][np.diff(offsets) > 0]] = True
    one, two = b[1:-1].copy(), b[:-2].copy()
    one[row_start] = two[row_start] = 0
    two[1:][row_start[:-1]] = 0
    with np.errstate(over="ignore"):
        tri = ((b[2:] << np.uint32(16) | one << np.uint32(8) | two) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        bins = np.where(np.isnan(m), 99, np.floor(np.where(np.isnan(m), 0, np.minimum(np.log1p(m) * 12, 98))))
        binned = ((bins.astype(np.uint32) * np.uint32(64) + np.arange(m.shape[1], dtype=np.uint32) + np.uint32(1 << 24)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
    return tri.astype(np.int64), binned.astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch], rate: float) -> Iterator[pa.RecordBatch]:
    """Counts of vote patterns, and the features of sampled documents."""
    schema = pa.schema([("kind", pa.string()), ("pattern", pa.int64()), ("n", pa.int64()), ("rank", pa.int64()), ("buckets", pa.binary()), ("values", pa.binary())])
    counts: dict[int, int] = {}
    taken: set[int] = set()
    for batch in batches:
        rank = np.asarray(batch.column(0))
        data, offsets = text_bytes(batch.column(1))
        rows = []
        for s, e in row_chunks(offsets):
            part, at = data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]
            m = measures(part, at)
            code = pattern(votes(m))
            for c, n in zip(*np.unique(code, return_counts=True), strict=True):
                counts[int(c)] = counts.get(int(c), 0) + int(n)
            chosen = np.flatnonzero(rank[s:e] < rate * RANKS)
            if len(chosen):
                tri, binned = features(part, at, m)
                for d in chosen:
                    if int(rank[s + d]) in taken:
                        continue
                    taken.add(int(rank[s + d]))
                    g, n = np.unique(tri[at[d] : at[d + 1]], return_counts=True)
                    x = np.r_[n * (SCALE / max(1, at[d + 1] - at[d])), np.ones(binned.shape[1]), 1.0]
                    rows.append({"kind": "text", "pattern": int(code[d]), "rank": int(rank[s + d]), "buckets": np.r_[g, binned[d], 0].astype("<i4").tobytes(), "values": x.astype("<f4").tobytes()})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    yield pa.RecordBatch.from_pylist([{"kind": "votes", "pattern": c, "n": n} for c, n in counts.items()], schema=schema)


def _train(batches: Iterator[pa.RecordBatch], model: WeakLabels) -> Iterator[pa.RecordBatch]:
    """Logistic regression with per-weight step sizes on the sample's posteriors."""
    rows = sorted((r["rank"], len(r["buckets"]), r["buckets"], r["values"], r["pattern"]) for b in batches for r in b.to_pylist())
    w, grown = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    if rows:
        target = model.posterior(unpattern(np.array([r[4] for r in rows])))
        order = np.random.default_rng(11)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                g, x = np.frombuffer(rows[i][2], "<i4"), np.frombuffer(rows[i][3], "<f4").astype(float)
                grad = (1 / (1 + np.exp(-np.clip(x @ w[g], -30, 30))) - target[i]) * x + PENALTY * w[g]
                np.add.at(grown, g, grad * grad)
                np.subtract.at(w, g, RATE * grad / np.sqrt(grown[g]))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["bucket", "weight"])


def _score(batches: Iterator[pa.RecordBatch], model: WeakLabels, w: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        good, score, words = [], [], []
        for s, e in row_chunks(offsets):
            part, at = data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]
            m = measures(part, at)
            tri, binned = features(part, at, m)
            total = np.diff(np.r_[0.0, np.cumsum(w[tri])][at]) * SCALE / np.maximum(1, np.diff(at)) + w[binned].sum(1) + w[0]
            words.append(m[:, -1])
            good.append(model.posterior(votes(m)))
            score.append(1 / (1 + np.exp(-np.clip(total, -30, 30))) if w.any() else good[-1])
        good, score = (np.concatenate(x) if x else np.zeros(0) for x in (good, score))
        score = np.where(np.concatenate(words) > 0, score, 0.0) if words else score
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "weak_label", "score", "keep"])


def quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: (doc_id, weak_label, score, keep).

    weak_label is the posterior of the votes alone and score the trained scorer's probability that the text is good; keep
    says that it is `threshold` or more. A null text or one without words has score 0. Equal texts get equal scores, and
    with a scorer that learned nothing the weak labels are the scores. A score that ties with the threshold is kept. Texts are measured whole, however long. An empty table gives no rows. Only doc_id and text are read.
    """
    rank = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(RANKS))
    texts = docs.agg(F.approx_count_distinct(rank)).first()[0]  # equal ones count once, as in the sample
    gather = partial(_gather, rate=min(1.0, SAMPLE_DOCS / max(1, texts)))
    gathered = materialise(map_arrow(docs.select(rank.alias("rank"), "text"), gather, "kind string, pattern long, n long, rank long, buckets binary, values binary"), "weak-labels")
    table = gathered.where("kind = 'votes'").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    model = WeakLabels(unpattern(np.asarray(table.column(0))), np.asarray(table.column(1)).astype(float))
    sample = gathered.where("kind = 'text'").select("rank", "buckets", "values", "pattern").distinct().coalesce(1)
    fitted = map_arrow(sample, partial(_train, model=model), "bucket long, weight double").toArrow()
    w = np.zeros(1 << BITS)
    w[np.asarray(fitted.column(0))] = np.asarray(fitted.column(1))
    return map_arrow(docs.select("doc_id", "text"), partial(_score, model=model, w=w, threshold=threshold), "doc_id long, weak_label double, score double, keep boolean")
