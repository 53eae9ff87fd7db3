"""Language ID: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL, temperature-calibrated.

Text becomes lower-case words between single spaces; its 1- to 3-grams of characters are hashed. A feature is the n-gram's
count times its inverse document frequency, over the text's sum of these. Follow-the-regularised-leader (proximal) with an
L1 and an L2 penalty leaves most weights at zero. A temperature, fitted on training rows that the weights never saw, turns
the scores into probabilities.

Document frequencies come from all rows that may be learned from. The weights are fitted by one task on a bounded sample
of SAMPLE_PER_LANGUAGE texts a language (an expected number; the choice hashes the text, and equal texts count once).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import map_arrow, materialise

BITS = 17
SAMPLE_PER_LANGUAGE = 400
RANKS = 1 << 62
CHUNK_CHARS = 1 << 18
SCALE = 30.0  # features of a text sum to this
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
#: The pipeline rejects documents whose calibrated score is below this.
MIN_SCORE = 0.4


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it part of a word (letter or mark), is it a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    return letter | np.array([k == "M" for k in kinds]), letter


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, grams, has_letter, starts) of all texts' characters.

    doc[i] is the text of character i and grams[k - 1, i] the bucket of the k-gram that ends there (0: none). has_letter
    says which texts have a letter; starts[d] is text d's first character.
    """
    word, letter = _classes()
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 1 for t in low])
    cps = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(size)
    has_letter = np.add.reduceat(letter[cps], ends - size) > 0
    inside = word[cps]
    take = inside.copy()
    take[1:] |= inside[:-1]  # of white space and marks between words, the first character stays, as a space
    x = np.where(inside, cps, 32)[take].astype(np.uint32)
    doc = np.repeat(np.arange(len(low)), size)[take]
    pad = np.r_[np.full(2, 32, np.uint32), x]
    a, b = pad[1:-1], pad[:-2]
    space, shift = x == 32, np.uint32(32 - BITS)
    with np.errstate(over="ignore"):
        one = x * np.uint32(0x9E3779B1)
        two = (one ^ (a + np.uint32(1)) * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
        three = (two ^ (b + np.uint32(1)) * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
        grams = np.stack([one * np.uint32(0x7FEB352D) >> shift, two >> shift, three >> shift]).astype(np.int64)
    np.maximum(grams, 1, out=grams)
    grams[0, space] = 0
    grams[2, a == 32] = 0  # nothing spans two words, nor two texts
    grams[1, space & (a == 32)] = 0
    return doc, grams, has_letter, np.searchsorted(doc, np.arange(len(low)))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK_CHARS):
            size += len(texts[end] or "")
            end += 1
        yield at, texts[at:end]
        at = end


def _by_text(doc: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    for s, e in zip(starts, np.r_[starts[1:], len(doc)], strict=True):
        yield grams[:, s:e].ravel()


# ---------------------------------------------------------------- learning

_LEARN = "kind string, bucket long, n long, lang string, grams binary, counts binary, rank long"


def _statistics(batches: Iterator[pa.RecordBatch], rates: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a partition, and the counts of its sampled documents and of an excerpt of each."""
    schema = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("n", pa.int64()), ("lang", pa.string()), ("grams", pa.binary()), ("counts", pa.binary()), ("rank", pa.int64())])
    df, seen, total = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool), 0
    taken: set[tuple[str, int]] = set()

    def sampled(lang: str, grams: np.ndarray, rank: int) -> dict:
        g, n = np.unique(grams[grams > 0], return_counts=True)
        return {"kind": "text", "lang": lang, "grams": g.astype("<i4").tobytes(), "counts": n.astype("<i4").tobytes(), "rank": rank}

    for batch in batches:
        langs, ranks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        rows = []
        for at, texts in _chunks(batch.column(0).to_pylist()):
            doc, grams, has_letter, starts = ngrams(texts)
            for d, g in enumerate(_by_text(doc, grams, starts)):
                if not has_letter[d]:
                    continue
                seen[g] = True
                there = np.flatnonzero(seen)
                df[there] += 1
                seen[there] = False
                total += 1
                lang, rank = langs[at + d], ranks[at + d]
                if rank < rates[lang] * RANKS and (lang, rank) not in taken:
                    taken.add((lang, rank))
                    rows.append(sampled(lang, g, rank))
                    words = texts[d].split()
                    begin = rank % max(1, len(words) - 5)
                    short = ngrams([" ".join(words[begin : begin + 3 + rank % 7])])
                    if short[2][0]:
                        rows.append(sampled(lang, short[1].ravel(), rank))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    df[0] = total
    at = np.flatnonzero(df)
    nothing = pa.nulls(len(at))
    yield pa.RecordBatch.from_arrays([pa.array(["df"] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(df[at], pa.int64()), *(nothing.cast(schema.field(k).type) for k in (3, 4, 5, 6))], schema=schema)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def features(g: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = n * idf[g]
    return x * (SCALE / max(x.sum(), 1e-12))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (buckets x classes; bucket 0 is the intercept) of FTRL-proximal over (buckets, values, class) examples."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            g, x, y = examples[i]
            w = weights(z[g], n[g])
            p = softmax(x @ w)
            p[y] -= 1
            grad = x[:, None] * p
            z[g] += grad - (np.sqrt(n[g] + grad * grad) - np.sqrt(n[g])) / ALPHA * w
            n[g] += grad * grad
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    low, high, part = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _fit(batches: Iterator[pa.RecordBatch], idf: np.ndarray, langs: list[str]) -> Iterator[pa.RecordBatch]:
    """Fit weights and temperature on the sample: (class, bucket, weight) rows; class -1 has the temperature."""
    rows = sorted((r["rank"], r["lang"], len(r["grams"]), r["grams"], r["counts"]) for b in batches for r in b.to_pylist())
    number = {c: k for k, c in enumerate(langs)}
    train, rest = [], []
    for rank, lang, _, g, c in rows:
        g, c = np.frombuffer(g, "<i4").astype(np.int64), np.frombuffer(c, "<i4")
        example = (np.r_[0, g], np.r_[1.0, features(g, c, idf)], number[lang])
        (rest if rank % 5 == 0 else train).append(example)
    w = ftrl(train, len(langs)) if train else np.zeros((1 << BITS, len(langs)))
    t = temperature(np.array([x @ w[g] for g, x, _ in rest]).reshape(len(rest), len(langs)), np.array([y for *_, y in rest], np.int64))
    b, c = np.nonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, c], pa.int32()), pa.array(np.r_[0, b], pa.int64()), pa.array(np.r_[t, w[b, c]], pa.float64())], names=["class", "bucket", "weight"])


class Model:
    """Languages, inverse document frequencies, sparse weights and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, bucket: np.ndarray, lang: np.ndarray, weight: np.ndarray, temperature: float):
        self.langs, self.idf, self.bucket, self.lang, self.weight, self.temperature = langs, idf.astype(np.float32), bucket, lang, weight, temperature

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(intercepts, a row a bucket: weight times frequency for each language, and the frequency alone)."""
        m = np.zeros((1 << BITS, len(self.langs) + 1))
        m[self.bucket, self.lang] = self.weight
        intercept = m[0, :-1].copy()
        m[:, :-1] *= self.idf[:, None]
        m[:, -1] = self.idf
        m[0] = 0
        return intercept, m


def learn(docs: DataFrame) -> Model:
    """Fit on the rows of (text, lang) whose lang isn't null and whose crc32(doc_id as text) mod 4 is not 2."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    rank = F.pmod(F.xxhash64("text"), F.lit(RANKS))
    # the sample counts equal texts once, so its rate follows from the number of different ones
    texts = dict(known.groupBy("lang").agg(F.approx_count_distinct(rank)).collect())
    langs = sorted(texts)
    rates = {k: min(1.0, SAMPLE_PER_LANGUAGE / max(1, n)) for k, n in texts.items()}
    gathered = materialise(map_arrow(known.select("text", "lang", rank.alias("rank")), partial(_statistics, rates=rates), _LEARN), "language-statistics")
    df = np.zeros(1 << BITS)
    for r in gathered.where("kind = 'df'").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():  # a row a bucket at most
        df[np.asarray(r.column(0))] = np.asarray(r.column(1))
    idf = np.where(df > 0, np.log((1 + df[0]) / (1 + df)) + 1, 0)
    idf[0] = 0
    sample = gathered.where("kind = 'text'").select("lang", "grams", "counts", "rank").distinct().coalesce(1)
    fitted = map_arrow(sample, partial(_fit, idf=idf, langs=langs), "class int, bucket long, weight double").toArrow()
    c, b, w = (np.asarray(fitted.column(k)) for k in range(3))
    return Model(langs, idf, b[c >= 0], c[c >= 0], w[c >= 0], float(w[c < 0][0]) if len(w) else 1.0)


# ---------------------------------------------------------------- prediction


def _label(texts: list[str | None], model: Model, intercept: np.ndarray, m: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, scores = [], []
    for _, some in _chunks(texts):
        if not model.langs:
            names += ["und"] * len(some)
            scores += [0.0] * len(some)
            continue
        doc, grams, has_letter, starts = ngrams(some)
        total = np.zeros((len(some), m.shape[1]))
        if len(doc):
            full = np.flatnonzero(np.diff(np.r_[starts, len(doc)]))
            total[full] = np.add.reduceat(m[grams[0]] + m[grams[1]] + m[grams[2]], starts[full])
        p = softmax((total[:, :-1] * (SCALE / np.maximum(total[:, -1:], 1e-12)) + intercept) / model.temperature)
        best = p.argmax(1)
        names += [model.langs[k] if ok else "und" for k, ok in zip(best, has_letter, strict=True)]
        scores += np.where(has_letter, p[np.arange(len(p)), best], 0.0).tolist()
    return names, scores


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    table = model.table()
    for batch in batches:
        names, scores = _label(batch.column(2).to_pylist(), model, *table)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def _keep(batches: Iterator[pa.RecordBatch], model: Model, at: int, min_score: float) -> Iterator[pa.RecordBatch]:
    """The rows whose text, column `at`, has a recognised language."""
    table = model.table()
    for batch in batches:
        names, scores = _label(batch.column(at).to_pylist(), model, *table)
        yield batch.filter(pa.array([n != "und" and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    A null text or one without a letter is `und` with score 0, and so is every text if nothing could be learned. Equal
    texts get equal predictions, however long they are. held_out says that crc32(doc_id as text) mod 4 is 2 (a null doc_id: false). Ties go to
    the language that sorts first. Only doc_id and text are read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return map_arrow(docs.select("doc_id", held.alias("held_out"), "text"), partial(_predict, model=model), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the documents that may be learned from and predict all."""
    return predict(docs, learn(docs))


def drop_unknown(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a recognised language, with all their columns: not `und`, and a score of min_score at least.

    Each row is judged where it is, so rows without doc_id and repeated rows are too, and no text is shuffled.
    """
    return map_arrow(docs, partial(_keep, model=learn(docs), at=docs.columns.index("text"), min_score=min_score), docs.schema)
