"""The mixed corpus follows the targets, whatever the documents' lengths."""

import numpy as np
import pytest

from foldspark.llm import mixing


def test_long_documents_are_mixed_in_proportion(spark, monkeypatch):
    """Source a has a shard's run of about 70 words and documents of 500 words, one a shard."""
    monkeypatch.setattr(mixing, "SHARD_DOCS", 10)
    words = [500] * 400 + [10] * 400 + [100] * 3200
    docs = spark.createDataFrame([(k, "w " * n, "b" if n == 100 else "a") for k, n in enumerate(words)], "doc_id long, text string, source string")
    goal = mixing.targets({"a": 204_000, "b": 320_000}, (1, 19))
    got = {"a": 0, "b": 0}
    long = 0
    for r in mixing.apply_mix(docs, (1, 19), block=8).select("doc_id", "source").collect():
        got[r.source] += words[r.doc_id]
        long += words[r.doc_id] == 500
    assert got["a"] == pytest.approx(goal["a"], rel=0.3) and got["b"] == pytest.approx(goal["b"], rel=0.03)
    assert long * 500 == pytest.approx(goal["a"] * 200 / 204, rel=0.3)


def test_passes_are_the_runs_words():
    rng = np.random.default_rng(1)
    for _ in range(300):
        sizes = rng.integers(0, 9, rng.integers(1, 9))
        if total := int(sizes.sum()):
            quota, start = int(rng.integers(0, 3 * total + 1)), int(rng.integers(0, total))
            each = mixing.take_run(np.ones(total, np.int64), quota, start)
            assert mixing.passes(np.arange(total), total, quota, start).tolist() == each.tolist()
            # over all starts, each word, so each document's middle one, is passed quota times
            assert (sum(mixing.passes(np.arange(total), total, quota, s) for s in range(total)) == quota).all()
