"""Whitening and exact search against brute force."""

import math
import random

import numpy as np
import pytest

from foldspark.llm import exact_topk, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, rep string, mark string, x string, component int, score string, rank string"


def integer_rows(rows):
    """(vec_id, integers without the zeros at the end) of the rows that take part."""
    out = []
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) and abs(math.floor(256 * c)) <= exact_topk.LARGEST for c in v):
            x = [math.floor(256 * c) for c in v]
            while x and not x[-1]:
                x.pop()
            out.append((i, tuple(x)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, [rng.gauss(0, 1 + j) for j in range(rng.choice([3, 3, 3, 5]))]) for i in range(300)]
    out += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(150)]  # a hot vector
    out += [(2000, None), (2010, [None, 1.0]), (2020, [math.nan]), (2030, []), (2040, [1e30]), (2050, [0.0, -0.0]), (2060, [math.inf, 1.0])]
    return out + [(0, [0.1, 0.2]), (0, [0.1, 0.2]), (10, [-0.3, 0.9, 0.1]), (None, [1.0, 2.0])]


@pytest.fixture(scope="module")
def vectors(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "embeddings.parquet")
    spark.createDataFrame([(*r, 1, *["?"] * 3, 7, "?", "?") for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def search(rows, k, every):
    found = sorted({(i, x) for i, x in integer_rows(rows) if i is not None})
    out = []
    for i, x in found:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in found if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def test_search_equals_brute_force(spark, vectors, rows, monkeypatch):
    assert sorted(map(tuple, exact_topk.top_k(vectors, 5, 10).collect())) == search(rows, 5, 10)
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 40)  # several shards, so that the first part's scores bound the rest
    monkeypatch.setattr(exact_topk, "QUERY_CELLS", 60)
    assert sorted(map(tuple, exact_topk.top_k(vectors, 7, 1).collect())) == search(rows, 7, 1)
    few = vectors.where("vec_id in (10, 20, 30)")
    assert sorted(map(tuple, exact_topk.top_k(few, 5, 10).collect())) == search([r for r in rows if r[0] in (10, 20, 30)], 5, 10)
    assert exact_topk.top_k(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [3, 40_000, 1 << 24])
def test_index_leaves_nobody_out(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (700, 9)).astype(np.int32)
    x[100:300, 2:] = 0  # ties
    index = exact_topk.ImpactIndex(x)
    for q in [*rng.integers(-spread, spread + 1, (30, 9)), np.zeros(9, np.int64)]:
        exact = [sum(a * b for a, b in zip(v, q.tolist())) for v in x.tolist()]
        kth = sorted(exact)[-6]
        for least in (-math.inf, float(kth), float(sorted(exact)[-20])):
            which, score = index.reach(q, 6, least)
            assert dict(zip(which.tolist(), score.tolist())) == {i: s for i, s in enumerate(exact) if s >= kth}


def fitted(rows):
    found = integer_rows(rows)
    dim = max(len(x) for _, x in found)
    wide = {(i, (*x, *[0] * (dim - len(x)))) for i, x in found}
    x = np.array(sorted({v for _, v in wide}), float)
    e, b = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)) / len(x))
    return found, dim, x, e[::-1], b[:, ::-1]


def test_whitening_equals_brute_force(vectors, rows):
    found, dim, x, e, b = fitted(rows)
    n, sums = len(x), [int(s) for s in x.sum(0)]
    got = whitening.whiten(vectors).collect()
    assert len(got) == 4 * len(found) and {r.n for r in got} == {n}
    want = {}
    for i, v in found:
        wide = (*v, *[0] * (dim - len(v)))
        want.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(wide, sums)), (np.array(wide) - x.mean(0)) @ b[:, :4] / np.sqrt(e[:4])))
    for c in range(1, 5):
        own = [r for r in got if r.component == c]
        single = [r for r in own if len(want[r.vec_id]) == 1]
        pairs = np.array([(r.whitened, want[r.vec_id][0][1][c - 1]) for r in single])
        assert min(np.abs(pairs @ [1, -1]).max(), np.abs(pairs @ [1, 1]).max()) < 1e-9
        assert sorted((str(r.vec_id), r.deviation) for r in own) == sorted((str(i), d) for i, many in want.items() for d, _ in many)
        assert all(abs(r.explained - e[c - 1] / e.sum()) < 1e-12 and r.identity_error < 1e-9 for r in own)


def test_whitening_of_odd_tables(spark, vectors):
    assert whitening.whiten(vectors.limit(0)).count() == 0  # no rows
    assert whitening.whiten(vectors.where("vec_id >= 1000 and vec_id < 1150")).count() == 0  # no variance
    assert whitening.whiten(vectors.where("vec_id = 2030")).count() == 0  # no components
    equal = spark.createDataFrame([(i, [float(j == i % 6) for j in range(6)]) for i in range(12)], "vec_id long, embedding array<float>")
    got = whitening.whiten(equal).collect()  # five equal eigenvalues
    assert len(got) == 48 and all(abs(r.explained - 0.2) < 1e-12 and r.identity_error < 1e-9 for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(line).collect()  # rank 1: one component
    assert len(got) == 9 and all(r.component == 1 and abs(r.explained - 1) < 1e-12 for r in got)
    large = spark.createDataFrame([(0, [65536.0] * 40), (1, [-65536.0] * 40), (2, [65536.0] * 40)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(large).collect()} == {40 * (2 * (1 << 24)) ** 2}


def test_bidiagonalisation_beyond_the_complete_size():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((900, 300)) * np.r_[9, 7, 7, 5, np.linspace(3, 0.1, 296)]
    a[:, 1], a[:, 200:] = a[:, 2], 0
    a -= a.mean(0)
    seen = []

    def product(p, earlier):
        u = a @ p
        seen.append(1)
        return {"back": a.T @ u, "square": np.array([u @ u]), "earlier": (a @ earlier).T @ u}

    basis, s = whitening.bidiagonalise(product, 300, 5, float(np.linalg.norm(a)))
    want = np.linalg.svd(a)
    assert len(seen) < 200
    np.testing.assert_allclose(s[:5], want[1][:5], rtol=1e-11)
    np.testing.assert_allclose(np.abs(np.sum(basis[:, :5] * want[2][:5].T, 0)), 1, atol=1e-9)
