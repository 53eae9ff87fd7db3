"""Exact and near dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from foldspark.llm import common, embedding_dedup, exact_dedup, near_dedup


def components(nodes, linked):
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(best[a], best[b])
            for n in (a, b):
                if best[n] > low:
                    best[n], changed = low, True
    return best


def test_exact_dedup(spark, odd_docs, odd_rows, no_docs):
    groups = {}
    for r in odd_rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    want = []
    for r in odd_rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(odd_docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == set(groups)


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 256, (5_000, 32), dtype=np.uint8)
    index = exact_dedup.CuckooIndex(64)
    live: dict[bytes, int] = {}
    for step in range(60):
        some = keys[rng.choice(len(keys), 200, replace=False)]
        if step % 3 == 2:
            was = index.delete(some, np.ones(200, np.int64))
            assert was.tolist() == [k.tobytes() in live for k in some]
            for k in some:
                if live.get(k.tobytes()):
                    live[k.tobytes()] -= 1
                    if not live[k.tobytes()]:
                        del live[k.tobytes()]
        else:
            index.insert(some, np.arange(200), np.ones(200, bool), np.ones(200, np.int64))
            for k in some:
                live[k.tobytes()] = live.get(k.tobytes(), 0) + 1
        assert index.contains(keys).tolist() == [k.tobytes() in live for k in keys]
    assert index.resizes > 0
    assert {index.digests[k].tobytes(): int(index.copies[k]) for k in index.live()} == live


def shingles(text, width=5):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def groups_of(rows, width=5, similarity=75):
    """(document, first document of its group) for documents told apart by (doc_id, text)."""
    sets = {(r[0], r[1]): shingles(r[1], width) for r in rows if r[0] is not None}
    docs = sorted(sets, key=lambda d: (d[0], d[1] or ""))
    linked = [(k, j) for k, a in enumerate(docs) for j, b in enumerate(docs[:k]) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    best = components(range(len(docs)), linked)
    return {d: docs[best[k]] for k, d in enumerate(docs)}


def expected_near(rows, width=5, similarity=75):
    of = {d: first[0] for d, first in groups_of(rows, width, similarity).items()}
    return sorted(((r[0], len(shingles(r[1], width)), of.get((r[0], r[1])), r[0] == of.get((r[0], r[1]))) for r in rows), key=repr)


def test_near_duplicates(spark, odd_docs, odd_rows, no_docs):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd_docs).collect()]
    assert sorted(got, key=repr) == expected_near(odd_rows)
    assert near_dedup.near_duplicates(no_docs).count() == 0
    kept = near_dedup.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() < odd_docs.count()


def test_a_reused_doc_id_joins_nothing(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    w, v = ([word() for _ in range(60)] for _ in range(2))
    rows = [(1, " ".join(w)), (2, " ".join([*w[:-1], "x"])), (2, " ".join(v)), (5, " ".join([*v[:-1], "x"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()) == expected_near(rows)
    assert sorted(tuple(r) for r in near_dedup.drop_near_copies(docs).collect()) == sorted([rows[0], rows[2]])


def test_random_tables_with_reused_ids_and_repeated_rows(spark):
    for seed in range(3):
        rng = random.Random(seed)
        bases = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 80))] for _ in range(6)]
        rows = []
        for _ in range(60):
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(len(words))] = "new"
            rows.append((rng.choice([None, *range(20)]), " ".join(words)))
        rows += rng.choices(rows, k=12)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()]
        want = expected_near(rows)
        assert sorted(got, key=repr) == want
        kept = near_dedup.drop_near_copies(docs).collect()
        named = [r for r in kept if r.doc_id is not None]
        assert len(named) == len({tuple(r) for r in named}) and sum(r.doc_id is None for r in kept) == sum(r[0] is None for r in rows)
        of = groups_of([tuple(r) for r in rows])
        assert sorted(of[tuple(r)] for r in named) == sorted(set(of.values()))  # one of each group


@pytest.mark.parametrize("small_bucket", [0, 32])
def test_a_large_group_of_near_copies(spark, monkeypatch, small_bucket):
    """A base and copies whose links are close to the threshold, compared as pairs and in small blocks."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small_bucket)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 16)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(70):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((1000 - k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == expected_near(rows)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for share, n in ((0.5, 40), (0.8, 400), (0.75, 3)):
        close = []
        for _ in range(60):
            both = rng.integers(0, 2**63, n).astype(np.uint64)
            same = int(round(share * n))
            x, y = both, np.r_[both[:same], rng.integers(0, 2**63, n - same).astype(np.uint64)]
            sig = near_dedup.super_minhash(np.repeat([0, 1], [len(x), len(y)]), np.r_[x, y], 2)
            assert np.isfinite(sig).all()
            close.append((sig[0] == sig[1]).mean() - same / (2 * n - same))
        assert abs(np.mean(close)) < 0.02
    assert np.isinf(near_dedup.super_minhash(np.zeros(0, np.int64), np.zeros(0, np.uint64), 2)).all()


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2000 + k) for k in range(1, 50)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = components({n for e in edges for n in e}, edges)
    alone = {a for a, b in edges} | {b for a, b in edges}
    got = {r.node: r.component for r in common.connected_components(frame).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in alone - set(got))
    assert common.connected_components(frame.limit(0)).count() == 0


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        v = rng.standard_normal(16) if k % 4 == 0 else rows[k - k % 4][1] + rng.standard_normal(16) * rng.choice([0.02, 0.08, 0.11, 0.3])
        rows.append((k, np.asarray(v), k % 3 if k % 4 == 0 else rows[k - k % 4][2]))
    rows = [(k, [float(x) for x in v], lab) for k, v, lab in rows]
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [float("nan")] + [1.0] * 15, 0), (204, [None, *[1.0] * 15], 0), (205, rows[0][1], None), (206, rows[0][1], rows[0][2]), (207, [x * 1e200 for x in rows[0][1]], rows[0][2])]
    rows += [(208, rows[0][1][:8], rows[0][2]), (209, [1e-200] * 16, 1), (210, [float("inf")] * 16, 1), (None, rows[0][1], rows[0][2])]
    usable = {k: np.array(v, float) for k, v, lab in rows if k is not None and v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {r[0]: r[2] for r in rows}
    scaled = {k: v / np.abs(v).max() for k, v in usable.items()}
    linked = [(a, b) for a in usable for b in usable if a < b and label[a] == label[b] and len(usable[a]) == len(usable[b]) and scaled[a] @ scaled[b] / np.linalg.norm(scaled[a]) / np.linalg.norm(scaled[b]) >= 0.93]
    best = components([r[0] for r in rows if r[0] is not None], linked)
    want = [(r[0], sum(r[0] in e for e in linked) if r[0] is not None else 0, best.get(r[0]), r[0] == best.get(r[0])) for r in rows]
    frame = spark.createDataFrame([(*r, "?", "?") for r in rows], "vec_id long, embedding array<double>, label int, rep string, tables string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect()]
    want = [(k, n, c, kept or k is None) for k, n, c, kept in want]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_embedding_groups_larger_than_a_block(spark, monkeypatch):
    """Single-precision vectors, close groups of several blocks and many copies, against brute force."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_MEMBERS", 16)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 24))
    x = np.array([centres[k % 6] + rng.standard_normal(24) * (0.05, 0.15, 0.2)[k % 3] for k in range(240)]).astype(np.float32)
    x[200:] = x[7]
    label = ["a" if k % 12 < 9 else "b" for k in range(240)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = [(a, b) for a in range(240) for b in range(a + 1, 240) if label[a] == label[b] and u[a] @ u[b] >= 0.93]
    best, degree = components(range(240), linked), np.bincount(np.array(linked).ravel(), minlength=240)
    frame = spark.createDataFrame([(k, x[k].tolist(), label[k]) for k in range(240)], "vec_id long, embedding array<float>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect())
    assert sum(n for _, n, _ in got) >= 0.99 * degree.sum() and all(n <= degree[k] for k, n, _ in got)
    assert [c for _, _, c in got] == [best[k] for k in range(240)]


def test_hash_tables_find_close_vectors():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((3000, 64))
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * side
    assert (embedding_dedup.bucket_hashes(x) == embedding_dedup.bucket_hashes(y)).any(1).mean() > 0.985


def test_embedding_dedup_of_a_whole_table_with_planted_links(spark, tmp_path):
    """The given table and copies of its vectors with noise, so that there are links to find, against brute force."""
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    rng = np.random.default_rng(3)
    x, label = np.stack(given["embedding"]).astype(float), given["label"].to_numpy()
    pick = rng.integers(0, len(x), 900)
    noisy = x[pick] + rng.standard_normal((900, x.shape[1])) * rng.uniform(0.01, 0.06, 900)[:, None]
    x, label = np.vstack([x, noisy]).astype(np.float32), np.r_[label, label[pick]]
    rows = [(int(k), v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(str(tmp_path / "embeddings"))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "embeddings"))).collect()}
    found = sum(r.n_links for r in got.values())
    assert close.sum() > 1000 and all(r.n_links <= close[k].sum() for k, r in got.items()) and found >= 0.99 * close.sum()
    best = components(range(len(x)), np.argwhere(close).tolist())
    assert sum(r.component_id == best[k] for k, r in got.items()) >= 0.99 * len(x)
