"""Cross-tokenizer alignment against whole texts encoded by the public libraries."""

import hashlib
import random
from collections import Counter

import pytest

from foldspark.llm import token_align

ALIGNER = token_align.load(*token_align.default_vocabularies())
ODD = ["a▁b", "  two  spaces ", "tab\tx\n\n", "\x00z", "ﬁ Ω", "<s> </s> <unk> <0x41> <|endoftext|> x", "日本 語🙂 y", "́x", "a\u0085b c", "\r\n x", " ", "café é à la Ünï", "don't 's 't 'll", "x " * 50, "a b", "é ́x", "a ´ b", "　 x y", "Привет мир ҃ x", "z" * 5000]


def plain(text):
    """(ids of A, ids of B, groups, links) of a whole text, byte by byte; none if it isn't given back."""
    if not text:
        return [], [], [], []
    a, b = ALIGNER.a.encode(" " + text, add_special_tokens=False).ids, ALIGNER.b.encode(text)
    spelled = [b"".join(ALIGNER.bytes_a[i] for i in a), b"".join(ALIGNER.bytes_b[i] for i in b)]
    if spelled != [(" " + text).encode()] * 2:
        return [], [], [], []
    ends_a = [sum(ALIGNER.size_a[i] for i in a[: k + 1]) for k in range(len(a))] if len(a) < 500 else None
    if ends_a is None:
        ends_a, at = [], 0
        for i in a:
            at += ALIGNER.size_a[i]
            ends_a.append(at)
    groups, links, own_a, own_b, at, j = [], [], [], [], 0, 0
    for i, end in zip(a, ends_a, strict=True):
        own_a.append(i)
        while j < len(b) and at < end:
            own_b.append(b[j])
            at += ALIGNER.size_b[b[j]]
            j += 1
        if at == end:
            groups.append((own_a, own_b))
            links.append((own_a[-1], own_b[-1]))
            own_a, own_b = [], []
    return a, b, groups, links


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def wanted(rows):
    """The result rows for (doc_id, text) pairs."""
    each = [(i, *plain(t)) for i, t in rows]
    count = Counter(link for r in each for link in r[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return sorted(
        (
            (i, len(a), len(b), len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(written(g).encode()).hexdigest() if a else "")
            for i, a, b, g, links in each
        ),
        key=repr,
    )


def test_units_align_as_whole_texts():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices(" \n\tabcAé'ßЖ日́​­1,.!▁<|>", k=rng.randint(1, 40))) for _ in range(4000)]
    for text, units in zip(texts, ALIGNER.aligned(texts), strict=True):
        a, b, groups, links = plain(text)
        assert (sum(u[0] for u in units), sum(u[1] for u in units), sum(u[2] for u in units)) == (len(a), len(b), len(groups)), text
        assert ";".join(u[3] for u in units) == written(groups)


def test_links_of_tokens_without_bytes():
    assert token_align.links([2, 3], [5]) == [(1, 0)]
    assert token_align.links([2, 3, 0], [5, 0]) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert list(token_align.common_ends([2, 3, 0, 1], [5, 0, 1])) == [(3, 2), (4, 3)]


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_scores_equal_brute_force(spark, odd_docs, odd_rows, no_docs, monkeypatch, block_bytes):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", block_bytes)
    rows = [(r[0], r[1]) for r in odd_rows] + [(5000 + k, t) for k, t in enumerate(ODD)] + [(None, "the quick brown fox")] * 3
    more = spark.createDataFrame([(*r, *["?"] * 4) for r in rows[len(odd_rows) :]], "doc_id long, text string, block string, code string, a string, count string")
    docs = odd_docs.select("doc_id", "text").unionByName(more, allowMissingColumns=True)
    got = sorted((tuple(r) for r in token_align.score(docs).collect()), key=repr)
    assert got == wanted(rows)
    assert token_align.score(no_docs).count() == 0
    if block_bytes > 300:
        groups = {r.doc_id: [(g.ids_a, g.ids_b) for g in r.groups] for r in token_align.groups(docs).collect() if r.doc_id is not None and r.doc_id >= 5000}
        assert groups == {i: plain(t)[2] for i, t in rows if i is not None and i >= 5000}
        counts = Counter(x for _, t in rows for x in plain(t)[3])
        assert {(r.a, r.b): r["count"] for r in token_align.pair_counts(docs).collect()} == counts
