"""Language ID, quality, mixing, URL filter, chat formatting and the pipeline, on small inputs and against brute force."""

import json
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldspark.llm import byte_bpe, chat_format, exact_dedup, language_id, mixing, near_dedup, quality, url_filter

from foldspark.llm.url_filter_sql import judge_sql

from .conftest import CLASH, SCHEMA, SYLLABLES, rows_of, sentence


# ---------------------------------------------------------------- language ID


def test_language_id_learns_and_holds_out(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(4)
    many = [(k, sentence(rng, lang, rng.randint(3, 60)), lang) for k, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    docs = spark.createDataFrame([(k, t, None if k % 10 == 0 else lang, "?", "?") for k, t, lang in many], "doc_id long, text string, lang string, held_out string, score string")
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, *_ in many)
    assert np.mean([got[k].lang_pred == lang for k, _, lang in many if got[k].held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    # what is held out cannot teach: other labels there change nothing
    lied = docs.withColumn("lang", F.expr("case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end"))
    assert sorted(language_id.language_id(lied).collect()) == sorted(got.values())

    odd = language_id.language_id(odd_docs).collect()
    assert len(odd) == len(odd_rows)
    no_letter = [r[0] for r in odd_rows if not any(c.isalpha() for c in r[1] or "")]
    assert sorted((r.doc_id for r in odd if r.lang_pred == "und"), key=repr) == sorted(no_letter, key=repr)
    assert all(r.score == 0 for r in odd if r.lang_pred == "und")
    assert language_id.language_id(no_docs).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} <= {"und"}


def test_ngrams_stay_inside_their_text():
    alone = [language_id.ngrams([t]) for t in ("ab cd", "ef")]
    both = language_id.ngrams(["ab cd", None, "ef"])
    doc, grams = both[0], both[1]
    assert np.array_equal(grams[:, doc == 0], alone[0][1]) and np.array_equal(grams[:, doc == 2], alone[1][1])
    assert both[2].tolist() == [True, False, True]


# ---------------------------------------------------------------- quality


def test_quality_tells_junk_from_text(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(6)
    rows = []
    for k in range(240):
        text = ". ".join(sentence(rng, "en", rng.randint(6, 12)).capitalize() for _ in range(rng.randint(3, 9))) + "."
        if k % 4 == 0:
            text = [text.upper().replace(" ", "!! "), " ".join(w + "%%%" for w in text.split()), " | ".join(text.split()), "word " * 300][k // 4 % 4]
        rows.append((k, text))
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[k].keep for k, _ in rows if k % 4]) > 0.98
    assert np.mean([got[k].keep for k, _ in rows if k % 4 == 0]) < 0.1
    odd = quality.quality(odd_docs).collect()
    assert len(odd) == len(odd_rows) and all(not r.keep and r.score == 0 for r in odd if r.doc_id in (82, 83, 84))
    assert quality.quality(no_docs).count() == 0


def test_weak_labels_recover_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.8
    good, bad = [0.99, 0.97, 0.98, 0.99], [0.5, 0.4, 0.6, 0.3]
    v = np.stack([np.where(y, rng.random(len(y)) < g, rng.random(len(y)) >= b) for g, b in zip(good, bad, strict=True)], 1).astype(np.int8)
    codes, n = np.unique(quality.pattern(v), return_counts=True)
    model = quality.WeakLabels(quality.unpattern(codes, 4), n.astype(float))
    assert np.allclose(model.right[1], good, atol=0.03) and np.allclose(model.right[0], bad, atol=0.12)


# ---------------------------------------------------------------- mixing


def test_targets_share_and_stop():
    got = mixing.targets({"b": 100, "a": 10, None: 500, "c": 0})
    assert got["c"] == 0 and got["a"] == 30 and got["b"] == 300 and got[None] == pytest.approx(280)
    assert sum(mixing.targets({f"s{k:02d}": 1000 for k in range(9)}).values()) == pytest.approx(9000)
    assert mixing.targets({}) == {} and mixing.targets({"a": 5}) == {"a": 5.0}


def test_sainte_lague_is_highest_quotients():
    rng = np.random.default_rng(0)
    for _ in range(200):
        claims = rng.integers(0, 50, rng.integers(1, 12)).astype(float)
        seats, want = int(rng.integers(0, 200)), np.zeros(len(claims), int)
        for _ in range(seats * bool(claims.sum())):
            want[np.argmax(claims / (2 * want + 1))] += 1
        assert mixing.sainte_lague(claims, seats).tolist() == want.tolist()


def test_runs_take_what_they_should():
    sizes = np.array([3, 0, 5, 2])
    for quota in range(31):
        for start in range(10):
            got = mixing.take_run(sizes, quota, start)
            line = np.repeat(np.arange(4), sizes)
            want = np.bincount([line[(start + k) % 10] for k in range(quota)], minlength=4)
            assert got.tolist() == want.tolist()


def targets_by_hand(sizes):
    """Weights 1, 2, 3 by code point, null last; shares stop at three times a source, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        worst = max(open_, key=lambda s: share[s] - 3 * sizes[s]) if open_ else None
        if not open_ or share[worst] <= 3 * sizes[worst]:
            return fixed | share
        fixed[worst] = 3.0 * sizes[worst]


def size_of(text):
    return len(re.findall("[^\x20\x09-\x0D]+", text or ""))


def test_mix(spark, odd_docs, odd_rows, no_docs):
    of_source = {}
    for r in odd_rows:
        of_source[r[3]] = of_source.get(r[3], 0) + size_of(r[1])
    goal = targets_by_hand(of_source)
    got = mixing.mix(odd_docs).collect()
    assert sorted(got, key=repr) == sorted(mixing.mix(odd_docs.repartition(7)).collect(), key=repr)
    source_of = {}
    for r in odd_rows:
        source_of.setdefault((r[0], size_of(r[1])), r[3])
    taken = dict.fromkeys(of_source, 0)
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == of_source[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(odd_rows) and all(abs(taken[s] - goal[s]) <= mixing.BLOCK_WORDS for s in goal)
    assert mixing.mix(no_docs).count() == 0
    mixed = mixing.apply_mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixing.apply_mix(no_docs).count() == 0


def test_mix_of_many_shards(spark):
    """Rare short documents, a source of one word, a hot source, repeated rows and null keys, over some 100 shards."""
    rng = random.Random(2)
    rows = [(k, "w " * rng.choice([1, 3, 20, 60]), f"s{min(k % 7, 5)}") for k in range(50_000)]
    rows += [(60_000 + k, "eight words are in each of these ones", "rare") for k in range(60)]
    rows += [(70_000, "one", "tiny"), (None, None, None), (None, "no id " * 9, None), (80_001, None, "void"), (80_000, "", "void")]
    rows += [(90_000, "the same row again and again", "s1")] * 3_000 + [(None, "no id " * 9, None)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, held = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
        held.setdefault((i, size_of(t)), s)
    goal = targets_by_hand(sizes)
    got = mixing.mix(docs).collect()
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = held[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows) and sum(sizes.values()) > 90 * 64 * 100
    assert all(abs(taken[s] - goal[s]) <= max(mixing.BLOCK_WORDS, 0.01 * goal[s]) for s in sizes), (taken, goal)
    assert taken["rare"] == 1440 and taken["tiny"] == 3
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(9)).collect()))
    mixed = mixing.apply_mix(docs).groupBy("source").agg(F.sum(F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim("text"), " ")))).alias("n")).collect()
    words = {r.source: r.n for r in mixed}
    assert all(words[s] == pytest.approx(goal[s], rel=0.02, abs=300) for s in sizes if goal[s])


# ---------------------------------------------------------------- URL filter


def judged_by_sql(urls, levels):
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"page_id": range(len(urls)), "url": pd.array(urls, "string")}))
    rows = con.sql(judge_sql(levels, "given")).fetchall()
    return {r[0]: r[1:] for r in rows}


def judged(frame, **options):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, r.blocked_share) for r in url_filter.judge(frame, **options).collect()}


def test_url_filter(spark):
    rng = random.Random(8)
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.org/es/1", "x://Example.ORG", "x://example.org/en/12", "x://a.example.org/es/?q#f", "x://b.com#top", "x://notorg/", "x://c.com/fr", "x://c.com/fr/\n/x://y", "a://b://c/d"]
    for _ in range(900):
        host = rng.choice(["shop.com", "deep.shop.com", "site.net", "wiki.org", "example.org"])
        path = rng.choice([f"/de/{rng.randrange(9999)}", f"/fr/{rng.randrange(9999)}.html", f"/en/{rng.choice('abc')}/{rng.randrange(9)}", f"/tag/{sentence(rng, 'en', 1)}", "/a/b/c/d/e/f", "/", "", f"/es/x{rng.randrange(9999)}/y"])
        if path.startswith("/es/") and host == "wiki.org":
            host = "example.org"
        urls.append(f"https://{host}{path}{rng.choice(['', '?a=/x', '#y'])}")
    urls += [f"https://bad.com/de/{k}" for k in range(60)] + ["https://bad.com/en/1", "https://bad.com/x", "x://long.net/" + "long/" * 3 + "z" * 100_000] + urls[20:23]
    frame = spark.createDataFrame([(k, u, None, "?") for k, u in enumerate(urls)], "page_id long, url string, html string, template string")
    got, want = judged(frame), judged_by_sql(urls, 6)
    assert got == want
    of = {(h, p): (v, t) for h, p, r, v, t, _ in got.values() if r is None}
    variable = {t for (h, p), (v, t) in of.items() if p.startswith("/fr/")}
    assert all(t.endswith("/*") for t in variable) and not any("*" in t for (_, p), (_, t) in of.items() if p.startswith("/a/b"))
    # pages under /es/ are blocked on hosts without a rule for them, as they are where a rule speaks; those under /fr/ are not
    assert {v for (h, p), (v, _) in of.items() if p.startswith("/es/") and h.endswith(".net")} == {"block"}
    assert {v for (h, p), (v, _) in of.items() if p.startswith("/fr/")} == {"allow"}
    assert any("|.." in t for _, t in of.values())
    assert url_filter.judge(frame.limit(0)).count() == 0
    assert {v for *_, v, _, _ in judged(frame, rules=()).values()} == {"allow"}


def test_url_templates_have_no_depth_limit(spark):
    """The only thing that tells two branches apart is below 20 equal segments."""
    stem = "/s" * 20
    urls = [f"x://a.com{stem}/{kind}/{k}" for kind in ("good", "bad") for k in range(40)] + [f"x://b.net{stem}/{kind}/{k}" for kind in ("good", "bad") for k in range(100, 140)]
    rules = (url_filter.Rule("a.com", f"{stem}/bad/", False), url_filter.Rule("a.com", f"{stem}/good/", True))
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for host, path, rule, verdict, template, _ in judged(frame, rules=rules).values():
        assert verdict == ("block" if "/bad/" in path else "allow") and (rule is None) == (host == "b.net")
        assert template == f"{stem}/{'bad' if '/bad/' in path else 'good'}/*"


# ---------------------------------------------------------------- chat formatting


def test_chat_format(spark):
    call = lambda i, name, args, after=None: {"id": i, "name": name, "arguments": args} | ({"after": after} if after else {})
    say = lambda **x: json.dumps(x)
    rows = [
        (1, 0, "user", 'hi "x"\n é'),
        (1, 1, "assistant", say(content="look", tool_calls=[call("a", "search", {"query": "z", "limit": 3, "b": 1}), call("b", "calculator", {"expression": "1+1"}, ["a"]), call("c", "nope", {})])),
        (1, 2, "tool", say(tool_call_id="a", content="res")), (1, 3, "tool", say(tool_call_id="b", content="2")), (1, 4, "tool", say(tool_call_id="zz", content="res")),
        (1, 5, "assistant", "{not json"), (1, 6, None, None), (1, 7, "assistant", say(tool_calls=[call("a", "search", {})])),
        (2, 0, "assistant", say(tool_calls=[call("x", "fetch", {"url": 5}, ["y"])])), (2, 1, "assistant", say(tool_calls=[call("y", "fetch", "str", ["x"])])),
        (2, 2, "assistant", say(tool_calls=[call("p", "python", {"code": "1"}, ["q"])])), (2, 3, "assistant", say(tool_calls=[call("q", "python", {"code": "2"}, ["r", "gone"])])), (2, 4, "assistant", say(tool_calls=[call("r", "python", {"code": "3"})])),
        (3, 0, "tool", say(tool_call_id="late", content="early result")), (3, 1, "assistant", say(tool_calls=[call("late", "python", {"code": "3"})])),
        (None, None, "tool", say(tool_call_id="a", content="res")), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "system", "long " * 20_000), (6, 0, "user", ""),
    ]
    frame = spark.createDataFrame([(*r, "?") for r in rows], "conv_id long, turn long, role string, text string, message string")
    got = chat_format.format_chats(frame).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got}
    for r in got:
        assert json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message
    assert at[1, 0].message == '{"content":"hi \\"x\\"\\n é","role":"user"}' and at[1, 0].linked is None and at[1, 0].errors == []
    assert at[1, 1].errors == ["a: b: unknown", "a: repeated identifier", "c: no result", "c: unknown tool"] and at[1, 1].calls == 3 and not at[1, 1].linked
    assert at[1, 2].linked and at[1, 3].linked and at[1, 4].errors == ["zz: no call"] and at[1, 5].calls == 0
    assert at[1, 7].errors == ["a: query: missing", "a: repeated identifier"]
    assert at[2, 0].errors == ["x: cycle", "x: no result", "x: url: not a string"] and "y: arguments: not an object" in at[2, 1].errors
    assert [at[2, k].place_level for k in (2, 3, 4)] == [2, 1, 0]
    place = lambda r: (r.place_turn, r.place_level, r.place_kind)
    assert place(at[3, 0]) > place(at[3, 1]) and place(at[1, 3]) > place(at[1, 1])
    assert at[None, None].errors == ["a: no call"] and sum(r.conv_id == 4 for r in got) == 2
    assert chat_format.format_chats(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows = rows_of(40, seed=3)
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        before, after = docs.collect(), out.collect()
        if name == "language_id":
            want = [r for r in before if r.text and not (r.doc_id is not None and (model[r.doc_id].lang_pred == "und" or model[r.doc_id].score < language_id.MIN_SCORE))]
            assert sorted(after, key=repr) == sorted(want, key=repr)
        if name == "exact_dedup":
            want = {}
            for r in before:
                want[r.text or ""] = max(want.get(r.text or "", -1), r.doc_id if r.doc_id is not None else -1)
            assert sorted((r.text or "", r.doc_id if r.doc_id is not None else -1) for r in after) == sorted(want.items())
        if name == "minhash_near_dedup":
            decided = {r.doc_id: r.kept for r in near_dedup.near_duplicates(docs).collect()}
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(k for k, v in decided.items() if v and k is not None)
        kept.append(len(after))
        docs = spark.createDataFrame(after, docs.schema)
    assert len(rows) > kept[0] > kept[1] > kept[2] > 20
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, path)
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id, size_of(r.text)] = copies.get((r.doc_id, size_of(r.text)), 0) + 1
    assert mixed.columns == docs.columns and {k for k in copies} <= {(r.doc_id, size_of(r.text)) for r in docs.collect()}
    assert all(0 < n <= 3 for n in copies.values())
    tokens = corpus_pipeline.STAGES[4][1](spark, mixed, path).collect()
    assert sum(r.n_tokens for r in tokens) == sum(len(r.ids) for r in tokens) and len(tokens) == sum(copies.values())
    whole = corpus_pipeline.run(spark, path)
    assert sorted(((r.doc_id, r.n_tokens) for r in whole.collect()), key=repr) == sorted(((r.doc_id, r.n_tokens) for r in tokens), key=repr)
    assert exact_dedup.drop_copies(docs).count() == docs.count() and byte_bpe.encode_checked(docs).count() == docs.count()


def test_pipeline_over_no_documents(spark, no_docs, tmp_path):
    """An empty table, and one whose documents all go in the first stage, leave no rows in the columns of any other run."""
    none = str(tmp_path / "none")
    no_docs.write.parquet(f"{none}/documents.parquet")
    nothing = corpus_pipeline.run(spark, none)
    assert nothing.count() == 0 and {"doc_id", "n_tokens", "ids"} <= set(nothing.columns)
    blank = str(tmp_path / "blank")
    rows = [(k, text, lang, "s", 0, *["?"] * len(CLASH)) for k, (text, lang) in enumerate([(None, "en"), ("", "en"), (" \n", None), ("42 %", "de")])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{blank}/documents.parquet")
    gone = corpus_pipeline.run(spark, blank)
    assert gone.count() == 0 and gone.columns == nothing.columns


@pytest.mark.parametrize("copies", [0, 200_000])
def test_repeated_texts_leave_the_classifiers_their_samples(spark, copies, monkeypatch):
    """Copies of one text count once in a sample, so they take no place of other texts."""
    rng = random.Random(5)
    words = {"aa": "the of and house ring stone thing".split(), "bb": "der und haus schön straße nicht über".split()}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randint(5, 30))) + f" {rng.randint(0, 10**9)}.", lang) for k, lang in enumerate(["aa", "bb"] * 250)]
    rows += [(1000 + k, "$$$ %%% ### " * rng.randint(3, 30) + str(rng.randint(0, 10**9)), None) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = spark.range(5000, 5000 + copies).select(F.col("id").alias("doc_id"), F.lit(rows[0][1]).alias("text"), F.lit("aa").alias("lang"))
    docs = docs.union(many).repartition(4)
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(docs).where("doc_id < 1000").collect()}
    for lang in words:
        own = [got[k] == lang for k, _, of in rows if of == lang]
        assert sum(own) > 0.95 * len(own)
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 300)
    score = {r.doc_id: r.score for r in quality.quality(docs).where("doc_id < 5000").collect()}
    good, junk = ([score[r[0]] for r in rows if (r[2] is None) == bad] for bad in (False, True))
    assert sum(a > b for a in good for b in junk) > 0.95 * len(good) * len(junk)


def test_quality_ranks_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) > 0.9 * len(good) * len(bad)


def test_quality_of_nothing_learned(spark):
    nothing = quality.quality(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {r.score for r in nothing} == {0.0}


def test_blocks_shrink_with_the_claim():
    claims = np.array([0.0, 3.0, 1000.0, 40_000.0, 1e9])
    assert mixing.block_words(claims, 64).tolist() == [1, 1, 1, 64, 64]
    assert all(b == 1 or c / b >= mixing.FINE_BLOCKS for c, b in zip(claims, mixing.block_words(claims, 48)))


def test_calls_that_share_an_identifier_and_a_turn(spark):
    call = '{"tool_calls":[{"id":"%s","name":"search","arguments":{},"after":%s}]}'
    rows = [(1, 1, "assistant", call % ("x", "[]")), (1, 2, "assistant", call % ("y", '["x"]')), (1, 2, "assistant", call % ("y", "[]")), (1, 3, "assistant", call % ("z", '["y"]'))]
    first, last = (chat_format.format_chats(spark.createDataFrame(o, "conv_id long, turn long, role string, text string").coalesce(1)) for o in (rows, rows[::-1]))
    assert sorted(map(repr, first.collect())) == sorted(map(repr, last.collect()))


def test_url_rounds_follow_the_forks_and_not_the_depth(spark):
    """Two urls of a thousand segments that part at the last one, among others, and the templates of a plain descent."""
    deep = "/".join(f"s{i}" for i in range(1000))
    urls = [f"https://a.com/{deep}/{e}" for e in ("x", "y")] + ["https://c.com/*/b/c", "https://c.com/*/b/d"] + [f"https://b.org/p{k}/show" for k in range(40)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert all(got[k].template.count("/") == 1001 and "/s500/s501/" in got[k].template for k in (0, 1)) and all(got[k].template.startswith("/*/b/") for k in (2, 3))
    assert all(re.fullmatch(r"/(\*|p\d+)(\|\.\.)?/show", got[k].template) for k in range(4, 44))
    assert len(got) == len(urls)
