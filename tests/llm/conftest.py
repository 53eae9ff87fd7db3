import random

import pytest

#: Names that operators use inside, and that an input may have too.
CLASH = ["keep_id", "group_size", "digest", "kept", "component_id", "n_shingles", "bands", "bucket", "rep", "size", "taken", "target", "key", "shard", "held_out", "score", "of_id", "taken_id", "copy", "n", "a", "b", "n_tokens", "ids_sha256", "decoded_sha256", "ids_crc32", "start", "part", "weak_label", "keep", "lang_pred", "text_sha256", "template", "path"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
SYLLABLES = {"en": "th er on an re in ed nd ha at", "de": "ein sch ung ich ge be ver zu ü ß", "fr": "eau oi é è que tion ou ai le ment"}


def sentence(rng, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


def rows_of(n=60, seed=1):
    """Documents with exact and near copies, nulls, empty, one-word, odd and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append([k, sentence(rng, lang, rng.randint(8, 120)), lang, f"s{k % 4}"])
    for k in range(n, n + 12):  # near copies: a few words changed
        words = out[k % 5][1].split()
        words[rng.randrange(len(words))] = "changed"
        out.append([k, " ".join(words), out[k % 5][2], "s0"])
    out += [[n + 20, out[0][1], "en", "s1"], [n + 21, out[0][1].upper(), "en", None], [n + 22, None, None, None], [n + 23, "", "en", "s2"], [n + 24, " \n\t ", "de", "s2"]]
    out += [[n + 25, "one", "en", "s3"], [n + 26, "42 %% 17", None, "s3"], [n + 27, "日本語 🙂 text \x00 ́", "en", "é"], [n + 28, sentence(rng, "fr", 30_000), "fr", "s3"], [n + 29, "x" * 5_000, "en", "s3"]]
    out += [out[3], out[3], [None, "no id here at all", "en", "s0"], [None, None, None, None]]
    return [(*r, len(r[1] or ""), *["?"] * len(CLASH)) for r in out]


@pytest.fixture(scope="session")
def odd_rows():
    return rows_of()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
