import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from phonolith.llm import language_id as I


def brute_counts(text):
    padded = I.letters(text)
    grams = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g != " " and " " not in g[1:-1]:
                grams[g] += 1
    return grams


def code(gram):
    return sum(ord(c) << 21 * (2 - i) for i, c in enumerate(gram))


def test_counts_equal_brute_force_also_in_chunks(monkeypatch):
    text = "Ärger über ÉTÉ, x2y don't! 漢字 " * 50
    want = {code(g): n for g, n in brute_counts(text).items()}
    for chunk in (I.CHUNK, 64):
        monkeypatch.setattr(I, "CHUNK", chunk)
        assert dict(zip(*(x.tolist() for x in I.gram_counts(I.letters(text))))) == want


def sentences():
    rng = random.Random(5)
    words = {"en": "the of and to in with that house water", "de": "der die und das mit nicht über haus wasser", "fr": "le la les et est dans être maison eau"}
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        yield i, " ".join(rng.choice(words[lang].split()) for _ in range(25)), lang


def test_predictions(spark):
    rows = [*sentences(), (900, None, "en"), (901, "123 ...", "en"), (902, "the house", None), (903, "x" * 300_000, "en"), (None, "die und das", "de"), (5, "repeated id the of", "en")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, score string")
    profiles = I.learn(docs.where("doc_id % 4 <> 2 OR doc_id IS NULL"))
    assert list(profiles) == ["de", "en", "fr"]
    got = I.predict(docs, profiles).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    held = [r for r in sentences() if r[0] % 4 == 2]
    assert sum(by[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held)
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und" and by[900]["score"] == 0.0
    assert by[902]["lang_pred"] == "en" and by[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert I.predict(docs.limit(0), profiles).count() == 0
    none = I.learn(docs.limit(0))
    assert none == {} and {r["lang_pred"] for r in I.predict(docs, none).collect()} == {"und"}


def test_profiles_equal_brute_force(spark):
    rows = list(sentences())
    docs = spark.createDataFrame([*rows, *rows[:7]], "doc_id long, text string, lang string")
    profiles = I.learn(docs, size=50)
    for lang in ("en", "de", "fr"):
        total = sum((brute_counts(t) for _, t, own in [*rows, *rows[:7]] if own == lang), Counter())
        want = [g for _, g in sorted((-n, code(g)) for g, n in total.items())[:50]]
        assert profiles[lang].tolist() == want
    table = I.Profiles(profiles, 50)
    for _, text, _ in rows[:20]:
        own = [g for _, g in sorted((-n, code(g)) for g, n in brute_counts(text).items())[:50]]
        apart = {lang: sum(abs(p.tolist().index(g) - r) if g in p.tolist() else 50 for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda x: (apart[x], x))
        name, score = table.nearest(I.letters(text))
        assert name == best and np.isclose(score, 1 - apart[best] / (50 * len(own)))


def test_signs_that_look_like_letters_are_none(spark):
    assert [I.letters(t) for t in ("²", "①② ½", "\u0301", "7_7", "a² b", "नमस्ते", "ไทยี")] == ["", "", "", "", " a b ", " नमस्ते ", " ไทยี "]
    docs = spark.createDataFrame([(1, "²"), (2, "①② ½"), (3, None), (4, "abc")], "doc_id long, text string")
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in I.predict(docs, {"xx": I.ranked(*I.gram_counts(" abc "), 400)}).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4] == ("xx", 1.0)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(I, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        I.learn(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, lang string"))


def test_the_query_and_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(I.ORACLE["op8_language_id"])
    got = I.op8_language_id(spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = sorted(map(tuple, got.collect()))
    assert [r[:3] for r in rows] == [r[:3] for r in sorted(want.fetchall())]
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)


def test_profiles_of_the_most_languages_are_small():
    import pickle

    rng = np.random.default_rng(1)
    profiles = {f"l{i:04}": rng.choice(1 << 40, I.PROFILE, replace=False).astype(np.int64) for i in range(I.MAX_LANGUAGES)}
    table = I.Profiles(profiles)
    assert len(pickle.dumps(table)) < 40_000_000
    padded = I.letters("some words of text")
    own = I.ranked(*I.gram_counts(padded), I.PROFILE)
    profiles["l0777"][: len(own)] = own
    assert I.Profiles(profiles).nearest(padded) == ("l0777", 1.0)
