import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from phonolith.llm import lm_score as L


def brute_counts(texts, order):
    """{context: Counter of symbols} for contexts of 0 to order bytes."""
    out: dict[bytes, Counter] = {}
    for t in texts:
        data = bytes([L.START]) * order + b" ".join(L.words_of(t)) + bytes([L.END])
        for i in range(order, len(data)):
            for k in range(order + 1):
                out.setdefault(data[i - k : i], Counter())[data[i]] += 1
    return out


def brute_cost(tree, context, symbol):
    """log10 probability: method C with exclusion, from the longest known context down."""
    cost, excluded, k = 0.0, set(), len(context)
    while k >= 0:
        seen = tree.get(context[len(context) - k :] if k else b"")
        if seen:
            left = {s: n for s, n in seen.items() if s not in excluded}
            if left:
                total = sum(left.values()) + len(left)
                if symbol in left:
                    return cost + math.log10(left[symbol] / total)
                cost += math.log10(len(left) / total)
            excluded |= set(seen)
        k -= 1
    return cost - math.log10(L.SYMBOLS - len(excluded))


def brute_score(tree, text, order):
    data = bytes([L.START]) * order + b" ".join(L.words_of(text)) + bytes([L.END])
    return sum(brute_cost(tree, data[i - order : i], data[i]) for i in range(order, len(data)))


def corpus():
    rng = random.Random(4)
    syllables = ["an", "the", "Re", "ion", "é", "ti", "ou"]
    rows = []
    for i in range(60):
        rows.append(" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 40))))
    return [*rows, None, "", " \n\t", "zzz qqq 漢字", "long " * 3000, "same text here", "same text here"]


@pytest.mark.parametrize("hot", [{}, {"hot_grams": 150, "hot_words": 3}, {"hot_grams": 0, "hot_words": 0}])
def test_scores_match_brute_force(spark, hot):
    rows = [(i, t, 9) for i, t in enumerate(corpus())] + [(None, "the reion", 9), (3, "doubled id", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    train = [t for i, t, _ in rows if zlib.crc32(str("" if i is None else i).encode()) % 10]
    got = L.scored(docs, docs.where(L.crc_mod(docs.doc_id, 10) != 0), **hot).collect()
    assert len(got) == len(rows)
    tree = brute_counts(train, L.ORDER)
    tokens = Counter(w for t in train for w in [*L.words_of(t), b""])
    total, size = sum(tokens.values()), len(tokens)
    want = Counter()
    for i, t, _ in rows:
        own = [*L.words_of(t), b""]
        base = sum(math.log10((tokens[w] + 0.1) / (total + 0.1 * (size + 1))) for w in own)
        want[(i, len(own), sum(tokens[w] > 0 for w in own), total, round(base, 5), round(brute_score(tree, t, L.ORDER), 5))] += 1
    assert Counter((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want


def test_probabilities_of_all_symbols_sum_to_one(spark):
    docs = spark.createDataFrame([(t,) for t in corpus()], "text string")
    levels, contexts = L.trie(L.counts(docs).where("gram IS NOT NULL").select("gram", "n"))
    known = {r["gram"]: r["cost"] for r in L.known_costs(levels, contexts).collect()}
    starts = (b"n the ", b"re rea", b"zzzzzz", b"\xfe\xfe\xfe\xfe\xfe\xfe", b"z qqq ", b"antian")
    codes = [int.from_bytes(c, "big") << 8 | s for c in starts for s in range(256) if s != L.START]
    unknown = spark.createDataFrame([(c,) for c in codes if c not in known], "gram long")
    costs = known | {r["gram"]: r["cost"] for r in L.escaped_costs(unknown, levels, contexts).collect()}
    for at in range(len(starts)):
        assert np.isclose(sum(10 ** costs[c] for c in codes[255 * at : 255 * (at + 1)]), 1.0)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["id"]: r for r in L.scored(docs, docs.limit(0)).collect()}
    assert math.isclose(got[1]["score"], 4 * -math.log10(255), rel_tol=1e-9) and got[1]["n_known"] == 0
    assert got[2]["n_tokens"] == 1
    assert L.scored(docs.limit(0), docs).count() == 0


def test_hash_table_finds_all_and_only_its_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    table = L.HashTable(keys, keys.astype(float))
    probe = np.concatenate([keys, rng.integers(0, 1 << 40, 5000)])
    values, missing = table.get(probe)
    there = np.isin(probe, keys)
    assert set(missing) == set(np.flatnonzero(~there)) and (values[there] == probe[there]).all()


def test_a_very_long_text_and_frequent_rows(spark):
    rows = [(1, "one two three " * 100_000), (2, "one two three " * 100_000), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in L.scored(docs, docs).collect()}
    assert got[1]["score"] == got[2]["score"] and got[1]["n_tokens"] == 300_001
    assert got[1]["score"] / 1_400_000 > -0.01
    counts = spark.createDataFrame([(i, max(1, i // 10)) for i in range(1000)], "word long, n long")
    for most in (0, 1, 37, 999, 1000):
        kept = L.frequent(counts, most).count()
        assert kept <= most and (most < 1000 or kept == 1000)


def test_the_query_holds_out_by_crc_and_beats_unigrams(spark):
    got = L.op4_lm_scoring(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_packed_counts_come_back(spark, monkeypatch):
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 56, 5000))
    n = rng.integers(1, 1 << 40, len(codes))
    back = [L.unpacked_grams(g, m) for _, g, m in L.packed_grams(codes, n)]
    found = dict(zip(np.concatenate([b[0] for b in back]).tolist(), np.concatenate([b[1] for b in back]).tolist()))
    assert found == dict(zip(codes.tolist(), n.tolist()))
    # Tasks that pass their sums on all the time, and add up in small steps, count the same.
    docs = spark.createDataFrame([(t,) for t in [*corpus() * 3, None, "", "nul\x00byte"]], "text string").repartition(5)
    plain = Counter((r["word"] and bytes(r["word"]), r["gram"], r["n"]) for r in L.counts(docs).collect())
    for name, value in (("HELD", 1), ("HELD_WORDS", 1), ("WAITING", 10), ("BATCH_BYTES", 20)):
        monkeypatch.setattr(L, name, value)
    assert Counter((r["word"] and bytes(r["word"]), r["gram"], r["n"]) for r in L.counts(docs).collect()) == plain
    assert max(Counter((w, g) for w, g, _ in plain).values()) == 1
