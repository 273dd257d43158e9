import random
import tracemalloc
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pytest

from phonolith.llm import quality as Q
from phonolith.llm.common import mark


def brute(text):
    words = (text or "").encode().split()
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)

    def union(least):
        return len({x for i in range(n) if best[i] >= least for x in range(i, i + best[i])})

    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    again = len({x for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for x in range(i, i + 8)})
    longest = max([k for k in best if k >= Q.Rules.min_repeat], default=0)
    return again, union(Q.Rules.min_repeat), longest


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "a", "a a", "a " * 40, "a b c d " * 11, "x y z w v u t s " * 2]
    for size in (2, 3, 30):
        for _ in range(12):
            out.append(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCD"[:size]) for _ in range(rng.randint(1, 90))))
    return out


def test_repetition_equals_brute_force():
    number = defaultdict(count(1).__next__)
    numbered = [Q.numbered(t, number) for t in texts()]
    got = Q.repetition(numbered, len(number), Q.Rules())
    assert [tuple(map(int, r)) for r in got] == [brute(t) for t in texts()]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    codes = np.append(rng.integers(1, 3, 300), 0)
    order = Q.suffix_order(codes)
    assert order.tolist() == sorted(range(301), key=lambda i: codes[i:].tolist())
    shared = Q.shared_before(codes, order)
    for a, b in zip(order[:-1], order[1:]):
        x, y = codes[a:].tolist(), codes[b:].tolist()
        assert shared[b] == next(k for k in range(301) if x[k : k + 1] != y[k : k + 1])


@pytest.mark.parametrize("kind", ["equal", "period", "copied", "random"])
def test_a_very_long_text_takes_little_memory(kind):
    n, rng = 400_000, random.Random(2)
    some = [f"w{rng.randrange(5000)}" for _ in range(n // 2)]
    text = {"equal": "w " * n, "period": "a b c d e f g h " * (n // 8), "copied": " ".join(some * 2), "random": " ".join(some)}[kind]
    number = defaultdict(count(1).__next__)
    tracemalloc.start()
    codes = Q.numbered(text, number)
    got = Q.repetition([codes], len(number), Q.Rules())[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n
    if kind != "random":
        assert got[0] == n and got[2] == {"equal": n - 1, "period": n - 8, "copied": n // 2}[kind]
    else:
        assert got[0] == 0


def test_words_across_chunks(monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 5)
    number = defaultdict(count(1).__next__)
    text = " one two\tthree a  verylongword\x0bé \n b two "
    assert Q.numbered(text, number).tolist() == [number[w] for w in text.encode().split()]


def test_rows_against_the_contract(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(None, "one two\none two\n\n#$ é", 1, "x"), (500, "word " * 300_000, 1, "x"), (501, "same row", 1, "x"), (501, "same row", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, c0 string")
    found = Q.measured(docs, keep=["doc_id"]).collect()
    assert len(found) == len(rows)
    got = {r[mark("c0")]: r for r in found}
    for i, text in enumerate(texts()):
        r, n = got[i], len((text or "").split())
        again, part, longest = brute(text)
        assert [r[mark(c)] for c in ("n_words", "n_repeat_words", "covered_words", "longest_repeat")] == [n, again, part, longest]
        failed = n < 20 or 100 * again > 30 * n
        assert r[mark("base_failed")] == failed
        assert r[mark("kept")] == (not failed and part <= 0.4 * n and longest <= 0.3 * n)
    r = got[None]
    assert [r[mark(c)] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")] == [6, 15, 2, 1]
    assert got[500][mark("n_repeat_words")] == 300_000 and not got[500][mark("kept")]
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(len(texts())) if got[i][mark("kept")]}
    assert Q.keep_good(docs.limit(0)).count() == 0
