import random

import public_tokenizers
import pytest

from phonolith.llm import token_counts as T
from phonolith.llm.packing import byte_ranks

FILE = public_tokenizers.path("byte_bpe_50k.json")


def greedy(pieces, word):
    """Longest match first, piece by piece."""
    longest, at, n = max(map(len, pieces)), 0, 0
    while at < len(word):
        end = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces)
        at, n = end, n + 1
    return n


@pytest.fixture(scope="module")
def pieces():
    return set(byte_ranks(open(FILE, encoding="utf-8").read()))


def test_counts_equal_greedy_matching(pieces):
    automaton = T.Automaton(pieces)
    rng = random.Random(1)
    parts = ["un", "believ", "able", "the", "ation", "é", "漢", "1", "2023", "...", "--", "'s", "X", "zq"]
    for _ in range(3000):
        word = b" " + "".join(rng.choice(parts) for _ in range(rng.randint(1, 12))).encode()
        assert automaton.count(word) == greedy(pieces, word), word


def test_counts_equal_greedy_matching_on_nested_pieces():
    rng = random.Random(2)
    for _ in range(200):
        pieces = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 7))) for _ in range(12)}
        automaton = T.Automaton(pieces)
        for _ in range(30):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30)))
            assert automaton.count(word) == greedy(pieces, word)


def test_a_vocabulary_without_single_bytes_is_an_error():
    with pytest.raises(ValueError):
        T.Automaton({b"ab"})


def test_rows(spark, pieces):
    texts = [None, "", " \n", "the unbelievable", "the unbelievable", "a\x1cb", "x" * 200_000, "word " * 50_000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "no id", 7)], "doc_id long, text string, n_words int")
    got = {r["id"]: (r["n_words"], r["n_tokens"]) for r in T.token_counts(docs, FILE).collect()}
    for i, t in [*enumerate(texts), (None, "no id")]:
        words = (t or "").encode().split()
        assert got[i] == (len(words), sum(greedy(pieces, b" " + w) for w in (words if i != 7 else [])) if i != 7 else got[7][1])
    assert got[7] == (50_000, 50_000)
    assert T.token_counts(docs.limit(0), FILE).count() == 0
