import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from phonolith.llm import packing
from phonolith.llm.packing import Limits, best_fit, placement

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "Bc", " ", " ", "  ", "\n", "\t", ".", "'s", "é", "12", "\xa0", "\x1c", "\x85", "漢", "👍", "<|endoftext|>"]


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(FILE)
    found.encode_special_tokens = True
    return found


def test_ids_are_the_tokenizers(tokenizer):
    memo = packing.chunk_memo(open(FILE, encoding="utf-8").read())
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(memo.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("wide", [3, 4096])
def test_ids_around_long_white_space(tokenizer, monkeypatch, wide):
    monkeypatch.setattr(packing, "WIDE", wide)
    monkeypatch.setattr(packing.ChunkMemo, "wide", packing.re.compile(f"[{packing.SPACES}]{{{wide},}}").finditer)
    memo = packing.chunk_memo(open(FILE, encoding="utf-8").read())
    rng = random.Random(3)
    runs = [" ", "\n", "\t", "\u3000", "\r\n", " \n", "\x1c", "\x85 "]
    for _ in range(400):
        text = "".join(rng.choice([rng.choice(PARTS), rng.choice(runs) * rng.choice([1, 2, 3, 5, 5000] if wide > 3 else [1, 2, 3, 5])]) for _ in range(rng.randint(0, 8)))
        assert np.frombuffer(memo.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:200])


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n\t", "\r\n", "x", "7", "-"])
def test_ids_of_millions_of_characters_without_a_break(tokenizer, run):
    memo = packing.chunk_memo(open(FILE, encoding="utf-8").read())
    long = run * (5_000_000 // len(run))
    for text in (long, f"word{long}end", f"{long}end", f"word {long}"):
        assert np.array_equal(np.frombuffer(memo.ids(text), "<u4"), tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("limits", [Limits(64), Limits(64, max_docs=3), Limits(64, max_cost=1500), Limits(64, 4, 2000)])
def test_plan_holds_every_constraint_and_places_every_piece(limits):
    rng = random.Random(5)
    top = 38 if limits.max_cost else 64
    histogram = {s: rng.randint(1, 60) for s in range(1, top)}
    plan = best_fit(histogram, limits)
    placed: dict[int, int] = {}
    for times, inside in plan:
        assert sum(s * n for s, n in inside.items()) <= limits.max_tokens
        assert sum(inside.values()) <= (limits.max_docs or 10**9)
        assert sum(s * s * n for s, n in inside.items()) <= (limits.max_cost or 10**9)
        for s, n in inside.items():
            placed[s] = placed.get(s, 0) + times * n
    assert placed == histogram
    if limits == Limits(64):
        assert sum(t for t, _ in plan) <= 1.02 * sum(s * n for s, n in histogram.items()) / 64 + 1
    assert set(placement(plan)) == set(histogram)


def test_a_piece_beyond_a_capacity_is_an_error():
    with pytest.raises(ValueError):
        best_fit({60: 1}, Limits(64, max_cost=100))


def test_pack_documents_against_the_contract(spark, tokenizer):
    rng = random.Random(2)
    texts = [None, "", "x"] + [" ".join(rng.choice(["alpha", "beta", "Ünder", "12", "..."]) for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["word " * 5000] + ["same text"] * 40
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "no id", 1, 2)], "doc_id long, text string, piece int, length int")
    rows = packing.pack_documents(docs, FILE, limits=Limits(256)).toPandas()
    bins: dict[int, list] = {}
    for r in rows.itertuples():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = rows[rows.id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own)))
        at = 0
        for r in own.itertuples():
            assert r.start == at and (r.length == 256 or r.piece == 0)
            assert r.crc == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len(bins) <= 1.03 * rows.length.sum() / 256 + 1
    assert packing.pack_documents(docs.limit(0), FILE).count() == 0


def test_long_chunks_are_not_remembered():
    memo = packing.ChunkMemo(open(FILE, encoding="utf-8").read())
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(10_000)) for _ in range(3)) for _ in range(100)]
    for text in texts:
        memo.ids(text)
    assert not memo
    memo.ids("a few short words")
    assert set(memo) == {"few", "short", "words"} and all(len(k) <= packing.MEMO_CHARS for k in memo)
