"""The registered queries themselves, over the smallest tables, against the contract written out plainly."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from phonolith.llm import registry

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\f\r":
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def test_op2_simhash(spark, texts):
    got = registry.QUERIES["op2_simhash_near_dedup"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = {}
    for i, text in texts.items():
        own = words((text or "").translate(LOWER))
        shingles = [" ".join(own[k : k + 3]) for k in range(len(own) - 2)] if len(own) >= 3 else [" ".join(own)] * bool(own)
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.collect()} == {i: (f"{prints[i]:016x}", find(i)) for i in texts}


def test_op3_token_counts(spark, texts):
    got = registry.QUERIES["op3_token_counts"](spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_tokens"]
    assert {r["doc_id"]: r["n_words"] for r in got.collect()} == {i: len(words(t)) for i, t in texts.items()}


def test_op5_base_columns(spark, texts):
    got = registry.QUERIES["op5_quality_rules"](spark, SF)
    for r in got.collect():
        text, own = texts[r["doc_id"]] or "", words(texts[r["doc_id"]])
        at = defaultdict(list)
        for k in range(len(own) - 7):
            at[tuple(own[k : k + 8])].append(k)
        again = len({x for places in at.values() if len(places) > 1 for k in places for x in range(k, k + 8)})
        lines = [line for line in text.split("\n") if words(line)]
        want = (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), again)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(own) < 20 or 100 * again > 30 * len(own)) and not (r["kept"] and r["base_failed"])


def test_op10_packing(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = registry.QUERIES["op10_best_fit_packing"](spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in got.collect():
        pieces[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own, at = pieces[i], 0
        total += len(ids)
        assert sorted(own) == list(range(-(-len(ids) // 1024)))
        for k in sorted(own):
            r = own[k]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and (k == 0 or r["length"] == 1024)
            at += r["length"]
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) * 1.02 + 1


@pytest.mark.parametrize("name", ["op1_benchmark_decontamination", "op7_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    want = con.sql(registry.ORACLE[name])
    got = registry.QUERIES[name](spark, SF)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
