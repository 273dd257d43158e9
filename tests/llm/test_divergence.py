import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from phonolith.llm import divergence, registry

SCHEMA = "doc_id long, text string, lang string, source string, n string, term int, rank int"


def rows_of(spark, docs):
    """Extra columns have the names of the operator's own."""
    return spark.createDataFrame([(i, *d, "x", 1, 2) for i, d in enumerate(docs)], SCHEMA)


def brute(docs, min_docs=10, top=10):
    counts, within, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts.update((lang, source, w) for w in found)
        within.update((lang, w) for w in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), n in within.items() if x == lang and n >= min_docs)
        own = sorted(s for x, s in groups if x == lang)
        share = lambda table: {w: 1 + 10**9 * (table[w] + 2) // (sum(table.values()) + 2 * len(kept)) for w in kept}
        tables = {s: {w: counts[lang, s, w] for w in kept} for s in own}
        p = {s: share(t) for s, t in tables.items()}
        q = share({w: sum(t[w] for t in tables.values()) for w in kept})
        value = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(o, sum(value(p[s][w], p[o][w]) for w in kept)) for o in own if o != s]
            terms = [(w, value(p[s][w], q[w])) for w in kept if tables[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def docs_of(seed, n=300, sources=9, vocabulary=60):
    random = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocabulary)] + ["ÄRGER", "ärger", "Été", "naïve", "日本", "A", "a", "B1c"]
    docs = []
    for i in range(n):
        own = random.zipf(1.3, random.integers(0, 40)) % len(words)
        docs.append((" ,".join(words[w] for w in own), ("en", "de", None)[random.integers(0, 3)], None if i % 17 == 0 else f"s{random.integers(0, sources)}"))
    return docs + [(None, "en", "s1"), ("", None, None), ("1234 \x00\t", "xx", "alone"), ("word " * 30, "xx", "other"), docs[0], docs[0]]


@pytest.mark.parametrize("chunk,cells", [(512, 32_768), (2, 40), (4, 1)])
def test_equals_the_definition(spark, chunk, cells):
    docs = docs_of(1)
    assert found(divergence.audit(rows_of(spark, docs).repartition(5), chunk=chunk, cells=cells)) == brute(docs)


def test_small_limits(spark, monkeypatch):
    docs = docs_of(2, n=60)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert found(divergence.audit(rows_of(spark, docs), min_docs=2, top=3)) == brute(docs, 2, 3)


def test_edge_cases(spark):
    assert found(divergence.audit(rows_of(spark, []))) == []
    # No kept terms: pairs of value 0, ranked by name; one source: nothing.
    docs = [("one two", "en", "b"), (None, "en", "a"), ("three", "en", None), ("four", "fr", "z")]
    assert found(divergence.audit(rows_of(spark, docs))) == brute(docs)
    assert [r[3:] for r in brute(docs) if r[1] == "b"] == [("", 0, 1), ("a", 0, 2)]
    # A very long text counts as one document.
    long = [("mot " * 400_000 + "rare", "fr", "x")] + [("mot rare autre", "fr", "y")] * 10
    assert found(divergence.audit(rows_of(spark, long))) == brute(long)


def test_shares_are_exact():
    counts = np.array([[0, 5, 10**15, 9_000_000_000_000_000]], np.int64)
    totals = np.full((1, 1), 9_200_000_000_000_000)
    assert divergence.shares(counts, totals)[0].tolist() == [1 + 10**9 * (int(c) + 2) // 9_200_000_000_000_000 for c in counts[0]]
    with pytest.raises(OverflowError):
        divergence.shares(np.array([[10**16]]), np.array([[10**16]]))


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    wanted = sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({registry.ORACLE['op13_source_divergence']})").fetchall())
    got = found(registry.QUERIES["op13_source_divergence"](spark, sf))
    assert got == wanted
    docs = con.sql("SELECT text, lang, source FROM documents").fetchall()
    assert got == brute(docs)
