import random

import pytest
import xxhash
from pyspark.sql import functions as F

from phonolith.llm import simhash
from phonolith.llm.common import LOWER_BYTES
from phonolith.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: {id: fp} -> {id: smallest id reachable}."""
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "Ärger", "été", "iota", "kappa"]
    rows = []
    for i in range(60):
        rows.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))))
    for i in range(40):
        base = rows[i % 20].split(" ")
        base[rng.randrange(len(base))] = rng.choice(words)
        rows.append(" ".join(base))
    return rows + [None, "", " \t\n", rows[3], rows[3], "one", "One", "a b", "long " * 30000]


def test_fingerprint_equals_the_plain_definition():
    for text in texts():
        assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_fingerprint_is_sparks_xxhash64(spark):
    row = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert simhash.fingerprint("A  b\tc") == row


@pytest.mark.parametrize("bucket", [256, 1])
def test_components_match_brute_force(spark, bucket):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(docs, bucket=bucket).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(fps)
    assert got == {i: (fps[i], want[i]) for i, _ in rows}


@pytest.mark.parametrize("bucket", [256, 2])
def test_links_find_every_close_pair(spark, bucket):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = set(centres)
    for c in centres:
        for _ in range(25):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(frame, bucket)).collect()}
    want = brute_components({x: x % 2**64 for x in signed})
    assert {x: found.get(x, x) for x in signed} == want


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "u long, v long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}


def test_keep_one_keeps_columns_and_one_of_each(spark):
    rows = [(5, "x y z w", "p", 1), (3, "x y z w", None, 2), (3, "x y z w", None, 2), (None, "x y z w", "q", 3), (9, "something else entirely here", "r", 4), (None, None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    got = sorted(simhash.keep_one(docs).collect(), key=str)
    assert len(got) == 3 and {tuple(r) for r in got} == {(3, "x y z w", None, 2), (9, "something else entirely here", "r", 4), (None, None, None, 5)}
    assert simhash.keep_one(docs.limit(0)).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_looked_up_segments_are_never_broadcast(spark, monkeypatch, tmp_path):
    """Estimates leave out that a fingerprint looks up 34 segments, so its rows would all go through the driver."""
    plans, write = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), write(df, name))[1])
    rng = random.Random(3)
    spark.createDataFrame([(rng.getrandbits(62),) for _ in range(300)], "fp long").write.parquet(f"{tmp_path}/fps")
    simhash.links(spark.read.parquet(f"{tmp_path}/fps")).count()
    # The join that verifies distances; below it the small counts of full segments may be broadcast.
    found = [next(line for line in p.splitlines() if "Join" in line) for p in plans if "bit_count" in p]
    assert found and all("SortMergeJoin" in line for line in found)
