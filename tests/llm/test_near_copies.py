"""Near copies of the pipeline against brute force over all pairs."""

import random
from itertools import combinations

import corpus_pipeline
import pytest
from phonolith.llm import near_copies as N


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def groups(rows):
    """The smallest id of each row's group, by all pairs."""
    sets, root = [N.shingles(N.words(t)) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if N.similar(sets[i], sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_near_copies_go_in_the_pipeline_stage(spark):
    rng, rows = random.Random(5), []
    for base in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 50, 120, 400]))]
        rows += [(len(rows) + k, edited(rng, words, e)) for k, e in enumerate([0, *rng.choices([0, 1, 2, 4, 9, 40], k=3)])]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "one three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    assert 60 < len(want) < 200


@pytest.mark.parametrize("few", [2, 16])
def test_a_large_group_of_edited_copies(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW", few)
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = [(7, " ".join(words)), *((10 + i, edited(rng, words, 1 + i % 2)) for i in range(60)), (99, "others entirely " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: r["root"] for r in N.near_copies(docs).collect()}
    assert len({found[i] for i, _ in rows[:-1]}) == 1 and found[99] != found[7]


def templated(rng, shared, own, pairs, more):
    """Texts of a common template; of each pair the texts also share ``more`` words."""
    body = [f"t{i}" for i in range(shared)]
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(pairs):
        common = fresh(more)
        rows += [(2 * i + k, " ".join(body + common + fresh(own - more))) for k in (0, 1)]
    return rows


def similarity(a, b):
    a, b = (set(N.shingles(N.words(t)).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("pairs", [300, 1000])
def test_pairs_on_a_background_just_below_the_threshold(spark, pairs):
    """Each text is nearly as similar to all others as to its partner, and all have the template's shingles in their prefixes."""
    rows = templated(random.Random(8), 400, 50, pairs, 7)
    assert 0.77 < similarity(rows[0][1], rows[2][1]) < 0.8 <= similarity(rows[0][1], rows[1][1]) < 0.83
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: r["root"] for r in N.near_copies(docs).collect()}
    recall = sum(found[2 * i] == found[2 * i + 1] for i in range(pairs)) / pairs
    assert recall == 1.0 and len(set(found.values())) == pairs


def test_groups_of_edited_copies_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 4)
    monkeypatch.setattr(N, "BLOCK", 8)
    for seed, size, edits in ((1, 60, 3), (2, 100, 5), (3, 30, 2)):
        rng, rows = random.Random(seed), []
        start = [f"w{rng.randrange(400)}" for _ in range(size)]
        for i in range(150):
            source = start if not rows or rng.random() < 0.3 else rng.choice(rows)[1].split()
            rows.append((i, edited(rng, source, rng.randrange(edits + 1))))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r["doc_id"] for r in N.keep_near(docs).collect()}
        assert got == groups(rows) and 3 < len(got)


def test_filters_lose_nothing():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 120)
        a = set(range(n))
        b = (a - set(rng.sample(sorted(a), rng.randrange(0, n // 4 + 1)))) | set(range(1000, 1000 + rng.randrange(0, n // 4 + 1)))
        order = rng.sample(sorted(a | b), len(a | b))
        front = lambda x: set(sorted(x, key=order.index)[: N.prefix_size(len(x))])  # noqa: E731, B023
        c, t = len(front(a) & front(b)), N.overlaps(len(a), len(b))
        assert (len(a & b) >= t) == (5 * len(a & b) >= 4 * len(a | b))
        if len(a & b) >= t:
            assert c >= 1 and c + max(len(x) - N.prefix_size(len(x)) for x in (a, b)) >= t


def test_edge_cases(spark):
    schema = "doc_id long, text string, fp string, part int, token long"
    assert N.near_copies(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(f"w{i % 70_001}" for i in range(300_000))
    texts = [(1, None), (2, ""), (None, " "), (None, None), (3, "a b"), (3, "A\tb"), (4, long), (5, long + " end"), (6, "b a")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], schema)
    found = {}
    for r in N.near_copies(docs).collect():
        found.setdefault(r["root"], []).append(r["id"])
    assert sorted((sorted(map(str, g)) for g in found.values())) == [["1", "2", "None", "None"], ["3", "3"], ["4", "5"], ["6"]]
    kept = N.keep_near(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6]
