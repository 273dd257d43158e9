import numpy as np
import pytest

from phonolith.llm import ann

SCHEMA = "vec_id long, embedding array<float>, q int, ids string, nth long"


def rows_of(spark, vectors, ids=None):
    """Extra columns have the names of the operator's own."""
    return spark.createDataFrame([(i if ids is None else ids[i], v, 1, "x", 2) for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, ids, step, k):
    """[(query id, answers)] of each query row, of its k best other rows."""
    good = [i for i, v in enumerate(vectors) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([np.float32(vectors[i]) for i in good], dtype=float)
    out = []
    for at, i in enumerate(good):
        if ids[i] is not None and ids[i] % step == 0:
            scores = x @ x[at]
            rest = [(-s, float("inf") if ids[j] is None else ids[j], ids[j]) for s, j in zip(scores, good) if j != i]
            out.append((ids[i], [(r[2], -r[0]) for r in sorted(rest, key=lambda r: r[:2])[:k]]))
    return out


def answers(got):
    """The same of the operator's rows; equal ids' answers are told apart by their ranks' order."""
    out = {}
    for r in got:
        out.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["vec_id"], r["score"]))
    return out


def same(got, wanted):
    found = answers(got)
    assert sorted(found) == sorted({q for q, _ in wanted})
    for q in found:
        for rank in range(1, max(len(a) for _, a in wanted) + 1):
            expected = sorted((a[rank - 1] for w, a in wanted if w == q and len(a) >= rank), key=str)
            have = sorted(found[q].get(rank, []), key=str)
            assert [x[0] for x in have] == [x[0] for x in expected]
            assert [x[1] for x in have] == pytest.approx([x[1] for x in expected], rel=1e-12, abs=1e-12)


def test_exact_below_two_partitions(spark):
    random = np.random.default_rng(1)
    vectors = [list(map(float, v)) for v in random.integers(-3, 4, (120, 4))]  # many ties
    vectors += [None, [], [None, 1.0, 2.0, 3.0], [float("nan")] * 4, [0.0] * 4, [1.0, 2.0]]
    vectors += [vectors[7]] * 40 + [[3.0, 3.0, 3.0, 3.0]] * 30
    ids = list(range(len(vectors)))
    ids[30], ids[31], ids[32] = 20, 20, None  # a query's id thrice, and a null one
    wanted = brute([v if v is None or len(v) == 4 else None for v in vectors], ids, 20, 20)
    same(ann.nearest(rows_of(spark, vectors, ids)).collect(), wanted)


def test_all_candidates_if_fewer(spark):
    vectors = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    same(ann.nearest(rows_of(spark, vectors)).collect(), brute(vectors, [0, 1, 2], 20, 20))
    assert ann.nearest(rows_of(spark, [[1.0, 0.0]])).collect() == []
    assert ann.nearest(rows_of(spark, [])).collect() == []
    assert ann.nearest(rows_of(spark, [None, [0.0]])).collect() == []


def test_recall_over_partitions(spark):
    random = np.random.default_rng(2)
    centres = random.standard_normal((30, 16))
    x = centres[random.integers(0, 30, 4000)] + 0.5 * random.standard_normal((4000, 16))
    x[3000:3400] = x[0]  # one very common vector
    vectors = [list(map(float, v)) for v in x]
    got = answers(ann.nearest(rows_of(spark, vectors), per_part=256, sample=2000, target=0.95).collect())
    hit = 0
    wanted = brute(vectors, list(range(4000)), 20, 20)
    for q, expected in wanted:
        mine = {r: found[0] for r, found in got[q].items()}
        assert sorted(mine) == list(range(1, 21)) and q not in {i for i, _ in mine.values()}
        hit += len({i for i, _ in mine.values()} & {i for i, _ in expected})
        assert [s for _, s in (mine[r] for r in range(1, 21))] == sorted((s for _, s in mine.values()), reverse=True)
    assert hit / (20 * len(wanted)) >= 0.9
    # Copies of one vector are equally near, so the smallest ids are the answer.
    assert [i for i, _ in (v[0] for _, v in sorted(got[3000].items()))] == [i for i, _ in dict(wanted)[3000]]


def test_queries_with_too_few_rows_search_everywhere(spark, monkeypatch):
    random = np.random.default_rng(4)
    vectors = [list(map(float, v)) for v in random.standard_normal((300, 3))]
    monkeypatch.setattr(ann, "fitted", lambda s, x, parts, k, target: ann.Router((np.eye(3, 3, dtype=np.float32), np.zeros(3, np.float32), np.eye(3, 64, dtype=np.float32) * 9, np.linspace(0, -9, 64, dtype=np.float32)), 64, 1))
    got = ann.nearest(rows_of(spark, vectors), per_part=4).collect()
    assert len(got) == 15 * 20
    found = ann.nearest(rows_of(spark, vectors), k=200, per_part=4).collect()
    same(found, brute(vectors, list(range(300)), 20, 200))


def test_partitions_are_balanced_and_cut_few_edges():
    random = np.random.default_rng(6)
    group = np.repeat(np.arange(4), 64)
    near = np.array([random.choice(np.flatnonzero(group == g), 6) for g in group])
    part = ann.partitioned(near, 4, random)
    assert sorted(np.bincount(part)) == [64] * 4
    assert (part[near] == part[:, None]).mean() > 0.95
