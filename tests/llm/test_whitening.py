import math

import numpy as np
import pytest

from phonolith.llm import whitening

SCHEMA = "vec_id long, label int, component int, embedding array<float>, n string"


def rows_of(spark, vectors, ids=None):
    """Extra columns have the names of the result's."""
    return spark.createDataFrame([(i if ids is None else ids[i], 0, 7, v, "x") for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors):
    """(n, deviations by place, eigenvalues, eigenvectors, means) of the definition, in whole numbers."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, dims = len(fit), range(len(fit[0]))
    sums = [sum(v[d] for v in fit) for d in dims]
    deviations = [sum((n * v[d] - sums[d]) ** 2 for d in dims) for v in x]
    covariance = np.array([[sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in fit) / n**3 for b in dims] for a in dims])
    values, vectors = np.linalg.eigh(covariance)
    return n, deviations, values[::-1], vectors[:, ::-1], np.array(sums) / n, np.array(x)


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_the_definition(spark, parts):
    random = np.random.default_rng(3)
    mixed = random.standard_normal((300, 6)) @ random.standard_normal((6, 6)) * 0.4
    vectors = [list(map(float, v)) for v in mixed] + [list(map(float, mixed[0]))] * 150
    got = whitening.whitened(rows_of(spark, vectors).repartition(parts)).collect()
    n, deviations, values, basis, means, x = brute(vectors)
    assert len(got) == 450 * 4 and n == 300
    assert {r["n"] for r in got} == {n}
    assert all(r["deviation"] == deviations[r["id"]] for r in got)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    for k in range(4):
        own = sorted((r for r in got if r["component"] == k + 1), key=lambda r: r["id"])
        wanted = (x - means) @ basis[:, k] / math.sqrt(values[k])
        white = np.array([r["whitened"] for r in own])
        assert min(np.abs(white - wanted).max(), np.abs(white + wanted).max()) < 1e-9
        assert own[0]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-12)


def test_merging_equals_one_summary():
    random = np.random.default_rng(5)
    x = random.integers(-100, 100, (500, 5)) + 10**6
    whole = whitening.summary(x)
    parts = [whitening.summary(p) for p in np.split(x, [1, 7, 200, 333])]
    merged = parts[0]
    for p in parts[1:]:
        merged = whitening.merged(merged, p)
    assert merged.n == 500 and list(merged.sums) == list(x.sum(axis=0)) == list(whole.sums)
    assert np.abs(merged.scatter - whole.scatter).max() < 1e-12 * np.trace(whole.scatter) and np.allclose(merged.mean, x.mean(axis=0), rtol=1e-14)


def test_rows_that_take_no_part(spark):
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 2.0, 3.0]]
    good = [[0.0, 1.0], [0.5, 1.0], [0.5, -0.0], [0.5, 0.0], [1.0, 0.25]]
    got = whitening.whitened(rows_of(spark, bad + good, ids=[*range(10), None])).collect()
    assert sorted({r["id"] for r in got if r["id"] is not None}) == [6, 7, 8, 9] and len(got) == 5 * 2
    # -0.0 and 0.0 are one vector.
    assert {r["n"] for r in got} == {4}


def test_without_variance(spark):
    got = whitening.whitened(rows_of(spark, [[1.0, 2.0, 3.0]] * 3)).collect()
    assert len(got) == 9 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, 0.0, 0.0)}
    two = whitening.whitened(rows_of(spark, [[0.0, 0.0], [1.0, 1.0]])).collect()
    assert sorted(abs(r["whitened"]) for r in two if r["component"] == 1) == pytest.approx([1, 1])
    assert {r["whitened"] for r in two if r["component"] == 2} == {None}


def test_empty_and_huge(spark):
    assert whitening.whitened(rows_of(spark, [])).collect() == []
    assert whitening.whitened(rows_of(spark, [None, []])).collect() == []
    far = [[3.0e38, 0.0], [-3.0e38, 1.0], [0.0, 5.0]]
    got = whitening.whitened(rows_of(spark, far)).collect()
    # Sums of -1 and 1536: the last row's deviation fits.
    assert len(got) == 6 and {(r["id"], r["deviation"]) for r in got} == {(0, None), (1, None), (2, 1 + 2304**2)}
    # Beyond 64 bits on the way, but not at the end.
    model = whitening.Whitening(3, np.array([1 << 62, 0], object), np.eye(2), np.ones(2), np.ones(2))
    x = np.array([[1 << 61, 5]])
    assert list(model.deviations(x)[0]) == [3 * (1 << 61) - (1 << 62), 15]


def test_codes_are_equal_for_equal_vectors_only():
    x = np.array([[0, 1], [0, 200], [0, 1], [70000, 0], [1 << 40, 0], [-128, 127], [-129, 127]])
    _, codes = whitening._encoded(x / 256)
    assert len(set(codes)) == 6 and codes[0] == codes[2]
    assert np.array_equal(whitening._decoded(codes, 2), x)
