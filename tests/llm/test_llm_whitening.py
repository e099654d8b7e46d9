from __future__ import annotations

import math

import numpy as np
import pytest

from tillroll.llm import bidiagonal, whitening


def check_pairs(a):
    d = a.shape[1]
    values, vectors = bidiagonal.singular_pairs(whitening.reduced(a, d))
    expected = np.linalg.svd(a, compute_uv=False)
    expected = np.append(expected, np.zeros(d - len(expected)))
    assert np.abs(values - expected).max() <= 1e-14 * max(expected[0], 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
    assert np.abs(a.T @ (a @ vectors) - vectors * values**2).max() <= 1e-13 * max(expected[0] ** 2, 1e-300)
    return values


@pytest.mark.parametrize("d", [1, 2, 3, 16, 64])
def test_random_factors(d):
    check_pairs(np.random.default_rng(d).standard_normal((3 * d + 2, d)))


def test_close_equal_zero_and_graded_values():
    rng = np.random.default_rng(1)
    left = np.linalg.qr(rng.standard_normal((300, 40)))[0]
    right = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    check_pairs(left @ np.diag(np.r_[5 + 1e-9 * np.arange(5), 3 + 1e-13 * np.arange(10), np.ones(25)]) @ right)
    check_pairs(left @ np.diag(np.r_[np.full(20, 2.0), np.full(20, 1.0)]) @ right)
    check_pairs(np.repeat(rng.standard_normal((50, 6)), 2, axis=1))
    check_pairs(np.hstack([rng.standard_normal((50, 4)), np.zeros((50, 3))]))
    check_pairs(np.eye(9))
    check_pairs(np.zeros((4, 4)))
    check_pairs(rng.standard_normal((3, 8)))


def test_dqds_keeps_small_values_relatively_accurate():
    a = np.logspace(0, -30, 12)
    b = 0.3 * a[1:]
    squares = bidiagonal.dqds((a * a).tolist(), (b * b).tolist())
    from fractions import Fraction

    product = math.prod(Fraction(float(x)) ** 2 for x in a)
    assert abs(float(math.prod(map(Fraction, squares)) / product) - 1) < 1e-13


def brute_force(vectors):
    """n, sums, trace and covariance of the distinct vectors, and every row's exact deviation."""
    steps = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, steps))), dtype=object)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    deviation = [sum((n * x - s) ** 2 for x, s in zip(v, sums)) for v in steps]
    centred = (np.array(fit, dtype=np.float64) - np.array([s / n for s in sums]))
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return steps, n, sums, deviation, values[::-1], directions[:, ::-1]


def check_rows(vectors, rows, k):
    steps, n, sums, deviation, values, directions = brute_force(vectors)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by) == k * len(vectors)
    for c in range(k):
        expected = (np.array(steps, dtype=np.float64) - np.array([s / n for s in sums])) @ directions[:, c] / math.sqrt(values[c])
        got = np.array([by[i, c + 1].whitened for i in range(len(vectors))])
        assert min(np.abs(got - expected).max(), np.abs(got + expected).max()) < 1e-8
        assert by[0, c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    for i, value in enumerate(deviation):
        assert (by[i, 1].n, int(by[i, 1].deviation)) == (n, value)
    assert rows[0].identity_error < 1e-9


def test_query_against_eigenvectors_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    rows = whitening.op13_whitening(spark, sf).collect()
    assert [r.vec_id for r in given] == list(range(len(given)))
    check_rows([r.embedding for r in given], rows, 4)


SCHEMA = "vec_id long, embedding array<float>, x string, part string, n int"


def test_rows_in_many_partitions_with_repeats_and_left_out_ones(spark):
    rng = np.random.default_rng(7)
    vectors = (rng.standard_normal((500, 5)) * [3, 2, 1, 0.5, 0.1]).astype(np.float32).tolist()
    vectors += vectors[:200] + [vectors[0]] * 300
    data = [(i, v, "x", "p", 1) for i, v in enumerate(vectors)]
    bad = [None, [1.0, None, 1.0, 1.0, 1.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [1.0] * 4, []]
    data += [(10_000 + i, v, None, None, None) for i, v in enumerate(bad)]
    df = spark.createDataFrame(data, SCHEMA).repartition(23)
    check_rows(vectors, whitening.whiten(df).collect(), 4)


def test_factors_meet_in_small_groups(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (400, 6))
    fit = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(11)
    mean = x.mean(axis=0)
    r = whitening.triangular_factor(fit, mean, fan=2)
    scatter = (x - mean).T @ (x - mean)
    assert np.abs(r.T @ r - scatter).max() < 1e-9 * np.abs(scatter).max()


def test_edge_rows(spark):
    def run(data):
        rows = whitening.whiten(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
        return sorted((r.vec_id if r.vec_id is not None else -1, r.component, r.n, r.deviation, r.whitened) for r in rows)

    assert run([]) == []
    assert run([(1, None), (2, [math.nan])]) == []
    assert run([(1, []), (2, [])]) == []
    assert run([(1, [0.5, 1.0])]) == [(1, 1, 1, 0, None), (1, 2, 1, 0, None)]
    wide = 2**60 + 1
    got = run([(None, [1.0, 0.0]), (wide, [-1.0, 0.0]), (wide, [-1.0, 0.0])])
    assert [(i, c, n, int(v)) for i, c, n, v, _ in got] == [
        (-1, 1, 2, 512**2), (-1, 2, 2, 512**2),
        (wide, 1, 2, 512**2), (wide, 1, 2, 512**2), (wide, 2, 2, 512**2), (wide, 2, 2, 512**2),
    ]
    assert [w for i, c, *_, w in got if c == 2] == [None] * 3
    assert [abs(w) for i, c, *_, w in got if c == 1] == pytest.approx([1.0] * 3)
    huge = run([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])])
    assert all(v is None or v < 10**38 for *_, v, _ in huge) and len(huge) == 6
