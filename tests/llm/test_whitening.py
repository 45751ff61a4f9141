"""Whitening against dense eigenvectors."""

import numpy as np
import pytest

from linkforge.llm import whitening


def dense(vectors, k=4):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors], object)
    distinct = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (distinct * n - sums).astype(float) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    held = values > 1e-12 * values.sum()
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x.tolist()]
    total = np.trace(centred.T @ centred) / n
    return n, deviation, ((x * n - sums).astype(float) / n) @ components[:, held] / np.sqrt(values[held]), values[held] / total


def check(spark, vectors, ids=None, kind="float"):
    df = spark.createDataFrame([(i if ids is None else ids[i], v, 7, 1) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, n long, x long")
    rows = whitening.whiten(df).orderBy("vec_id", "component").collect()
    return df, rows


@pytest.mark.parametrize("dim", [3, 8, 40, 90])
def test_against_dense(spark, dim):
    rng = np.random.default_rng(dim)
    x = (rng.standard_normal((300, dim)) * np.linspace(2, 0.5, dim)).astype(np.float32).astype(float)
    vectors = [[float(c) for c in r] for r in np.vstack([x, x[:40], x[:1].repeat(100, axis=0)])]
    n, deviation, white, explained = dense(vectors)
    _, rows = check(spark, vectors)
    k = min(4, dim)
    assert len(rows) == k * len(vectors) and {r["n"] for r in rows} == {n} and n == 300
    got = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-9
    assert [r["deviation"] for r in rows[::k]] == deviation
    assert np.allclose([r["explained"] for r in rows[:k]], explained, rtol=1e-9)
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_odd_rows(spark):
    """Nulls, entries that aren't finite or too large, another length, ids that repeat or lack, clashing columns, negative zero."""
    rng = np.random.default_rng(0)
    good = [[float(c) for c in r] for r in rng.standard_normal((30, 5))] + [[-0.0, 0.0, 1.0, 2.0, 3.0]]
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] + [0.0] * 4, [1e300] * 5, [1.0, 2.0]]
    ids = [None, None, 1, 1, *range(100, 100 + len(good + odd) - 4)]
    _, rows = check(spark, good + odd, ids, "double")
    n, deviation, white, explained = dense(good)
    assert len(rows) == 4 * len(good) and rows[0]["n"] == n
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(deviation)
    assert sum(r["vec_id"] is None for r in rows) == 8 and sum(r["vec_id"] == 1 for r in rows) == 8


def test_few_rows_and_few_directions(spark):
    assert check(spark, [[1.0, 2.0], [1.0, 2.0]])[1] == []
    assert check(spark, [])[1] == []
    _, rows = check(spark, [[0.0, 1.0, 5.0], [1.0, 1.0, 5.0], [3.0, 1.0, 5.0]])
    assert [r["component"] for r in rows] == [1, 1, 1] and rows[0]["explained"] == pytest.approx(1)
    assert np.var([r["whitened"] for r in rows]) == pytest.approx(1)


def test_exact_sums_and_large_entries(spark):
    big = float(1 << 40)
    vectors = [[big, 1.0], [-big, 2.0], [big - 1, 4.0]]
    _, rows = check(spark, vectors, kind="double")
    n, deviation, _, _ = dense(vectors)
    assert [r["deviation"] for r in rows[:: len(rows) // 3]] == [d if d < 1 << 63 else None for d in deviation]
    fit = whitening.on_grid(spark.createDataFrame([(0, [big]), (1, [big]), (2, [0.5])], "i long, v array<double>"), "i", "v")
    assert whitening.exact_sums(fit) == (3, [2 * 256 * (1 << 40) + 128])
