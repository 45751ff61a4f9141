"""Links among embeddings: repeated ids, planted near copies, a large group."""

import numpy as np
import pytest

from linkforge.llm import embed_lattice


def found(spark, rows):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return [tuple(r) for r in embed_lattice.link_embeddings(df).select("vec_id", "n_links", "component_id", "kept").collect()]


def brute_force(rows):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    least = np.array([i for i, _ in rows])
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], 2**62).min(axis=1))
        if (new == least).all():
            break
        least = new
    return sorted((i, int(n), int(c), i == c) for (i, _), n, c in zip(rows, linked.sum(axis=1), least))


def test_two_vectors_of_one_id(spark):
    """(1, v), (1, w) with near copies of each: every row has the one link that is its own, in every order."""
    rng = np.random.default_rng(0)
    v, w = rng.standard_normal((2, 64))
    rows = [(1, v), (1, w), (2, v + 0.01 * rng.standard_normal(64)), (3, w + 0.01 * rng.standard_normal(64))]
    for order in (rows, rows[::-1]):
        assert sorted(found(spark, order)) == brute_force(rows) and {r[1] for r in found(spark, order)} == {1}


@pytest.mark.parametrize("size", [16, 256])
def test_planted_near_copies(spark, size):
    """Clusters with pairs near the threshold: no pair below it is linked, and nine in ten above it are found, by far."""
    rng = np.random.default_rng(size)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(size)
        spread = (0.15, 0.2, 0.25)[c % 3]
        rows += [(len(rows) + k, centre + spread * rng.standard_normal(size)) for k in range(6)]
    want, got = brute_force(rows), sorted(found(spark, rows))
    assert sum(r[1] for r in want) > 300
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.97 * len(rows)


def test_large_group_of_copies(spark):
    """A third of all rows is one vector: its pairs aren't made, and each row counts the others."""
    rng = np.random.default_rng(1)
    one = rng.standard_normal(32)
    rows = [(i, one if i % 3 == 0 else rng.standard_normal(32)) for i in range(300)]
    assert sorted(found(spark, rows)) == brute_force(rows)
