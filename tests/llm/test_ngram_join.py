"""The n-gram join: repeated ids, trees in blocks, and that the trees decide."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from linkforge.llm import ngram_join
from tests.llm.conftest import words
from tests.llm.test_llm import shingles


def classes(rows):
    """Least id reachable of each row, all pairs compared."""
    sets, least = [shingles(t) for _, t in rows], [i for i, _ in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return sorted((i, len(s), c) for (i, _), s, c in zip(rows, sets, least))


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs).collect())


def test_repeated_ids(spark):
    """Two texts under one id, each with a near copy of its own, in every order of the rows."""
    a, b = words(60, 1), words(60, 2)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a[:-1], "z"])), (8, " ".join([*b[:-1], "z"]))]
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        got = found(spark, order)
        assert got == classes(rows) and {r[2] for r in got} == {5}


def test_drop_by_text(spark):
    """Of two texts under one id only the near copy of an older one goes."""
    a, b = words(60, 1), words(60, 2)
    docs = spark.createDataFrame([(1, " ".join(a)), (5, " ".join([*a[:-1], "z"])), (5, " ".join(b)), (6, None), (7, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in ngram_join.drop_near_copies(docs).collect()} == {(1, " ".join(a)), (5, " ".join(b)), (6, None), (7, "")}


@pytest.mark.parametrize("block", [2048, 16])
def test_groups_and_chains(spark, monkeypatch, block):
    """A large group of near copies, a chain of copies of copies, texts that share a passage only; in one block and in many."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(0)
    base, chain, passage = words(80, 3), words(100, 4), words(30, 5)
    rows = []
    for _ in range(60):
        w = list(base)
        w[int(rng.integers(80))] = f"n{len(rows)}"
        rows.append((len(rows), " ".join(w)))
    for k in range(25):
        chain = [*chain[4:], *[f"c{k}x{j}" for j in range(4)]]
        rows.append((len(rows), " ".join(chain)))
    for k in range(40):
        rows.append((len(rows), " ".join([*passage, *words(int(rng.integers(5, 60)), 10 + k)])))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert found(spark, rows) == classes(rows)


def _batch(shingle_sets, extra):
    n = len(shingle_sets)
    vectors = [ngram_join._count_vector(s) for s in shingle_sets]
    node = [ngram_join._node(s) for s in shingle_sets]
    return node, pa.RecordBatch.from_pydict({"hub": pa.array([1] * n, pa.int64()), "block": pa.array([0] * n, pa.int64()), "node": pa.array(node, pa.int64()), **extra, "vector": pa.array(vectors, pa.binary())})


def test_trees_decide(monkeypatch):
    """In a tree of more than a leaf the search from the oldest point finds the near copies and leaves the rest; without it there are no pairs."""
    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**62, 100, dtype=np.uint64)
    near = [np.sort(np.append(base[:95], rng.integers(1, 2**62, 5, dtype=np.uint64))) for _ in range(30)]
    far = [np.sort(rng.integers(1, 2**62, 100, dtype=np.uint64)) for _ in range(30)]
    node, batch = _batch([*near, *far], {"rep": pa.array(range(60), pa.int64())})
    pairs = [set(zip(b["a"].to_pylist(), b["b"].to_pylist())) for b in ngram_join._covered(iter([batch]))][0]
    assert pairs == {(min(node[0], x), max(node[0], x)) for x in node[1:30]}
    _, batch = _batch([*near, *far], {"class": pa.array([*[k % 2 for k in range(30)], *range(100, 130)], pa.int64())})
    crossed = set().union(*[set(zip(b["a"].to_pylist(), b["b"].to_pylist())) for b in ngram_join._crossed(iter([batch]))])
    assert crossed == {(min(x, y), max(x, y)) for x in node[:30:2] for y in node[1:30:2]}
    monkeypatch.setattr(ngram_join.RTree, "near", lambda self, point: np.zeros(0, np.int64))
    monkeypatch.setattr(ngram_join.RTree, "pairs", lambda self, group=None: iter(()))
    assert not sum(len(b) for b in ngram_join._covered(iter([_batch([*near, *far], {"rep": pa.array(range(60), pa.int64())})[1]])))
    assert not sum(len(b) for b in ngram_join._crossed(iter([batch])))


def test_near_is_the_bound():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 12, (12, 128))
    points = (centres[rng.integers(0, 12, 300)] + rng.integers(0, 2, (300, 128))).astype(np.int32)
    tree, size = ngram_join.RTree(points), points.sum(axis=1)
    for k in range(0, 300, 17):
        met = (np.minimum(points, points[k]).sum(axis=1) >= -((-75 * (size + size[k])) // 175)) & (np.minimum(size, size[k]) * 100 >= 75 * np.maximum(size, size[k]))
        assert set(tree.near(k).tolist()) == set(np.flatnonzero(met).tolist())
