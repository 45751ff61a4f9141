"""Decomposition in blocks against the dense one."""

import numpy as np
import pytest

from linkforge.operators import block_svd, svd, tfidf


def test_against_dense(spark):
    names = spark.createDataFrame([(i, f"part {i * 37 % 101} kind {i * 13 % 17} x{i}") for i in range(200)], "id long, name string")
    weights = tfidf.fit(names, "id", "name").transform(names, "id", "name").cache()
    rows = weights.collect()
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    x = np.zeros((200, len(terms)))
    for r in rows:
        x[r["id"], terms[r["term"]]] = r["weight"]
    _, values, v = np.linalg.svd(x, full_matrices=False)
    # several blocks of terms and of rows
    own = block_svd.fit_blocks(weights, 12, passes=9, block_bytes=22 * 8 * 90)
    assert own.term_blocks > 2 and own.values == pytest.approx(values[:12], rel=0.005)
    got = np.array([r["vector"] for r in own.transform(weights).orderBy("id").collect()])
    assert np.diag(got.T @ got) == pytest.approx(own.values**2, rel=1e-3)
    # the same plane of the leading values as the dense one, and the same distances as the decomposition on one machine
    lead = got[:, :4] / np.linalg.norm(got[:, :4], axis=0)
    assert np.linalg.svd(lead.T @ (x @ v[:4].T / values[:4]), compute_uv=False).min() > 0.99
    other = np.array([r["vector"] for r in svd.fit(weights, 12, passes=9).transform(weights).orderBy("id").collect()])
    far = lambda a: np.linalg.norm(a[:, None] - a[None], axis=2)
    assert np.abs(far(got) - far(other)).max() < 0.05
    new = spark.createDataFrame([(7, "never met", 1.0), (8, rows[0]["term"], 2.0)], "id long, term string, weight double")
    found = {r["id"]: r["vector"] for r in own.transform(new).collect()}
    assert found[7] == [0.0] * 12 and any(found[8])


def test_no_weights_and_few(spark):
    none = spark.createDataFrame([], "id long, term string, weight double")
    assert len(block_svd.fit_blocks(none).values) == 0
    one = spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0)], "id long, term string, weight double")
    own = block_svd.fit_blocks(one)
    assert own.values == pytest.approx([5**0.5]) and {r["id"]: r["vector"] for r in own.transform(one).collect()} == {1: pytest.approx([2.0]), 2: pytest.approx([1.0])}
