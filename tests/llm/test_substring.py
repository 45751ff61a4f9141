"""The parse against a reference: greedy factors, compared words, colliding hashes."""

import numpy as np
import pyarrow as pa

from linkforge.llm import substring
from linkforge.llm.words import split
from tests.llm.conftest import words


def reference(passages):
    """Passages (document, first word, words) as the blocks get them."""
    heads, hashes = [], []
    for doc, first, w in passages:
        part = next(split(pa.array([" ".join(w)]), lower=False))
        heads.append(np.array([doc, first, len(w)], np.int64))
        hashes.append(part.hashes)
    return substring.Reference([(np.concatenate(heads).tobytes(), np.concatenate(hashes).tobytes())])


def parsed(ref, w, owner):
    part = next(split(pa.array([" ".join(w)]), lower=False))
    hashes = substring.windows(part.hashes, substring.WINDOW)
    hit, entry = ref.found(hashes, np.full(len(hashes), owner))
    at = np.flatnonzero(hit)
    return ref.parse(part.hashes, at, entry[at])


def test_greedy_factors():
    a, b, c = words(120, 1), words(120, 2), words(40, 3)
    ref = reference([(1, 10, a), (2, 0, b)])
    # 70 words of a go over into 80 of b; then what is known to nobody; then 60 of a
    text = [*a[20:90], *b[30:110], *c, *a[:60]]
    assert parsed(ref, text, 9) == [(0, 70, 1, 30), (70, 80, 2, 30), (190, 60, 1, 10)]
    assert parsed(ref, text, 2) == [(0, 70, 1, 30), (190, 60, 1, 10)] and parsed(ref, text, 1) == []
    # a factor's end is looked at from all windows across it: two passages that overlap in the text
    joint = words(100, 5)
    ref = reference([(1, 0, joint[:70]), (2, 0, joint[30:])])
    assert parsed(ref, joint, 9) == [(0, 70, 1, 0), (30, 70, 2, 0)]
    assert parsed(ref, joint[:49], 9) == []


def test_words_are_compared(monkeypatch):
    """With one hash for all windows nothing is removed that doesn't stand in the reference."""
    a, b = words(120, 1), words(120, 2)
    monkeypatch.setattr(substring, "windows", lambda hashes, n: np.full(max(0, len(hashes) - n + 1), 7, np.uint64))
    ref = reference([(1, 0, a)])
    assert parsed(ref, b, 9) == []
    for first, n, doc, ref_first in parsed(ref, [*b[:40], *a], 9):
        assert [*b[:40], *a][first : first + n] == a[ref_first : ref_first + n] and doc == 1


def test_passage_of_many_documents(spark):
    """A third of all documents share a passage; the smallest keeps it, and ids that repeat are no reference for each other."""
    passage = words(55, 7)
    rows = [(i, " ".join([*words(30, 100 + i), *(passage if i % 3 == 0 else words(20, 500 + i)), *words(25, 300 + i)])) for i in range(3, 90)]
    rows += [(2, " ".join(passage)), (2, " ".join([*passage, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["n_words"]): r for r in substring.remove_repeats(docs).collect()}
    for i, t in rows:
        r = got[i, len(t.split())]
        assert r["n_removed"] == (55 if i % 3 == 0 and i > 2 else 0)
        assert [f["ref_doc"] for f in r["factors"]] == ([2] if r["n_removed"] else [])
