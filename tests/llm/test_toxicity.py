"""The Kneser-Ney models against counts made one by one, and the scale."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from linkforge.llm import toxicity


def brute_force(rows):
    """Ratios of words and stems from lists of pairs."""
    pairs = {}
    for i, t, x in rows:
        if zlib.crc32(str(i).encode()) % 5 > 1:
            for p in itertools.pairwise(["", *t.split()]):
                pairs.setdefault(p, set()).add(x)
    words, stems = {}, {}
    for (_, w), classes in pairs.items():
        for table, key in ((words, w), (stems, w[:5])):
            c = table.setdefault(key, [0, 0, 0])
            c[0] += 1
            c[1] += 1 in classes
            c[2] += 0 in classes
    all_of = [sum(c[k] for c in words.values()) for k in (1, 2)]
    discount, kept, left = {}, {}, {}
    for name, table in (("word", words), ("stem", stems)):
        for k in (1, 2):
            one, two = (sum(c[k] == j for c in table.values()) for j in (1, 2))
            d = one / (one + 2 * two) if one else 0.5
            kept[name, k] = {key: (c[k] - d if c[k] > 3 else 0) / all_of[k - 1] for key, c in table.items()}
            left[name, k] = 1 - sum(kept[name, k].values())
    shared = {key: (c[0] + 1) / (len(pairs) + len(stems) + 1) for key, c in stems.items()}
    p_stem = {k: {key: kept["stem", k][key] + left["stem", k] * shared[key] for key in stems} for k in (1, 2)}
    p_word = {k: {w: kept["word", k][w] + left["word", k] * p_stem[k][w[:5]] * c[0] / stems[w[:5]][0] for w, c in words.items()} for k in (1, 2)}
    base = np.log(left["stem", 1] / left["stem", 2])
    of_stem = {key: np.log(p_stem[1][key] / p_stem[2][key]) - base for key, c in stems.items() if max(c[1:]) > 3}
    of_word = {w: np.log(p_word[1][w] / p_word[2][w]) - base - np.log(left["word", 1] / left["word", 2]) for w, c in words.items() if max(c[1:]) > 3}
    # as probabilities, with the words met
    assert sum(p_word[1].values()) == pytest.approx(1 - left["word", 1] * left["stem", 1] * (1 - sum(shared.values())))
    return of_word, of_stem


@pytest.mark.parametrize("cores", [1, 3])
def test_ratios_are_kneser_ney(spark, cores):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x % 60:04d}{'abc'[x % 3] * (x % 4)}" for x in rng.zipf(1.3, 60) % 400), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train_toxicity(docs.repartition(cores), spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int"))
    of_word, of_stem = brute_force(rows)
    assert len(model.word) == len(of_word) and len(model.stem) == len(of_stem) and of_word and of_stem
    for _, t, _ in rows[:40]:
        w = [*t.split(), "w0001zzz", "never", "W0002"]
        want = [of_word.get(x, of_stem.get(x[:5], 0)) for x in (y.lower() for y in w)]
        _, keys, bounds = next(toxicity.tokens(pa.array([" ".join(w)])))
        assert model.ratios(keys) == pytest.approx(want, abs=1e-5)
        assert model.lead(keys, bounds)[0] == pytest.approx(sum(sorted([0, 0, 0, *(max(0, x) for x in want)])[-3:]) / 3, abs=1e-5)


def test_unknown_words_get_nothing():
    """As many entries as a small table would mix up: what wasn't counted gets no ratio."""
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 2_000_000, dtype=np.uint64))
    model = toxicity.ToxicityModel(keys, np.ones(len(keys), np.float32), np.zeros(0, np.uint64), np.zeros(0, np.float32))
    _, w, bounds = next(toxicity.tokens(pa.array([" ".join(f"z{i}" for i in range(300_000))])))
    assert not model.ratios(w).any() and model.lead(w, bounds).tolist() == [0]


def test_scale_rises():
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, 400), np.zeros(400, int)
    x[:100] += 5
    y[:100] = 1
    slope, shift = toxicity.fit_scale(x, y)
    assert 1.5 < -shift / slope < 3.5 and ((slope * x + shift > 0) == y).mean() > 0.97
    for some in ((x[:0], y[:0]), (x[:3], y[:3]), (x[200:], y[200:]), (-x, y)):
        slope, shift = toxicity.fit_scale(*some)
        assert slope >= toxicity.LEAST_SLOPE and np.isfinite(shift)
    slope, shift = toxicity.fit_scale(x[:0], y[:0])
    assert 0 < -shift / slope < 4


def test_whole_text_is_compared_by_pairs(spark):
    """The same words in another order are toxic or not, as only p(w | before) tells, and every word of a text counts."""
    rng = np.random.default_rng(4)

    def text(x):
        filler = [f"f{a}" for a in rng.integers(0, 40, 40)]
        for k in rng.choice(39, 6, replace=False):
            filler[k] = "you are rats" if x else "rats are you"
        return " ".join(filler)

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    held = [r for r in toxicity.score_toxicity(docs, model).collect() if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held)

    before, w, bounds = next(toxicity.tokens(pa.array(["you are rats f1 never", "rats are you", "", "are rats"])))
    ratios = model.conditional(before, w)
    mixed = np.log(1 - toxicity.INTERPOLATION + toxicity.INTERPOLATION * np.exp(ratios)) * toxicity.PER_WORDS
    assert model.difference(before, w, bounds) == pytest.approx([mixed[:5].mean(), mixed[5:8].mean(), 0, mixed[8:].mean()])

    # the counts one by one
    counted = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 5 > 1]
    pairs = {x: {} for x in (0, 1)}
    for t, x in counted:
        for p in itertools.pairwise(["", *t.split()]):
            pairs[x][p] = pairs[x].get(p, 0) + 1

    def shares(x, v, word):
        of = pairs[x]
        one, two = (sum(c == j for c in of.values()) for j in (1, 2))
        d = one / (one + 2 * two) if one else 0.5
        kept = {p: c - d for p, c in of.items() if c > 3}
        total = max(1, sum(c for p, c in of.items() if p[0] == v))
        return kept.get((v, word), 0) / total, 1 - sum(c for p, c in kept.items() if p[0] == v) / total

    # a pair that isn't kept: the contexts' backoff and the word's own ratio
    own = model.ratios(w)
    assert ratios[4] == pytest.approx(np.log(shares(1, "f1", "never")[1] / shares(0, "f1", "never")[1]) + own[4], abs=1e-5)
    assert shares(1, "are", "rats")[0] > 0 and shares(0, "are", "rats")[0] == 0 and ratios[2] > 1 > own[2]
