"""Toxicity by class-conditional Kneser-Ney models.

One model is estimated from toxic and one from ordinary labelled documents.
Each has the probability of a word after the word before it: how often the pair
stands in its documents, less an absolute discount, estimated from how many
counts are 1 and 2.  What the discount frees is shared out by continuation:
after how many different words a word stands.  What is freed there is shared
out by the same model of stems (a word's first letters), whose discount is
shared out by the counts that both classes have in common.  An expression that
neither class has met often gets the same probability from both, but for a
constant, and doesn't count.

Most of a toxic text is ordinary, so its likelihood is that of the ordinary
model with INTERPOLATION of the toxic one mixed in.  A document's score compares
the two log-likelihoods of its whole text, normalised by its length; one rising
scale turns the difference into a probability.

Words go by 64-bit hashes, the upper half from the stem, and are counted
exactly, from all labelled documents of the folds that are learnt from.  The
model has a row for each pair, context, word and stem that changes a score: those
that one class has met more than CUT times.  It grows with the corpus, and what isn't in
it is left to the backoff.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import Scratch, partitions, to_partition
from linkforge.llm.labels import bounded_sample, fold, held_out, labelled
from linkforge.llm.words import byte_sums, mix64, split

#: Counts up to this go whole to the backoff, as in pruned models.
CUT = 3
#: A stem are a word's first bytes.
STEM_BYTES = 5
#: The score's scale is fitted on fold 1, which the counts leave out, on at most so many documents.
CALIBRATION_FOLD, CALIBRATION_DOCS = 1, 20_000
#: Share of the toxic model in a toxic text.
INTERPOLATION = 0.01
#: Words by which log-likelihoods are normalised: differences are those of so many.
PER_WORDS = 100
#: Words of ``lead``, those where the toxic model leads most.
LEADING = 3
THRESHOLD = 0.5

# words are runs of ASCII letters and digits and of bytes of other characters
_BETWEEN = np.array([not (chr(c).isalnum() if c < 128 else True) for c in range(256)])
_START, _TURN, _HALF = np.uint64(0x5BD1E995), np.uint64(0x9FB21C651E98DF25), np.uint64(32)


def tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the documents: keys of the words before, of the words, and the documents' bounds."""
    for words in split(column, lower=True, separators=_BETWEEN):
        stem = mix64(byte_sums(words.data, words.starts, np.minimum(words.starts + STEM_BYTES, words.ends), lower=True))
        w = (stem >> _HALF << _HALF) | (words.hashes >> _HALF)
        before = np.empty_like(w)
        before[1:] = w[:-1]
        begins = words.bounds[:-1][np.diff(words.bounds) > 0]
        before[begins] = _START
        yield before, w, words.bounds


def pair_keys(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(before * _TURN + w)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted keys in a table sorted by key, 0 for those that it doesn't have, and which it has."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    met = keys[at] == wanted
    return np.where(met, values[at], 0).astype(np.float64), met


@dataclass
class ToxicityModel:
    """Log-likelihood ratios in tables sorted by key, and the scale of the score.

    ``word``: log p_toxic(w) - log p_ordinary(w), less its constant for what is
    unknown to both; ``stem``: the same for a word that isn't in that table.
    ``pair``: the same of p(w | before); ``context``: what stands before the
    word's own ratio where the pair isn't in that table.
    """

    word_keys: np.ndarray
    word: np.ndarray
    stem_keys: np.ndarray
    stem: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    pair_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    context_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    context: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def ratios(self, w: np.ndarray) -> np.ndarray:
        known, met = _looked_up(self.word_keys, self.word, w)
        return np.where(met, known, _looked_up(self.stem_keys, self.stem, w >> _HALF)[0])

    def conditional(self, before: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log p_toxic(w | before) - log p_ordinary(w | before) of each word."""
        known, met = _looked_up(self.pair_keys, self.pair, pair_keys(before, w))
        return np.where(met, known, _looked_up(self.context_keys, self.context, before)[0] + self.ratios(w))

    def difference(self, before: np.ndarray, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-likelihood of each whole document as a toxic text less that as an ordinary one, by its length, in PER_WORDS words; 0 without words."""
        toxic = np.log1p(INTERPOLATION * np.expm1(np.minimum(self.conditional(before, w), 50)))
        doc, n = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), np.diff(bounds)
        return PER_WORDS * np.bincount(doc, toxic, len(n)) / np.maximum(n, 1)

    def lead(self, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The mean of the LEADING highest ratios of each document, none below 0; words that a document lacks count as unknown ones, 0.  Shows what stands out, no part of a score."""
        ratios = self.ratios(w)
        some = np.flatnonzero(ratios > 0)
        doc, ratios = np.searchsorted(bounds, some, "right") - 1, ratios[some]
        order = np.lexsort((-ratios, doc))
        doc, ratios = doc[order], ratios[order]
        first = np.searchsorted(doc, np.arange(len(bounds) - 1))
        top = np.arange(len(doc)) - first[doc] < LEADING
        return np.bincount(doc[top], ratios[top], len(bounds) - 1) / LEADING

    def score(self, before: np.ndarray, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(before, w, bounds) + self.shift, -30, 30)))


#: Pairs of words counted in a task before they are sent.
HELD = 2_000_000


def _sums(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], [np.add.reduceat(c[order], first) if len(first) else c for c in counts]


def _distinct(before: np.ndarray, w: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs of words, in the order of their hashes, and how often each class has each."""
    order = np.lexsort((w, before))
    before, w = before[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (w[1:] != w[:-1])])) if len(w) else np.zeros(0, np.int64)
    return before[first], w[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in (toxic, ordinary)]


# Pairs and counts are sent by the thousand, packed: half as much is shuffled as by rows.

_BLOCKS = "part int, what int, n long, block binary"
#: What blocks hold, and their columns.
_PAIR, _CONTEXT, _WORD, _COUNTED = range(4)
_KINDS = {_PAIR: (np.uint64, np.uint64, np.int32, np.int32), _CONTEXT: (np.uint64, np.int64, np.int64), _WORD: (np.uint64, np.int64, np.int64, np.int64), _COUNTED: (np.int64,) * 4}


def _packed(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(c.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> dict[int, list[np.ndarray]]:
    """For each thing that blocks hold the columns of all its blocks of a partition."""
    got = {what: [[np.zeros(0, k)] for k in kinds] for what, kinds in _KINDS.items()}
    for batch in batches:
        for what, n, block in zip(*(batch.column(c).to_pylist() for c in ("what", "n", "block"))):
            width = sum(np.dtype(k).itemsize for k in _KINDS[what])
            data, at = pa.decompress(block, decompressed_size=n * width, codec="zstd", asbytes=True), 0
            for column, k in zip(got[what], _KINDS[what]):
                column.append(np.frombuffer(data, k, n, at))
                at += n * np.dtype(k).itemsize
    return {what: [np.concatenate(c) for c in columns] for what, columns in got.items()}


def _dealt(what: int, part: np.ndarray, n_parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n_parts + 1))
    columns = [c.astype(k, copy=False)[order] for c, k in zip(columns, _KINDS[what])]
    rows = [(p, what, int(b - a), _packed(*[c[a:b] for c in columns])) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["part", "what", "n", "block"])


def _pairs(n_parts: int):
    """Distinct pairs of words and how often each class has them, and the same of the first words alone, a stretch of the documents at a time."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            before, w, toxic, ordinary = held[0]
            yield _dealt(_PAIR, (pair_keys(before, w) % np.uint64(n_parts)).astype(np.int64), n_parts, before, w, toxic, ordinary)
            first, counts = _sums(before, toxic, ordinary)
            yield _dealt(_CONTEXT, (mix64(first) % np.uint64(n_parts)).astype(np.int64), n_parts, first, *counts)

        for batch in batches:
            label, at = batch.column("label").to_numpy(), 0
            for before, w, bounds in tokens(batch.column("_text")):
                k = len(bounds) - 1
                toxic = np.repeat(label[at : at + k] == 1, np.diff(bounds)).astype(np.int32)
                at += k
                held.append((before, w, toxic, 1 - toxic))
                size += len(w)
                if size >= HELD:
                    held = [_distinct(*(np.concatenate(c) for c in zip(*held)))]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield from sent()
                        held, size = [], 0
        if size:
            held = [_distinct(*(np.concatenate(c) for c in zip(*held)))]
            yield from sent()

    return f


def _continuations(n_parts: int):
    """All of a pair meet here, whichever words it has: for each word, how many pairs end in it, of all and of each class.

    Pairs and contexts above the cut go on, and how many pairs a class has met once and twice.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _unpacked(batches)
        before, w, toxic, ordinary = _distinct(*got[_PAIR])
        words, counts = _sums(w, np.ones(len(w), np.int64), (toxic > 0).astype(np.int64), (ordinary > 0).astype(np.int64))
        part = lambda w: ((w >> _HALF) % np.uint64(n_parts)).astype(np.int64)
        yield _dealt(_WORD, part(words), n_parts, words, *counts)
        kept = (toxic > CUT) | (ordinary > CUT)
        yield _dealt(_PAIR, part(w[kept]), n_parts, before[kept], w[kept], toxic[kept], ordinary[kept])
        yield _dealt(_COUNTED, np.zeros(1, np.int64), n_parts, *[np.array([(c == k).sum()]) for c in (toxic, ordinary) for k in (1, 2)])
        first, (toxic, ordinary) = _sums(*got[_CONTEXT])
        kept = (toxic > CUT) | (ordinary > CUT)
        yield _dealt(_CONTEXT, part(first[kept]), n_parts, first[kept], toxic[kept], ordinary[kept])

    return f


#: Sums over all words: pairs and stems; how many pairs a class has met once and twice; then of each class and of words and stems: the counts' sum, how many are 1 and 2, how many and what sum are above the cut.
_TOTALS = ["pairs", "stems", *[f"{what}_pair_{of}" for of in ("toxic", "ordinary") for what in ("one", "two")], *[f"{what}_{kind}_{of}" for kind in ("word", "stem") for of in ("toxic", "ordinary") for what in ("all", "one", "two", "kept", "sum")]]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words of a stem meet here: rows of kind 1 for words and 2 for stems above the cut, and of kind 0 with the sums (``key`` says which of _TOTALS).

    Of kind 3 are the pairs above the cut, with the counts of their second word
    (``key``), and of kind 4 the contexts, which come as they are.
    """
    got = _unpacked(batches)
    w, n, nt, no = got[_WORD]
    w, (n, nt, no) = _sums(w, n, nt, no)
    stem, (s, st, so) = _sums(w >> _HALF, n, nt, no)
    total = {"pairs": n.sum(), "stems": len(stem)} | {x: c.sum() for x, c in zip(_TOTALS[2:6], got[_COUNTED])}
    for kind, of_class in (("word", (nt, no)), ("stem", (st, so))):
        for of, c in zip(("toxic", "ordinary"), of_class):
            total |= {f"all_{kind}_{of}": c.sum(), f"one_{kind}_{of}": (c == 1).sum(), f"two_{kind}_{of}": (c == 2).sum(), f"kept_{kind}_{of}": (c > CUT).sum(), f"sum_{kind}_{of}": c[c > CUT].sum()}
    own = np.searchsorted(stem, w >> _HALF)
    words, stems = np.flatnonzero((nt > CUT) | (no > CUT)), np.flatnonzero((st > CUT) | (so > CUT))
    before, second, *counts = got[_PAIR]
    of, context = np.searchsorted(w, second), got[_CONTEXT]
    of_kind = [
        {"key": np.arange(len(_TOTALS)), "n": np.array([int(total[x]) for x in _TOTALS])},
        {"key": w[words].view(np.int64), "n": n[words], "nt": nt[words], "no": no[words]} | {x: c[own[words]] for x, c in (("s", s), ("st", st), ("so", so))},
        {"key": stem[stems].view(np.int64), "s": s[stems], "st": st[stems], "so": so[stems]},
        {"key": second.view(np.int64), "before": before.view(np.int64), "ct": counts[0], "co": counts[1], "n": n[of], "nt": nt[of], "no": no[of]} | {x: c[own[of]] for x, c in (("s", s), ("st", st), ("so", so))},
        {"key": context[0].view(np.int64), "ct": context[1], "co": context[2]},
    ]
    for kind, columns in enumerate(of_kind):
        size = len(columns["key"])
        rows = [columns.get(c, np.zeros(size, np.int64)) for c in _COLUMNS[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *[pa.array(np.asarray(c, np.int64)) for c in rows]], _COLUMNS)


_COLUMNS = ["kind", "key", "n", "nt", "no", "s", "st", "so", "before", "ct", "co"]


def _with_contexts(found: DataFrame, total: dict[str, int]) -> DataFrame:
    """Words, stems, pairs and the contexts of pairs, the latter two with the context's counts (at, ao) and what each class's pairs keep of them (kt, ko)."""
    pairs = found.filter("kind = 3")
    kept = lambda c, of: F.sum(F.when(F.col(c) > CUT, F.col(c) - F.lit(_discount(total, f"pair_{of}"))).otherwise(0.0))
    of = pairs.groupBy("before").agg(kept("ct", "toxic").alias("kt"), kept("co", "ordinary").alias("ko"))
    of = of.join(found.filter("kind = 4").select(F.col("key").alias("before"), F.col("ct").alias("at"), F.col("co").alias("ao")), "before")
    none = {c: F.lit(0.0) for c in ("kt", "ko")} | {c: F.lit(0).cast("long") for c in ("at", "ao")}
    contexts = of.select(F.lit(4).alias("kind"), F.col("before").alias("key"), *[F.lit(0).cast("long").alias(c) for c in _COLUMNS[2:8]], "before", *[F.lit(0).cast("long").alias(c) for c in ("ct", "co")], *none)
    return found.filter("kind in (1, 2)").select("*", *[c.alias(x) for x, c in none.items()]).unionByName(pairs.join(of, "before").select(*_COLUMNS, *none)).unionByName(contexts)


def _discount(total: dict[str, int], of: str) -> float:
    one, two = total[f"one_{of}"], total[f"two_{of}"]
    return one / (one + 2 * two) if one else 0.5


def _ratios(total: dict[str, int]):
    """(kind, key, ratio) of the words, stems, pairs and contexts."""

    def kept(c: np.ndarray, of: str) -> np.ndarray:
        """The class's share of a count above the cut, less the discount."""
        return np.where(c > CUT, c - _discount(total, of), 0) / total[f"all_{of}"]

    def left(of: str) -> float:
        """What the discount and the cut leave to the backoff."""
        return 1 - (total[f"sum_{of}"] - _discount(total, of) * total[f"kept_{of}"]) / total[f"all_{of}"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, key, n, nt, no, s, st, so, before, ct, co, kt, ko, at, ao = (batch.column(c).to_numpy() for c in [*_COLUMNS, "kt", "ko", "at", "ao"])
            # one place more is that of all stems not met
            shared = (s + 1) / (total["pairs"] + total["stems"] + 1)
            of_stem, of_word, of_pair, of_context = [], [], [], []
            for of, c, cs, pair, keeps, of_all in (("toxic", nt, st, ct, kt, at), ("ordinary", no, so, co, ko, ao)):
                stem = kept(cs, f"stem_{of}") + left(f"stem_{of}") * shared
                constant = np.log(left(f"word_{of}")) + np.log(left(f"stem_{of}"))
                of_stem.append(np.log(stem) - np.log(left(f"stem_{of}")))
                word = kept(c, f"word_{of}") + left(f"word_{of}") * stem * n / np.maximum(s, 1)
                # a context that the class hasn't met leaves all to the words
                rest, of_all = 1 - keeps / np.maximum(of_all, 1), np.maximum(of_all, 1)
                own = np.where(pair > CUT, pair - _discount(total, f"pair_{of}"), 0) / of_all
                with np.errstate(divide="ignore"):  # a stem or a context has no words of its own
                    of_word.append(np.log(word) - constant)
                    of_pair.append(np.log(own + rest * word) - constant)
                of_context.append(np.log(rest))
            with np.errstate(invalid="ignore"):
                ratio = np.choose(kind - 1, [x[0] - x[1] for x in (of_word, of_stem, of_pair, of_context)])
            keys = np.where(kind == 3, pair_keys(before.view(np.uint64), key.view(np.uint64)).view(np.int64), key)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(keys), pa.array(ratio.astype(np.float32))], ["kind", "key", "ratio"])

    return f


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    """Counts all labelled documents outside folds 0 and 1 and fits the scale on fold 1; None if both labels aren't met.

    Labels are joined by id after the folds that aren't counted have gone.
    What comes to the driver are 16 bytes for each pair, context, word and stem
    above the cut: as many as the labelled texts have, which is sublinear in their size.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = scratch.cut(labelled(labels, label, id_col))
    counted = known.filter(fold(id_col) != CALIBRATION_FOLD)
    rows = docs.select(id_col, F.col(text_col).alias("_text")).filter((fold(id_col) != CALIBRATION_FOLD) & ~held_out(id_col))
    # labels grow with the documents, so they are merged at every size, never broadcast
    rows = rows.join(counted.hint("merge"), id_col)
    n = partitions(spark)
    blocks = to_partition(rows.select("_text", "label").mapInArrow(_pairs(n), _BLOCKS), "part")
    blocks = to_partition(blocks.mapInArrow(_continuations(n), _BLOCKS), "part")
    found = scratch.cut(blocks.mapInArrow(_statistics, "kind int, " + ", ".join(f"{c} long" for c in _COLUMNS[1:])))
    sums = {r["key"]: r["n"] for r in found.filter("kind = 0").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    total = {x: sums.get(i, 0) for i, x in enumerate(_TOTALS)}
    if not total["all_word_toxic"] or not total["all_word_ordinary"]:
        scratch.drop(found)
        return None
    ratios = _with_contexts(found, total).mapInArrow(_ratios(total), "kind int, key long, ratio float").toArrow()
    tables = []
    for kind in (1, 2, 3, 4):
        rows = ratios.filter(pc.equal(ratios.column("kind"), kind))
        keys, values = rows.column("key").to_numpy().view(np.uint64), rows.column("ratio").to_numpy()
        order = np.argsort(keys)
        tables += [keys[order], values[order]]
    model = ToxicityModel(*tables[:4], pair_keys=tables[4], pair=tables[5], context_keys=tables[6], context=tables[7])
    scratch.drop(found)
    sample = bounded_sample(known.filter(fold(id_col) == CALIBRATION_FOLD), CALIBRATION_DOCS, id_col)
    rows = docs.select(id_col, F.col(text_col).alias("_text")).filter(fold(id_col) == CALIBRATION_FOLD).join(F.broadcast(sample), id_col).select("_text", "label")
    found = _differences(rows, model).toArrow()
    model.slope, model.shift = fit_scale(found.column("difference").to_numpy(), found.column("label").to_numpy())
    return model


#: What the scale knows before it meets a document: a text as likely in both classes is ordinary, one that the toxic model knows far better is toxic.
PRIOR = ((0.0, 0), (4.0, 1))
#: The scale rises, if but by this.
LEAST_SLOPE = 0.1


def fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of a logistic scale by damped Newton steps; PRIOR counts as two documents, and the slope is LEAST_SLOPE at least."""
    x, y = (np.concatenate([a, b]).astype(float) for a, b in zip((x, y), zip(*PRIOR)))
    order = np.lexsort((y, x))  # sums don't depend on the rows' order
    x, y = x[order], y[order]
    rows = np.stack([x, np.ones(len(x))], axis=1)

    def loss(w: np.ndarray) -> float:
        z = rows @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge * w @ w)

    w = np.array([1.0, -2.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        g = rows.T @ (p - y) + 2 * ridge * w
        h = (rows * (p * (1 - p))[:, None]).T @ rows + 2 * ridge * np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6:
            new = w - size * step
            new[0] = max(new[0], LEAST_SLOPE)
            if loss(new) < loss(w):
                break
            size /= 2
        else:
            break
        w = new
    return float(w[0]), float(w[1])


def _differences(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    broadcast = rows.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for before, w, bounds in tokens(batch.column("_text")):
                x = broadcast.value.difference(before, w, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(x), batch.column("label").slice(at, len(x))], ["difference", "label"])
                at += len(x)

    return rows.mapInArrow(f, "difference double, label int")


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) of every document.

    A null or empty text has no words, so both likelihoods are 1 and its score
    is that of a ratio of 0; without a model every score is 0.  Rows are scored
    one by one; repeated rows and null ids are allowed.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held_out(id_col).alias("held_out"))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        for batch in batches:
            parts = [own.score(before, w, bounds) for before, w, bounds in tokens(batch.column("_text"))] if own is not None else [np.zeros(len(batch))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["_id", "held_out", "score", "predicted"])

    out = rows.mapInArrow(scored, f"_id {dict(rows.dtypes)['_id']}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("_id", id_col)
