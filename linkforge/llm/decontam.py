"""Benchmark decontamination: documents that contain a benchmark item but for few edited words.

Words are the symbols.  The CGK random walk reads a window of words and at each
of its steps writes the word it stands at, going on to the next word or not as
a random function of the step and the word says; windows at a small edit
distance are written as strings at a small Hamming distance, because the walks
meet again after an edit.  Bit-sampling LSH reads a few steps of what was
written as a key, several times for several walks: as often as it takes, by
measurement, to find the target's share of items of the benchmark's lengths.
Windows and items that share a key are verified by the exact edit distance.

All windows have one size, PIECE words: an item is cut into pieces of it, one
every STRIDE words, so that an item with edits all over still has pieces with
few.  A window starts at every word of every document; verification aligns the
whole item around it.

An item too short for that is cut into one run of words more than it may have
edits: each edit spoils one run at most, so one stands unedited wherever the
item is, and runs are looked up as they are.  This misses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import released, whole_row
from linkforge.llm.words import Words, mix64, windows
from linkforge.llm.words import split as split_words

#: Share of an item's words that may be edited, rounded down.
EDIT_SHARE = 0.2
PIECE, STRIDE = 12, 2
#: Share of items, edited as much as is allowed, that are to be found.
TARGET_RECALL = 0.98
#: Repetitions, the cheapest first: random walks, and keys read from each; and the steps in a key.
REPETITIONS, STEPS = ((2, 3), (3, 3), (3, 4), (4, 4), (5, 4), (6, 5), (8, 6), (12, 6)), 5
#: Items of fewer words are found by unedited runs of their words.
WALKED_WORDS = 20
#: Words of items searched for in one scan of the documents; a larger benchmark takes several.
BLOCK_WORDS = 4_000_000
_SYMBOL_BITS, _FILTER_BITS = 12, 20


@dataclass
class Items:
    """Benchmark items and the keys of their pieces."""

    ids: np.ndarray
    words: list[np.ndarray]
    keys: list[np.ndarray]  # for each (walk, key), then for each length of run: sorted hashes
    owners: list[np.ndarray]  # the piece or run of each
    piece_item: np.ndarray
    piece_at: np.ndarray
    walked: bool
    runs: list[int]
    repetitions: tuple[int, int]


def _random(repetitions: tuple[int, int], seed: int = 5) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """The walks' tables (step x symbol: whether to go on) and the sampled steps of each key."""
    # one step from each of STEPS equal stretches, so that a key reads words from the whole window
    ends = np.linspace(0, PIECE, STEPS + 1).astype(int)
    walks, steps = [], []
    for w in range(repetitions[0]):
        rng = np.random.default_rng((seed, w))
        walks.append(rng.integers(0, 2, (PIECE, 1 << _SYMBOL_BITS), dtype=np.uint8).astype(np.int32))
        steps.append([np.array([rng.integers(a, b) for a, b in zip(ends[:-1], ends[1:])]) for _ in range(repetitions[1])])
    return walks, steps


@lru_cache
def repetitions_for(lengths: tuple[int, ...], target: float = TARGET_RECALL) -> tuple[int, int]:
    """The fewest repetitions that find the target's share of items of each of these lengths after as many edits as are allowed."""
    for shape in REPETITIONS[:-1]:
        if all(recall(EDIT_SHARE, n, 400, repetitions=shape) >= target for n in lengths):
            return shape
    return REPETITIONS[-1]


def hardest(lengths: set[int]) -> tuple[int, ...]:
    """Of lengths of items the ones to measure: short ones, and of each five the one that may have a further edit."""
    return tuple(sorted({min(40, max(WALKED_WORDS, n - n % 5)) for n in lengths if n >= WALKED_WORDS}))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _keys(symbols: np.ndarray, starts: np.ndarray, walks: list[np.ndarray], steps: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
    """Keys of the windows at ``starts``, for each walk and key; ``symbols`` goes on for PIECE more at its end.

    After s steps a walk has gone on by s words at most, so it stays in its window.
    """
    for walk, chosen in zip(walks, steps):
        wanted = {int(s) for one in chosen for s in one}
        written: dict[int, np.ndarray] = {}
        at = starts.copy()
        for s in range(max(wanted) + 1):
            here = symbols[at]
            if s in wanted:
                written[s] = here.astype(np.uint64)
            at += walk[s][here]
        for one in chosen:
            key = written[int(one[0])].copy()
            for s in one[1:]:
                key <<= np.uint64(_SYMBOL_BITS)
                key |= written[int(s)]
            yield key * _MIX


def split(column: pa.Array) -> Iterator[Words]:
    """Words of the lower-cased texts; letters of all scripts are lowered."""
    return split_words(pc.utf8_lower(column), lower=True)


def _symbols(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _SYMBOL_BITS)).astype(np.int32)


def allowed(n: int) -> int:
    return int(EDIT_SHARE * n)


def index_items(ids: list[int], texts: list[str | None], target: float = TARGET_RECALL) -> Items:
    """Items of all lengths but 0, indexed."""
    words, kept = [], []
    for part in split(pa.array(texts, pa.string())):
        for i in range(len(part)):
            h = part.hashes[part.bounds[i] : part.bounds[i + 1]]
            if len(h):
                words.append(h.copy())
                kept.append(ids[part.first + i])
    return index_words(kept, words, target)


def index_words(ids: list[int], words: list[np.ndarray], target: float = TARGET_RECALL, repetitions: tuple[int, int] | None = None) -> Items:
    """Pieces of the long items under the keys of all walks, as many as the target recall needs, and runs of the short ones."""
    repetitions = repetitions or repetitions_for(hardest({len(h) for h in words}), target)
    pieces, owner, offset = [], [], []
    runs: dict[int, list[tuple[np.uint64, int, int]]] = {}
    for i, h in enumerate(words):
        if len(h) < WALKED_WORDS:
            cuts = np.linspace(0, len(h), allowed(len(h)) + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:]):
                runs.setdefault(int(b - a), []).append((windows(h[a:b], b - a)[0], i, int(a)))
            continue
        for s in sorted({*range(0, len(h) - PIECE + 1, STRIDE), len(h) - PIECE}):
            pieces.append(h[s : s + PIECE])
            owner.append(i)
            offset.append(s)
    keys, owners = [], []
    if pieces:
        flat = np.concatenate([*pieces, np.zeros(PIECE, np.uint64)])
        for key in _keys(_symbols(flat), np.arange(len(pieces), dtype=np.int32) * PIECE, *_random(repetitions)):
            order = np.argsort(key, kind="stable")
            keys.append(key[order])
            owners.append(order)
    for _, found in sorted(runs.items()):
        key, item, at = (np.array(c) for c in zip(*found))
        order = np.argsort(key, kind="stable")
        keys.append(key[order])
        owners.append(order + len(owner))
        owner += item.tolist()
        offset += at.tolist()
    return Items(np.array(ids, np.int64), words, keys, owners, np.array(owner, np.int64), np.array(offset, np.int64), bool(pieces), sorted(runs), repetitions)


def _streams(hashes: np.ndarray, items: Items, drawn: tuple) -> Iterator[np.ndarray]:
    """Hashes at the words, in the order of the items' keys."""
    if items.walked:
        symbols = np.concatenate([_symbols(hashes), np.zeros(PIECE, np.int32)])
        yield from _keys(symbols, np.arange(len(hashes), dtype=np.int32), *drawn)
    for n in items.runs:
        yield windows(hashes, n)


def edit_distances(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For rows of ``text`` (0 is no word): least edit distance of the item to a run of words in the row."""
    n = len(item)
    steps = np.arange(n + 1, dtype=np.int32)
    row = np.tile(steps, (len(text), 1))
    least = row[:, n].copy()
    for t in range(text.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = 0
        np.minimum(row[:, :-1] + (text[:, t, None] != item), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        np.minimum(least, row[:, n], out=least)
    return least


def find(words: Words, items: Items, filters: list[np.ndarray], drawn: tuple) -> list[tuple[int, int, int, int]]:
    """(document in the slice, item, distance, first word of the aligned region) for the leaks of a slice."""
    n = len(words.hashes)
    if not n or not len(items.ids):
        return []
    met = []
    for key, keys, owners, some in zip(_streams(words.hashes, items, drawn), items.keys, items.owners, filters):
        at = np.flatnonzero(some[key >> np.uint64(64 - _FILTER_BITS)])
        if not len(at):
            continue
        lo, hi = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
        size = hi - lo
        at, lo, size = at[size > 0], lo[size > 0], size[size > 0]
        if len(at):
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            met.append(np.stack([np.repeat(at, size), owners[which]], axis=1))
    if not met:
        return []
    met = np.concatenate(met)
    item, start = items.piece_item[met[:, 1]], met[:, 0] - items.piece_at[met[:, 1]]
    doc = np.searchsorted(words.bounds, met[:, 0], "right") - 1
    # regions that begin within half the allowed shift of each other are one
    grain = np.array([max(1, allowed(len(w)) // 2) for w in items.words])[item]
    found = np.unique(np.stack([item, doc, np.floor_divide(start, grain) * grain], axis=1), axis=0)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    cut = np.flatnonzero(np.concatenate([[True], found[1:, 0] != found[:-1, 0]]))
    for a, b in zip(cut, np.append(cut[1:], len(found))):
        own = items.words[int(found[a, 0])]
        k = allowed(len(own))
        for x in range(a, b, 4096):
            d, s = found[x : min(b, x + 4096), 1], found[x : min(b, x + 4096), 2]
            where = s[:, None] - k + np.arange(len(own) + 3 * k + 2)
            inside = (where >= words.bounds[d][:, None]) & (where < words.bounds[d + 1][:, None])
            text = np.where(inside, words.hashes[np.clip(where, 0, n - 1)], np.uint64(0))
            distance = edit_distances(own, text)
            for i in np.flatnonzero(distance <= k):
                key = (int(d[i]), int(found[a, 0]))
                best = (int(distance[i]), int(max(0, s[i] - words.bounds[d[i]])))
                out[key] = min(out.get(key, best), best)
    return [(d, i, *v) for (d, i), v in sorted(out.items())]


def _filters(items: Items) -> list[np.ndarray]:
    out = []
    for keys in items.keys:
        f = np.zeros(1 << _FILTER_BITS, bool)
        f[keys >> np.uint64(64 - _FILTER_BITS)] = True
        out.append(f)
    return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", target: float = TARGET_RECALL) -> Iterator[Items]:
    """Indexed items in blocks of about BLOCK_WORDS words, which bounds what a scan broadcasts."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    ids, texts, size = [], [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"]) // 6
        if size >= BLOCK_WORDS:
            yield index_items(ids, texts, target)
            ids, texts, size = [], [], 0
    if ids:
        yield index_items(ids, texts, target)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", target: float = TARGET_RECALL) -> DataFrame:
    """(id_col, item_col, distance, first_word) of the benchmark items that documents contain.

    An item of n words is contained if some run of a document's words, lower
    case, is within EDIT_SHARE * n word edits of it.  Of items with as many
    edits the share ``target`` is found, of those with fewer more; short ones
    are all found.  ``first_word`` says about
    where.  Null and empty texts contain nothing; rows without an id are left
    out; rows that repeat an id give one row for each item; items that repeat
    an id are one item with several texts; null items, items without words and
    an empty benchmark are found nowhere.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text")).filter("doc_id is not null")
    out = spark.createDataFrame([], "doc_id long, item_id long, distance int, first_word int")
    for items in item_blocks(benchmark, item_col, item_text_col, target):
        index = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            filters, drawn = _filters(own), _random(own.repetitions)
            for batch in batches:
                ids, found = batch.column("doc_id").to_numpy(), []
                for words in split(batch.column("_text")):
                    found += [(ids[words.first + d], own.ids[i], k, s) for d, i, k, s in find(words, own, filters, drawn)]
                columns = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "first_word"])

        out = out.unionByName(rows.mapInArrow(released(scan), "doc_id long, item_id long, distance int, first_word int"))
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "first_word")).alias("_b"))
    return best.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "_b.distance", "_b.first_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", target: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text contains no benchmark item; nothing is shuffled.

    Null and empty texts contain none and stay; rows are judged one by one, so
    null and repeated ids need no rule; an empty benchmark drops nothing.
    """
    spark, names = docs.sparkSession, docs.columns
    out = docs.select(F.col(text_col).cast("string").alias("_text"), whole_row(docs).alias("_row"))
    schema = out.schema
    for items in item_blocks(benchmark, item_col, item_text_col, target):
        index = spark.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            filters, drawn = _filters(own), _random(own.repetitions)
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for words in split(batch.column("_text")):
                    keep[[words.first + d for d, *_ in find(words, own, filters, drawn)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(released(clean), schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])


def recall(edits: float, n: int = 40, trials: int = 400, seed: int = 1, repetitions: tuple[int, int] | None = None) -> float:
    """Measured share of items of n random words found after edits * n random word edits, with the repetitions that items of this length get unless given."""
    rng = np.random.default_rng(seed)
    drawn = lambda k: mix64(rng.integers(1, 2**62, k, dtype=np.uint64))
    items, texts = [drawn(n) for _ in range(trials)], []
    for item in items:
        text = list(item)
        for _ in range(int(edits * n)):
            kind, at = rng.integers(3), int(rng.integers(len(text)))
            text[at : at + (kind < 2)] = list(drawn(int(kind != 1)))
        texts.append(np.concatenate([drawn(30), np.array(text, np.uint64), drawn(30)]))
    none, bounds = np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    index = index_words(list(range(trials)), items, repetitions=repetitions)
    found = find(Words(0, none, none, bounds, none, none, np.concatenate(texts)), index, _filters(index), _random(index.repetitions))
    return len({d for d, i, *_ in found if d == i}) / trials
