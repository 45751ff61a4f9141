"""Alignment of two tokenizers' tokens over the same bytes.

Both cut a text into tokens whose bytes, joined, are the text after a space.
Offsets where a token of either ends together with one of the other cut the
tokens into groups; the two tokens that end there are linked.  How often a pair
of ids is linked in the whole corpus, and whether that is the most for either
of its ids, comes back to every link of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import Scratch, release, small_batches
from linkforge.llm.pieces import SPACE, decimal, piece_encoder, slices
from linkforge.llm.sstable import Encoder

#: Pairs with at least this share of all links are frequent; there are no more of them than its inverse.
FREQUENT = 20_000


class PlainEncoder(Encoder):
    """Ids of texts in which the strings of special tokens are text like any other."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__(path, most)
        self.tokenizer.encode_special_tokens = True
        self.special = []

    def surfaces(self) -> list[bytes]:
        """Bytes of each id: a byte-level vocabulary writes printable bytes as themselves and the others, in order, from U+0100 on."""
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        return out


@lru_cache(2)
def _left(path: str) -> tuple[PlainEncoder, list[bytes], np.ndarray]:
    own = PlainEncoder(path)
    surfaces = own.surfaces()
    return own, surfaces, np.array([len(s) for s in surfaces], np.int64)


@lru_cache(2)
def _right(path: str) -> tuple[list[bytes], np.ndarray]:
    surfaces = piece_encoder(path).surfaces()
    return surfaces, np.array([len(s) for s in surfaces], np.int64)


def merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two rising lists of ends that hold the same end, by one merge of both."""
    at = np.searchsorted(b, a)
    same = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a) if len(b) else np.zeros(0, np.int64)
    return same, at[same]


def written(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
    """Groups as text: ids of a side joined by commas, the sides by a bar, groups by a semicolon."""
    # the place of each token among both sides' tokens: a group's left ones, then its right ones
    first_a, first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    place_a = np.arange(len(a)) + np.repeat(first_b, last_a - first_a + 1)
    place_b = np.arange(len(b)) + np.repeat(last_a + 1, last_b - first_b + 1)
    ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    marks[place_a[last_a]], marks[place_b[last_b]] = ord("|"), ord(";")
    marks[-1] = 0
    return decimal(ids, marks)


def align_tokens(df: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = False) -> DataFrame:
    """A row for each row: id_col, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times; with the tokens also a_ids, b_ids, a_last, b_last.

    ``left`` is a byte-level model of the tokenizers library, which gets a space
    and the text, ``right`` one of the sentencepiece library, which adds the
    space.  ``pairs`` are the distinct linked pairs, the left id above the lower
    32 bits and the right id in them, and ``times`` how often the row has each.
    ``a_last`` and ``b_last`` are the places of each group's last tokens.
    Every token has a byte at least, so an end is one token's of each side, and
    a group has one link.

    A text has no tokens, zeros and an empty digest if it is null, empty or if
    either side's bytes, joined, aren't the space and the text.  Rows that
    share an id, or have none, each stand for themselves.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def aligned(texts: list[str]) -> Iterator[tuple]:
        (own, surfaces_a, length_a), (_, length_b), other = _left(left), _right(right), piece_encoder(right)
        none = np.zeros(0, np.int64)
        for text, a, b, normal in zip(texts, own.encode([" " + t for t in texts]), *other.cut(texts)):
            want = b" " + text.encode("utf-8", "surrogatepass")
            a, b = np.frombuffer(a, own.kind).astype(np.int64), np.array(b, np.int64)
            # a piece's bytes stand in the normalised text, but for unknown ones
            fits = text and normal.replace(SPACE, b" ") == want and other.lengths[b].all()
            ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
            if not fits or ends_a[-1] != len(want) or ends_b[-1] != len(want) or not (own.by_parts or b"".join([surfaces_a[i] for i in a]) == want):
                yield 0, 0, 0, 0, "", none, none, *([none] * 4 if with_tokens else [])
                continue
            last_a, last_b = merge(ends_a, ends_b)
            pairs, times = np.unique(a[last_a] << 32 | b[last_b], return_counts=True)
            digest = hashlib.sha256(written(a, b, last_a, last_b)).hexdigest()
            yield len(a), len(b), len(last_a), len(last_a), digest, pairs, times, *([a, b, last_a, last_b] if with_tokens else [])

    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["a_ids", "b_ids", "a_last", "b_last"] if with_tokens else [])]

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            for frame in frames:
                texts = [t or "" for t in frame["_text"].tolist()]
                for a, b in slices(texts, 1 << 20):
                    out = pd.DataFrame(list(aligned(texts[a:b])), columns=names)
                    out.insert(0, "_id", frame["_id"].iloc[a:b].to_numpy())
                    yield out
        finally:
            release()

    schema = f"_id {dict(rows.dtypes)['_id']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    schema += ", a_ids array<int>, b_ids array<int>, a_last array<int>, b_last array<int>" if with_tokens else ""
    return rows.mapInPandas(f, schema).withColumnRenamed("_id", id_col)


def _each(aligned: DataFrame, *keep: str) -> DataFrame:
    """A row for each distinct pair of each row: keep, pair, k."""
    return aligned.select(*keep, F.explode(F.arrays_zip("pairs", "times")).alias("_e")).select(*keep, F.col("_e.pairs").alias("pair"), F.col("_e.times").alias("k"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, count, a_most, b_most): links of each pair of ids in all rows, and the most that any pair of its left and of its right id has."""
    counts = _each(aligned).groupBy("pair").agg(F.sum("k").cast("long").alias("count"))
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "count")
    for side in ("a", "b"):
        counts = counts.join(counts.groupBy(side).agg(F.max("count").alias(f"{side}_most")), side)
    return counts.select("pair", "a", "b", "count", "a_most", "b_most")


def scored_links(aligned: DataFrame, counts: DataFrame, row: str, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, n_best_a, count_sum) of each row that has links: those whose pair is its right, its left id's most frequent, and the sum of counts.

    Pairs with a ``frequent``-th of all links are ``frequent`` at most, so they
    are broadcast; no other pair has a larger share than that of the shuffle
    by pairs which brings the rest their counts.
    """
    marked = counts.select("pair", "count", (F.col("count") == F.col("b_most")).cast("int").alias("best"), (F.col("count") == F.col("a_most")).cast("int").alias("best_a"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * frequent >= total

    def summed(rows: DataFrame) -> DataFrame:
        times: Column = F.col("k").cast("long")
        return rows.groupBy(row).agg(F.sum(times * F.col("best")).alias("n_best"), F.sum(times * F.col("best_a")).alias("n_best_a"), F.sum(times * F.col("count")).alias("count_sum"))

    each, known = _each(aligned, row), F.broadcast(marked.filter(often))
    rest = each.join(F.broadcast(marked.filter(often).select("pair")), "pair", "left_anti").join(marked.filter(~often), "pair")
    both = summed(each.join(known, "pair")).unionByName(summed(rest))
    return both.groupBy(row).agg(*[F.sum(c).alias(c) for c in ("n_best", "n_best_a", "count_sum")])


def align_corpus(df: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a.

    ``n_best`` are the links whose pair's count in all rows is the highest of
    its right id, ties included, ``n_best_a`` those of its left id;
    ``count_sum`` is the sum of counts over the links.  Odd texts and ids are as
    in ``align_tokens``; an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    # each row has a number, drawn once and written, since ids may repeat
    aligned = scratch.cut(align_tokens(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), left, right, "_id", "_text").withColumn("_row", F.monotonically_increasing_id()))
    counts = scratch.cut(pair_counts(aligned))
    scores = scored_links(aligned, counts, "_row").withColumnRenamed("_row", "_of")
    out = aligned.select("_id", "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(scores, F.col("_row") == F.col("_of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("n_best_a"))
