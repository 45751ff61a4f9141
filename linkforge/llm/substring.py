"""Removal of repeated passages by relative Lempel-Ziv parsing.

A document is parsed relative to a reference, the documents with smaller ids: a
factor is the longest run of words, 50 at least, that goes on alike in a
reference passage.  The parse is greedy: at the first word that begins a window
of the reference it looks the window up, compares the words and goes on with
them as far as they agree, then looks at the windows across the factor's end,
so no covered word is missed, and parses on behind it.

The reference is indexed by 50-word windows in blocks that are dealt over the
cluster.  Windows that two documents have name the smallest document that has
them; its passages, words and all, are sent to each block with a document that
may need them, and are the reference of the documents there.

A window is looked for only in blocks where it can be found: of the 31 runs of
20 words in a window, that with the least hash is its anchor, and equal windows
have equal anchors.  About one word in sixteen starts an anchor; windows whose
anchor no second document has are not indexed.

Words go by 64-bit hashes.  Windows are found by hashes too, but a word is
removed only where the words of the passage were compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from linkforge.llm.common import Scratch, maybe_in, partitions, released, tidy, to_partition, whole_row
from linkforge.llm.words import Words, split, windows

WINDOW, ANCHOR = 50, 20


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    more = width - size
    return np.minimum(out[: len(out) - more], out[more:]) if more else out


def _window_index(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows within documents: document, first word in it, hash, and anchor."""
    none = np.zeros(0, np.int64)
    if len(words.hashes) < WINDOW:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    anchors = _sliding_least(windows(words.hashes, ANCHOR), WINDOW - ANCHOR + 1)
    hashes = windows(words.hashes, WINDOW)
    n = np.maximum(0, np.diff(words.bounds) - WINDOW + 1)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = words.bounds[doc] + first
    return doc, first, hashes[at], anchors[at]


def _packed(bucket: np.ndarray, columns: list[np.ndarray], name: str, names: list[str]) -> pa.RecordBatch:
    """One row for each bucket with its part of the columns as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(bucket)) if len(bucket) else first
    out = [pa.array(bucket[first].astype(np.int32))]
    for c in columns:
        c = c[order]
        out.append(pa.array([c[a:b].tobytes() for a, b in zip(first, last)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, [name, *names])


def _gathered(batches: Iterator[pa.RecordBatch], name: str, names: list[str], kinds: list) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The reverse: each bucket's columns, joined over all rows of the partition."""
    held: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in [name, *names]]):
            parts = held.setdefault(row[0], [[] for _ in names])
            for p, x in zip(parts, row[1:]):
                p.append(x)
    for bucket in sorted(held):
        yield bucket, [np.frombuffer(b"".join(p), k) for p, k in zip(held.pop(bucket), kinds)]


def _anchors(buckets: int):
    """Distinct (anchor, home block) pairs of each batch; ``many`` if two of its documents have the anchor."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            found = []
            for words in split(batch.column("_text"), lower=False):
                doc, _, _, anchor = _window_index(words)
                if len(doc):
                    new = np.ones(len(doc), bool)
                    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                    found.append((anchor[new], doc[new] + words.first))
            if not found:
                continue
            anchor, doc = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            home = block[doc]
            order = np.lexsort((doc, home, anchor))
            anchor, home, doc = anchor[order], home[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (home[1:] != home[:-1])]))
            last = np.append(first[1:], len(anchor)) - 1
            many = (doc[last] != doc[first]).astype(np.uint8)
            anchor, home = anchor[first], home[first].astype(np.int32)
            yield _packed((anchor % np.uint64(buckets)).astype(np.int64), [anchor, home, many], "bucket", ["anchors", "homes", "many"])

    return f


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that two documents have, sent to the home blocks of both."""
    for _, (anchor, home, many) in _gathered(batches, "bucket", ["anchors", "homes", "many"], [np.uint64, np.int32, np.uint8]):
        order = np.lexsort((home, anchor))
        anchor, home, many = anchor[order], home[order], many[order]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(anchor)))
        shared = np.repeat((size > 1) | (np.maximum.reduceat(many, first) > 0 if len(first) else np.zeros(0, bool)), size)
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (home[1:] != home[:-1])
        keep = shared & new
        if keep.any():
            yield _packed(home[keep], [anchor[keep]], "block", ["entries"])


def _member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value stands in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values, at


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("entries",)) -> Iterator[tuple[int, pa.RecordBatch | None, list[tuple[bytes, ...]]]]:
    """Slices of batches sorted by (block, kind): (block, documents or None, entries met in this slice)."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist() if len(block) else []
        for a, b in zip(cut, [*cut[1:], len(block)]):
            part = batch.slice(a, b - a)
            mask = pc.is_valid(part.column(names[0]))
            entries = list(zip(*[part.column(c).filter(mask).to_pylist() for c in names]))
            docs = part.filter(pc.invert(mask))
            yield int(block[a]), docs if len(docs) else None, entries


_WINDOW = np.dtype([("hash", np.uint64), ("doc", np.int64), ("first", np.int32), ("more", np.uint8)])


def _candidate_windows(buckets: int):
    """For each block, the windows with shared anchors: hash, smallest document here, its place, and whether another has it here too."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, table = None, [], np.zeros(0, np.uint64)
        for block, docs, entries in _blocks(batches):
            if block != at:
                at, held, table = block, [], None
            held += entries
            if docs is None:
                continue
            if table is None or entries:
                table = np.unique(np.frombuffer(b"".join(x for x, in held), np.uint64))
            if not len(table):
                continue
            ids = docs.column("doc_id").to_numpy()
            found = []
            for words in split(docs.column("_text"), lower=False):
                doc, first, hashes, anchor = _window_index(words)
                hit, _ = _member(anchor, table)
                found.append((hashes[hit], ids[doc[hit] + words.first], first[hit]))
            if not found:
                continue
            h, d, p = (np.concatenate([x[i] for x in found]) for i in range(3))
            if not len(h):
                continue
            order = np.lexsort((p, d, h))
            h, d, p = h[order], d[order], p[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            last = np.append(start[1:], len(h)) - 1
            out = np.empty(len(start), _WINDOW)
            out["hash"], out["doc"], out["first"], out["more"] = h[start], d[start], p[start], d[last] != d[start]
            home = np.full(len(start), block, np.int32)
            yield _packed((out["hash"] % np.uint64(buckets)).astype(np.int64), [out, home], "bucket", ["windows", "homes"])

    return f


_REQUEST = np.dtype([("hash", np.uint64), ("doc", np.int64), ("first", np.int32), ("target", np.int32)])


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For windows of two documents or more: the block of the smallest is asked to send its words to the blocks of the others."""
    for _, (w, home) in _gathered(batches, "bucket", ["windows", "homes"], [_WINDOW, np.int32]):
        order = np.lexsort((w["first"], w["doc"], w["hash"]))
        w, home = w[order], home[order]
        if not len(w):
            continue
        start = np.flatnonzero(np.concatenate([[True], w["hash"][1:] != w["hash"][:-1]]))
        at = np.repeat(start, np.diff(np.append(start, len(w))))
        # a block where the smallest document is alone needs nothing
        needed = (w["doc"] != w["doc"][at]) | (w["more"] > 0)
        out = np.empty(int(needed.sum()), _REQUEST)
        out["hash"], out["doc"], out["first"], out["target"] = w["hash"][at][needed], w["doc"][at][needed], w["first"][at][needed], home[needed]
        if len(out):
            yield _packed(home[at][needed], [out], "block", ["entries"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reference passages for other blocks: heads (document, first word, words) and the words.

    Windows asked for that overlap go as one passage.
    """
    at, held, table = None, [], None
    for block, docs, entries in _blocks(batches):
        if block != at:
            at, held, table = block, [], None
        held += entries
        if docs is None:
            continue
        if table is None or entries:
            # blocks send what they know of a window once a batch
            table = np.unique(np.frombuffer(b"".join(x for x, in held), _REQUEST))
            table = table[np.lexsort((table["first"], table["target"], table["doc"]))]
        if not len(table):
            continue
        ids = docs.column("doc_id").to_numpy()
        sent: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for words in split(docs.column("_text"), lower=False):
            own = ids[words.first : words.first + len(words)]
            lo, hi = np.searchsorted(table["doc"], own, "left"), np.searchsorted(table["doc"], own, "right")
            some = np.flatnonzero(hi > lo).tolist()
            if not some:
                continue
            hashes = windows(words.hashes, WINDOW)
            for i in some:
                a, n = int(words.bounds[i]), int(words.bounds[i + 1] - words.bounds[i])
                asked = table[lo[i] : hi[i]]
                asked = asked[asked["first"] + WINDOW <= n]
                # rows that repeat an id: the window has to be this one's
                asked = asked[hashes[a + asked["first"]] == asked["hash"]]
                if not len(asked):
                    continue
                first, target = asked["first"].astype(np.int64), asked["target"]
                start = np.flatnonzero(np.concatenate([[True], (target[1:] != target[:-1]) | (first[1:] > first[:-1] + WINDOW)]))
                last = np.append(start[1:], len(first)) - 1
                for f, e, t in zip(first[start].tolist(), (first[last] + WINDOW).tolist(), target[start].tolist()):
                    sent.setdefault(t, []).append((np.array([own[i], f, e - f], np.int64), words.hashes[a + f : a + e]))
        if sent:
            columns = [pa.array(list(sent), pa.int32()), *[pa.array([np.concatenate([x[k] for x in s]).tobytes() for s in sent.values()], pa.binary()) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, ["block", "heads", "words"])


def _asked_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.unique(np.frombuffer(x, _REQUEST)["doc"]) for x in batch.column("entries").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(ids)) if ids else [], pa.int64())], ["doc_id"])


class Reference:
    """Reference passages of a block, indexed by their 50-word windows."""

    def __init__(self, segments: list[tuple[bytes, bytes]]):
        heads = np.frombuffer(b"".join(h for h, _ in segments), np.int64).reshape(-1, 3)
        self.words = np.frombuffer(b"".join(w for _, w in segments), np.uint64)
        self.doc, self.first = heads[:, 0], heads[:, 1]
        self.end = np.cumsum(heads[:, 2])
        hashes = windows(self.words, WINDOW)
        n = heads[:, 2] - WINDOW + 1
        segment = np.repeat(np.arange(len(heads)), n)
        place = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.end - heads[:, 2], n)
        key, doc = hashes[place], self.doc[segment]
        # the smallest document's passage stands for a window
        order = np.lexsort((self.first[segment] + place, doc, key))
        order = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])] if len(order) else order
        self.key, self.segment, self.place = key[order], segment[order], place[order]

    def found(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which windows may stand in a passage of a document smaller than their owner, and the entry of each."""
        hit, at = _member(hashes, self.key)
        if len(self.key):
            hit &= self.doc[self.segment[at]] < owner
        return hit, at

    def parse(self, words: np.ndarray, hit: np.ndarray, entry: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Greedy factors of one document: (first word, words, reference document, its first word).

        ``hit`` are the starts of the windows that may be found, in order,
        ``entry`` where the index has them.
        """
        out, k = [], 0
        while k < len(hit):
            i, e = int(hit[k]), int(entry[k])
            segment, place = int(self.segment[e]), int(self.place[e])
            n = min(len(words) - i, int(self.end[segment]) - place)
            differ = words[i : i + n] != self.words[place : place + n]
            n = int(differ.argmax()) if differ.any() else n
            if n < WINDOW:  # another window's hash
                k += 1
                continue
            passage_start = int(self.end[segment - 1]) if segment else 0
            out.append((i, n, int(self.doc[segment]), int(self.first[segment]) + place - passage_start))
            k = int(np.searchsorted(hit, i + n - WINDOW + 1))
        return out


def _parsed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Each document's factors, and what is left of it."""
    at, held, reference = None, [], None
    for block, docs, segments in _blocks(batches, ("heads", "words")):
        if block != at:
            at, held, reference = block, [], None
        held += segments
        if docs is None:
            continue
        if reference is None or segments:
            reference = Reference(held)
        known = pc.is_valid(docs.column("doc_id")).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(docs.column("doc_id"), 0).to_numpy()
        n_words, n_removed, kept, spans = [], [], [], []
        for words in split(docs.column("_text"), lower=False):
            doc, first, hashes, _ = _window_index(words)
            own = doc + words.first
            hit, entry = reference.found(hashes, ids[own])
            at_hit = np.flatnonzero(hit & known[own])
            bounds = np.searchsorted(doc[at_hit], np.arange(len(words) + 1))
            for i in range(len(words)):
                a, b = words.bounds[i], words.bounds[i + 1]
                text = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes()
                pieces = text.split()
                of = at_hit[bounds[i] : bounds[i + 1]]
                found = reference.parse(words.hashes[a:b], first[of], entry[of]) if len(of) else []
                cover = np.zeros(b - a + 1, np.int64)
                for x in found:
                    cover[x[0]] += 1
                    cover[x[0] + x[1]] -= 1
                left = np.flatnonzero(np.cumsum(cover[:-1]) == 0) if found else None
                n_words.append(int(b - a))
                n_removed.append(int(b - a - len(left)) if found else 0)
                kept.append(b" ".join([pieces[k] for k in left.tolist()] if found else pieces))
                spans.append([dict(zip(("first", "words", "ref_doc", "ref_first"), x)) for x in found])
        names = docs.schema.names
        carried = [(c, docs.column(c)) for c in names if c not in ("block", "heads", "words", "_text")]
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        span = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_first", pa.int32())]))
        more = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array([k.decode("utf-8", "replace") if with_text else None for k in kept], pa.string()), "factors": pa.array(spans, span)}
        yield pa.RecordBatch.from_arrays([*[x for _, x in carried], *more.values()], [*[c for c, _ in carried], *more])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Removes each word that a 50-word window covers which also starts in a document with a smaller id.

    Returns ``id_col``, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept``
    (the words left, joined by one space; null without ``with_text``), ``factors`` (the duplicate spans:
    first word, words, reference document, its first word) and the columns
    ``keep``.  Windows are judged on the input.

    Null texts have no words.  Rows without an id lose nothing and are no
    reference; rows that repeat an id are no reference for each other.  A
    passage that a third of all documents share is reported once for each batch
    of rows on its way to the index and sent once to each block, so no task gets
    a row for each document.
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    keep = keep or []
    n = partitions(spark)
    blocks = buckets = n
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    known = rows.filter("doc_id is not null")
    anchors = known.select("block", "_text").mapInArrow(released(_anchors(buckets)), "bucket int, anchors binary, homes binary, many binary")
    shared = scratch.cut(to_partition(anchors, "bucket").mapInArrow(released(_shared_anchors), "block int, entries binary"))
    tidy(spark)

    def beside(entries: DataFrame, docs: DataFrame) -> DataFrame:
        """Documents and entries of a block in one partition, the entries first."""
        names = [c for c in entries.columns if c != "block"]
        both = docs.select("*", *[F.lit(None).cast("binary").alias(c) for c in names]).unionByName(entries, allowMissingColumns=True)
        return to_partition(both, "block").sortWithinPartitions("block", F.col(names[0]).isNull())

    texts = known.select("block", "doc_id", "_text")
    candidates = beside(shared, texts).mapInArrow(released(_candidate_windows(buckets)), "bucket int, windows binary, homes binary")
    asked = scratch.cut(to_partition(candidates, "bucket").mapInArrow(released(_requests), "block int, entries binary"))
    tidy(spark)
    scratch.drop(shared)
    smallest = asked.mapInArrow(released(_asked_ids), "doc_id long").distinct()
    segments = beside(asked, maybe_in(texts, scratch.cut(smallest), "doc_id")).mapInArrow(released(_segments), "block int, heads binary, words binary")
    segments = scratch.cut(segments)
    tidy(spark)
    scratch.drop(asked)
    span = ArrayType(StructType().add("first", "integer").add("words", "integer").add("ref_doc", "long").add("ref_first", "integer"))
    schema = StructType([rows.schema["doc_id"], *[rows.schema[f"_k{i}"] for i in range(len(keep))]])
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string").add("factors", span)
    docs = rows.select("block", "doc_id", "_text", *[f"_k{i}" for i in range(len(keep))])
    out = beside(segments, docs).mapInArrow(released(lambda batches: _parsed(batches, with_text)), schema)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept", "factors", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text; a row that loses nothing stays as it is, one that loses all goes."""
    names = docs.columns
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), whole_row(docs).alias("_row"))
    found = remove_repeats(rows, "_id", "_t", keep=["_row"])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_row").getField(text_col))
    return found.filter("n_removed = 0 or n_removed < n_words").select(*[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in names])
