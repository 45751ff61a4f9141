"""Jaccard similarity join over word shingles with count-vector R-trees.

A document's set are its distinct five-word shingles, hashed to 64 bits.  The
shingles are hashed into groups, and a document's counts by group are a point;
the overlap of two sets is at most the sum of the coordinate-wise minima, which
an R-tree bounds for whole nodes by their boxes.

In one tree over a whole corpus all boxes would meet, since the counts of
unrelated texts are alike.  The points are therefore dealt to trees by
coordinates of a far finer grouping, one shingle each: two sets with a Jaccard
similarity of t share k of the first n - ceil(t n) + k elements of each under
any common order (the prefix filter), so a point is dealt by its first
coordinates only, and no link is lost; a point that shares fewer than k of them
with whatever others has no link and leaves.  Frequent shingles come last in
that order.  Coordinates whose oldest point is the same share one tree.

Only pairs that a tree's search lets through are verified.  The first search
covers each tree: from its oldest point, then from the oldest one not met yet.
Its verified links give classes; the second search is for all pairs of
different classes.  A tree of many points is searched in blocks of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import Scratch, components, maybe_in, partitions, released, spread, tidy, to_partition
from linkforge.llm.words import shingle_sets, split

N, THRESHOLD = 5, (75, 100)
#: Groups of a point in the trees: four shingles or fewer a group on average, from GROUPS to TREE_GROUPS of them.
GROUPS, TREE_GROUPS, LEAF = 128, 1024, 8
#: Points of a tree that one task has at once; a larger tree is searched in blocks.  PIVOTS start the first search, which the second completes.
BLOCK, PIVOTS = 2048, 64
#: The longer a prefix, the more of its elements a link needs: one more for each EXTRA shingles.
EXTRA = 12
#: Slots in which shingles are counted for the common order, and in how many pieces the counts are summed; 2 MB are broadcast.
SLOTS, PIECES = 1 << 18, 16


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of sets of these sizes for the threshold: ceil(t (a + b) / (1 + t))."""
    p, q = THRESHOLD
    return -((-p * (a + b)) // (p + q))


def _extra(n: int) -> int:
    """How many of its first coordinates a point must share at least with another of n shingles or more."""
    return max(1, n // EXTRA)


def _prefix(n: int) -> int:
    p, q = THRESHOLD
    return n + (-p * n) // q + _extra(n) if n else 0


def _count_vector(shingles: np.ndarray, most: int | None = None) -> bytes:
    """Counts by group, in so many groups that one has four shingles or fewer on average (``most`` at most); the first byte is their width.

    In few groups the counts of any two long texts are alike, so groups grow
    with the set; their number is a power of two, and finer counts are folded
    to compare them with coarser ones.
    """
    groups = max(GROUPS, 1 << max(0, (len(shingles) - 1) // 4).bit_length())
    groups = min(groups, most) if most else groups
    v = np.bincount((shingles >> np.uint64(24)).astype(np.int64) & (groups - 1), minlength=groups)
    width = 1 if v.max(initial=0) < 1 << 8 else 2 if v.max() < 1 << 16 else 4
    return bytes([width]) + v.astype(f"<u{width}").tobytes()


def _fine_allowed(a: bytes, b: bytes) -> bool:
    x, y = (np.frombuffer(v, f"<u{v[0]}", offset=1).astype(np.int64) for v in (a, b))
    need = _needed(x.sum(), y.sum())
    if len(x) != len(y):  # both counts are powers of two; the finer is folded
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = y.reshape(-1, len(x)).sum(axis=0)
    return bool(np.minimum(x, y).sum() >= need)


def _groups_of(packed: list[bytes]) -> np.ndarray:
    return np.array([(len(v) - 1) // v[0] for v in packed])


def _vectors(packed: list[bytes], groups: int) -> np.ndarray:
    """Count vectors folded to so many groups, of which each has as many at least."""
    out = np.empty((len(packed), groups), np.int32)
    for i, v in enumerate(packed):
        x = np.frombuffer(v, f"<u{v[0]}", offset=1)
        out[i] = x if len(x) == groups else x.reshape(-1, groups).sum(axis=0)
    return out


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(46)).astype(np.int64)


def _node(s: np.ndarray) -> int:
    """A set's name among the points: 64 bits of a cryptographic hash of its sorted shingles."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: size, digest and count vectors of its set; and the partition's counts of shingles by slot, in pieces."""
    names = ["doc_id", "text_hash", "n", "node", "vector", "fine", "key"]
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        rows: list[tuple[int, int, bytes, bytes]] = []
        held: list[np.ndarray] = []
        for words in split(batch.column("_text"), lower=True):
            for s in shingle_sets(words, N):
                rows.append((len(s), _node(s), _count_vector(s, TREE_GROUPS), _count_vector(s)))
                counts += np.bincount(_slots(s), minlength=SLOTS) if len(s) > SLOTS else 0
                if 0 < len(s) <= SLOTS:
                    held.append(s)
            if held:
                counts += np.bincount(_slots(np.concatenate(held)), minlength=SLOTS)
                held = []
        k = len(rows)
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *[pa.array(c, pa.int64()) for c in columns[:2]], *[pa.array(c, pa.binary()) for c in columns[2:]], pa.nulls(k, pa.int64())], names)
    if counts.any():
        empty = pa.nulls(PIECES, pa.int64())
        pieces = pa.array([x.astype("<u4" if counts.max() < 1 << 32 else "<u8").tobytes() for x in np.split(counts, PIECES)], pa.binary())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pieces, pa.nulls(PIECES, pa.binary()), pa.array(range(PIECES), pa.int64())], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size, sums = SLOTS // PIECES, {}
    for batch in batches:
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("vector").to_pylist()):
            sums.setdefault(key, np.zeros(size, np.int64))
            sums[key] += np.frombuffer(piece, f"<u{len(piece) // size}").astype(np.int64)
    yield pa.RecordBatch.from_pydict({"key": pa.array(list(sums), pa.int64()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})


def _ordered_prefix(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first elements of a sorted set in the common order: by the count of their slot, then by hash.

    Any order is right; in this one shingles that many documents share come
    last, even where a slot's other shingles blur its count.
    """
    return s[np.argsort(counts[_slots(s)], kind="stable")[: _prefix(len(s))]]


_POINT, _PLACE = np.dtype([("node", np.int64), ("age", np.float32)]), np.uint32((1 << 31) - 1)


def _entries(known, buckets: int):
    """For each batch and bucket, one row with the packed entries of the batch's documents.

    An entry is a coordinate and a place in the row's list of points; its top
    bit says that the coordinate is among the first n - ceil(t n) + 1.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in batches:
            keys, places, base, points, ages, met = [], [], [], [], [], set()
            ids = batch.column("doc_id").to_numpy()
            for words in split(batch.column("_text"), lower=True):
                for doc_id, s in zip(ids[words.first :].tolist(), shingle_sets(words, N)):
                    if not len(s):
                        continue
                    node = _node(s)
                    if node in met:  # copies are one point
                        continue
                    met.add(node)
                    prefix = _ordered_prefix(s, counts)
                    keys.append(prefix)
                    places.append(np.full(len(prefix), len(points), np.uint32))
                    base.append(np.arange(len(prefix)) <= len(prefix) - _extra(len(s)))
                    points.append(node)
                    ages.append(doc_id)
            if not keys:
                continue
            key, place = np.concatenate(keys), np.concatenate(places) | (np.concatenate(base).astype(np.uint32) << np.uint32(31))
            table = np.empty(len(points), _POINT)
            table["node"], table["age"] = points, ages
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, place, bucket = key[order], place[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs: list[tuple[bytes, bytes, bytes]] = []
            for a, b in zip(first, np.append(first[1:], len(key))):
                # a point's data go once with its entries
                some, at = np.unique(place[a:b] & _PLACE, return_inverse=True)
                blobs.append((key[a:b].tobytes(), (at.astype(np.uint32) | (place[a:b] & ~_PLACE)).tobytes(), table[some].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *[pa.array(c, pa.binary()) for c in zip(*blobs)]], ["bucket", "keys", "places", "points"])

    return f


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coordinates that two points or more have, a row for each point: (node, the oldest point that has it, base).

    Age is the document's id, to the 24 bits of a float; it only orders.
    """
    held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
    for batch in batches:
        for bucket, *parts in zip(*[batch.column(c).to_pylist() for c in ("bucket", "keys", "places", "points")]):
            held.setdefault(bucket, []).append(tuple(parts))
    for bucket in sorted(held):
        parts = held.pop(bucket)
        key = np.frombuffer(b"".join(p[0] for p in parts), np.int64)
        place = [np.frombuffer(p[1], np.uint32) for p in parts]
        point = np.concatenate([np.frombuffer(p[2], _POINT)[x & _PLACE] for p, x in zip(parts, place)])
        node, age, base = point["node"], point["age"], np.concatenate(place) > _PLACE
        order = np.argsort(key, kind="stable")
        key, node, age, base = key[order], node[order], age[order], base[order]
        alone = np.ones(len(key), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        key, node, age, base = key[~alone], node[~alone], age[~alone], base[~alone]
        # one entry for each point of a tree, with its least age
        order = np.lexsort((age, node, key))
        key, node, age, base = key[order], node[order], age[order], base[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, age, base = key[new], node[new], age[new], base[new]
        order = np.lexsort((node, age, key))
        key, node, base = key[order], node[order], base[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        keep = np.repeat(size > 1, size)
        hub = np.repeat(node[first], size)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(hub), pa.array(base[keep])], ["node", "hub", "base"])


class RTree:
    """A packed R-tree over count vectors, for pairs whose bounded overlap reaches what the threshold needs.

    Points are sorted by size and packed into leaves, the leaves into nodes and
    so on.  A node keeps the coordinate-wise maxima and the least and largest
    size below it; the overlap of anything below two nodes is at most the sum
    of the minima of their maxima.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes = points, points.sum(axis=1)
        # by size, and among like sizes by the heaviest half of the coordinates, so that boxes are small
        self.order = np.lexsort((points[:, : points.shape[1] // 2].sum(axis=1), self.sizes))
        self.leaf = leaf
        levels = [(self.points[self.order], self.sizes[self.order], self.sizes[self.order])]
        while len(levels[-1][0]) > 1:
            box, low, high = levels[-1]
            cut = np.arange(0, len(box), leaf)
            levels.append((np.maximum.reduceat(box, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        self.levels = levels

    def near(self, point: int) -> np.ndarray:
        """Indexes of the points whose bounded overlap with this one reaches what the threshold needs."""
        p, q = THRESHOLD
        own, n = self.points[point], int(self.sizes[point])
        at = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            box, low, high = self.levels[level]
            at = at[(q * high[at] >= p * n) & (p * low[at] <= q * n)]
            at = at[np.minimum(box[at], own).sum(axis=1) >= _needed(low[at], n)]
            if level:
                at = (at[:, None] * self.leaf + np.arange(self.leaf)).reshape(-1)
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]

    def pairs(self, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i, j) that the bound lets through; with ``group``, only pairs of different groups."""
        p, q = THRESHOLD
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            box, low, high = self.levels[level]
            # b stands at or after a in the order of sizes, so its least size decides
            near = q * high[a] >= p * low[b]
            a, b = a[near], b[near]
            for x in range(0, len(a), 16_384):
                i, j = a[x : x + 16_384], b[x : x + 16_384]
                if group is not None and level == 0:
                    differ = group[self.order[i]] != group[self.order[j]]
                    i, j = i[differ], j[differ]
                bound = np.minimum(box[i], box[j]).sum(axis=1)
                met = bound >= _needed(low[i], low[j])
                i, j = i[met], j[met]
                if not len(i):
                    continue
                if level == 0:
                    yield self.order[i], self.order[j]
                    continue
                size = len(self.levels[level - 1][0])
                k = np.arange(self.leaf)
                for y in range(0, len(i), 64):
                    left = (i[y : y + 64, None, None] * self.leaf + k[None, :, None]) + 0 * k[None, None, :]
                    right = (j[y : y + 64, None, None] * self.leaf + k[None, None, :]) + 0 * k[None, :, None]
                    left, right = left.reshape(-1), right.reshape(-1)
                    ok = (left < size) & (right < size) & ((left < right) if level == 1 else (left <= right))
                    stack.append((level - 1, left[ok], right[ok]))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose fine count vectors allow the threshold."""
    for batch in batches:
        keep = pa.array([_fine_allowed(x, y) for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(axis=1) >= _needed(a.sum(axis=1), b.sum(axis=1))


def _sent(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _trees(batches: Iterator[pa.RecordBatch], names: list[str], rows: int = 20_000) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[bytes]]]:
    """Trees, many at a time: where each begins, the columns of its points and their vectors.

    Rows come sorted by (hub, block), which name a tree or a part of one.
    """
    held: list[tuple[list[np.ndarray], list[bytes]]] = []
    size = 0

    def joined() -> tuple[list[np.ndarray], list[bytes]]:
        return [np.concatenate([h[0][i] for h in held]) for i in range(len(names) + 2)], [x for h in held for x in h[1]]

    def starts(columns: list[np.ndarray]) -> np.ndarray:
        hub, block = columns[:2]
        return np.flatnonzero(np.concatenate([[True], (hub[1:] != hub[:-1]) | (block[1:] != block[:-1])]))

    for batch in batches:
        if not len(batch):
            continue
        held.append(([batch.column(c).to_numpy() for c in ("hub", "block", *names)], batch.column("vector").to_pylist()))
        size += len(batch)
        if size >= rows:
            columns, vectors = joined()
            first = starts(columns)
            cut = int(first[-1])  # the last tree may go on
            if cut:
                yield first[:-1], [c[:cut] for c in columns[2:]], vectors[:cut]
            held, size = [([c[cut:] for c in columns], vectors[cut:])], len(vectors) - cut
    if held:
        columns, vectors = joined()
        yield starts(columns), columns[2:], vectors


def _leaf_pairs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of points within the trees that are one leaf."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(size[(size > 1) & (size <= LEAF)]).tolist():
        i, j = np.triu_indices(n, 1)
        at = first[size == n][:, None]
        left.append((at + i).reshape(-1))
        right.append((at + j).reshape(-1))
    return np.concatenate(left), np.concatenate(right)


def _once(i: np.ndarray, j: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different points, each pair of points once."""
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return i[order[new & (a != b)]], j[order[new & (a != b)]]


def _bound_met(i: np.ndarray, j: np.ndarray, vector: list[bytes], groups: np.ndarray) -> np.ndarray:
    """Which pairs the bound lets through, each in the coarser groups of its two points."""
    out, least = np.zeros(len(i), bool), np.minimum(groups[i], groups[j])
    for g in np.unique(least).tolist():
        for x in np.array_split(np.flatnonzero(least == g), max(1, int((least == g).sum()) // 8192)):
            rows, at = np.unique(np.concatenate([i[x], j[x]]), return_inverse=True)
            points = _vectors([vector[r] for r in rows.tolist()], g)
            out[x] = _allowed(points[at[: len(x)]], points[at[len(x) :]])
    return out


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first search: pairs that the trees let through and that join what may be linked.

    A tree of one leaf gives all its pairs.  In a larger one the oldest point is
    a pivot: the tree is searched for all points that may be linked with it,
    then from the oldest point not met yet, PIVOTS times at most; pairs without
    a pivot are left to the second search.
    """
    for first, (node, age), vector in _trees(batches, ["node", "rep"]):
        groups, size = _groups_of(vector), np.diff(np.append(first, len(node)))
        i, j = _once(*_leaf_pairs(first, size), node)
        met = _bound_met(i, j, vector, groups)
        left, right = [i[met]], [j[met]]
        for at, n in zip(first[size > LEAF].tolist(), size[size > LEAF].tolist()):
            tree = RTree(_vectors(vector[at : at + n], int(groups[at : at + n].min())))
            open_, order = np.ones(n, bool), np.lexsort((node[at : at + n], age[at : at + n]))
            for _ in range(PIVOTS):
                if not open_.any():
                    break
                pivot = int(order[open_[order].argmax()])
                found = tree.near(pivot)
                found = found[open_[found] & (node[at + found] != node[at + pivot])]
                open_[pivot] = open_[found] = False
                left.append(np.full(len(found), at + pivot))
                right.append(at + found)
        i, j = _once(np.concatenate(left), np.concatenate(right), node)
        yield _sent(node[i], node[j])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second search: all pairs of different classes that the trees let through."""
    for first, (node, group), vector in _trees(batches, ["node", "class"]):
        groups = _groups_of(vector)
        for at, end in zip(first.tolist(), np.append(first[1:], len(node)).tolist()):
            tree = RTree(_vectors(vector[at:end], int(groups[at:end].min())))
            for i, j in tree.pairs(group[at:end]):
                i, j = _once(at + i, at + j, node)
                yield _sent(node[i], node[j])


def _of_point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the set that the point is; rows that repeat an id may have others."""
    for batch in batches:
        own = [_node(s) for s in split_sets(batch.column("text"))]
        keep = pc.equal(batch.column("node"), pa.array(own, pa.int64()))
        yield batch.filter(keep)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose shingle sets, made anew from the texts, reach the threshold."""
    p, q = THRESHOLD
    for batch in batches:
        keep = []
        for x, y in zip(split_sets(batch.column("ta")), split_sets(batch.column("tb"))):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(q * both >= p * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def split_sets(column: pa.Array) -> Iterator[np.ndarray]:
    for words in split(column, lower=True):
        yield from shingle_sets(words, N)


def _blocks_of(members: DataFrame) -> DataFrame:
    """(hub, block, node, class) of the second search: a tree of up to BLOCK points is one block.

    A larger one has its largest class in parts, each with each part of the
    other points, and these parts with each other.  Where the largest class
    stands beside others only pairs with it are looked for: there the others
    pass for one class.
    """
    small = members.filter(f"k + others <= {BLOCK}").select("hub", F.lit(0).cast("long").alias("block"), "node", "class")
    large = members.filter(f"k + others > {BLOCK}").withColumn("s", F.expr(f"(k + {BLOCK - 1}) div {BLOCK}")).withColumn("r", F.expr(f"(others + {BLOCK - 1}) div {BLOCK}"))
    large = large.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("class") == F.col("most"), F.col("s")).otherwise(F.col("r"))))
    own = large.filter("class = most").select("hub", F.explode(F.expr("transform(sequence(0L, r - 1), j -> 1 + part * r + j)")).alias("block"), "node", "class")
    rest = large.filter("class <> most")
    beside = rest.select("hub", F.explode(F.expr("transform(sequence(0L, s - 1), i -> 1 + i * r + part)")).alias("block"), "node", F.expr("~most").alias("class"))
    among = rest.select("hub", F.explode(F.expr("transform(sequence(0L, r - 1), j -> -1 - (least(part, j) * r + greatest(part, j)))")).alias("block"), "node", "class")
    return small.unionByName(own).unionByName(beside).unionByName(among)


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of each document under links of a Jaccard similarity of 0.75 or more.

    Returns one row for each row: ``id_col``, ``n_shingles``,
    ``component_id``, the smallest id reachable by links, and ``text_hash``,
    which tells rows that repeat an id apart.

    Steps: profiles of all sets; equal sets become one point; points are dealt
    to trees by the coordinates they share; the first search of the trees and
    its verified links give classes; the second searches them for pairs of
    different classes.  Pairs within a class need no verification, so a group of
    thousands of near copies costs about as many pairs as it has members, and
    still no pair of different classes is left out.

    Null and empty texts have no shingles and link with nothing.  Rows without
    an id take part in nothing and have a null component.  Rows that repeat an
    id are each judged by their own text.  An empty table gives an empty
    result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("_text"))
    profiles = scratch.cut(hashed.mapInArrow(released(_profiles), "doc_id long, text_hash long, n long, node long, vector binary, fine binary, key long"))
    counts = np.zeros(SLOTS, np.int64)
    for r in spread(profiles.filter("key is not null").select("key", "vector"), "key").mapInArrow(released(_summed), "key long, counts binary").collect():
        counts[r["key"] * (SLOTS // PIECES) :][: SLOTS // PIECES] += np.frombuffer(r["counts"], np.int64)
    known = spark.sparkContext.broadcast(counts)
    sets = profiles.filter("key is null").select("doc_id", "text_hash", "n", "node", "vector", "fine")
    points = scratch.cut(sets.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("vector").alias("vector"), F.first("fine").alias("fine")))

    buckets = partitions(spark)
    entries = rows.filter("doc_id is not null").mapInArrow(released(_entries(known, buckets)), "bucket int, keys binary, places binary, points binary")
    shared = scratch.cut(to_partition(entries, "bucket").mapInArrow(released(_shared), "node long, hub long, base boolean"))
    tidy(spark)
    # a partner has three quarters of a point's shingles at least
    p, q = THRESHOLD
    enough = F.greatest(F.lit(1), F.expr(f"(n * {p} + {q - 1}) div {q} div {EXTRA}"))
    linkable = shared.groupBy("node").agg(F.count("*").alias("shares")).join(points.select("node", "n"), "node").filter(F.col("shares") >= enough)
    linkable = scratch.cut(linkable.select("node"))
    # the longer prefix has been for counting; one shared coordinate of the shorter is enough to meet
    trees = scratch.cut(shared.filter("base").select("hub", "node").distinct().join(linkable, "node"))
    scratch.drop(shared)

    def links_of(pairs: DataFrame) -> DataFrame:
        """Bounds pairs by their fine vectors and verifies those left; only the texts of their documents are shuffled."""
        fine = points.select("node", "fine")
        pairs = pairs.join(fine.select(F.col("node").alias("a"), F.col("fine").alias("va")), "a").join(fine.select(F.col("node").alias("b"), F.col("fine").alias("vb")), "b")
        pairs = scratch.cut(pairs.select("a", "b", "va", "vb").mapInArrow(released(_bounded), "a long, b long"))
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = scratch.cut(nodes.join(points, "node").select("node", "rep"))
        some = maybe_in(rows, wanted, "rep")
        texts = some.join(wanted, some["doc_id"] == wanted["rep"]).select("node", F.col("_text").alias("text"))
        texts = scratch.cut(texts.mapInArrow(released(_of_point), "node long, text string").dropDuplicates(["node"]))
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        out = scratch.cut(both.select("a", "b", "ta", "tb").mapInArrow(released(_verified), "a long, b long"))
        scratch.drop(texts, wanted, pairs)
        return out

    def planted(members: DataFrame, *columns: str) -> DataFrame:
        """The trees' points with their vectors, a tree or block of one in one partition."""
        with_vector = members.join(points.select("node", "rep", "vector"), "node")
        return spread(with_vector, "hub", "block").select("hub", "block", "node", *columns, "vector").sortWithinPartitions("hub", "block")

    sizes = scratch.cut(trees.groupBy("hub").agg(F.count("*").alias("m")).filter("m > 1"))
    members = trees.join(sizes, "hub")
    blocks = F.expr(f"(m + {BLOCK - 1}) div {BLOCK}")
    dealt = members.select("hub", "node", F.pmod(F.xxhash64("node"), blocks).alias("block"))
    # the oldest point of a tree in blocks goes to all of them
    of_large = members.filter(f"m > {BLOCK}").join(points.select("node", "rep"), "node")
    oldest = of_large.groupBy("hub").agg(F.min(F.struct("rep", "node")).alias("o"), F.first("m").alias("m"))
    oldest = oldest.select("hub", F.col("o.node").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    first = links_of(planted(dealt.unionByName(oldest).distinct(), "rep").mapInArrow(released(_covered), "a long, b long").distinct())
    classes = scratch.cut(components(scratch, first))

    # trees of one leaf have been searched for all pairs
    members = members.filter(f"m > {LEAF}").join(classes, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("class"))
    of_class = members.groupBy("hub", "class").agg(F.count("*").alias("k"))
    mixed = of_class.groupBy("hub").agg(F.count("*").alias("classes"), F.max(F.struct("k", "class")).alias("most"), F.sum("k").alias("m")).filter("classes > 1")
    mixed = mixed.select("hub", F.col("most.class").alias("most"), F.col("most.k").alias("k"), (F.col("m") - F.col("most.k")).alias("others"))
    members = scratch.cut(members.join(mixed, "hub"))
    second = links_of(planted(_blocks_of(members), "class").mapInArrow(released(_crossed), "a long, b long").distinct())
    scratch.drop(trees, members, sizes)
    links = first.unionByName(second)

    final = components(scratch, links)
    of_point = points.select("node", "rep").join(final, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("class"))
    smallest = of_point.groupBy("class").agg(F.min("rep").alias("component_id"))
    named = of_point.join(smallest, "class").select(F.col("node").alias("_node"), F.col("component_id").alias("_class"))
    out = sets.join(named, (sets["node"] == named["_node"]) & (sets["n"] > 0) & sets["doc_id"].isNotNull(), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("_class", "doc_id").alias("component_id"), "text_hash")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that with the smallest id, all columns as they are; rows without an id stay.

    Rows that repeat an id stay or go by their own text: all whose class has
    that id as its smallest stay.
    """
    classes = ngram_join(docs, id_col, text_col)
    gone = classes.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, (docs[id_col].cast("long") == gone["_gone"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["_hash"]), "left_anti")
