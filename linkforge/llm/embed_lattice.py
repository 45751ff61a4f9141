"""Near duplicates among embeddings by E8 lattice hashing.

Each table projects the unit vectors to three blocks of 8 dimensions and decodes
each block to its nearest point of the E8 lattice; the three points are a cell.
A vector is filed in its own cell and looks into its own cell and the cells
next to it: those whose point differs by the minimal lattice vectors nearest to
what decoding left over.  Pairs that meet are verified by cosine in double
precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import Scratch, components
from linkforge.llm.words import mix64

BLOCKS, TABLES, PROBES, SCALE = 3, 20, 8, 0.6


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row of 8 coordinates, doubled so that it is whole numbers."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
        worst = np.abs(off[odd]).argmax(axis=1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return (2 * np.where(nearer[:, None], whole, half)).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = [0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = [1 if bits >> k & 1 else -1 for k in range(8)]
        if v.count(-1) % 2 == 0:
            out.append(v)
    return np.array(out, np.int64)


def cells(unit: np.ndarray, seed: int = 7, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the own cell (n x tables) and of the probed cells (n x tables x probes) of unit vectors."""
    n, d = unit.shape
    rng = np.random.default_rng(seed)
    short = minimal_vectors()
    coefficients = rng.integers(1, 2**63, (BLOCKS, 8), dtype=np.uint64) | np.uint64(1)
    own, near = np.empty((n, tables), np.uint64), np.empty((n, tables, probes), np.uint64)
    steps = [(short.astype(np.uint64) * coefficients[b]).sum(axis=1) for b in range(BLOCKS)]
    for t in range(tables):
        total, gains, moves = np.full(n, t + 1, np.uint64), [], []
        for b in range(BLOCKS):
            x = unit @ (rng.standard_normal((d, 8)) * scale) + rng.random(8)
            point = decode_e8(x)
            total += (point.astype(np.uint64) * coefficients[b]).sum(axis=1, dtype=np.uint64)
            gain = (x - point / 2) @ short.T.astype(float)
            top = np.argpartition(-gain, probes, axis=1)[:, :probes]
            gains.append(np.take_along_axis(gain, top, axis=1))
            moves.append(steps[b][top])
        best = np.argpartition(-np.hstack(gains), probes, axis=1)[:, :probes]
        own[:, t] = mix64(total)
        near[:, t] = mix64(total[:, None] + np.take_along_axis(np.hstack(moves), best, axis=1))
    return own, near


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of one length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has only finite components and one that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0))


def link_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, seed: int = 7) -> DataFrame:
    """Links rows whose vectors have a cosine of ``threshold`` or more, and gives each row its class.

    Returns one row for each input row: ``id_col``, ``n_links`` (other rows
    linked directly), ``component_id`` (smallest id reachable) and ``kept``
    (the id is the component's).  Rows of one and the same vector are hashed
    and compared once and count each as a link of the others, so a vector that
    a third of all rows share costs no pair.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; so do vectors of different lengths with each other.  A
    null id takes part in no link and has a null component; rows that repeat an
    id each count as a row.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scratch.cut(df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).withColumn("_h", F.xxhash64("_v")))
    good = _usable(rows.filter("_id is not null"), "_v")
    # a point for each distinct vector, whatever ids it has; its number is drawn once and written
    points = good.groupBy("_h", "_v").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"))
    points = scratch.cut(points.withColumn("node", F.monotonically_increasing_id()))
    sizes = [r[0] for r in points.select(F.size("_v")).distinct().collect()]
    found = None
    for size in sizes:
        here = points.filter(F.size("_v") == size)

        def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("_v"))
                peak = np.abs(x).max(axis=1, keepdims=True)
                x = x / peak
                own, near = cells(x / np.linalg.norm(x, axis=1, keepdims=True), seed)
                keys = np.concatenate([own[:, :, None], near], axis=2)
                home = np.zeros(keys.shape, bool)
                home[:, :, 0] = True
                each = keys.shape[1] * keys.shape[2]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), each)), pa.array(home.reshape(-1))], ["cell", "node", "home"])

        entries = scratch.cut(here.select("node", "_v").mapInArrow(filed, "cell long, node long, home boolean"))
        homes = entries.filter("home").select("cell", F.col("node").alias("a"))
        pairs = homes.join(entries.select("cell", F.col("node").alias("b")), "cell").filter("a <> b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = pairs.join(here.select(F.col("node").alias("a"), F.col("_v").alias("_x")), "a").join(here.select(F.col("node").alias("b"), F.col("_v").alias("_y")), "b")

        def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = _matrix(batch.column("_x")), _matrix(batch.column("_y"))
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                keep = pa.array(cosine >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

        links = both.select("a", "b", "_x", "_y").mapInArrow(verified, "a long, b long")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "a long, b long")
    links = scratch.cut(found)
    classes = components(scratch, links)
    copies = points.select(F.col("node").alias("b"), "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    of_point = points.join(degree, points["node"] == degree["a"], "left").join(classes.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    of_point = of_point.select("_h", "_v", "rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("class"))
    smallest = of_point.groupBy("class").agg(F.min("rep").alias("c"))
    of_point = of_point.join(smallest, "class").select(F.col("_h").alias("_g"), F.col("_v").alias("_w"), "n", "c")
    out = rows.join(of_point, (rows["_h"] == of_point["_g"]) & (rows["_v"] == of_point["_w"]) & rows["_id"].isNotNull(), "left")
    component = F.coalesce("c", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
