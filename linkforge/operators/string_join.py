"""All pairs of strings whose Jaro-Winkler similarity reaches a threshold, without comparing most others.

Common characters, lengths and the first four characters bound the similarity.
Strings are filed in cells by their first character and length; cells whose
bounds keep them apart never meet, strings of the cells that do are bounded one
by one, and only what is left is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.functions.strsim import _codes, jaro_winkler_many
from linkforge.operators.scratch import Tables

#: Groups of first characters, length classes (each a quarter longer than the one before), groups in which characters are counted.
FIRST, CLASSES, GROUPS = 32, 40, 64
BLOCK_ROWS = 2048
_SLACK = 1e-9


def bound(c: np.ndarray, n: np.ndarray, m: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """What the similarity of strings of n and m characters doesn't exceed, with at most c in common and so many equal at the start."""
    c = np.minimum(c, np.minimum(n, m))
    jaro = np.where(c > 0, (c / np.maximum(n, 1) + c / np.maximum(m, 1) + 1) / 3, 0.0)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro) + _SLACK


def _class(n: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.floor(np.log(np.maximum(n, 1)) / np.log(1.25))).astype(np.int64)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, characters of each group (strings x groups) and the first four characters."""
    codes, n = _codes(texts)
    row, at = np.nonzero(np.arange(codes.shape[1]) < n[:, None])
    groups = np.zeros((len(texts), GROUPS), np.int32)
    np.add.at(groups, (row, codes[row, at] % GROUPS), 1)
    four = np.zeros((len(texts), 4), np.uint32)
    four[:, : min(4, codes.shape[1])] = codes[:, :4]
    return n, groups, four


def allowed_cells(cells: np.ndarray, longest: np.ndarray, shortest: np.ndarray, most: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of cells (first x CLASSES + class) that can hold a pair as similar as the threshold, each pair once."""
    left, right = [], []
    for i in range(len(cells)):
        j = np.arange(i, len(cells))
        c = np.minimum(np.minimum(most[i], most[j]).sum(axis=1), np.minimum(longest[i], longest[j]))
        # the largest share of common characters that lengths in both ranges allow
        n = np.maximum(shortest[i], np.minimum(c, longest[i]))
        m = np.maximum(shortest[j], np.minimum(c, longest[j]))
        same = np.where(cells[i] // CLASSES == cells[j] // CLASSES, 4, 0)
        ok = bound(c, n, m, same) >= threshold
        left.append(np.full(int(ok.sum()), cells[i]))
        right.append(cells[j[ok]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


@dataclass
class SimilarStrings:
    """``pairs``: (orig_idxs, match_idxs, similarity) of different strings by the least id of each; ``members``: (rep, id); ``work``: (met, compared), pairs bounded one by one and pairs compared."""

    pairs: DataFrame
    members: DataFrame
    work: DataFrame
    strings: int

    def compared(self) -> int:
        return self.work.agg(F.sum("compared")).first()[0] or 0

    def rows(self) -> DataFrame:
        """(orig_idxs, match_idxs, similarity) of all rows, orig < match; copies are pairs at 1 (an empty string's at 0 are none)."""
        a, b = self.members.select(F.col("rep").alias("a"), F.col("id").alias("x")), self.members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        across = self.pairs.join(a, F.col("a") == F.col("orig_idxs")).join(b, F.col("b") == F.col("match_idxs")).select(F.least("x", "y").alias("orig_idxs"), F.greatest("x", "y").alias("match_idxs"), "similarity")
        within = a.join(b, F.col("a") == F.col("b")).filter("x < y").select(F.col("x").alias("orig_idxs"), F.col("y").alias("match_idxs"), F.lit(1.0).alias("similarity"))
        return across.unionByName(within)


def similar_strings(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.9, block_rows: int = BLOCK_ROWS) -> SimilarStrings:
    """Pairs of different strings with a similarity of ``threshold`` or more (above 0); no pair is lost.

    Null and empty strings are like nothing.  A string that many rows have is
    one, under its least id.  What comes to the driver is a row for each cell,
    at most FIRST x CLASSES.
    """
    if not threshold > 0:
        raise ValueError("a threshold above 0")
    spark = df.sparkSession
    tables = Tables(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null and text <> ''").withColumn("_h", F.xxhash64("text"))
    one = tables.written(rows.groupBy("_h", "text").agg(F.min("id").alias("rep")))
    kind = dict(one.dtypes)["rep"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                n, groups, four = counted(batch.column("text").to_pylist())
                cell = (four[:, 0] % FIRST).astype(np.int64) * CLASSES + _class(n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * GROUPS), pa.array(groups.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("rep"), batch.column("text"), pa.array(n.astype(np.int32)), lists], ["cell", "id", "text", "n", "groups"])

    filed = tables.written(one.select("rep", "text").mapInArrow(f, f"cell int, id {kind}, text string, n int, groups array<int>"))
    found = filed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("n").alias("longest"), F.min("n").alias("shortest"), *[F.max(F.col("groups")[g]).alias(f"g{g}") for g in range(GROUPS)]).orderBy("cell").toPandas()
    cells = found["cell"].to_numpy(np.int64)
    a, b = allowed_cells(cells, found["longest"].to_numpy(np.int64), found["shortest"].to_numpy(np.int64), found[[f"g{g}" for g in range(GROUPS)]].to_numpy(np.int64), threshold)
    parts = dict(zip(cells.tolist(), (-(-found["rows"].to_numpy(np.int64) // block_rows)).tolist()))
    met = pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "na": [parts[x] for x in a.tolist()], "nb": [parts[x] for x in b.tolist()]})
    met = spark.createDataFrame(met, "a int, b int, na int, nb int") if len(met) else spark.createDataFrame([], "a int, b int, na int, nb int")

    def dealt(own: str, n: str, mine: str, other: str, m: str) -> DataFrame:
        # renamed to themselves, since both sides are one table
        out = filed.select("cell", "id", "text").toDF("cell", "id", "text").join(F.broadcast(met.toDF(*met.columns)), F.col("cell") == F.col(own))
        return out.select("a", "b", "id", "text", F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other))

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, similar, n_met, n_compared = ([], []), [], 0, 0
        if len(left) and len(right):
            x, y = left["text"].to_pylist(), right["text"].to_pylist()
            (n, gx, fx), (m, gy, fy) = counted(x), counted(y)
            own = [t["id"].to_numpy(zero_copy_only=False) for t in (left, right)]
            same_cell = left["a"][0].as_py() == left["b"][0].as_py()
            for at in range(0, len(x), 256):
                rows_ = slice(at, at + 256)
                common = sum(np.minimum(gx[rows_, g, None], gy[None, :, g]) for g in range(GROUPS))
                alike = np.minimum.accumulate((fx[rows_, None] == fy[None]) & (fx[rows_, None] > 0), axis=2).sum(axis=2)
                ok = bound(common, n[rows_, None], m[None], alike) >= threshold
                # of a cell's pairs with itself each once
                open_ = own[0][rows_, None] < own[1][None] if same_cell else own[0][rows_, None] != own[1][None]
                n_met += int(open_.sum())
                i, j = np.nonzero(ok & open_)
                n_compared += len(i)
                s = jaro_winkler_many([x[at + k] for k in i.tolist()], [y[k] for k in j.tolist()])
                keep = s >= threshold
                ids[0].append(own[0][rows_][i[keep]])
                ids[1].append(own[1][j[keep]])
                similar.append(s[keep])
        kind_ = left["id"].type if len(left) else right["id"].type
        first, second = (pa.array(np.concatenate(v) if v else [], kind_) for v in ids)
        lead = lambda v, value, t: pa.concat_arrays([pa.array([value], t), v])
        # the first row says what was done
        return pa.Table.from_arrays([lead(first, None, kind_), lead(second, None, kind_), lead(pa.array(np.concatenate(similar) if similar else [], pa.float64()), None, pa.float64()), pa.array([n_met] + [0] * len(first), pa.int64()), pa.array([n_compared] + [0] * len(first), pa.int64())], ["a", "b", "similarity", "met", "compared"])

    keys = ["a", "b", "_p", "_q"]
    done = dealt("a", "na", "_p", "_q", "nb").groupBy(*keys).cogroup(dealt("b", "nb", "_q", "_p", "na").groupBy(*keys)).applyInArrow(compared, f"a {kind}, b {kind}, similarity double, met long, compared long")
    done = tables.written(done)
    pairs = done.filter("a is not null").select(F.least("a", "b").alias("orig_idxs"), F.greatest("a", "b").alias("match_idxs"), "similarity")
    o = one.select(F.col("_h").alias("_g"), F.col("text").alias("_t"), "rep")
    members = rows.join(o, (F.col("_h") == F.col("_g")) & (F.col("text") == F.col("_t"))).select("rep", "id")
    return SimilarStrings(pairs, members, done.filter("a is null").select("met", "compared"), int(found["rows"].sum()))


def jaro_winkler_join(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.9) -> DataFrame:
    """(orig_idxs, match_idxs, similarity), orig < match, of all rows; see ``similar_strings``."""
    return similar_strings(df, id_col, text_col, threshold).rows()
