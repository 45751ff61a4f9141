"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Every passage is encoded from its
characters and its repetitions, gated attention weighs the passages, and the
weighted mean of their codes is scored by a logistic unit.  Only the
documents' labels are learnt from; the attention learns which passages matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkforge.llm.common import released, whole_row
from linkforge.llm.labels import bounded_sample, held_out, labelled
from linkforge.llm.words import split

PASSAGE_WORDS = 64
#: Training reads at most so many labelled documents, each of at most so many bytes; scoring has no limit.
SAMPLE_DOCS, SAMPLE_BYTES = 4_000, 100_000
THRESHOLD = 0.3

# classes of bytes: 0 other control, 1 a-z, 2 A-Z, 3 0-9, 4 lead byte of a longer character, 5 its other bytes, 6 line end, 7 other white space, 8... each ASCII sign
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 4, 5
_CLASS[[10, 13]], _CLASS[[9, 11, 12, 32]] = 6, 7
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_SIGNS] = 8 + np.arange(len(_SIGNS))
N_CLASSES = 8 + len(_SIGNS)
N_FEATURES = N_CLASSES + 5


def passages(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the documents: features of all passages, and the bounds of each document's passages.

    A document without words is one passage of zeros.
    """
    for words in split(column, lower=False):
        n_words = np.diff(words.bounds)
        n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
        bounds = np.concatenate([[0], np.cumsum(n_passages)])
        total = int(bounds[-1])
        out = np.zeros((total, N_FEATURES), np.float32)
        if len(words.starts):
            doc = np.repeat(np.arange(len(n_words)), n_words)
            within = np.arange(len(words.starts)) - words.bounds[doc]
            passage = bounds[doc] + within // PASSAGE_WORDS
            # a passage has the bytes from its first word to the next passage or the document's end
            first = np.flatnonzero(within % PASSAGE_WORDS == 0)
            begin, end = words.starts[first], words.offsets[doc[first] + 1]
            end[:-1] = np.minimum(end[:-1], begin[1:])
            gaps = begin - np.concatenate([[0], end[:-1]])
            owner = np.stack([np.full(len(first), total), passage[first]], axis=1).reshape(-1)
            of_byte = np.repeat(owner, np.stack([gaps, end - begin], axis=1).reshape(-1))
            counts = np.bincount(of_byte * N_CLASSES + _CLASS[words.data[: len(of_byte)]], minlength=(total + 1) * N_CLASSES).reshape(-1, N_CLASSES)[:total]
            size = np.maximum(1, counts.sum(axis=1, keepdims=True))
            out[:, :N_CLASSES] = np.sqrt(counts / size)
            in_passage = np.bincount(passage, minlength=total)
            n = np.maximum(1, in_passage)
            same = np.zeros(len(passage), bool)
            same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (passage[1:] == passage[:-1])
            order = np.lexsort((words.hashes, passage))
            h, p = words.hashes[order], passage[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
            length = words.ends - words.starts
            out[:, N_CLASSES] = np.bincount(passage, same, total) / n
            out[:, N_CLASSES + 1] = np.bincount(p, new, total) / n
            out[:, N_CLASSES + 2] = np.log1p(np.bincount(passage, length, total) / n)
            out[:, N_CLASSES + 3] = np.bincount(passage, length == 1, total) / n
            out[:, N_CLASSES + 4] = np.log1p(in_passage)
        yield out, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Weights: standardised features -> tanh code; gated attention (tanh times sigmoid); logistic score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the documents and the attention weight of each passage."""
        return _forward(self.weights, (features - self.mean) / self.scale, bounds)[:2]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray) -> tuple:
    starts, sizes = bounds[:-1], np.diff(bounds)
    code = np.tanh(x @ w["encode"] + w["encode_b"])
    t, s = np.tanh(code @ w["v"]), _sigmoid(code @ w["u"])
    e = (t * s) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    alpha = e / np.repeat(np.add.reduceat(e, starts), sizes)
    bag = np.add.reduceat(alpha[:, None] * code, starts, axis=0)
    return _sigmoid(bag @ w["out"] + w["out_b"]), alpha, code, t, s, bag


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss of the bags."""
    starts, sizes = bounds[:-1], np.diff(bounds)
    p, alpha, code, t, s, bag = _forward(w, x, bounds)
    d = (p - y) / len(y)
    d_bag_rows = np.repeat(d[:, None] * w["out"], sizes, axis=0)
    d_alpha = (d_bag_rows * code).sum(axis=1)
    d_e = alpha * (d_alpha - np.repeat(np.add.reduceat(alpha * d_alpha, starts), sizes))
    d_ts = d_e[:, None] * w["a"]
    d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
    d_code = alpha[:, None] * d_bag_rows + d_t @ w["v"].T + d_s @ w["u"].T
    d_pre = d_code * (1 - code * code)
    return {"encode": x.T @ d_pre, "encode_b": d_pre.sum(axis=0), "v": code.T @ d_t, "u": code.T @ d_s, "a": (t * s).T @ d_e, "out": bag.T @ d, "out_b": d.sum()}


def fit_attention(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 200, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> AttentionModel:
    """Adam on the mean logistic loss over all bags at once; deterministic."""
    rng = np.random.default_rng(seed)
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale = np.maximum(scale, 1e-3)  # a sign hardly seen in training doesn't run away with the score
    x = ((features - mean) / scale).astype(np.float32)
    shapes = {"encode": (x.shape[1], hidden), "encode_b": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "a": (gate,), "out": (hidden,), "out_b": ()}
    w = {k: (rng.standard_normal(s) * (0.0 if k.endswith("_b") else (s[0] if s else 1) ** -0.5)).astype(np.float32) for k, s in shapes.items()}
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    y = labels.astype(np.float32)
    for step in range(1, epochs + 1):
        grads = _gradients(w, x, bounds, y)
        for k, g in grads.items():
            g = g + decay * w[k] if not k.endswith("_b") else g
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(mean, scale, w)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> AttentionModel | None:
    """Fits the model on a bounded sample of labelled documents; None if both labels aren't met.

    The sample's ids (``sample_docs`` at most) are broadcast, so the texts
    aren't shuffled; its passages, ``sample_docs * sample_bytes / 128`` at
    most, come to the driver.
    """
    sample = bounded_sample(labelled(labels, label, id_col), sample_docs, id_col)
    rows = docs.select(id_col, F.col(text_col).alias("_text")).filter(F.octet_length("_text") <= sample_bytes).join(F.broadcast(sample), id_col)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for features, bounds in passages(batch.column("_text")):
                n = len(bounds) - 1
                bags = [features[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(at, n).cast(pa.string()), batch.column("label").slice(at, n), pa.array(bags, pa.binary())], ["id", "label", "bag"])
                at += n

    found = sorted(rows.mapInArrow(released(encoded), "id string, label int, bag binary").collect(), key=lambda r: (r["id"], r["bag"]))
    y = np.array([r["label"] for r in found])
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in found]
    return fit_attention(np.vstack(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def score_quality(docs: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(id_col, held_out, score, predicted) of every document, with the columns ``keep`` besides.

    A null or empty text is a bag with one passage of zeros and gets the
    model's score for it; without a model (labels of one kind, or none) every
    score is 0.5.  Rows are scored one by one, so repeated rows and ties need
    no rule; a null id is allowed.
    """
    keep = keep or []
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held_out(id_col).alias("held_out"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        for batch in batches:
            if own is None:
                scores = np.full(len(batch), 0.5)
            else:
                parts = [own.score(*part)[0] for part in passages(batch.column("_text"))]
                scores = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = StructType([f for f in rows.schema.fields if f.name != "_text"]).add("score", "double").add("predicted", "integer")
    out = rows.mapInArrow(released(scored), schema)
    return out.select(F.col("_id").alias(id_col), "held_out", "score", "predicted", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def filter_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches the threshold.

    Null and empty texts are scored like any other, as one empty passage;
    repeated rows and null ids each stay or go by their own score; without both
    labels nothing is learnt and all rows stay; an empty table gives an empty one.
    """
    model = train_quality(docs, labels, label, id_col, text_col)
    names = docs.columns
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), whole_row(docs).alias("_row"))
    scored = score_quality(rows, model, "_id", "_text", threshold, keep=["_row"])
    return scored.filter("predicted = 1").select(*[F.col("_row").getField(c).alias(c) for c in names])
