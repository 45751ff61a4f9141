"""A character transformer's forward pass in NumPy, and embeddings by it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.functions.chars import VOCABULARY_SIZE, encode

_erf = np.vectorize(math.erf, otypes=[np.float64])


@dataclass(frozen=True)
class Shape:
    """Sizes of a model."""

    dim: int = 384
    heads: int = 6
    layers: int = 6
    length: int = 512
    expansion: int = 4


BASE, SMALL = Shape(768, 12, 12, 128), Shape(384, 6, 6, 512)


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + _erf(x / math.sqrt(2)))


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5) * scale + shift


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def positions(length: int, dim: int) -> np.ndarray:
    at = np.arange(length)[:, None] * np.exp(np.arange(0, dim, 2) * (-math.log(10_000) / dim))
    out = np.zeros((length, dim))
    out[:, 0::2], out[:, 1::2] = np.sin(at), np.cos(at)
    return out


class CharTransformer:
    """Learned characters and fixed positions, pre-norm blocks, a head over the vocabulary.

    Weights come from a file of arrays or, seeded, at random.
    """

    def __init__(self, shape: Shape, weights: dict[str, np.ndarray] | None = None, seed: int = 0):
        self.shape = shape
        self.w = weights or self._random(seed)

    def _random(self, seed: int) -> dict[str, np.ndarray]:
        rng, d, e = np.random.default_rng(seed), self.shape.dim, self.shape.expansion
        w = {"embed": rng.normal(0, 0.02, (VOCABULARY_SIZE, d)), "head1": rng.normal(0, 0.02, (d, d)), "head1_b": np.zeros(d), "head2": rng.normal(0, 0.02, (d, VOCABULARY_SIZE)), "head2_b": np.zeros(VOCABULARY_SIZE)}
        for name in ("in", "out", "head"):
            w |= {f"{name}_scale": np.ones(d), f"{name}_shift": np.zeros(d)}
        for i in range(self.shape.layers):
            w |= {f"{i}.qkv": rng.normal(0, 0.02, (d, 3 * d)), f"{i}.proj": rng.normal(0, 0.02, (d, d)), f"{i}.fc1": rng.normal(0, 0.02, (d, e * d)), f"{i}.fc1_b": np.zeros(e * d), f"{i}.fc2": rng.normal(0, 0.02, (e * d, d)), f"{i}.fc2_b": np.zeros(d)}
            for name in ("n1", "n2"):
                w |= {f"{i}.{name}_scale": np.ones(d), f"{i}.{name}_shift": np.zeros(d)}
        return w

    def save(self, path: str) -> None:
        np.savez(path, **self.w)

    @classmethod
    def load(cls, path: str, shape: Shape) -> CharTransformer:
        with np.load(path) as f:
            return cls(shape, dict(f))

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return layer_norm(x, self.w[f"{name}_scale"], self.w[f"{name}_shift"])

    def hidden(self, ids: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """States of the last layer for rows of ``shape.length`` ids."""
        n, length = ids.shape
        if length != self.shape.length:
            raise ValueError(f"rows must have {self.shape.length} ids")
        d, h = self.shape.dim, self.shape.heads
        x = self._norm(self.w["embed"][ids] + positions(length, d), "in")
        for i in range(self.shape.layers):
            q, k, v = np.split(self._norm(x, f"{i}.n1") @ self.w[f"{i}.qkv"], 3, axis=-1)
            q, k, v = (z.reshape(n, length, h, d // h).transpose(0, 2, 1, 3) for z in (q, k, v))
            scores = q @ k.transpose(0, 1, 3, 2) / math.sqrt(d // h)
            if mask is not None:
                scores = np.where(mask[:, None, None, :] == 0, -1e4, scores)
            x = x + (softmax(scores) @ v).transpose(0, 2, 1, 3).reshape(n, length, d) @ self.w[f"{i}.proj"]
            inner = gelu(self._norm(x, f"{i}.n2") @ self.w[f"{i}.fc1"] + self.w[f"{i}.fc1_b"])
            x = x + gelu(inner @ self.w[f"{i}.fc2"] + self.w[f"{i}.fc2_b"])
        return self._norm(x, "out")

    def logits(self, ids: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        inner = self._norm(self.hidden(ids, mask) @ self.w["head1"] + self.w["head1_b"], "head")
        return np.maximum(inner, 0) @ self.w["head2"] + self.w["head2_b"]

    def embed(self, ids: np.ndarray) -> np.ndarray:
        """Means of the states over all places, paddings too."""
        return self.hidden(ids).mean(axis=1)

    def fill(self, ids: np.ndarray) -> np.ndarray:
        """The likeliest id at each place."""
        return softmax(self.logits(ids)).argmax(axis=-1)


def embed_texts(df: DataFrame, id_col: str, text_col: str, model: CharTransformer) -> DataFrame:
    """(id, vector) by the model, in Arrow batches; the weights are broadcast, of a size the model's shape fixes."""
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), encode(F.col(text_col), model.shape.length).alias("ids"))
    held = df.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 32):
                part = batch.slice(a, 32)
                out = held.value.embed(np.array(part.column("ids").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(out.astype(np.float32)), pa.list_(pa.float32()))], ["id", "vector"])

    return rows.mapInArrow(f, f"id {dict(rows.dtypes)['id']}, vector array<float>")
