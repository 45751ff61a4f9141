"""Choices that depend on the size of the input."""

from __future__ import annotations

from dataclasses import dataclass

#: Most bytes of a block of vectors that a task compares with another.
EXACT_BYTES = 16 << 20
#: Rows up to which a neighbour join is exact.
EXACT_ROWS = 50_000


@dataclass(frozen=True)
class IvfShape:
    """Cells of an inverted-list index and how many of them a query looks into."""

    cells: int = 512
    probes: int = 32


#: Shape for similarity vectors to anchors.
ANCHOR_SHAPE = IvfShape(256, 16)
#: Bytes of a product code, for vectors of names and for similarities to anchors.
VECTOR_PARTS, ANCHOR_PARTS = 32, 8


def choose(rows: int, limit: int = EXACT_ROWS) -> str:
    return "ivf" if rows > limit else "exact"
