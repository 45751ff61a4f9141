"""SentencePiece encoding that keeps, for every piece, the bytes of the text that it came from.

A model file holds its pieces and how texts are normalised before they are cut:
a compiled character map (a trie of byte strings, and what each is replaced
by), a space added in front, extra spaces removed, spaces written as U+2581.
``Normalizer`` applies the map by its longest match at each place and records
for every byte it writes where in the text the replaced characters began.
``PieceEncoder`` has the library cut the normalised text, by a copy of the model
that normalises nothing more, and reads each piece's span off that record.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import released, small_batches

SPACE = "▁".encode()
#: Kinds of pieces in a model file.
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return n, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """Number, value and whole bytes of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        began = at
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value, data[began:at]


def message(number: int, value: int | bytes) -> bytes:
    """A field of a protocol-buffer message."""
    out, parts = bytearray(), [number << 3 | (0 if isinstance(value, int) else 2), value if isinstance(value, int) else len(value)]
    for n in parts:
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out) + (b"" if isinstance(value, int) else value)


@dataclass
class Model:
    """What encoding needs of a model file, and ``plain``: the model with a normaliser that changes nothing."""

    pieces: list[bytes] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces: bool = True  # removed
    escape: bool = True
    suffix: bool = False  # the space is added behind
    plain: bytes = b""

    @classmethod
    def read(cls, data: bytes) -> Model:
        m, rest = cls(), []
        for number, value, raw in fields(data):
            if number == 1:
                own = {n: v for n, v, _ in fields(value)}
                m.pieces.append(own.get(1, b""))
                m.kinds.append(own.get(3, 1))
            if number == 2:
                own = {n: v for n, v, _ in fields(value)}
                m.suffix = bool(own.get(24, 0))
            if number == 3:
                own = {n: v for n, v, _ in fields(value)}
                m.charsmap = own.get(2, b"")
                m.dummy_prefix, m.extra_spaces, m.escape = (bool(own.get(n, 1)) for n in (3, 4, 5))
            else:
                rest.append(raw)
        m.plain = b"".join(rest) + message(3, message(1, b"identity") + message(3, 0) + message(4, 0) + message(5, 0))
        return m


class CharacterMap:
    """A compiled character map: the size of a double-array trie, the trie, and the replacements, each ended by a zero byte.

    A unit of the trie has 32 bits: the label in the lowest eight (and the
    highest, which is set in units that hold a value), the offset to its
    children from the tenth, shifted by eight more if the tenth itself is set,
    and in the ninth whether a value ends here.
    """

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.units = np.frombuffer(data, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = data[4 + size :]
        #: What can't begin an entry by its first two bytes needs no look into the trie; an entry of one byte begins with any second byte.
        self.begins = np.zeros((256, 257), bool)
        for a in range(256) if self.units else ():
            at, ended = self._step(self._children(0), a)
            if at is None:
                continue
            if ended is not None:
                self.begins[a] = True
            else:
                self.begins[a, :256] = [self._step(at, b)[0] is not None for b in range(256)]

    def _children(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10 << (unit >> 6 & 8))

    def _step(self, at: int, byte: int) -> tuple[int | None, int | None]:
        """Where the children of the node below a byte are, and the value that ends there."""
        node = at ^ byte
        if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
            return None, None
        below = self._children(node)
        return below, self.units[below] & 0x7FFFFFFF if self.units[node] >> 8 & 1 else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest entry that stands at a place, 0 for none, and its replacement."""
        node, length, value = self._children(0), 0, 0
        for k in range(at, len(data)):
            node, ended = self._step(node, data[k])
            if node is None:
                break
            if ended is not None:
                length, value = k + 1 - at, ended
        return length, self.replacements[value : self.replacements.index(0, value)] if length else b""


@dataclass
class Normalized:
    """``data``, and for each of its bytes and its end the offset in the text of the characters that it stands for."""

    data: bytes
    source: np.ndarray


class Normalizer:
    """A model's normalisation of texts, with the record of where each byte comes from."""

    def __init__(self, model: Model):
        self.model = model
        self.map = CharacterMap(model.charsmap) if model.charsmap else None
        own = sorted((p for p, k in zip(model.pieces, model.kinds) if k == USER_DEFINED), key=len, reverse=True)
        self.symbols = re.compile(b"|".join(map(re.escape, own))) if own else None  # the longest first

    def __call__(self, text: str) -> Normalized:
        data = text.encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, np.uint8)
        # each byte's character begins at its leading byte
        lead = np.arange(len(raw), dtype=np.int64)
        if not data.isascii():
            lead[(raw & 0xC0) == 0x80] = 0
            lead = np.maximum.accumulate(lead)
        out, source, blank = self._replaced(data, raw, lead)
        return Normalized(b"", np.array([len(raw)])) if blank else self._spaced(out, source, len(raw))

    def _replaced(self, data: bytes, raw: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """The text by the longest entries, extra spaces left out at once, since what a space follows decides; and whether it is extra spaces only."""
        if not (self.map or self.symbols or self.model.extra_spaces):
            return raw, lead, not len(raw)
        places = np.zeros(0, np.int64)
        if self.map and len(raw):
            following = np.append(raw[1:].astype(np.int64), 256)
            places = np.flatnonzero(self.map.begins[raw, following])
        if self.symbols:
            places = np.union1d(places, [m.start() for m in self.symbols.finditer(data)]).astype(np.int64)
        parts, sources, at, space, only = [], [], 0, self.model.extra_spaces, self.model.extra_spaces

        def put(piece: np.ndarray, origin: np.ndarray, unit: bool) -> None:
            nonlocal space, only
            only = only and (piece.tobytes() == b" " if unit else not piece.tobytes().strip(b" "))
            if self.model.extra_spaces and len(piece):
                blank = piece == 32
                if unit:  # a replacement loses the spaces that it begins with only
                    begin = int(np.argmin(blank)) if not blank.all() else len(piece)
                    keep = np.arange(len(piece)) >= (begin if space else 0)
                else:
                    keep = ~(blank & np.append(space, blank[:-1]))
                piece, origin = piece[keep], origin[keep]
                if len(piece):
                    space = bool(piece[-1] == 32)
            parts.append(piece)
            sources.append(origin)

        places = places.tolist()
        k = 0
        while k < len(places):
            here = places[k]
            found = self.symbols.match(data, here) if self.symbols else None
            length, by = (len(found[0]), found[0]) if found else self.map.longest(data, here) if self.map else (0, b"")
            if length:
                put(raw[at:here], lead[at:here], False)
                put(np.frombuffer(by, np.uint8), np.full(len(by), here), True)
                at = here + length
                k = bisect_left(places, at, k)
            else:
                k += 1
        put(raw[at:], lead[at:], False)
        return np.concatenate(parts), np.concatenate(sources), only or not len(raw)

    def _spaced(self, out: np.ndarray, source: np.ndarray, size: int) -> Normalized:
        m, end = self.model, size
        if m.dummy_prefix and not m.suffix:
            first = int(source[0]) if m.extra_spaces and len(source) else 0
            out, source = np.concatenate([[np.uint8(32)], out]), np.concatenate([[first], source])
        if m.extra_spaces:
            # spaces at the end go, and where they are escaped the sign for one as well
            data, mark, n = out.tobytes(), SPACE if m.escape else b" ", len(out)
            while data.endswith(b" ", 0, n) or data.endswith(mark, 0, n):
                n -= 1 if data[n - 1] == 32 else len(mark)
                end = int(source[n])
            out, source = out[:n], source[:n]
        if m.dummy_prefix and m.suffix:
            out, source = np.append(out, np.uint8(32)), np.append(source, end)
        data = out.tobytes()
        if m.escape:
            source, data = np.repeat(source, np.where(out == 32, len(SPACE), 1)), data.replace(b" ", SPACE)
        return Normalized(data, np.append(source, end))


@dataclass
class Pieces:
    """Ids of a text's pieces and the bytes of the text, from ``begins`` to ``ends``, that each came from.

    Where the pieces of one character are bytes, the last of them has the
    character and the others nothing.
    """

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class PieceEncoder:
    """Pieces of whole texts, by a model file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.model = Model.read(data)
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=self.model.plain)
        self.normalize = Normalizer(self.model)
        #: Bytes of the normalised text that each piece takes; an unknown one has no length of its own.
        self.lengths = np.array([1 if k == BYTE else 0 if k == UNKNOWN else len(p) for p, k in zip(self.model.pieces, self.model.kinds)], np.int64)

    def cut(self, texts: list[str]) -> tuple[list[list[int]], list[bytes]]:
        """Ids of each text, and the normalised texts."""
        normal = [self.normalize(t).data for t in texts]
        return self.cutter.encode([n.decode("utf-8", "surrogatepass") for n in normal], num_threads=1), normal

    def encode(self, texts: list[str]) -> list[Pieces]:
        normal = [self.normalize(t) for t in texts]
        plain = [n.data.decode("utf-8", "surrogatepass") for n in normal]
        out = []
        for n, t, ids in zip(normal, plain, self.cutter.encode(plain, num_threads=1)):
            ids = np.array(ids, np.int32)
            size = self.lengths[ids]
            if not size.all():
                surfaces = self.cutter.encode(t, out_type=str)
                size = np.array([self.lengths[i] or len(s.encode()) for i, s in zip(ids.tolist(), surfaces)], np.int64)
            ends = np.cumsum(size)
            if len(ends) and ends[-1] != len(n.data) or not len(ends) and n.data:
                raise ValueError("pieces that don't add up to the normalised text")
            bounds = n.source[np.append(0, ends)] if len(ends) else np.zeros(1, np.int64)
            out.append(Pieces(ids, bounds[:-1], bounds[1:]))
        return out

    def surfaces(self) -> list[bytes]:
        """Bytes of each id: U+2581 is a space, byte pieces are their byte."""
        return [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, b" ") for p, k in zip(self.model.pieces, self.model.kinds)]


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """A worker's encoder, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


_DIGITS: dict[int, np.ndarray] = {}


def decimal(ids: np.ndarray, separators: np.ndarray | int) -> bytes:
    """Ids in decimal, each followed by its separator (0 for none)."""
    width = len(str(int(ids.max()))) if len(ids) else 1
    if width not in _DIGITS:
        # leading zeros stay out
        _DIGITS[width] = np.array([list(str(i).rjust(width, "\0").encode() + b"\0") for i in range(10**width)], np.uint8) if width <= 5 else np.zeros(0, np.uint8)
    if width > 5:
        marks = np.broadcast_to(separators, len(ids)).tolist()
        return b"".join(str(i).encode() + (bytes([m]) if m else b"") for i, m in zip(ids.tolist(), marks))
    out = _DIGITS[width][ids]
    out[:, width] = separators
    out = out.reshape(-1)
    return out[out != 0].tobytes()


def slices(texts: list[str], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together, a longer text on its own."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= most):
            size += len(texts[b])
            b += 1
        yield a, b
        a = b


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, begins, ends) of each row: the pieces of the whole text and the UTF-8 bytes of it that each came from.

    Null texts are empty and have no pieces; ids may be null or repeat, each
    row stands for itself; columns of other names are not regarded; an empty
    table gives an empty result.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            for a, b in slices(texts):
                found = own.encode(texts[a:b])
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p.ids) for p in found)]), pa.int32()), pa.array(np.concatenate([getattr(p, c) for p in found]), pa.int32())) for c in ("ids", "begins", "ends")]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, b - a), *lists], ["_id", "ids", "begins", "ends"])

    return rows.mapInArrow(released(f), f"_id {dict(rows.dtypes)['_id']}, ids array<int>, begins array<int>, ends array<int>").withColumnRenamed("_id", id_col)


def decode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the library's decoding of each row's ids; null ids give an empty text."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(model)
        for batch in batches:
            texts = own.library.decode([x or [] for x in batch.column("_ids").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], ["_id", "text"])

    return rows.mapInArrow(released(f), f"_id {dict(rows.dtypes)['_id']}, text string").withColumnRenamed("_id", id_col)


def piece_digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256, n_covered, spans_crc32) of each row, without moving the pieces themselves.

    The ids have an end id (the model's own unless given) and are hashed in
    decimal, joined by a space; ``decoded_sha256`` is that of the library's
    decoding of them in UTF-8.  ``n_covered`` counts the bytes of the text that
    the spans cover, ``spans_crc32`` is taken over begins and ends as
    little-endian unsigned 32-bit integers.  Odd rows are as in ``encode_pieces``.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_covered", "spans_crc32"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        own = piece_encoder(model)
        end = own.library.eos_id() if end_id is None else end_id
        for batch in batches:
            texts, out = [t or "" for t in batch.column("_text").to_pylist()], []
            for a, b in slices(texts):
                found = own.encode(texts[a:b])
                closed = [np.append(p.ids, end) for p in found]
                decoded = own.library.decode([x.tolist() for x in closed], num_threads=1)
                for p, ids, text in zip(found, closed, decoded):
                    marks = np.full(len(ids), 32, np.uint8)
                    marks[-1] = 0
                    spans = np.concatenate([p.begins, p.ends]).astype("<u4").tobytes()
                    out.append((len(ids), hashlib.sha256(decimal(ids, marks)).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), int((p.ends - p.begins).sum()), zlib.crc32(spans)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["_id", *names])

    return rows.mapInArrow(released(f), f"_id {dict(rows.dtypes)['_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long, spans_crc32 long").withColumnRenamed("_id", id_col)
