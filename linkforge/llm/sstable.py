"""Token ids in sorted string tables.

A shard is one file: data blocks, a sparse block index, a Bloom filter and a
footer.  Keys are document ids, entries ascend, and a key is stored as what it
adds to the key before it; every block begins with a whole key.  Looking a
document up reads the footer, the filter and the index, finds the block by
binary search and reads that block alone.

All numbers are little-endian; a varint has 7 bits a byte, low bits first.

    block   entries: shared u8, rest u8, varint value bytes, rest of the key, value
    index   for each block: last key (9 bytes), offset u64, bytes u32, crc32 u32
    filter  bits of a Bloom filter, its hashes derived from blake2b of the key
    footer  64 bytes: see FOOTER

A key is a byte 0 for a null id or 1 and the id, offset to be unsigned, in 8
bytes big-endian, so bytes sort as ids do.  A value are the document's ids,
each of ``width`` bytes.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import partitions, shared_dir, small_batches

MAGIC = b"LFSST001"
#: magic, entries, token ids, index offset, filter offset, filter bits, hashes, width
FOOTER = struct.Struct("<8sQQQQQHH4xQ")
_INDEX = struct.Struct("<9sQII")
BLOCK_BYTES, FILTER_BITS_PER_KEY, FILTER_HASHES = 64 << 10, 10, 7
END_ID = 2


def key_bytes(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _filter_bits(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(hashes)]


class Writer:
    """Writes one shard; keys must not descend."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.block, self.index, self.keys = [], [], []
        self.size, self.at, self.last, self.tokens = 0, 0, b"", 0

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_bytes(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        head = bytes((shared, 9 - shared)) + _varint(len(value)) + key[shared:]
        self.block += [head, value]
        self.size += len(head) + len(value)
        self.last = key
        self.keys.append(key)
        self.tokens += len(value) // self.width
        if self.size >= self.block_bytes:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            data = b"".join(self.block)
            self.sink.write(data)
            self.index.append(_INDEX.pack(self.last, self.at, len(data), zlib.crc32(data)))
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._close_block()
        index = b"".join(self.index)
        bits = max(64, FILTER_BITS_PER_KEY * len(self.keys))
        filled = np.zeros(bits, np.uint8)
        for key in self.keys:
            filled[_filter_bits(key, bits, FILTER_HASHES)] = 1
        self.sink.write(index)
        self.sink.write(np.packbits(filled, bitorder="little").tobytes())
        self.sink.write(FOOTER.pack(MAGIC, len(self.keys), self.tokens, self.at, self.at + len(index), bits, FILTER_HASHES, self.width, 0))


class Reader:
    """Reads one shard through a random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.entries, self.tokens, self.index_at, self.filter_at, self.bits, self.hashes, self.width, _ = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        index = self._read(self.index_at, self.filter_at - self.index_at)
        self.index = [_INDEX.unpack_from(index, i) for i in range(0, len(index), _INDEX.size)]
        self.filter = self._read(self.filter_at, size - FOOTER.size - self.filter_at)

    def _read(self, offset: int, size: int) -> bytes:
        return self.source.read_at(size, offset)

    def _block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, size, crc = self.index[number]
        data = self._read(offset, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {number} is damaged")
        at, key = 0, b""
        while at < size:
            shared, rest = data[at], data[at + 1]
            at += 2
            n = shift = 0
            while True:
                byte = data[at]
                at += 1
                n |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    break
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for number in range(len(self.index)):
            for key, value in self._block(number):
                yield key_id(key), self._ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The values of a key, none if it isn't there."""
        key = key_bytes(doc_id)
        if not self.entries or not all(self.filter[b >> 3] >> (b & 7) & 1 for b in _filter_bits(key, self.bits, self.hashes)):
            return []
        out = []
        for number in range(bisect_left(self.index, (key,)), len(self.index)):
            for k, value in self._block(number):
                if k == key:
                    out.append(self._ids(value))
                elif k > key:
                    return out
        return out


def open_shard(path: str) -> Reader:
    fs, p = pafs.FileSystem.from_uri(path)
    return Reader(fs.open_input_file(p))


#: How byte-level models of this kind part a text before merging, for texts of the characters below alone: letters, contractions, digits, other signs, white space.
_PARTS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ʯ]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ʯ0-9]+|\s+(?!\S)|\s+")
_PLAIN = re.compile("[\t\n\r -~¡-©«-±´¶-¸»¿À-ʯ‐-‧]*")


class Encoder:
    """Token ids of whole texts by the tokenizers library.

    Where the model is a byte-level one that parts texts by the usual pattern
    and has no normaliser, a text's ids are those of its parts in turn; each
    part is encoded by the library once and remembered, up to ``most`` parts.
    Texts with characters beyond Latin letters and common signs or with special
    tokens, and other models, go to the library whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        # a worker has one core, and each thread of the library holds memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.by_parts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not made.get("normalizer") and not made.get("truncation") and not made.get("padding")
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.most = f"<u{self.width}", most
        self.known: dict[str, bytes] = {}
        end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = end[0] if len(end) == 1 else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of each part.  Words after a space are joined by line ends: the library parts them there, and a line end has an id of its own."""
        plain = lambda p: p[0] == " " and p[1:].isalpha()
        words = [p for p in parts if plain(p)] if self.line_end is not None else []
        rest = [p for p in parts if not plain(p)] if words else parts
        groups = [words[i : i + 2000] for i in range(0, len(words), 2000)]
        for group, data in zip(groups, self._whole(["\n".join(g) + "\n" for g in groups])):
            ends = np.flatnonzero(np.frombuffer(data, self.kind) == self.line_end)
            if len(ends) != len(group):
                rest += group
                continue
            starts = np.concatenate([[0], ends[:-1] + 1])
            yield from zip(group, [data[a:b] for a, b in zip((starts * self.width).tolist(), (ends * self.width).tolist())])
        for a in range(0, len(rest), 20_000):
            yield from zip(rest[a : a + 20_000], self._whole(rest[a : a + 20_000]))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        whole, parted, met = [], [], set()
        known = self.known.get
        for i, text in enumerate(texts):
            if self.by_parts and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                parts = _PARTS.findall(text)
                ids = list(map(known, parts))
                if all(ids):  # a part has one id at least, so only parts not met yet are false
                    out[i] = b"".join(ids)
                else:
                    gaps = [k for k, x in enumerate(ids) if x is None]
                    met.update([parts[k] for k in gaps])
                    parted.append((i, parts, ids, gaps))
            else:
                whole.append(i)
        new = dict(self._each(list(met)))
        if len(self.known) + len(new) <= self.most:
            self.known.update(new)
        for i, parts, ids, gaps in parted:
            for k in gaps:
                ids[k] = new[parts[k]]
            out[i] = b"".join(ids)
        if whole:
            for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
                out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder, kept between its tasks with the parts it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tables(df: DataFrame, tokenizer: str, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, slice_bytes: int = 4 << 20) -> list[dict]:
    """Encodes all texts and writes them, in ascending order of ids, as shards under ``out_dir``.

    ``out_dir`` must be a URI that all executors share and pyarrow can open; it
    defaults to a new folder in the shared folder.  Returns the manifest, a row
    for each shard in order: path, entries, token ids and ``start``, the ids in
    the shards before.  A shard's name holds the attempt that wrote it, and
    only attempts that succeeded are in the manifest, so a lost executor's
    half-written file does no harm.

    Null texts are empty (their end id alone); null ids come first; rows that
    repeat an id each have an entry; an empty table gives an empty manifest.
    """
    spark = df.sparkSession
    small_batches(spark)
    out_dir = out_dir or f"{shared_dir(spark)}/sstables-{uuid.uuid4().hex}"
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # a hash of the text parts rows that share an id, or have none
    rows = rows.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("_text")).sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = pafs.FileSystem.from_uri(out_dir)
        path = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
        own, writer, sink = None, None, None
        gc.freeze()  # what the worker remembers of words isn't searched for cycles again and again
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                own = encoder(tokenizer)
                fs.create_dir(folder, recursive=True)
                sink = fs.open_output_stream(f"{folder}/{path}")
                writer = Writer(sink, own.width)
                end = np.array([end_id], own.kind).tobytes()
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist()
            a = 0
            while a < len(texts):  # some megabyte at a time, however long the texts are
                b, size = a, 0
                while b < len(texts) and (b == a or size < slice_bytes):
                    size += len(texts[b])
                    b += 1
                for doc_id, value in zip(ids[a:b], own.encode(texts[a:b])):
                    writer.add(doc_id, value + end)
                a = b
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [path], "entries": [len(writer.keys)], "tokens": [writer.tokens]})

    found = sorted(rows.mapInArrow(write, "part long, path string, entries long, tokens long").collect(), key=lambda r: r["part"])
    out, start = [], 0
    for r in found:
        out.append({"path": f"{out_dir}/{r['path']}", "entries": r["entries"], "tokens": r["tokens"], "start": start})
        start += r["tokens"]
    return out


def read_tables(spark, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of each entry, read back from the shards."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"
    if not manifest:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long").repartition(len(manifest))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                held: list[tuple] = []
                for doc_id, ids in open_shard(path):
                    held.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path))
                    start += len(ids)
                    if len(held) == 10_000:
                        yield _rows(held)
                        held = []
                yield _rows(held)

    def _rows(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()])], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return rows.mapInArrow(read, schema)
