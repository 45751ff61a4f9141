"""Pieces, their spans and the alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from linkforge.llm import alignment, pieces
from linkforge.llm.queries import piece_model_path, tokenizer_path

rng = random.Random(1)
ALPHABET = [*"abe é日本▁ \t\n  ́ﬁ①½ Å\x00　’…中🙂é", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "  ", "the ", "ing"]
TEXTS = ["", " ", "  a  b ", "▁", "a▁b", "\x01", "x" * 5000, "<|endoftext|>", *["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 30))) for _ in range(400)]]


def compare(path):
    own = pieces.PieceEncoder(str(path))
    for text, found in zip(TEXTS, own.encode(TEXTS)):
        want = own.library.encode(text, return_type="proto").pieces
        assert found.ids.tolist() == [p.id for p in want]
        assert list(zip(found.begins.tolist(), found.ends.tolist())) == [(p.begin, p.end) for p in want]


def test_the_given_model():
    compare(piece_model_path())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_compiled_maps_of_the_library(rule, tmp_path):
    """The given pieces with the library's own character maps, with each flag of the normaliser off and on."""
    made = pieces.Model.read(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    with open(piece_model_path(), "rb") as f:
        rest = b"".join(raw for number, _, raw in pieces.fields(f.read()) if number != 3)
    for flags in [(1, 1, 1), (0, 1, 1), (1, 0, 1), (1, 1, 0), (0, 0, 0)]:
        spec = pieces.message(1, b"own") + pieces.message(2, made.charsmap) + b"".join(pieces.message(n, v) for n, v in zip((3, 4, 5), flags))
        path = tmp_path / f"{rule}{flags}.model"
        path.write_bytes(rest + pieces.message(3, spec))
        compare(path)


def test_user_symbols_and_a_space_behind(tmp_path):
    """Symbols that a normaliser mustn't touch, a model that puts the space behind, one that knows no bytes."""
    made = pieces.Model.read(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    with open(piece_model_path(), "rb") as f:
        data = f.read()
    parts = [(n, v, raw) for n, v, raw in pieces.fields(data)]
    symbol = pieces.message(1, pieces.message(1, "①a".encode()) + pieces.message(3, pieces.USER_DEFINED))
    spec = pieces.message(3, pieces.message(2, made.charsmap))
    trainer = next(v for n, v, _ in parts if n == 2)
    others = b"".join(raw for n, _, raw in parts if n not in (2, 3))
    (tmp_path / "symbol.model").write_bytes(others + symbol + pieces.message(2, trainer) + spec)
    (tmp_path / "suffix.model").write_bytes(others + pieces.message(2, trainer + pieces.message(24, 1)) + spec)
    (tmp_path / "unknown.model").write_bytes(b"".join(pieces.message(1, v) if n != 1 else raw for n, v, raw in parts if n == 1 and dict((a, b) for a, b, _ in pieces.fields(v)).get(3) != pieces.BYTE) + pieces.message(2, trainer + pieces.message(35, 0)) + spec)
    TEXTS.append("x①a ①a① a①a")
    try:
        for name in ("symbol", "suffix", "unknown"):
            compare(tmp_path / f"{name}.model")
    finally:
        TEXTS.pop()


def test_decimal():
    import numpy as np

    for ids in ([0], [7, 0, 10, 99999], [123456, 5]):
        assert pieces.decimal(np.array(ids), 44) == "".join(f"{i}," for i in ids).encode()
    assert pieces.decimal(np.zeros(0, np.int64), 44) == b""


def test_rows(spark, odd_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    want = []
    for r in odd_docs.collect():
        ids = [*library.encode(r["text"] or ""), library.eos_id()]
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)), len((r["text"] or "").encode())))
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    got = pieces.piece_digests(odd_docs, piece_model_path())
    assert sorted([tuple(r)[:5] for r in got.collect()], key=key) == sorted(want, key=key)
    listed = pieces.encode_pieces(odd_docs, piece_model_path())
    assert sorted(map(str, [(r["doc_id"], len(r["ids"]) + 1) for r in listed.collect()])) == sorted(map(str, [w[:2] for w in want]))
    back = pieces.decode_pieces(listed, piece_model_path())
    assert sorted(map(str, [r["text"] for r in back.collect()])) == sorted(str(r["text"] or "") for r in odd_docs.collect())
    assert pieces.piece_digests(odd_docs.limit(0), piece_model_path()).count() == 0


def brute_alignment(rows):
    """The contract by plain loops over tokens."""
    left, right = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    left.encode_special_tokens = True
    surfaces = alignment.PlainEncoder(tokenizer_path()).surfaces()
    made, counts = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        a, b = left.encode(" " + (text or ""), add_special_tokens=False).ids, right.encode(text or "")
        piece = [right.id_to_piece(i) for i in b]
        bytes_a = [surfaces[i] for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, piece)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            made.append((doc_id, 0, 0, "", []))
            continue
        end = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ends_a, ends_b = end(bytes_a), end(bytes_b)
        at_b = {e: k for k, e in enumerate(ends_b)}
        i = j = 0
        for k, e in enumerate(ends_a):
            if e in at_b:
                groups.append((a[i : k + 1], b[j : at_b[e] + 1]))
                links.append((a[k], b[at_b[e]]))
                i, j = k + 1, at_b[e] + 1
        counts.update(links)
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        made.append((doc_id, len(a), len(b), hashlib.sha256(text_of.encode()).hexdigest(), links))
    most, most_a = defaultdict(int), defaultdict(int)
    for (x, y), n in counts.items():
        most[y], most_a[x] = max(most[y], n), max(most_a[x], n)
    return [(i, n, m, len(ls), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), digest, sum(counts[p] == most_a[p[0]] for p in ls)) for i, n, m, digest, ls in made]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 3])
def test_alignment(spark, odd_docs, frequent, monkeypatch):
    """All odd rows and texts; with few frequent pairs most counts come by the shuffle."""
    monkeypatch.setattr(alignment.scored_links, "__defaults__", (frequent,))
    rows = [(r["doc_id"], r["text"][:3000] if r["text"] else r["text"]) for r in odd_docs.collect()] + [(100 + k, t) for k, t in enumerate(TEXTS[:200])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, pairs long, _row long")
    got = [tuple(r) for r in alignment.align_corpus(df, tokenizer_path(), piece_model_path()).collect()]
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(got, key=key) == sorted(brute_alignment(rows), key=key)
    assert alignment.align_corpus(df.limit(0), tokenizer_path(), piece_model_path()).count() == 0


def test_groups_and_tokens(spark):
    df = spark.createDataFrame([(1, "Hello worlds, naïve 日本")], "doc_id long, text string")
    r = alignment.align_tokens(df, tokenizer_path(), piece_model_path(), with_tokens=True).first()
    groups = []
    for k in range(r["n_groups"]):
        cut = lambda ids, last: ids[(last[k - 1] + 1 if k else 0) : last[k] + 1]
        groups.append(",".join(map(str, cut(r["a_ids"], r["a_last"]))) + "|" + ",".join(map(str, cut(r["b_ids"], r["b_last"]))))
    assert hashlib.sha256(";".join(groups).encode()).hexdigest() == r["groups_sha256"] and sum(r["times"]) == r["n_links"]
