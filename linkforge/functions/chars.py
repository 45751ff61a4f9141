"""Character and byte level token ids, masking for language modelling, bags of bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the special tokens of the character vocabulary, and their spelling in text
SPECIAL = {"[SEP]": 252, "[MASK]": 253, "[PAD]": 254, "[UNK]": 255}
MASK_ID, PAD_ID, UNK_ID = 253, 254, 255
VOCABULARY_SIZE = 256
IGNORED = -100
# Fixed values of byte-level ids: bytes come after three special ids, and 1 ends a text
BYTE_OFFSET, BYTE_END = 3, 1


def _spelled(text: Column) -> Column:
    t = F.translate(text, "üýþ", "ÿÿÿ")
    for token, code in SPECIAL.items():
        t = F.replace(t, F.lit(token), F.lit(chr(code)))
    return t


def chunks(text: Column, length: int) -> Column:
    """The whole text in consecutive chunks of ``length`` characters, for ``chunk_ids``; special tokens are one character, an empty text is one chunk."""
    found = F.regexp_extract_all(_spelled(text), F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    return F.when(F.char_length(text) > 0, found).when(text.isNotNull(), F.array(F.lit("")))


def chunk_ids(chunk: Column, length: int) -> Column:
    """Ids of a chunk, padded."""
    ids = F.transform(F.regexp_extract_all(chunk, F.lit("(?s)."), F.lit(0)), lambda c: F.least(F.lit(UNK_ID), F.ascii(c)))
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.lit(length) - F.char_length(chunk)))


def encode(text: Column, length: int) -> Column:
    """Ids of the first ``length`` characters, padded: code points, those from 255 on as unknown.

    The characters 252 to 254 are unknown too; the spelled special tokens have
    their ids.
    """
    t = F.substring(_spelled(text), 1, length)
    size = F.char_length(t)
    ids = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.least(F.lit(UNK_ID), F.ascii(F.substring(t, i, F.lit(1)))))).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNotNull(), F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(0), F.lit(length) - size))))


def attention_mask(ids: Column) -> Column:
    """Ones for all places, paddings too."""
    return F.transform(ids, lambda _: F.lit(1))


def decode(ids: Column) -> Column:
    """A character for each id."""
    return F.array_join(F.transform(ids, lambda i: F.char(i)), "")


def mlm_mask(row_id: Column, ids: Column, share: float = 0.15, seed: int = 0) -> Column:
    """STRUCT(input_ids, labels): floor(share * n) of the n places without special tokens are masked.

    They are those whose draws are least; labels keep the id there and are
    IGNORED elsewhere.
    """
    # the places are bound to a name, or they would be drawn again for each id
    return F.get(F.transform(F.array(mask_places(row_id, ids, share, seed)), lambda places: masked(ids, places)), F.lit(0))


def mask_places(row_id: Column, ids: Column, share: float = 0.15, seed: int = 0) -> Column:
    """The places that ``mlm_mask`` masks."""
    draw = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), row_id.cast("string"), i.cast("string"), F.lit("mask")))
    places = F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: ~F.get(ids, i).isin(list(SPECIAL.values())))
    ranked = F.transform(F.array_sort(F.transform(places, lambda i: F.struct(draw(i).alias("d"), i.alias("i")))), lambda x: x["i"])
    return F.slice(ranked, F.lit(1), F.floor(F.size(places) * share).cast("int"))


def masked(ids: Column, chosen: Column) -> Column:
    """STRUCT(input_ids, labels) with the chosen places masked."""
    hidden = F.transform(ids, lambda x, i: F.when(F.array_contains(chosen, i), F.lit(MASK_ID)).otherwise(x))
    labels = F.transform(ids, lambda x, i: F.when(F.array_contains(chosen, i), x).otherwise(F.lit(IGNORED)))
    return F.when(F.size(ids) > 0, F.struct(hidden.alias("input_ids"), labels.alias("labels")))


def byte_ids(text: Column) -> Column:
    """Byte-level ids: each UTF-8 byte after the offset, and the end."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    one = lambda i: (F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int") + BYTE_OFFSET)
    body = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), one)).otherwise(F.array().cast("array<int>"))
    return F.concat(body, F.array(F.lit(BYTE_END)))
