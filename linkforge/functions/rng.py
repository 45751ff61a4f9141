"""Random numbers that depend on a key alone, as SQL for Spark and for DuckDB: the same on every run and engine."""

from __future__ import annotations

ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(seed: int, *parts: str) -> str:
    return "concat_ws('|', " + ", ".join([f"'{seed}'", *[f"cast({p} as {{text}})" for p in parts]]) + ")"


def draw(dialect: str, seed: int, *parts: str) -> str:
    """SQL for a whole number in [0, 2^32) from the first 8 hex digits of the key's MD5."""
    text = "string" if dialect == "spark" else "varchar"
    made = key(seed, *parts).replace("{text}", text)
    if dialect == "spark":
        return f"cast(conv(substr(md5({made}), 1, 8), 16, 10) as bigint)"
    return f"('0x' || substr(md5({made}), 1, 8))::BIGINT"


def uniform(dialect: str, seed: int, *parts: str) -> str:
    kind = "double" if dialect == "spark" else "DOUBLE"
    return f"(cast({draw(dialect, seed, *parts)} as {kind}) / 4294967296)"


def letter(dialect: str, seed: int, *parts: str) -> str:
    place = f"{draw(dialect, seed, *parts)} % 52 + 1"
    place = f"cast({place} as int)" if dialect == "spark" else place
    return f"substr('{ASCII_LETTERS}', {place}, 1)"
