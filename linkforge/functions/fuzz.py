"""String corruption for test data: insertions, deletions, substitutions, transpositions.

Each is a SQL expression in the dialect asked for, so Spark runs it natively
and DuckDB gives the same strings.  Draws depend on seed, row id, place and
kind of corruption.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.functions.rng import letter, uniform

KINDS = ("insert", "delete", "substitute", "transpose")


def _chars(dialect: str, text: str, body: str, to: str = "") -> str:
    """Joins ``body``, an expression of the place i (from 1), over the places of the text."""
    size = f"char_length({text})" if dialect == "spark" else f"length({text})"
    if dialect == "spark":
        return f"case when {size} > 0 then array_join(transform(sequence(1, {size}), i -> {body}), '') else {text} end"
    return f"case when length({text}) > 0 then array_to_string(list_transform(range(1, {size} + 1), lambda i: {body}), '') else {text} end"


def corruption(dialect: str, kind: str, text: str, row_id: str, frequency: float, seed: int = 0) -> str:
    """SQL for a text corrupted in one way.

    insert: after a character, a random letter.  delete: the character goes.
    substitute: a random letter in its place.  transpose: the next character
    and then this one, in place of this one; the next is not skipped, so each
    makes the text longer by one.
    """
    u, c = uniform(dialect, seed, row_id, "i", f"'{kind}'"), f"substr({text}, {'cast(i as int)' if dialect == 'spark' else 'i'}, 1)"
    after = f"substr({text}, {'cast(i as int)' if dialect == 'spark' else 'i'} + 1, 1)"
    new = letter(dialect, seed, row_id, "i", f"'{kind} letter'")
    size = f"char_length({text})" if dialect == "spark" else f"length({text})"
    body = {
        "insert": f"case when {u} < {frequency} then concat({c}, {new}) else {c} end",
        "delete": f"case when {u} > {frequency} then {c} else '' end",
        "substitute": f"case when {u} < {frequency} then {new} else {c} end",
        "transpose": f"case when i < {size} and {u} < {frequency} then concat({after}, {c}) else {c} end",
    }[kind]
    return _chars(dialect, text, body)


def corrupt(df: DataFrame, kind: str, id_col: str, text_col: str, out_col: str, frequency: float, seed: int = 0) -> DataFrame:
    return df.withColumn(out_col, F.expr(corruption("spark", kind, text_col, id_col, frequency, seed)))


def fuzzify(df: DataFrame, id_col: str, text_col: str, out_col: str, frequency: float = 0.10, seed: int = 0) -> DataFrame:
    """The four corruptions one after another, each at a quarter of the frequency."""
    out = df.withColumn(out_col, F.col(text_col))
    for kind in KINDS:
        out = corrupt(out, kind, id_col, out_col, out_col, frequency / 4, seed)
    return out


def fuzzify_sql(table: str, id_col: str, text_col: str, out_col: str, frequency: float = 0.10, seed: int = 0) -> str:
    """DuckDB SQL for the same, as nested selects."""
    sql = f"SELECT *, {text_col} AS {out_col} FROM {table}"
    for kind in KINDS:
        sql = f"SELECT * REPLACE ({corruption('duckdb', kind, out_col, id_col, frequency / 4, seed)} AS {out_col}) FROM ({sql})"
    return sql
