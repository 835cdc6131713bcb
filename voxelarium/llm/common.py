"""Helpers shared by the text operators."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters that count as white space: ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without_white(text: Column) -> Column:
    """``text`` with every white-space character deleted."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, text)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are.

    ``lower`` does the same on pure ASCII and is faster there.
    """
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def sha256(text: Column) -> Column:
    """32 bytes; half of what the hex form moves."""
    return F.unhex(F.sha2(text, 256))


def lower_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that ``taken`` does not have, letter case ignored."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def carried(df: DataFrame, used: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` on ``df`` while all columns but ``used`` travel under other names.

    Columns are told apart by place, so any name will do: letters of another case, dots,
    backticks.  A used column is the one of exactly that name, else one that differs in case.
    Columns that ``step`` adds replace those of the same name, in any case.
    """
    hidden = {}
    for name in used:
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if at:
            hidden[at[0]] = name
    names = [hidden.get(i, f"carried_{i}") for i in range(len(df.columns))]
    back = dict(zip(names, df.columns))
    out = step(df.toDF(*names))
    added = {c.lower() for c in out.columns if c not in back}
    kept = [c for c in out.columns if c not in back or back[c].lower() not in added]
    return out.select(*kept).toDF(*[back.get(c, c) for c in kept])


def carries(*parameters: str):
    """For operators on a first ``DataFrame``: only the columns named by these parameters keep their names inside."""

    def decorate(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @wraps(operator)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            bound = signature.bind(df, *args, **kwargs)
            bound.apply_defaults()
            used = [bound.arguments[p] for p in parameters]
            return carried(df, used, lambda rows: operator(rows, *args, **kwargs))

        return run

    return decorate


def with_result(df: DataFrame, **columns: Column) -> DataFrame:
    """Set result columns; an input column of the same name (in any case) gives way."""
    clash = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash], *[v.alias(k) for k, v in columns.items()])
