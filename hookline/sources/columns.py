"""Finding the columns of a raw table. Works on names only; no job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted column names.
ANY_LABEL = ["label", "labels", "class", "target"]
TEXT_BY_PRIORITY = ["normalized_text", "raw_text", "text", "message"]
LABEL_BY_PRIORITY = ["labels", "label", "class", "target"]
SOURCE_BY_PRIORITY = ["source_type", "source", "type"]


def clean_headers(df: DataFrame) -> DataFrame:
    """Header names trimmed and lowered."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    """``df`` itself, or an error that lists every missing column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def _lowered(df: DataFrame) -> dict[str, str]:
    return {c.strip().lower(): c for c in df.columns}


def first_in_table(df: DataFrame, aliases: list[str]) -> str | None:
    """The first column, in table order, whose name is one of ``aliases``."""
    return next((c for name, c in _lowered(df).items() if name in aliases), None)


def first_by_priority(df: DataFrame, aliases: list[str]) -> str | None:
    """The column of the first alias, in the order given, that exists."""
    found = _lowered(df)
    return next((found[a] for a in aliases if a in found), None)


def optional(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """Column by name in any case, or ``default`` (empty text) when the table does not have it."""
    column = _lowered(df).get(name.lower())
    if column is not None:
        return F.col(f"`{column}`")
    return F.lit("") if default is None else default
