"""Small shared pieces: words, columns that pass through, and joins that stand very frequent keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The word rule of all operators as a Java pattern: runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than this share of the rows is joined through a broadcast; there are fewer than 1024 such keys.
HOT_SHARE = 1024


def words(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z in lower case. ``bytes`` methods fold and split on exactly the ASCII sets wanted."""
    return text.encode().lower().split() if text else []


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add, whatever the case of their names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores in front until no frame has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def append_columns(df: DataFrame, text: str, added: dict[str, str], make: Callable, as_bytes: bool = False) -> DataFrame:
    """``df`` with the columns ``added`` (name to type) computed from the text column, batch by batch.

    ``make`` gets the list of texts of a batch, ``as_bytes`` in UTF-8, and returns one Arrow array for each new column. Rows
    keep all other columns as they are; columns named like an added one are replaced.
    """
    base = without(df, *added)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + [f"`{n}` {t}" for n, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index(text))
            columns = make((bodies.cast(pa.binary()) if as_bytes else bodies).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return base.mapInArrow(run, schema)


def join_uneven(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (one row per ``key``; ``count`` says how many rows have the key).

    Keys with more than ``total / HOT_SHARE`` rows, fewer than ``HOT_SHARE`` of them, are broadcast, so their rows stay
    where they are; only rows of the other keys are shuffled. Both inputs are read twice and should be written tables.
    """
    limit = total // HOT_SHARE
    hot = F.broadcast(lookup.where(F.col(count) > limit).drop(count))
    cold = lookup.where(F.col(count) <= limit).drop(count)
    spread = rows.join(hot, key)
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return spread.unionByName(rest)
