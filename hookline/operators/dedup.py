"""Keep-first deduplication and duplicate counts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.text import text_hash


def _place(df: DataFrame, order: list[str]) -> Column:
    """The order columns as one value. Integers become one decimal, which a hash aggregate can hold; others a struct."""
    kinds = [df.schema[c].dataType for c in order]
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and all(isinstance(k, IntegralType) for k in kinds):
        first, second = (F.col(c).cast("decimal(19,0)") for c in order)
        return (first * F.lit(Decimal(10**19)) + second).cast("decimal(38,0)")
    return F.struct(*order)


def keep_first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order`` (which must order rows uniquely).

    Only keys and places are aggregated: copies are dropped on the map side, so a message that makes up a third of
    the corpus reaches the reducer as one narrow row per map task. The rows themselves then move once, to meet the
    places that won in a hash join on that unique value; texts are never sorted.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    place = _place(df, order)
    first = df.select(*named, place.alias("_place")).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_place").alias("_place"))
    return df.join(first.select("_place").hint("shuffle_hash"), place.eqNullSafe(F.col("_place")), "left_semi")


def distinct_text_label(df: DataFrame, order: list[str], text: str = "text", label: str = "label") -> DataFrame:
    """First row of each (text, label). Texts are compared by digest, which keeps the shuffle key short."""
    return keep_first(df, [F.sha2(F.col(text), 256), F.col(label)], order)


def distinct_messages(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """First row of each normalised text: a later copy goes even if its label differs."""
    return keep_first(df, [text_hash(F.col(text))], order)


def duplicate_counts(df: DataFrame, key: list[Column], by: list[str] | None = None) -> DataFrame:
    """Rows, distinct keys and duplicate rows, per ``by`` group or in total."""
    by = by or []
    named = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    copies = df.groupBy(*by, *named).agg(F.count("*").alias("_n"))
    return copies.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def label_conflicts(df: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """Rows, distinct keys, duplicate rows, keys that occur with more than one label, and the distinct share."""
    per_key = df.groupBy(*key).agg(
        F.count("*").alias("_n"), F.min(label).alias("_low"), F.max(label).alias("_high")
    )
    rows, distinct = F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")
    return per_key.agg(
        rows.alias("rows"),
        distinct.alias("distinct_keys"),
        (rows - distinct).alias("duplicate_rows"),
        F.count_if(F.col("_low") != F.col("_high")).alias("conflicting_keys"),
        F.try_divide(distinct, rows).alias("unique_ratio"),
        (F.try_divide(distinct, rows) * 100).alias("unique_pct"),
    )
