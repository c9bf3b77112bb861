"""Attaching values to rows by a key that may be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than 1/HOT_SHARE of the rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 4096


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, row_id: str, count: str, total: int, how: str = "left"
) -> DataFrame:
    """``rows`` with the columns of ``lookup`` (one row per ``key``, ``count`` = its rows, ``total`` = all rows).

    Hot keys, fewer than ``HOT_SHARE`` by definition, are broadcast. Their rows then carry a key of their own
    that matches nothing, so they spread over all tasks of the ordinary join that serves the other keys. Rows
    without a key, which may be most of them, spread in the same way. ``key`` must be a string column. All rows stay, ``how`` is ``left`` or ``inner``.
    """
    values = [c for c in lookup.columns if c not in (key, count)]
    limit = total // HOT_SHARE
    payload = lookup.select(F.col(key).alias("_key"), F.struct(*values).alias("_value"), F.col(count).alias("_n"))
    hot = payload.where(F.col("_n") > limit).select(F.col("_key").alias("_hot_key"), F.col("_value").alias("_hot"))
    cold = payload.where(F.col("_n") <= limit).select(
        F.col("_key").alias("_cold_key"), F.col("_value").alias("_cold")
    )
    step = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    spread = F.concat(F.lit("\x00"), F.col(row_id).cast("string"))
    step = step.withColumn("_join_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
    step = step.join(cold, F.col("_join_key") == F.col("_cold_key"), "left")
    step = step.withColumn("_value", F.coalesce("_hot", "_cold"))
    if how == "inner":
        step = step.where(F.col("_value").isNotNull())
    return step.select(*rows.columns, *[F.col("_value")[v].alias(v) for v in values])
