"""Checks that splits share nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import SPLITS

PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]


def split_overlap(df: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """For each pair of splits: distinct keys in both, and PASS or WARNING.

    One pass: each key collects the set of splits it occurs in as bits, then the bit patterns are counted.
    """
    bit = F.lit(0)
    for i, name in enumerate(SPLITS):
        bit = F.when(F.col(split) == name, 1 << i).otherwise(bit)
    masks = df.select(key.alias("_key"), bit.alias("_bit")).groupBy("_key").agg(F.bit_or("_bit").alias("_mask"))

    def shared(a: str, b: str) -> Column:
        both = (1 << SPLITS.index(a)) | (1 << SPLITS.index(b))
        return F.count_if(F.col("_mask").bitwiseAND(F.lit(both)) == both)

    row = masks.agg(
        F.array(
            *[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), shared(a, b).alias("shared")) for a, b in PAIRS]
        ).alias("pairs")
    )
    out = row.select(F.explode("pairs").alias("p")).select("p.*")
    return out.withColumn("status", F.when(F.col("shared") == 0, "PASS").otherwise("WARNING"))
