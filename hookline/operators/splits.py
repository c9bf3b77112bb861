"""Train / validation / test splits and fixed-seed samples."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
MAX_LABELS = 100  # a label with more values is refused, as it is no class label; nothing is dropped
SPLITS = ["train", "val", "test"]


@dataclass(frozen=True)
class Scheme:
    """``held``: share cut off first. ``second``: share cut off the held part or, with ``from_rest``, off the
    rest. Each cut takes ceil(share * rows), dealt to the labels by largest remainder."""

    held: float
    second: float
    from_rest: bool = False


SCHEMES = {
    "80_10_10": Scheme(held=0.20, second=0.50),
    "70_15_15": Scheme(held=0.30, second=0.50),
    "70_10_20": Scheme(held=0.20, second=0.10 / (1.0 - 0.20), from_rest=True),
}


def seeded_hash(key: Column, seed: int = SEED) -> Column:
    """Hex digest that stands in for a shuffled order: the same on every run and in every engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def deal(available: dict, share: float) -> dict:
    """What each label keeps when ceil(share * rows) rows are cut off: equal shares, by largest remainder.

    A tie goes to the smaller label.
    """
    total = sum(available.values())
    kept = total - math.ceil(share * total)
    if not total:
        return dict(available)
    out = {label: n * kept // total for label, n in available.items()}
    by_remainder = sorted(available, key=lambda label: (-(available[label] * kept % total), label))
    for label in by_remainder[: kept - sum(out.values())]:
        out[label] += 1
    return out


def cut_sizes(rows: dict, scheme: Scheme) -> dict:
    """Per label, after how many rows the first and the second cut fall."""
    kept = deal(rows, scheme.held)
    if scheme.from_rest:
        train = deal(kept, scheme.second)
        return {label: (train[label], kept[label]) for label in rows}
    held = {label: rows[label] - kept[label] for label in rows}
    val = deal(held, scheme.second)
    return {label: (kept[label], kept[label] + val[label]) for label in rows}


def split_limits(df: DataFrame, scheme: Scheme, key: str, label: str, seed: int = SEED) -> dict:
    """Per label, the hash values at the two cuts.

    Two passes over (key, label) only. The first counts rows per label and hash bucket, at most 65,536 numbers
    a label. The second ranks the rows of the buckets that hold a cut, at most two a label. The driver sees one
    total a label and one hash a cut.
    """
    hashed = df.where(F.col(label).isNotNull()).select(
        F.col(label).alias("label"), seeded_hash(F.col(key), seed).alias("hash")
    )
    hashed = hashed.withColumn("bucket", F.substring("hash", 1, 4))
    running = Window.partitionBy("label").orderBy("bucket")
    counts = hashed.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(running)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = counts.groupBy("label").agg(F.sum("n").alias("n")).limit(MAX_LABELS + 1).collect()
        if len(totals) > MAX_LABELS:
            raise ValueError(f"{label} has more than {MAX_LABELS} values; it is not a class label")
        cuts = cut_sizes({r["label"]: r["n"] for r in totals}, scheme)
        limits = {value: ["", ""] for value in cuts}  # a cut of size 0 takes no row: "" sorts before any hash
        wanted = [(value, which, at) for value, pair in cuts.items() for which, at in enumerate(pair) if at]
        if not wanted:
            return limits
        holds = [
            (F.col("label") == value) & (F.col("upto") >= at) & (F.col("upto") - F.col("n") < at)
            for value, _, at in wanted
        ]
        found = counts.where(reduce(lambda a, b: a | b, holds)).collect()
    finally:
        counts.unpersist()
    buckets = {(r["label"], r["bucket"]): r["upto"] - r["n"] for r in found}
    inside = [(F.col("label") == value) & (F.col("bucket") == bucket) for value, bucket in buckets]
    place = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("hash"))
    ranked = hashed.where(reduce(lambda a, b: a | b, inside)).withColumn("place", place)
    nth = [
        (F.col("label") == value) & (F.col("bucket") == bucket) & (F.col("place") == at - before)
        for value, _, at in wanted
        for (owner, bucket), before in buckets.items()
        if owner == value
    ]
    for r in ranked.where(reduce(lambda a, b: a | b, nth)).collect():
        at = buckets[r["label"], r["bucket"]] + r["place"]
        for which in (0, 1):
            if cuts[r["label"]][which] == at:
                limits[r["label"]][which] = r["hash"]
    return limits


def stratified_split(
    df: DataFrame, scheme: Scheme | str, key: str = "id", label: str = "label", seed: int = SEED
) -> DataFrame:
    """``df`` plus a ``split`` column: exact sizes, labels in equal shares, decided by a hash of the unique key.

    Each label's rows are thought of in hash order and cut at the exact sizes. Once the hash values at the
    cuts are known, a row finds its split by comparing its own hash with them: the data itself is neither
    sorted nor shuffled, and the result can be read any number of times for the price of a projection. Rows
    without a label are left out.
    """
    scheme = SCHEMES[scheme] if isinstance(scheme, str) else scheme
    limits = split_limits(df, scheme, key, label, seed)
    own = F.col("_hash")
    split = F.lit(None).cast("string")
    for value, (first, second) in limits.items():
        part = F.when(own <= first, SPLITS[0]).when(own <= second, SPLITS[1]).otherwise(SPLITS[2])
        split = F.when(F.col(label) == value, part).otherwise(split)
    marked = df.where(F.col(label).isNotNull()).withColumn("_hash", seeded_hash(F.col(key), seed))
    return marked.withColumn("split", split).drop("_hash")


def sample_per_class(
    df: DataFrame, n: int = 10, key: str = "id", label: str = "label", seed: str = "1111122222"
) -> DataFrame:
    """``n`` rows of each class, chosen by hash; ``position`` is their shuffled order.

    The rank filter is applied in every map task first, so at most ``n`` rows per class and task are shuffled.
    """
    step = df.withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    place = F.row_number().over(Window.partitionBy(label).orderBy("_hash"))
    picked = step.withColumn("_place", place).where(F.col("_place") <= n)
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_hash"))
    return picked.withColumn("position", order).drop("_hash", "_place")
