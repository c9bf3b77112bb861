"""Splits that never tear a group (registered domain) apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .lookup import lookup_join
from .splits import SEED, seeded_hash

HEAVY_SHARE = 100  # a group with more than 1/HEAVY_SHARE of the rows is placed by itself


def place_heavy_groups(groups: list[tuple[str, int, int]], totals: tuple[int, int], folds: int) -> dict[str, int]:
    """Fold of each heavy group: most uneven first, into the fold that keeps the label shares most equal.

    Adding a group to a fold changes the sum of squared label shares by a term that grows with how much of
    the group's labels the fold already holds; the smallest growth wins, then the fold with fewest rows.
    """
    held = [[0, 0] for _ in range(folds)]
    weight = [max(totals[1], 1) ** 2, max(totals[0], 1) ** 2]
    placed = {}
    for name, n0, n1 in sorted(groups, key=lambda g: (-abs(g[1] - g[2]), g[0])):
        growth = [(f[0] * n0 * weight[0] + f[1] * n1 * weight[1], f[0] + f[1], i) for i, f in enumerate(held)]
        best = min(growth)[2]
        held[best][0] += n0
        held[best][1] += n1
        placed[name] = best
    return placed


def _group_folds(groups: DataFrame, folds: int, seed: int) -> DataFrame:
    """(group, n0, n1, n) plus a fold for each group.

    Fewer than ``HEAVY_SHARE`` heavy groups are placed on the driver. The light ones are dealt out in hash
    order, separately for each (n0, n1), so that every fold gets its share of every kind of group. Ranks come
    from counts per hash bucket, so a kind that holds most groups is still ranked by many tasks.
    """
    spark = groups.sparkSession
    totals = groups.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "n")]
    ).first()
    is_heavy = F.col("n") * HEAVY_SHARE > totals["n"]
    heavy = [(r["group"], r["n0"], r["n1"]) for r in groups.where(is_heavy).collect()]
    placed = place_heavy_groups(heavy, (totals["n0"], totals["n1"]), folds)
    heavy_folds = spark.createDataFrame(list(placed.items()), "group string, fold int")
    heavy_rows = groups.join(F.broadcast(heavy_folds), "group")

    light = groups.where(~is_heavy).withColumn("_hash", seeded_hash(F.col("group"), seed))
    light = light.withColumn("_bucket", F.substring("_hash", 1, 4))
    kind = ["n0", "n1"]
    earlier = Window.partitionBy(*kind).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        light.groupBy(*kind, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(*kind, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*kind, "_bucket").orderBy("_hash", "group")
    rank = F.col("_start") + F.row_number().over(inside) - 1
    first = F.conv(F.substring(seeded_hash(F.concat_ws(":", *kind), seed), 1, 4), 16, 10).cast("bigint")
    light_rows = light.join(starts, [*kind, "_bucket"]).withColumn("fold", F.pmod(rank + first, F.lit(folds)))
    columns = ["group", "n0", "n1", "n", "fold"]
    return heavy_rows.select(*columns).unionByName(light_rows.select(*columns))


def group_split_table(df: DataFrame, group: str, label: str = "label", seed: int = SEED) -> DataFrame:
    """One row per group: its label counts and its split. 1 of 5 folds is held out, 1 of 2 of those is validation.

    Both placements read the counted groups, not the rows.
    """
    groups = df.groupBy(F.col(group).alias("group")).agg(
        F.count_if(F.col(label) == 0).alias("n0"),
        F.count_if(F.col(label) == 1).alias("n1"),
        F.count("*").alias("n"),
    )
    outer = materialize(_group_folds(materialize(groups, "groups"), 5, seed), "group-folds")
    columns = ["group", "n0", "n1", "n"]
    train = outer.where(F.col("fold") != 0).select(*columns, F.lit("train").alias("split"))
    held = _group_folds(outer.where(F.col("fold") == 0).select(*columns), 2, seed)
    return train.unionByName(
        held.select(*columns, F.when(F.col("fold") == 0, "val").otherwise("test").alias("split"))
    )


def group_split(
    df: DataFrame, group: str, key: str = "id", label: str = "label", seed: int = SEED
) -> DataFrame:
    """``df`` plus ``split``; all rows of a group share it, labels stay roughly balanced (about 80/10/10).
    A null group counts as ""."""
    grouped = df.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("")))
    table = materialize(group_split_table(grouped, "_group", label, seed), "group-splits")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    lookup = table.select(F.col("group").alias("_group"), "split", "n")
    return lookup_join(grouped, lookup, key="_group", row_id=key, count="n", total=total, how="inner").drop("_group")
