"""Positions in a sorted table without ever sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its lower 33 bits


def _sorted_table(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written out with each row's partition and row number.

    Writing fixes both: the readers below would otherwise each draw their own range boundaries.
    """
    marked = df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id())
    return materialize(marked, name).withColumns(
        {
            "_part": F.shiftrightunsigned("_mark", _ROW_BITS),
            "_row": F.col("_mark").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    ).drop("_mark")


def _before_part(table: DataFrame, sums: dict[str, Column], by: list[str]) -> DataFrame:
    """Per sort partition and group, the sums over the partitions before it. One row per sort task and group
    it holds; as the table is sorted by group, that is about one row per task plus one per group."""
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        table.groupBy("_part", *by)
        .agg(*[expr.alias(name) for name, expr in sums.items()])
        .select("_part", *by, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums])
    )


def sequence_id(df: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """``df`` with gap-free ids 1..n in the order of the (unique) ``order`` columns. Replaces a column ``out``."""
    table = _sorted_table(df, order, "sequence")
    starts = _before_part(table, {"_start": F.count("*")}, [])
    return table.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + F.col("_row") + 1).alias(out), *[c for c in df.columns if c != out]
    )


def prefix_sums(df: DataFrame, value: str, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """For one row per (group and) ``value``: adds ``<measure>_before``, the sum over all smaller values.

    ``by`` must have few distinct values, as the columns of a report do.
    """
    by = by or []
    table = _sorted_table(df, [*by, value], "prefix")
    starts = _before_part(table, {f"_{m}": F.sum(m) for m in measures}, by)
    inside = Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return table.join(F.broadcast(starts), ["_part", *by]).select(
        *df.columns,
        *[
            (F.col(f"_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_before")
            for m in measures
        ],
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: list[float], by: list[str] | None = None
) -> DataFrame:
    """The exact quantiles of a column, linearly interpolated, as ``q0``, ``q1``, …; one row, or one per group.

    Equal values are counted first, then placed by running counts, so no task holds the whole column. Nulls
    and NaN are ignored.
    """
    by = by or []
    number = F.col(value).cast("double")
    counted = (
        df.where(number.isNotNull() & ~F.isnan(number))
        .groupBy(*by, (number + 0.0).alias("v"))
        .agg(F.count("*").alias("n"))
    )
    placed = prefix_sums(counted, "v", ["n"], by)
    last = (placed.groupBy(*by).agg((F.sum("n") - 1).alias("_last")))
    if by:
        placed = placed.join(F.broadcast(last), by)
    else:
        placed = placed.withColumn("_last", F.lit(last.first()["_last"]))

    def value_at(index: Column) -> Column:
        holds = (F.col("n_before") <= index) & (F.col("n_before") + F.col("n") > index)
        return F.max(F.when(holds, F.col("v")))

    cells = []
    for i, p in enumerate(probabilities):
        place = F.col("_last") * F.lit(p)
        low = F.floor(place)
        cells += [
            value_at(low).alias(f"_low{i}"),
            value_at(F.least(low + 1, F.col("_last"))).alias(f"_high{i}"),
            F.max(place - low).alias(f"_share{i}"),
        ]
    quantiles = [
        (F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_share{i}")).alias(f"q{i}")
        for i in range(len(probabilities))
    ]
    return placed.groupBy(*by).agg(*cells).select(*by, *quantiles)
