"""Resharding by minimum-cost flow: which bytes of which old shard go to which new one, then only those files are written anew.

A layout is a folder with one subfolder a shard. From the bytes of the old shards and the room of the new ones a flow is
solved whose cost is the bytes that leave their shard; each unit of flow is a block of documents that stand next to each
other in the old shard's order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.ordered import prefix_sums
from ..session import Scratch
from .frames import fresh


@dataclass(frozen=True)
class Layout:
    """Sharded documents: folders, each with the shards that are read from it (``folder/<column>=<shard>/``).

    ``schema`` is that of the documents, ``column`` the name of the shard column, which no document column has.
    """

    folders: tuple[tuple[str, tuple[int, ...]], ...]
    schema: StructType
    column: str

    def read(self, spark: SparkSession, place: str = "place") -> DataFrame:
        """The documents with their shard and their ``place`` (turn of the folder, file, row of the file)."""
        whole = StructType([*self.schema.fields, StructField(self.column, IntegerType())])
        parts = []
        for turn, (folder, shards) in enumerate(self.folders):
            rows = spark.read.schema(whole).parquet(folder).where(F.col(self.column).isin(*shards))
            at = rows.metadataColumn("_metadata")
            spot = F.struct(F.lit(turn).alias("turn"), at["file_path"].alias("file"), at["row_index"].alias("row")).alias(place)
            parts.append(rows.select(*[F.col(f"`{c}`") for c in whole.names], spot))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def lay_out(docs: DataFrame, shard: Column, shards: int, folder: str) -> Layout:
    """``docs`` written to ``folder``, each row to the shard (0 to ``shards`` - 1) that the column ``shard`` says.

    Rows are dealt by (shard, row number), so a shard with most of the rows is written by as many tasks as any other.
    """
    spark = docs.sparkSession
    deal = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    column = fresh("shard", docs)
    rows = docs.withColumn(column, shard.cast("int"))
    task = (F.col(column) * deal + F.pmod(F.monotonically_increasing_id(), F.lit(deal))).cast("int")
    rows.repartitionById(shards * deal, task).write.partitionBy(column).parquet(folder)
    return Layout(((folder, tuple(range(shards))),), docs.schema, column)


def even(total: int, shards: int) -> list[int]:
    """Room for ``total`` bytes in ``shards`` shards, one byte apart at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def transfers(
    sizes: Sequence[int], room: Sequence[int], cost: Callable[[int, int], float] | None = None
) -> dict[tuple[int, int], int]:
    """(old shard, new shard) to bytes: the cheapest way to put all ``sizes`` into ``room``.

    ``cost`` is that of a byte from an old to a new shard; by default 0 for the shard of the same number, else 1, so the
    flow moves the fewest bytes. Successive shortest paths: each augments the flow along a cheapest path of the residual
    graph, in which bytes already dealt may be dealt back.
    """
    if sum(sizes) > sum(room):
        raise ValueError("the new shards have too little room")
    if not len(sizes) or not sum(sizes):
        return {}
    unit = np.array([[float(cost(i, j) if cost else i != j) for j in range(len(room))] for i in range(len(sizes))])
    flow = np.zeros(unit.shape, np.int64)
    left, free = np.array(sizes, np.int64), np.array(room, np.int64)
    while left.any():
        old, new = np.where(left > 0, 0.0, np.inf), np.full(len(free), np.inf)
        into, back = np.full(len(free), -1), np.full(len(left), -1)
        while True:  # Bellman-Ford: shorter ways forward by any edge, back by edges that carry flow
            ahead = old[:, None] + unit
            nearer = ahead.min(axis=0) < new - 1e-9
            new, into = np.where(nearer, ahead.min(axis=0), new), np.where(nearer, ahead.argmin(axis=0), into)
            behind = np.where(flow > 0, new[None, :] - unit, np.inf)
            closer = behind.min(axis=1) < old - 1e-9
            old, back = np.where(closer, behind.min(axis=1), old), np.where(closer, behind.argmin(axis=1), back)
            if not closer.any() and not nearer.any():
                break
        end = int(np.where(free > 0, new, np.inf).argmin())
        path, j = [], end
        while j >= 0:
            i = int(into[j])
            path.append((i, j, 1))
            j = int(back[i])
            if j >= 0:
                path.append((i, j, -1))
        most = min(int(left[path[-1][0]]), int(free[end]), *(int(flow[i, j]) for i, j, sign in path if sign < 0), int(left.sum()))
        for i, j, sign in path:
            flow[i, j] += sign * most
        left[path[-1][0]] -= most
        free[end] -= most
    return {(int(i), int(j)): int(flow[i, j]) for i, j in zip(*np.nonzero(flow), strict=True)}


def _key(text: Column, place: str) -> Column:
    """The order of the documents of a shard: large before small, equal texts next to each other, then by place."""
    at = F.col(place)
    return F.struct(
        (-size_of(text)).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text"), at["turn"].alias("turn"),
        at["file"].alias("file"), at["row"].alias("row"),
    )


def reshard(
    spark: SparkSession, layout: Layout, room: int | Sequence[int], folder: str, scratch: Scratch, text: str = "text",
    cost: Callable[[int, int], float] | None = None,
) -> tuple[Layout, dict[tuple[int, int], int]]:
    """The layout with new shards, as many as ``room`` says (a number of even shards, or bytes for each), and the flow.

    Each old shard that gives something away is put in order and cut at the running sums of its flow: first what stays,
    then a block for each new shard. A document belongs to the block that holds its middle byte, so a cut is off by half
    a document; as documents stand by size, those at the cuts are small ones. Only a group of equal texts that a cut
    meets is parted. Documents that stay in a shard without departures are not written again, nor is their file: the new
    layout reads them from the old folder. What is written goes from the old files to the new without a shuffle.

    Driver: one row a shard and, for the cuts, one a block (at most old plus new shards less one). The order is found on
    a narrow table of sizes and places by a range sort. Null texts have one byte; rows that repeat are documents of
    their own; an empty layout stays empty. Old folders must stay as long as the new layout is read.
    """
    column, place = layout.column, fresh("place", spark.createDataFrame([], layout.schema))
    rows = layout.read(spark, place)
    narrow = scratch.table(rows.select(
        F.col(column).alias("old"), size_of(F.col(text)).alias("size"), _key(F.col(text), place).alias("key")
    ))
    held = {r["old"]: r["size"] for r in narrow.groupBy("old").agg(F.sum("size").alias("size")).collect()}
    known = max([s for _, shards in layout.folders for s in shards], default=-1) + 1
    sizes = [held.get(i, 0) for i in range(known)]
    flow = transfers(sizes, even(sum(sizes), room) if isinstance(room, int) else room, cost)
    giving = sorted({i for i, j in flow if i != j})
    if not giving:
        return layout, flow
    blocks = []
    for i in giving:
        at = 0
        for j in sorted((j for k, j in flow if k == i), key=lambda j: (j != i, j)):
            blocks.append((i, j, 2 * at, 2 * (at + flow[i, j])))
            at += flow[i, j]
    parts = spark.createDataFrame(blocks, "part int, shard int, low bigint, high bigint")
    sums = prefix_sums(narrow.where(F.col("old").isin(*giving)), "key", ["size"], by=["old"])
    middle = 2 * F.col("size_before") + F.col("size")
    dealt = sums.join(F.broadcast(parts), (F.col("old") == F.col("part")) & (middle > F.col("low")) & (middle <= F.col("high")))
    firsts = dealt.groupBy("old", "shard", "low").agg(F.min("key").alias("first"))
    cuts = firsts.withColumn("next", F.lead("first").over(Window.partitionBy("old").orderBy("low"))).drop("low")
    cuts = F.broadcast(scratch.table(cuts).withColumnRenamed("shard", "to"))  # one row a block
    body, key = F.col("whole")[column], _key(F.col("whole")[text], "spot")
    leaving = rows.where(F.col(column).isin(*giving)).select(F.struct(*rows.drop(place).columns).alias("whole"), F.col(place).alias("spot"))
    leaving = leaving.join(cuts, (body == F.col("old")) & (key >= F.col("first")) & (F.col("next").isNull() | (key < F.col("next"))))
    written = leaving.select(*[F.col("whole")[c].alias(c) for c in layout.schema.names], F.col("to").alias(column))
    written.write.partitionBy(column).parquet(folder)
    stay = tuple((f, tuple(s for s in shards if s not in giving)) for f, shards in layout.folders)
    arrived = tuple(sorted({j for (i, j) in flow if i in giving}))
    return Layout((*((f, s) for f, s in stay if s), (folder, arrived)), layout.schema, column), flow


def with_slots(spark: SparkSession, layout: Layout, scratch: Scratch, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """The documents with their shard and their slot, the number from 0 of their row among the files of the shard.

    Files follow each other by folder and name. Where each begins is summed over one row a file; no document is moved.
    """
    docs = spark.createDataFrame([], layout.schema)
    place = fresh("place", docs)
    rows = layout.read(spark, place)
    spot = F.col(place)
    files = rows.select(F.col(layout.column).alias("s"), spot["turn"].alias("t"), spot["file"].alias("f")).groupBy("s", "t", "f")
    before = Window.partitionBy("s").orderBy("t", "f").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.table(files.agg(F.count("*").alias("n")).select("f", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    given = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(layout.column).alias("s"), spot["file"].alias("f"), spot["row"].alias("r"))
    return given.join(starts, "f").select(
        *[F.col("given")[c].alias(c) for c in docs.columns if c not in names], F.col("s").alias(names[0]), (F.col("start") + F.col("r")).alias(names[1])
    )
