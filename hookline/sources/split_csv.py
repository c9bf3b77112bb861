"""Records of CSV files whose quoted fields span lines, with each file read by many tasks.

Spark reads a file with ``multiLine`` in one task. Here files are read as lines, block by block. Whether a line starts
within a quoted field hangs on all lines before it, but each line is only a mapping of that one bit: it leaves it, sets
it, clears it or turns it over. The mappings are chained within a block, then over the blocks of a file, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

# Places in a line: within an unquoted field, at the start of a field, within quotes, behind a quote within quotes.
_PLAIN, _FIELD, _INSIDE, _CLOSING = range(4)


def _ends_open(text: Column, start: int) -> Column:
    """Whether a line that starts at the given place ends within quotes. The line is walked quote by quote.

    A quote opens a field only as its first character. Within quotes two quotes stand for one; what follows a closing
    quote belongs to an unquoted field, up to the next comma.
    """

    def past(state: Column, part: Column) -> Column:
        plain = F.when(part.endswith(","), _FIELD).otherwise(_PLAIN)
        return F.when((part == "") | (state == _INSIDE), state).otherwise(plain)

    def quote(state: Column) -> Column:
        return F.when(state == _INSIDE, _CLOSING).when(state == _PLAIN, _PLAIN).otherwise(_INSIDE)

    parts = F.split(text, '"', -1)
    first = past(F.lit(start), parts[0])
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    walked = F.aggregate(rest, first.cast("int"), lambda state, part: past(quote(state), part).cast("int"))
    return F.when(F.contains(text, F.lit('"')), walked == _INSIDE).otherwise(F.lit(start == _INSIDE))


def _chained(df: DataFrame, window, *keep: str) -> DataFrame:
    """``fixed`` and ``turned`` for each row: the bit that the rows of the window before it leave behind, if they fix
    it, and else whether they turn it over. Rows map the bit to ``from_out`` and ``from_in``."""
    turns = F.when(~F.col("from_in") & F.col("from_out"), 1).otherwise(0)
    up_to = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumn("_turns", F.sum(turns).over(up_to))
    sets = F.when(F.col("from_in") == F.col("from_out"), F.struct(F.col("from_in").alias("bit"), F.col("_turns").alias("turns")))
    seen = counted.withColumn("_set", F.last(sets, ignorenulls=True).over(before)).withColumn(
        "_past", F.coalesce(F.last("_turns").over(before), F.lit(0))
    )
    odd = (F.col("_past") - F.coalesce("_set.turns", F.lit(0))) % 2 == 1
    return seen.select(*keep, F.when(F.col("_set").isNotNull(), F.col("_set.bit") != odd).alias("fixed"), odd.alias("turned"))


def _after(fixed: Column, turned: Column, bit: Column) -> Column:
    return F.coalesce(fixed, bit != turned)


def split_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, at, place, record): the text of every record but the header of each file, quoted line breaks kept as
    they are. Lines end in LF or CRLF; empty lines are no records; an open quote at the end of a file ends there.

    ``at`` and ``place`` order the records of a file. The lines are written twice, and twice a shuffle brings the lines
    of a block together, in order. Records on one line then stay where they are; only those on several lines, or at the
    edge of a block, are put together by a third one. A quote that is never closed makes the rest of its file one
    record, which must fit into a cell (2 GB), as with Spark's reader.
    """
    text = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"), "value",
    )
    text = text.select(
        "*", _ends_open(F.col("value"), _FIELD).alias("from_out"), _ends_open(F.col("value"), _INSIDE).alias("from_in")
    )
    block = Window.partitionBy("path", "at").orderBy("place")
    lines = materialize(_chained(text, block, "path", "at", "place", "value", "from_out", "from_in"), "csv-lines")

    # What a block as a whole makes of the bit: its last line, behind what stands before that.
    def through(bit: bool) -> Column:
        before = _after(F.col("fixed"), F.col("turned"), F.lit(bit))
        return F.max_by(F.when(before, F.col("from_in")).otherwise(F.col("from_out")), "place")

    blocks = lines.groupBy("path", "at").agg(through(False).alias("from_out"), through(True).alias("from_in"))
    in_file = Window.partitionBy("path").orderBy("at")
    opened = _chained(blocks, in_file, "path", "at").select("path", "at", _after(F.col("fixed"), F.col("turned"), F.lit(False)).alias("open"))

    begins = ~_after(F.col("fixed"), F.col("turned"), F.col("open"))
    known = lines.join(opened, ["path", "at"]).select("path", "at", "place", "value", begins.alias("begins"))
    up_to = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = known.select(
        "*", F.max(F.when(F.col("begins"), F.col("place"))).over(up_to).alias("start"), F.lead("begins").over(block).alias("next_begins")
    )
    known = materialize(known, "csv-records")

    # Lines at the head of a block continue the last record of the blocks before.
    ends = known.groupBy("path", "at").agg(F.max("start").alias("start"))
    own = F.when(F.col("start").isNotNull(), F.struct("at", "start"))
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("path", "at", F.last(own, ignorenulls=True).over(earlier).alias("_from"))
    header = known.groupBy("path").agg(F.min(F.struct("at", "place")).alias("_header"))

    alone = F.col("begins") & F.coalesce("next_begins", F.lit(False))
    single = known.where(alone).select("path", "at", "place", F.col("value").alias("record"))
    pieces = known.where(~alone).join(carried, ["path", "at"], "left").select(
        "path", F.coalesce(F.when(F.col("start").isNotNull(), F.struct("at", "start")), F.col("_from")).alias("key"),
        F.struct("at", "place", "value").alias("line"),
    )
    joined = pieces.groupBy("path", "key").agg(F.array_sort(F.collect_list("line")).alias("lines")).select(
        "path", F.col("key.at").alias("at"), F.col("key.start").alias("place"), F.array_join("lines.value", "\n").alias("record")
    )
    records = single.unionByName(joined).join(header, "path")
    text = F.regexp_replace("record", r"\r$", "")
    return records.where((F.struct("at", "place") != F.col("_header"))).select("path", "at", "place", text.alias("record")).where("record <> ''")
