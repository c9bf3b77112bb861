"""CSV corpora, one file or many."""

from __future__ import annotations

import csv
import logging
from collections import defaultdict
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import clean_headers
from .split_csv import split_records

log = logging.getLogger(__name__)

_QUOTED = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_BAD = "_malformed"
LARGE_FILE = 512 << 20  # bytes from which one file is read by many tasks


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, every column text, header names trimmed and lowered. Malformed rows are cut or padded.

    Bodies hold line breaks, so a quoted field may span lines, and each file is read by one task here; ``by_header``
    and ``read_many`` read large files by many tasks.
    """
    return clean_headers(spark.read.csv(path, header=True, multiLine=multi_line, mode="PERMISSIVE", **_QUOTED))


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist; others are logged. Looks at names only."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for path in paths:
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        if name.getFileSystem(conf).exists(name):
            found.append(path)
        else:
            log.warning("%s cannot be read: no such file", path)
    return found


def _stem(path: Column) -> Column:
    """Name without ending of a file, or of the folder it lies in if that is named like a CSV file."""
    folder = F.regexp_extract(path, r"([^/]*)\.csv/[^/]*$", 1)
    own = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.url_decode(F.replace(F.when(folder != "", folder).otherwise(own), F.lit("+"), F.lit("%2B")))


def by_header(spark: SparkSession, paths: list[str], multi_line: bool = True, large: int = LARGE_FILE) -> list[DataFrame]:
    """One table for each distinct header among the files: text columns, ``source_file`` (the file's stem) and
    ``_malformed`` (the raw text of a row with too few or too many fields, else null).

    All first lines are read in one job, whatever the number of files; a table then reads all files of its header.
    With ``multi_line``, files of more than ``large`` bytes are cut into records by many tasks (``split_csv``).
    """
    paths = _existing(spark, paths)
    if not paths:
        return []
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("bytes"))
    first = lines.where("at = 0").withColumn("line", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "line").alias("header"), F.max("bytes").alias("bytes"))
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    for row in first.collect():  # a line for each file
        names = next(csv.reader([row["header"].removeprefix("\ufeff")]), [])
        groups[tuple(n.strip().lower() for n in names), multi_line and row["bytes"] > large].append(unquote(row["path"]))
    tables = []
    for (names, split), files in sorted(groups.items()):
        schema = ", ".join([*(f"c{i} string" for i in range(len(names))), f"{_BAD} string"])
        if split:
            options = {k: str(v).lower() for k, v in _QUOTED.items()} | {"multiLine": "true", "columnNameOfCorruptRecord": _BAD}
            fields = F.from_csv("record", schema, {**options, "mode": "PERMISSIVE"})
            df = split_records(spark, sorted(files)).select(fields.alias("r"), _stem(F.col("path")).alias("source_file"))
            df = df.select("r.*", "source_file")
        else:
            df = spark.read.csv(
                sorted(files), schema=schema, header=True, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, **_QUOTED
            )
            df = df.withColumn("source_file", _stem(F.col("_metadata.file_path")))
        tables.append(df.toDF(*names, _BAD, "source_file"))
    return tables


def sound_files(table: DataFrame) -> tuple[DataFrame, list[str]]:
    """``table`` of ``by_header`` without the files that hold a malformed row, and the stems of those files.

    All columns take part in the count, as a row is found malformed only where its fields are parsed.
    """
    parsed = F.count_if(F.col(_BAD).isNotNull() & (F.xxhash64(*table.columns) >= F.lit(-(1 << 63))))
    counts = table.groupBy("source_file").agg(parsed.alias("bad")).where("bad > 0")
    bad = sorted(r["source_file"] for r in counts.collect())  # faulty files only
    for name in bad:
        log.warning("%s holds malformed rows and is left out", name)
    return (table.where(~F.col("source_file").isin(bad)) if bad else table), bad


def read_csv_or_none(spark: SparkSession, path: str, label: str = "label", multi_line: bool = True) -> DataFrame | None:
    """Like ``read_csv``; a file that is missing, has no label column or holds a malformed row is logged and left out."""
    tables = by_header(spark, [path], multi_line)
    if len(tables) != 1:
        return None
    if label not in tables[0].columns:
        log.warning("%s has no %s column", path, label)
        return None
    table, bad = sound_files(tables[0])
    return None if bad else table.drop(_BAD, "source_file")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False) -> list[str]:
    """Paths below a folder on any file system Spark reads; file contents are not touched."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(folder)
        .select("path")
    )
    return sorted(r["path"] for r in files.collect())


def file_stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def read_many(
    spark: SparkSession, paths: list[str], skip: str = "_vectorized", prefix: str = "curated_", label: str = "label"
) -> DataFrame | None:
    """All readable files with a label column under one schema; ``source`` is the prefix and the file's stem.

    Files may differ in their columns and column order: those with the same header are read as one table, and the
    union of these is by name. Files with malformed rows are left out as a whole.
    """
    wanted = [p for p in paths if not (skip and skip in p.rsplit("/", 1)[-1].lower())]
    frames = []
    for table in by_header(spark, wanted):
        if label not in table.columns:
            log.warning("files with columns %s have no %s column", table.columns[:-2], label)
            continue
        sound, _ = sound_files(table)
        frames.append(sound.withColumn("source", F.concat(F.lit(prefix), "source_file")).drop(_BAD, "source_file"))
    return union_sources(frames) if frames else None


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Sources stacked by column name; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
