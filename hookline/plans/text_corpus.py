"""From raw e-mail and message tables to one labelled, deduplicated, split text corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_from_number, label_from_text
from ..functions.text import clean_text, has_text, strip_text, subject_body_text, tagged_text, text_hash
from ..operators.dedup import distinct_text_label, keep_first
from ..operators.ordered import sequence_id
from ..operators.splits import stratified_split
from ..session import materialize
from ..sources.columns import (
    ANY_LABEL,
    LABEL_BY_PRIORITY,
    SOURCE_BY_PRIORITY,
    TEXT_BY_PRIORITY,
    first_by_priority,
    first_in_table,
    optional,
    require,
)
from ..sources.readers import read_many, union_sources


def _column(df: DataFrame, name: str | None, what: str) -> Column:
    if name is None:
        raise ValueError(f"no {what} column among {df.columns}")
    return F.col(f"`{name}`")


def prepare_email(raw: DataFrame, key: str, source: Column) -> DataFrame:
    """(key, source, subject, sender, body, url, text, label) of a mail table; rows without a usable label go."""
    label = _column(raw, first_by_priority(raw, ["label"]), "label")
    cleaned = raw.select(
        F.col(key),
        source.alias("source"),
        *[clean_text(optional(raw, c)).alias(c) for c in ("subject", "sender", "body")],
        clean_text(optional(raw, "urls")).alias("url"),
        label_from_text(label).alias("label"),
    ).dropna(subset=["label"])
    text = tagged_text(F.col("sender"), F.col("subject"), F.col("body"))
    return cleaned.select(key, "source", "subject", "sender", "body", "url", text.alias("text"), "label")


def distinct_numbered(prepared: DataFrame, key: str) -> DataFrame:
    """A prepared table with the first row of each (text, label), numbered 1, 2, … as ``id`` in the order of its key."""
    first = distinct_text_label(prepared.withColumnRenamed(key, "_key"), ["_key"])
    numbered = sequence_id(first, ["_key"])
    return numbered.select("id", *[c for c in prepared.columns if c not in (key, "id")])


def prepare_email_files(spark: SparkSession, paths: list[str], key: str = "id") -> DataFrame:
    """The prepared e-mail table from CSV files: all sound files stacked, rows without a usable label gone, one row
    for each (text, label), numbered. ``key`` is a number that is unique over all files."""
    raw = read_many(spark, paths)
    if raw is None:
        raise ValueError("no readable file with a label column")
    rows = prepare_email(raw.withColumn(key, F.col(key).cast("bigint")), key, F.col("source"))
    return distinct_numbered(rows, key)


def prepare_list_mail(raw: DataFrame, key: str, source: str = "SpaPhish") -> DataFrame:
    """(key, source, subject, body, url, text, label) of a mail table whose URLs sit in a list-like column."""
    label = _column(raw, first_in_table(raw, ANY_LABEL), "label")
    cleaned = raw.select(
        F.col(key),
        F.lit(source).alias("source"),
        *[clean_text(optional(raw, c)).alias(c) for c in ("subject", "body")],
        clean_text(optional(raw, "urls")).alias("url"),
        label_from_text(label).alias("label"),
    ).dropna(subset=["label"])
    text = subject_body_text(F.col("subject"), F.col("body"))
    rows = cleaned.select(key, "source", "subject", "body", "url", text.alias("text"), "label")
    return distinct_text_label(rows, [key]).where(has_text(F.col("text")))


def prepare_short_text(raw: DataFrame, key: str, source: str = "ShortText") -> DataFrame:
    """(key, source, text, raw_text, source_type, label) of a short-message table."""
    text = clean_text(_column(raw, first_by_priority(raw, TEXT_BY_PRIORITY), "text"))
    label = _column(raw, first_by_priority(raw, LABEL_BY_PRIORITY), "label")
    kind = first_by_priority(raw, SOURCE_BY_PRIORITY)
    rows = raw.select(
        F.col(key),
        F.lit(source).alias("source"),
        text.alias("text"),
        clean_text(optional(raw, "raw_text", text)).alias("raw_text"),
        (strip_text(F.col(f"`{kind}`")) if kind else F.lit("")).alias("source_type"),
        label_from_text(label).alias("label"),
    )
    return distinct_text_label(rows.dropna(subset=["label"]), [key]).where(has_text(F.col("text")))


def stack_sources(parts: list[DataFrame], key: str) -> DataFrame:
    """(priority, key, source, text, label) of all sources; an earlier source has the lower priority number."""
    frames = [
        require(part, [key, "source", "text", "label"], "source").select(
            F.lit(i).alias("priority"),
            F.col(key),
            F.col("source").cast("string").alias("source"),
            strip_text(F.col("text")).alias("text"),
            label_from_number(F.col("label")).alias("label"),
        )
        for i, part in enumerate(parts)
    ]
    return union_sources(frames)


def build_text_dataset(parts: list[DataFrame], key: str) -> DataFrame:
    """(id, source, text, label): sources stacked, those with label 0 or 1, the first row of each message, numbered in source
    order.

    The rows are cleaned and hashed once and written. Which of them stay and their numbers are found from hashes and places
    alone, so a text moves once, to meet its number. Empty messages share one hash and go after the copies, as one row.
    """
    stacked = stack_sources(parts, key).where(F.col("label").isin(0, 1))
    text = F.col("text")
    rows = materialize(
        stacked.withColumns({"_hash": text_hash(text), "_full": has_text(text), "_at": F.monotonically_increasing_id()}), "stacked"
    )
    first = keep_first(rows.select("_at", "priority", key, "_hash", "_full"), [F.col("_hash")], ["priority", key]).where("_full")
    numbered = sequence_id(first.select("_at", "priority", key), ["priority", key]).select("_at", "id")
    kept = rows.select("_at", "source", "text", "label").join(numbered.hint("shuffle_hash"), "_at")
    return kept.select("id", "source", "text", "label")


def split_text_dataset(dataset: DataFrame) -> DataFrame:
    """The dataset with its 70 / 15 / 15 ``split``."""
    return stratified_split(dataset, "70_15_15")
