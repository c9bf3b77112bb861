"""The audits of raw files, text splits and URL tables, each as a set of small report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_hash
from ..functions.url_features import URL_FEATURES
from ..operators import profile as P
from ..operators.dedup import duplicate_counts, label_conflicts
from ..operators.overlap import split_overlap
from ..sources.columns import require
from ..sources.readers import by_header


def audit_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, n_rows, n_columns, column_names, n_null) of each CSV file; one scan for each distinct header."""

    def one(table: DataFrame) -> DataFrame:
        names = [c for c in table.columns if c not in ("_malformed", "source_file")]
        nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in names), F.lit(0))
        return table.groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("n_rows"), nulls.alias("n_null")).select(
            "file", "n_rows", F.lit(len(names)).cast("bigint").alias("n_columns"), F.lit(",".join(names)).alias("column_names"), "n_null"
        )

    return reduce(DataFrame.unionByName, [one(t) for t in by_header(spark, paths)])


def validate_splits(dataset: DataFrame) -> dict[str, DataFrame]:
    """Reports on (id, source, text, label, split): missing values, labels, sources, lengths, copies inside a
    split, texts and ids shared between splits, class balance."""
    require(dataset, ["id", "source", "text", "label", "split"], "split table")
    return {
        "missing": P.null_counts(dataset, only_missing=False),
        "labels": P.class_percentages(dataset, by=["split"]),
        "sources": dataset.groupBy("split", "source").agg(F.count("*").alias("n")),
        "lengths": P.length_stats(dataset, by=["split"]),
        "duplicates": duplicate_counts(dataset, [text_hash(F.col("text"))], by=["split"]),
        "shared_texts": split_overlap(dataset, text_hash(F.col("text"))),
        "shared_ids": split_overlap(dataset, F.col("id")),
    }


def profile_splits(dataset: DataFrame) -> dict[str, DataFrame]:
    """Length quantiles, length limits, and source by label, per split."""
    require(dataset, ["source", "text", "label", "split"], "split table")
    return {
        "quantiles": P.length_quantiles(dataset, by=["split"]),
        "limits": P.length_buckets(dataset, by=["split"]),
        "source_by_label": dataset.groupBy("split", "source").agg(
            F.count_if(F.col("label") == 0).alias("legitimate"), F.count_if(F.col("label") == 1).alias("phishing")
        ),
    }


def audit_urls(urls: DataFrame, features: DataFrame, url: str = "url", label: str = "label") -> dict[str, DataFrame]:
    """Repeated URLs and feature vectors, those with more than one label, and the label counts."""
    return {
        "urls": label_conflicts(urls, [url], label),
        "vectors": label_conflicts(features, URL_FEATURES, label),
        "labels": P.label_counts(features, label),
    }
