"""The cleaning pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline.llm import decontamination, mixing, pii, simhash, toxicity
from hookline.llm.frames import fresh
from hookline.session import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL cannot say the trained stages; the tests compare each stage with a plain version.
ORACLE_SQL: str | None = None


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, learned from the labelled ones among them, predicts to be toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tagger = toxicity.fit_tagger(docs, labels, Scratch(spark, "toxicity"))
    names = fresh("score", docs), fresh("predicted", docs), fresh("toxic_spans", docs)
    scored = toxicity.score_toxicity(docs, tagger, names=names)
    return scored.where(F.col(names[1]) == 0).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies go: of the documents linked by at most 4 differing SimHash bits the smallest id stays."""
    return simhash.keep_one(docs, Scratch(spark, "keep-one"), shingle=4, max_bits=4)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item, word for word or with other numbers and names, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = fresh("hits", docs), fresh("item", docs)
    found = decontamination.with_hits(docs, benchmark, Scratch(spark, "leaks"), names=names)
    return found.where(F.col(names[0]) == 0).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in them is replaced by its kind, and n_chars is counted anew."""
    return pii.redact(docs, Scratch(spark, "pii"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: adds how often each document is taken, and the targets behind it."""
    return mixing.mix(docs, Scratch(spark, "mix"), weights=(1, 2, 3), most=3)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("simhash", one_of_each),
    ("decontamination", not_leaked),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every stage but the last is written out and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
