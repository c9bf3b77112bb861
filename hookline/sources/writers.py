"""Tables, splits, matrices, models and metrics out."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replaces the table at ``path``. CSV gets a header and quoting that ``read_csv`` reads back."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    else:
        writer.format(fmt).save(path)


def write_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet") -> None:
    """All splits in one write, a folder for each. A reader of one split opens that folder only."""
    df.write.mode("overwrite").partitionBy(split).format(fmt).save(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """Feature rows with their label in the same row, so nothing depends on row order."""
    df.write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_feature_names(spark: SparkSession, names: list[str], path: str) -> None:
    rows = [(i, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "position int, feature string").coalesce(1).write.mode("overwrite").json(path)


def write_metrics(record: DataFrame, path: str) -> None:
    """A one-row metrics record as JSON."""
    record.coalesce(1).write.mode("overwrite").json(path)
