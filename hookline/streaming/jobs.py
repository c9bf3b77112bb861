"""Scoring e-mails as they arrive, and dropping e-mails that are sent again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import has_text, message_text
from ..plans.scoring import EmailModels, score_emails
from ..sources.columns import optional


def score_stream(
    emails: DataFrame, models: EmailModels, sink: str, checkpoint: str, key: str = "id", **trigger
) -> StreamingQuery:
    """Scores each micro-batch with the batch transform and writes it below ``sink`` as ``batch_id=…``.

    A batch that is run again after a failure replaces its own folder, so every e-mail is written once.
    ``trigger`` defaults to everything available now.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        score_emails(batch, models, key).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        emails.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drop_resent(emails: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """E-mails with a body, each message once within ``delay``; state older than that is dropped."""
    parts = [optional(emails, c) for c in ("subject", "sender", "body")]
    keyed = emails.where(has_text(parts[2])).withColumn("message_hash", F.sha2(message_text(*parts), 256))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["message_hash"])


def append_stream(rows: DataFrame, sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream to a parquet table, exactly once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
