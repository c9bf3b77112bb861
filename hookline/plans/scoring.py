"""Scoring e-mails: text model, URL model, fused risk. Models are fitted pipelines or tables of numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.risk import score_response
from ..functions.text import message_text
from ..functions.urls import extract_urls
from ..operators.given_models import TreeEnsemble, WordWeights
from ..operators.lookup import lookup_join
from ..operators.scores import explode_urls, join_scores, max_url_score
from ..operators.text_model import score_text
from ..operators.url_model import UrlPlusModel, score_urls
from ..session import materialize
from ..sources.columns import optional


@dataclass
class EmailModels:
    text: PipelineModel | WordWeights
    url: PipelineModel | TreeEnsemble


def _with_text_score(model: PipelineModel | WordWeights, df: DataFrame, text: str) -> DataFrame:
    return model.score_text(df, text) if isinstance(model, WordWeights) else score_text(model, df, text)


def _with_url_score(model: PipelineModel | TreeEnsemble, df: DataFrame) -> DataFrame:
    return model.score_urls(df) if isinstance(model, TreeEnsemble) else score_urls(model, df)


def as_messages(emails: DataFrame, key: str) -> DataFrame:
    """(key, message, urls) of e-mails with optional subject, sender, body; what is missing counts as empty."""
    parts = (optional(emails, c) for c in ("subject", "sender", "body"))
    messages = emails.select(key, message_text(*parts).alias("message"))
    return messages.withColumn("urls", extract_urls(F.col("message"), "live"))


def score_emails(emails: DataFrame, models: EmailModels, key: str = "id") -> DataFrame:
    """(key, response fields), one response for each input row: a mail that is sent again is scored again.

    One pass: both models run where the rows are, and the URL rows of an e-mail, which lie side by side, are
    reduced before the only shuffle. That carries a row number, the key, two scores and the URL list; message
    bodies stay in their tasks.
    """
    messages = as_messages(emails, key).withColumn("_row", F.monotonically_increasing_id())
    scored_text = _with_text_score(models.text, messages, "message")
    rows = scored_text.select("_row", key, "text_probability", "urls", F.posexplode_outer("urls").alias("pos", "url"))
    # Only the first row of an e-mail carries its list, or a mail with many URLs would grow by their square.
    mail = F.when(F.coalesce("pos", F.lit(0)) == 0, F.struct(F.col(key).alias("key"), "text_probability", "urls")).alias("mail")
    scored = _with_url_score(models.url, rows.select("_row", "url", mail)).groupBy("_row").agg(
        F.coalesce(F.max("probability"), F.lit(0.0)).alias("url_probability"),
        F.any_value("mail", ignoreNulls=True).alias("mail"),
    )
    response = score_response(F.col("mail.text_probability"), F.col("url_probability"), F.col("mail.urls"))
    return scored.select(F.col("mail.key").alias(key), response.alias("response")).select(key, "response.*")


def score_distinct_urls(exploded: DataFrame, model: UrlPlusModel | TreeEnsemble, key: str) -> DataFrame:
    """(key, pos, url, probability): every distinct URL is scored once and its score joined back.

    The counts that make the URLs distinct also tell which of them are frequent, so the join back spreads
    them. An e-mail without URLs keeps its row with a null score.
    """
    counted = exploded.where(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("n"))
    keyed = materialize(counted.withColumn("url_key", F.col("url")), "url-counts")  # features and n-grams are read from it
    scored = model.score(keyed, "url_key", "url", keep=["n"]).select(F.col("url_key").alias("url"), "probability", "n")
    scored = materialize(scored, "url-scores")
    total = scored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return lookup_join(exploded, scored, key="url", row_id=key, count="n", total=total)


def _score_table(
    rows: DataFrame,
    mode: str,
    url_column: str,
    text_model: PipelineModel | WordWeights,
    url_model: UrlPlusModel | TreeEnsemble,
    key: str,
    text: str,
    keep: list[str],
) -> DataFrame:
    """Text score and URL list of each row are written once, without the texts; all URL work reads that table."""
    listed = rows.withColumn("_urls", extract_urls(F.col(url_column), mode))
    scored = _with_text_score(text_model, listed, text).select(key, *keep, "text_probability", F.col("_urls").alias("urls"))
    scored = materialize(scored, "text-scores")
    if mode == "list" and scored.where(F.size("urls") > 0).isEmpty():
        raise ValueError("no URL in the whole table")
    per_url = score_distinct_urls(explode_urls(scored, key, outer=False), url_model, key)
    joined = join_scores(scored.withColumn("url_count", F.size("urls")), max_url_score(per_url, key), key)
    return joined.select(key, *keep, "text_probability", "url_probability", "url_count")


def score_splits(
    dataset: DataFrame, text_model: PipelineModel | WordWeights, url_model: UrlPlusModel | TreeEnsemble, key: str = "id",
    text: str = "text",
) -> DataFrame:
    """(key, source, split, label, text_probability, url_probability, url_count) of whole splits in one job."""
    return _score_table(dataset, "text", text, text_model, url_model, key, text, ["source", "split", "label"])


def score_listed_urls(
    mails: DataFrame,
    text_model: PipelineModel | WordWeights,
    url_model: UrlPlusModel | TreeEnsemble,
    key: str = "id",
    text: str = "text",
    urls: str = "url",
) -> DataFrame:
    """(key, label, text_probability, url_probability, url_count) of mails whose URLs sit in a list-like column.
    A table without any URL is an error."""
    return _score_table(mails, "list", urls, text_model, url_model, key, text, ["label"])
