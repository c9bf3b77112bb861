"""Per-e-mail URL scores from per-URL scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_urls(df: DataFrame, key: str = "id", urls: str = "urls", outer: bool = True) -> DataFrame:
    """One row per URL of an e-mail with its position; an e-mail without URLs keeps one row with null if ``outer``."""
    return df.select(key, (F.posexplode_outer if outer else F.posexplode)(urls).alias("pos", "url"))


def url_totals(df: DataFrame, urls: str = "urls") -> DataFrame:
    """E-mails, e-mails with a URL, and URLs in total."""
    size = F.size(urls)
    return df.agg(
        F.count("*").alias("emails"),
        F.count_if(size > 0).alias("emails_with_urls"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_urls"),
    )


def max_url_score(scored: DataFrame, key: str = "id", score: str = "probability") -> DataFrame:
    """Largest URL score per e-mail; 0 when it has none. All URLs of an e-mail come from one input row, so
    the map side already reduces them to one row per e-mail."""
    return scored.groupBy(key).agg(F.coalesce(F.max(score), F.lit(0.0)).alias("url_probability"))


def join_scores(emails: DataFrame, url_scores: DataFrame, key: str = "id") -> DataFrame:
    """E-mails with their URL score by key; an e-mail that was not scored gets 0."""
    out = emails.join(url_scores, key, "left")
    return out.withColumn("url_probability", F.coalesce("url_probability", F.lit(0.0)))


def with_max_over_urls(df: DataFrame, score: Column, out: str = "url_probability") -> DataFrame:
    """Largest value of an array of per-URL scores held in the row; 0 for an empty array. No shuffle."""
    return df.withColumn(out, F.coalesce(F.array_max(score), F.lit(0.0)))
