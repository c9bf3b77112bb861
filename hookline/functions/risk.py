"""Fusing the two probabilities into a risk, its level, and the response record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and limits of the score.
TEXT_WEIGHT = 0.6
URL_WEIGHT = 0.4
HIGH_RISK = 0.7
PHISHING_RISK = 0.5


def fused_risk(text_probability: Column, url_probability: Column) -> Column:
    return F.lit(TEXT_WEIGHT) * text_probability + F.lit(URL_WEIGHT) * url_probability


def is_phishing(risk: Column) -> Column:
    return risk >= PHISHING_RISK


def risk_level(risk: Column) -> Column:
    return F.when(risk >= HIGH_RISK, "High").when(risk >= PHISHING_RISK, "Medium").otherwise("Low")


def percent(probability: Column) -> Column:
    """Times 100 with two decimals. Rounds the exact binary value, halves to even, which ``round`` and
    ``bround`` do not: they round the shortest decimal form."""
    return F.format_number(probability * 100, 2).cast("double")


def score_response(text_probability: Column, url_probability: Column, urls: Column) -> Column:
    """The response record of one scored e-mail. Without URLs the URL probability is 0, so the risk stays
    below 0.6 and never reaches High."""
    risk = fused_risk(text_probability, url_probability)
    return F.struct(
        is_phishing(risk).alias("is_phishing"),
        risk_level(risk).alias("risk_level"),
        percent(risk).alias("risk_score"),
        percent(text_probability).alias("text_probability"),
        percent(url_probability).alias("url_probability"),
        F.size(urls).alias("url_count"),
        urls.alias("urls"),
    )
