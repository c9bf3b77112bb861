"""From a raw URL table to features and leak-free splits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import flip_label
from ..functions.text import numeric_or_zero
from ..functions.url_features import URL_FEATURES, with_url_features
from ..operators.dedup import keep_first
from ..operators.domains import with_registered_domain
from ..operators.group_split import group_split
from ..operators.ordered import sequence_id
from ..sources.columns import require

# Columns of the raw table. They hold one ratio that the model does not use.
URL_NUMERIC = [*URL_FEATURES[:10], "DegitRatioInURL", *URL_FEATURES[10:]]
URL_REQUIRED = ["URL", "Domain", *URL_NUMERIC, "label"]


def distinct_urls(raw: DataFrame, key: str, url: str = "URL", label: str = "label") -> DataFrame:
    """First row of each (URL, label); a null URL counts as empty. Rows without a label go afterwards."""
    filled = raw.withColumn(url, F.coalesce(F.col(url).cast("string"), F.lit("")))
    return keep_first(filled, [F.sha2(F.col(url), 256), F.col(label)], [key]).dropna(subset=[label])


def prepare_url_dataset(raw: DataFrame, key: str, source: str = "PhiUSIIL") -> DataFrame:
    """(id, source, URL, Domain, numerics, label) with the raw table's inverted labels turned round."""
    require(raw, URL_REQUIRED, "URL table")
    rows = distinct_urls(raw.select(key, *URL_REQUIRED), key).select(
        key,
        F.lit(source).alias("source"),
        "URL",
        F.coalesce(F.col("Domain"), F.lit("")).alias("Domain"),
        *[numeric_or_zero(F.col(c)).alias(c) for c in URL_NUMERIC],
        flip_label(F.col("label").cast("int")).alias("label"),
    )
    return sequence_id(rows, [key]).select("id", "source", "URL", "Domain", *URL_NUMERIC, "label")


def url_feature_table(urls: DataFrame, key: str, url: str = "url", label: str = "label") -> DataFrame:
    """(key, 25 features, label) straight from the URL column."""
    return with_url_features(urls.select(key, url, label), url).select(key, *URL_FEATURES, label)


def split_by_domain(
    urls: DataFrame, suffix_rules: Iterable[str], key: str = "id", url: str = "url", label: str = "label"
) -> DataFrame:
    """``urls`` with ``domain_group`` and a ``split`` in which no registered domain occurs twice."""
    return group_split(with_registered_domain(urls, suffix_rules, url), "domain_group", key, label)
