"""Registered domain (the label left of the public suffix, plus the suffix)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_or_empty
from ..functions.url_features import IPV4
from ..session import materialize

# Common public suffixes, for use without a full public-suffix list.
COMMON_SUFFIXES = [
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "me", "app", "dev", "xyz",
    "online", "site", "top", "shop", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "de", "fr", "es", "it", "nl",
    "eu", "ru", "cn", "com.cn", "in", "co.in", "jp", "co.jp", "br", "com.br", "au", "com.au", "ca", "us",
    "ch", "at", "be", "pl", "se", "no", "dk", "fi",
]
# The full stops that separate host labels.
IDN_DOTS = ".\u3002\uff0e\uff61"


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a public-suffix list file: one a line, ``//`` starts a comment."""
    lines = spark.read.text(path).select(F.trim("value").alias("rule"))
    return lines.where((F.col("rule") != "") & ~F.col("rule").startswith("//"))


def url_host(url: Column) -> Column:
    """Host part of something URL-like, lower case; user, port and trailing dots removed, brackets kept."""
    text = F.regexp_replace(text_or_empty(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//", "")
    authority = F.substring_index(F.regexp_extract(text, r"^([^/?#]*)", 1), "@", -1)
    bracketed = F.regexp_extract(authority, r"^(\[[^\]]*\])", 1)
    name = F.rtrim(F.trim(F.substring_index(authority, ":", 1)), F.lit(IDN_DOTS))
    dotted = F.translate(name, IDN_DOTS, "....")
    return F.lower(F.when(bracketed != "", bracketed).otherwise(dotted))


def _rule_table(rules: DataFrame) -> DataFrame:
    """Per host name: is it a suffix itself, are its children suffixes, is it exempt from its parent's rule.

    Rules are in public-suffix notation: ``co.uk``, ``*.ck``, ``!www.ck``. One name may have several.
    """
    rule = F.lower("rule")
    wild, exempt = rule.startswith("*."), rule.startswith("!")
    key = F.when(wild, F.substring(rule, 3, 1 << 20)).when(exempt, F.substring(rule, 2, 1 << 20)).otherwise(rule)
    named = rules.where(F.col("rule").isNotNull()).select(key.alias("key"), (~wild & ~exempt).alias("e"), wild.alias("w"), exempt.alias("x"))
    flags = named.groupBy("key").agg(F.max("e").alias("exact"), F.max("w").alias("wild"), F.max("x").alias("exempt"))
    return flags.select("key", F.struct("exact", "wild", "exempt").alias("rule"))


def with_registered_domain(
    df: DataFrame, rules: Iterable[str] | DataFrame = COMMON_SUFFIXES, url: str = "url", out: str = "domain_group"
) -> DataFrame:
    """``df`` plus the registered domain of ``url``.

    The longest matching suffix wins. Without a suffix the last label is the group, an IP address is its own
    group, no host gives "". The rules, of any number, are written as a table and joined with the last one, two, …
    labels of the host. The optimiser knows the table's size and broadcasts it while it is small, which leaves the
    rows where they are: no explode, no grouping, no shuffle of ``df``.
    """
    if not isinstance(rules, DataFrame):
        rules = df.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    lookup = materialize(_rule_table(rules), "suffix-rules")
    deepest = lookup.agg(F.max(F.size(F.split("key", r"\."))).alias("d")).first()["d"] or 0
    step = df.withColumn("_host", url_host(F.col(url)))
    step = step.withColumn("_labels", F.when(F.col("_host") == "", 0).otherwise(F.size(F.split("_host", r"\."))))
    found, exempt = [F.lit(0)], []
    for depth in range(1, deepest + 1):
        tail = F.when(F.col("_labels") >= depth, F.substring_index("_host", ".", -depth))
        side = lookup.select(F.col("key").alias(f"_k{depth}"), F.col("rule").alias(f"_r{depth}"))
        step = step.join(side, tail == F.col(f"_k{depth}"), "left")
        rule = F.col(f"_r{depth}")
        found.append(F.when(rule["exact"], depth).otherwise(0))
        found.append(F.when(rule["wild"] & (F.col("_labels") > depth), depth + 1).otherwise(0))
        exempt.append(F.when(rule["exempt"], depth - 1))
    longest = F.greatest(*found) if deepest else F.lit(0)
    step = step.withColumn("_suffix", F.coalesce(*exempt, longest))
    is_address = F.col("_host").rlike(IPV4) | F.col("_host").startswith("[")
    group = (
        F.when(is_address & (F.col("_suffix") == 0), F.col("_host"))
        .when(F.col("_suffix") == 0, F.substring_index("_host", ".", -1))
        .when(F.col("_suffix") >= F.col("_labels"), F.lit(""))
        .otherwise(F.expr("substring_index(_host, '.', -(_suffix + 1))"))
    )
    return step.withColumn(out, group).select(*df.columns, out)
