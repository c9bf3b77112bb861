"""Counts, shares, lengths and missing values: what the audits of a corpus print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import label_name
from ..functions.text import text_length, text_or_empty
from .ordered import exact_quantiles

# Limits and keywords of the audits.
LONG_LIMITS = [1000, 2000, 5000, 10000, 20000, 50000]
SHORT_LIMITS = [20, 50, 100, 200]
LENGTH_QUANTILES = [0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
LABEL_KEYWORDS = ["label", "class", "target", "type", "category", "spam", "phish", "legitimate"]


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label with its name, by label."""
    return (
        df.groupBy(label)
        .agg(F.count("*").alias("n"))
        .withColumn("name", label_name(F.col(label)))
        .orderBy(label)
    )


def source_counts(df: DataFrame, source: str = "source", keep_null: bool = True) -> DataFrame:
    """Rows per source, most frequent first."""
    rows = df if keep_null else df.where(F.col(source).isNotNull())
    return rows.groupBy(source).agg(F.count("*").alias("n")).orderBy(F.desc("n"), source)


def class_percentages(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Share of each label in percent, per ``by`` group. The window runs over the counted table."""
    by = by or []
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(group))


def source_by_label(df: DataFrame, source: str = "source", label: str = "label") -> DataFrame:
    """Source by label table with zero cells filled."""
    return (
        df.groupBy(source)
        .pivot(label, [0, 1])
        .count()
        .fillna(0, ["0", "1"])
        .select(source, F.col("0").alias("legitimate"), F.col("1").alias("phishing"))
    )


def null_counts(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Nulls per column as (column, n_null); one aggregate over the table, then one row per column."""
    one = df.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("n_null"))
                for c in df.columns
            ]
        ).alias("cells")
    )
    out = one.select(F.explode("cells").alias("cell")).select("cell.*")
    return out.where(F.col("n_null") > 0) if only_missing else out


def label_candidate_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if any(word in c.lower() for word in LABEL_KEYWORDS)]


def label_candidates(df: DataFrame, top: int = 20) -> DataFrame:
    """Most frequent values, null included, of every column whose name hints at a label.

    All candidate columns are counted in one pass; the top rows are cut per task before they meet.
    """
    names = label_candidate_columns(df.columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, place int")
    cells = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]
        )
    )
    counts = df.select(cells.alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def shape(df: DataFrame) -> DataFrame:
    """Row count, column count and column names."""
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def preview(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows in a given order."""
    return df.orderBy(*order).limit(n)


def length_table(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """How many rows have each text length. Far smaller than the corpus, and all length statistics follow from it."""
    return df.groupBy(*(by or []), text_length(F.col(text)).alias("len")).agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Shortest, longest, mean and median length, empty rows, rows below 20 characters."""
    lengths, weight = F.col("len"), F.col("n")
    return length_table(df, text, by).groupBy(*(by or [])).agg(
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        (F.sum(lengths * weight) / F.sum("n")).alias("mean_len"),
        F.percentile("len", F.lit(0.5), weight).alias("median_len"),
        F.coalesce(F.sum(F.when(lengths == 0, weight)), F.lit(0)).alias("n_empty"),
        F.coalesce(F.sum(F.when(lengths < 20, weight)), F.lit(0)).alias("n_below_20"),
    )


def length_quantiles(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Exact, interpolated length quantiles as p25 … p99."""
    wanted = F.percentile("len", F.array(*[F.lit(q) for q in LENGTH_QUANTILES]), F.col("n"))
    out = length_table(df, text, by).groupBy(*(by or [])).agg(wanted.alias("_q"))
    return out.select(
        *(by or []), *[F.col("_q")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(LENGTH_QUANTILES)]
    )


def length_buckets(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Rows and percentage above each long limit and below each short one."""
    by = by or []
    weight = F.col("n")

    def bucket(name: str, condition: Column) -> Column:
        n = F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))
        return F.struct(F.lit(name).alias("bucket"), n.alias("n"), (n * 100.0 / F.sum(weight)).alias("pct"))

    cells = [bucket(f"> {limit}", F.col("len") > limit) for limit in LONG_LIMITS]
    cells += [bucket(f"< {limit}", F.col("len") < limit) for limit in SHORT_LIMITS]
    one = length_table(df, text, by).groupBy(*by).agg(F.array(*cells).alias("cells"))
    return one.select(*by, F.explode("cells").alias("c")).select(*by, "c.*")


def domain_stats(df: DataFrame, domain: str = "domain_group") -> DataFrame:
    """Rows, rows without a domain, distinct domains. Rows are grouped first, so no value set is gathered."""
    return (
        df.groupBy(domain)
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col(domain) == "", F.col("n"))), F.lit(0)).alias("empty_domains"),
            F.count(domain).alias("distinct_domains"),
        )
    )


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Rows, distinct values and duplicate rows of a column; optionally from a sketch."""
    if approximate:
        out = df.agg(F.count("*").alias("rows"), F.approx_count_distinct(column).alias("distinct_rows"))
    else:
        out = df.groupBy(column).agg(F.count("*").alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")
        )
    return out.withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def describe_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, 25 %, 50 %, 75 %, max of each column, quartiles exact; one row per column."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    long = df.select(cells.alias("c")).select("c.column", "c.value")
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"])
    return moments.join(quartiles, "column").select(
        *moments.columns, F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )


def char_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entropy): Shannon entropy in bits of the characters of each text, 0 for an empty one.

    Counted within the row, as runs of equal characters in sorted order; nothing is shuffled, and the work grows with the
    length of the text, however many different characters it has.
    """
    step = df.select(key, text_or_empty(F.col(text)).alias("_text"))
    total = F.length("_text").cast("double")
    ordered = F.array_join(F.array_sort(F.split("_text", "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)((.)\2*+)"), F.lit(1))

    def add(bits: Column, run: Column) -> Column:
        n = F.length(run).cast("double")
        return bits + n * F.log2(n)

    bits = F.log2(total) - F.aggregate(runs, F.lit(0.0), add) / total
    return step.select(key, F.when(total > 0, bits).otherwise(F.lit(0.0)).alias("entropy"))
