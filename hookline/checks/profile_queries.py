"""Profiles, risk columns, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions.labels import argmax_label, label_from_text, threshold_label
from ..functions.text import text_length
from ..operators import metrics as M
from ..operators import profile as P
from ..operators.scores import join_scores, max_url_score, with_max_over_urls
from . import duck as D
from . import views
from .corpus_queries import domains, text_splits
from .registry import query
from .url_queries import REGDOMAIN_SQL, with_urls

_MAIL = D.ctes("emails")
_SPLITS = D.ctes(*D.DATASET, "text_splits")
_LENS = "(SELECT source, CAST(length(coalesce(text, '')) AS BIGINT) AS len FROM documents)"


@query(
    "agg_label_counts",
    _SPLITS + "SELECT label, count(*) AS n, CASE label WHEN 0 THEN 'LEGITIMATE' WHEN 1 THEN 'PHISHING' ELSE 'UNKNOWN' END AS name "
    "FROM text_splits GROUP BY label",
)
def agg_label_counts(spark, sf):
    return P.label_counts(text_splits(spark, sf))


@query(
    "agg_source_counts",
    _MAIL + "SELECT source, count(*) AS n FROM emails GROUP BY source",
)
def agg_source_counts(spark, sf):
    return P.source_counts(views.emails(spark, sf))


@query(
    "agg_class_pct",
    _SPLITS + "SELECT split, label, n, n * CAST(100 AS DOUBLE) / sum(n) OVER (PARTITION BY split) AS pct FROM "
    "(SELECT split, label, count(*) AS n FROM text_splits GROUP BY split, label)",
)
def agg_class_pct(spark, sf):
    return P.class_percentages(text_splits(spark, sf), by=["split"])


@query(
    "agg_crosstab",
    D.ctes("emails", "prepared") + "SELECT source, count(*) FILTER (WHERE label = 0) AS legitimate, count(*) FILTER (WHERE label = 1) AS phishing FROM prepared GROUP BY source",
)
def agg_crosstab(spark, sf):
    mails = views.emails(spark, sf).withColumn("label", label_from_text(F.col("label")))
    return P.source_by_label(mails.where(F.col("label").isNotNull()))


_JOINED = "documents d LEFT JOIN labels l USING (doc_id)"


@query(
    "agg_null_counts",
    f"""SELECT "column", n_null FROM (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'quality', 'toxic']) AS "column",
      unnest([count(*) FILTER (WHERE doc_id IS NULL), count(*) FILTER (WHERE text IS NULL), count(*) FILTER (WHERE lang IS NULL), count(*) FILTER (WHERE source IS NULL), count(*) FILTER (WHERE n_chars IS NULL),
      count(*) FILTER (WHERE quality IS NULL), count(*) FILTER (WHERE toxic IS NULL)]) AS n_null FROM {_JOINED}) WHERE n_null > 0""",
)
def agg_null_counts(spark, sf):
    docs = views.table(spark, sf, "documents")
    return P.null_counts(docs.join(views.table(spark, sf, "labels"), "doc_id", "left"))


@query(
    "agg_label_candidates",
    """WITH cells AS (SELECT 'event_type' AS "column", event_type AS value FROM events
       UNION ALL SELECT 'spam_score', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) FROM events)
    SELECT "column", value, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS place
      FROM (SELECT "column", value, count(*) AS n FROM cells GROUP BY ALL)) WHERE place <= 20""",
)
def agg_label_candidates(spark, sf):
    events = views.table(spark, sf, "events")
    return P.label_candidates(events.select("event_id", "event_type", F.floor("value").alias("spam_score")))


@query(
    "agg_shape_preview",
    "SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, 'doc_id,text,lang,source,n_chars' AS column_names FROM documents",
)
def agg_shape_preview(spark, sf):
    return P.shape(views.table(spark, sf, "documents"))


@query("agg_preview", "SELECT doc_id, text, lang FROM documents ORDER BY doc_id LIMIT 3")
def agg_preview(spark, sf):
    return P.preview(views.table(spark, sf, "documents").select("doc_id", "text", "lang"), ["doc_id"], 3)


@query(
    "agg_len_stats",
    "SELECT source, min(len) AS min_len, max(len) AS max_len, round(avg(len), 9) AS mean_len, round(median(len), 9) AS median_len, "
    f"count(*) FILTER (WHERE len = 0) AS n_empty, count(*) FILTER (WHERE len < 20) AS n_below_20 FROM {_LENS} GROUP BY source",
)
def agg_len_stats(spark, sf):
    out = P.length_stats(views.table(spark, sf, "documents"), by=["source"])
    return out.withColumns({"mean_len": F.round("mean_len", 9), "median_len": F.round("median_len", 9)})


@query(
    "agg_len_quantiles",
    "SELECT " + ", ".join(f"round(quantile_cont(len, {q}), 6) AS p{round(q * 100)}" for q in P.LENGTH_QUANTILES)
    + f" FROM {_LENS}",
)
def agg_len_quantiles(spark, sf):
    out = P.length_quantiles(views.table(spark, sf, "documents"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "agg_len_buckets",
    " UNION ALL ".join(
        f"SELECT '{sign} {x}' AS bucket, count(*) FILTER (WHERE len {sign} {x}) AS n, count(*) FILTER (WHERE len {sign} {x}) * CAST(100 AS DOUBLE) / count(*) AS pct FROM {_LENS}"
        for sign, limits in ((">", P.LONG_LIMITS), ("<", P.SHORT_LIMITS))
        for x in limits
    ),
)
def agg_len_buckets(spark, sf):
    return P.length_buckets(views.table(spark, sf, "documents"))


@query(
    "agg_domain_stats",
    D.ctes("urls") + "SELECT count(*) AS rows, count(*) FILTER (WHERE domain_group = '') AS empty_domains, count(DISTINCT domain_group) AS distinct_domains "
    f"FROM ({REGDOMAIN_SQL})",
)
def agg_domain_stats(spark, sf):
    return P.domain_stats(domains(spark, sf))


def with_scores(spark, sf):
    """E-mails with a text score and per-URL scores that need no model, so that SQL can check the rest."""

    def oddness(u):
        return F.length(F.regexp_replace(u, r"[\p{L}\p{N}]+", "")) / F.greatest(F.length(u), F.lit(1))

    scored = with_urls(spark, sf).select(
        "id",
        label_from_text(F.col("label")).alias("label"),
        ((text_length(F.col("body")) % 1000) / F.lit(999.0)).alias("text_probability"),
        F.size("urls").cast("bigint").alias("url_count"),
        "urls",
        F.transform("urls", oddness).alias("url_scores"),
    )
    return scored


def fused(spark, sf):
    step = with_max_over_urls(with_scores(spark, sf), F.col("url_scores"))
    return step.withColumn("risk", R.fused_risk(F.col("text_probability"), F.col("url_probability")))


def judged(spark, sf):
    return fused(spark, sf).where(F.col("label").isNotNull()).select(
        "label", F.col("risk").alias("score"), threshold_label(F.col("risk")).alias("predicted")
    )


_SCORED = D.ctes("emails", "scored")
_JUDGED = D.ctes("emails", "scored", "judged")


@query("agg_url_max", _SCORED + "SELECT id, url_probability FROM scored")
def agg_url_max(spark, sf):
    exploded = with_scores(spark, sf).select("id", F.explode_outer("url_scores").alias("probability"))
    return max_url_score(exploded)


@query("jn_scores", _SCORED + "SELECT id, label, text_probability, url_probability, url_count FROM scored")
def jn_scores(spark, sf):
    scored = with_scores(spark, sf)
    per_url = scored.select("id", F.explode("url_scores").alias("probability"))
    return join_scores(scored, max_url_score(per_url)).select(
        "id", "label", "text_probability", "url_probability", "url_count"
    )


@query("sc_fixed_fusion", _SCORED + "SELECT id, risk FROM scored")
def sc_fixed_fusion(spark, sf):
    return fused(spark, sf).select("id", "risk")


@query(
    "sc_level",
    _SCORED + "SELECT id, risk >= 0.5 AS is_phishing, CASE WHEN risk >= CAST(0.7 AS DOUBLE) THEN 'High' WHEN risk >= 0.5 THEN 'Medium' "
    "ELSE 'Low' END AS risk_level FROM scored",
)
def sc_level(spark, sf):
    return fused(spark, sf).select(
        "id", R.is_phishing(F.col("risk")).alias("is_phishing"), R.risk_level(F.col("risk")).alias("risk_level")
    )


@query(
    "sc_response",
    _SCORED + "SELECT id, risk >= 0.5 AS is_phishing, url_count, abs(risk_score - risk * 100) <= 0.005001 AS ok FROM "
    "(SELECT *, round(risk * 100, 2) AS risk_score FROM scored)",
)
def sc_response(spark, sf):
    """Rounding differs between engines at exact halves, so the rounded score is checked by its distance."""
    step = fused(spark, sf)
    r = R.score_response(F.col("text_probability"), F.col("url_probability"), F.col("urls"))
    return step.select("id", "risk", r.alias("r")).select(
        "id", "r.is_phishing", F.col("r.url_count").cast("bigint").alias("url_count"),
        (F.abs(F.col("r.risk_score") - F.col("risk") * 100) <= 0.005001).alias("ok"),
    )


@query("flt_threshold", _SCORED + "SELECT id, CASE WHEN risk >= 0.5 THEN 1 ELSE 0 END AS predicted FROM scored")
def flt_threshold(spark, sf):
    return fused(spark, sf).select("id", threshold_label(F.col("risk")).alias("predicted"))


@query("flt_argmax", _SCORED + "SELECT id, CASE WHEN risk > 1 - risk THEN 1 ELSE 0 END AS predicted FROM scored")
def flt_argmax(spark, sf):
    return fused(spark, sf).select("id", argmax_label(1 - F.col("risk"), F.col("risk")).alias("predicted"))


_STATS = """round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, min({c}) AS min, max({c}) AS max,
  round(quantile_cont({c}, 0.25), 9) AS p25, round(quantile_cont({c}, 0.5), 9) AS p50, round(quantile_cont({c}, 0.75), 9) AS p75"""


@query(
    "agg_describe",
    _SCORED + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, " + _STATS.format(c=f"CAST({c} AS DOUBLE)") + " FROM scored"
        for c in ("text_probability", "url_probability", "url_count")
    ),
)
def agg_describe(spark, sf):
    out = P.describe_scores(fused(spark, sf), ["text_probability", "url_probability", "url_count"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std", "p25", "p50", "p75")})


_CELLS = (
    "count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp, "
    "count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp"
)


@query("ev_confusion", _JUDGED + f"SELECT {_CELLS} FROM judged")
def ev_confusion(spark, sf):
    return M.confusion(judged(spark, sf))


_BINARY = (
    f"(SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall "
    f"FROM (SELECT {_CELLS} FROM judged))"
)


@query(
    "ev_binary",
    _JUDGED + "SELECT tn, fp, fn, tp, round(CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp), 9) AS accuracy, round(precision, 9) AS precision, "
    f"round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM {_BINARY}",
)
def ev_binary(spark, sf):
    out = M.binary_metrics(judged(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query(
    "ev_auc",
    _JUDGED + """SELECT round(CAST(sum(pos * (2 * before + neg)) AS DOUBLE) / 2 / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS roc_auc FROM (
      SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM judged GROUP BY score))""",
)
def ev_auc(spark, sf):
    return M.roc_auc(judged(spark, sf)).select(F.round("roc_auc", 9).alias("roc_auc"))


def _report_sql() -> str:
    def f1(p: str, r: str) -> str:
        return f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"

    return (
        _JUDGED + "SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM ("
        "WITH c AS (SELECT " + _CELLS + " FROM judged), "
        "m AS (SELECT *, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0) AS p0, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS r0, "
        "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p1, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r1, "
        "tn + fp AS s0, tp + fn AS s1, tn + fp + fn + tp AS s, CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp) AS acc FROM c), "
        f"x AS (SELECT *, {f1('p0', 'r0')} AS f0, {f1('p1', 'r1')} AS f1 FROM m) "
        "SELECT 'LEGITIMATE' AS name, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM x "
        "UNION ALL SELECT 'PHISHING', p1, r1, f1, s1 FROM x UNION ALL SELECT 'accuracy', acc, acc, acc, s FROM x "
        "UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM x "
        "UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s, (f0 * s0 + f1 * s1) / s, s FROM x)"
    )


@query("ev_report", _report_sql())
def ev_report(spark, sf):
    out = M.classification_report(judged(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "ev_logloss",
    _JUDGED + "SELECT round(avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)), 9) AS log_loss FROM "
    "(SELECT label, greatest(least(score, CAST(1 AS DOUBLE) - CAST('1e-15' AS DOUBLE)), CAST('1e-15' AS DOUBLE)) AS p FROM judged)",
)
def ev_logloss(spark, sf):
    out = M.log_loss(judged(spark, sf), probability="score")
    return out.select(F.round("log_loss", 9).alias("log_loss"))


@query("srt_topk", _MAIL + "SELECT label, count(*) AS n FROM emails GROUP BY label ORDER BY n DESC, label LIMIT 5")
def srt_topk(spark, sf):
    counts = views.emails(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(5)


# Audits of whole split tables


@query(
    "audit_split_quality",
    _SPLITS + """SELECT split, count(*) AS rows, count(*) FILTER (WHERE id IS NULL OR source IS NULL OR text IS NULL OR label IS NULL) AS n_incomplete,
      min(length(text)) AS min_len, max(length(text)) AS max_len, round(avg(length(text)), 9) AS mean_len, round(median(length(text)), 9) AS median_len,
      count(*) FILTER (WHERE length(text) = 0) AS n_empty, count(*) FILTER (WHERE length(text) < 20) AS n_below_20 FROM text_splits GROUP BY split""",
)
def audit_split_quality(spark, sf):
    rows = text_splits(spark, sf)
    any_null = F.col("id").isNull() | F.col("source").isNull() | F.col("text").isNull() | F.col("label").isNull()
    basics = rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(any_null).alias("n_incomplete"))
    lengths = P.length_stats(rows, by=["split"])
    out = basics.join(lengths, "split")
    return out.withColumns({"mean_len": F.round("mean_len", 9), "median_len": F.round("median_len", 9)})


@query(
    "audit_split_sources",
    _SPLITS + "SELECT split, source, count(*) AS n FROM text_splits GROUP BY split, source",
)
def audit_split_sources(spark, sf):
    return text_splits(spark, sf).groupBy("split", "source").agg(F.count("*").alias("n"))
