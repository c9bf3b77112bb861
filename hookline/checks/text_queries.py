"""Text, label and verdict columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions import verdict as V
from ..operators.profile import char_entropy
from . import duck as D
from . import views
from .registry import query

_MAIL = D.ctes("emails")


@query("txt_clean", _MAIL + f"SELECT id, {D.clean('body')} AS body, {D.clean('subject')} AS subject FROM emails")
def txt_clean(spark, sf):
    df = views.emails(spark, sf)
    return df.select("id", T.clean_text(F.col("body")).alias("body"), T.clean_text(F.col("subject")).alias("subject"))


@query("txt_strip", D.ctes("emails", "copies") + f"SELECT id, {D.strip('body')} AS body FROM copies")
def txt_strip(spark, sf):
    return views.copies(spark, sf).select("id", T.strip_text(F.col("body")).alias("body"))


@query("lbl_norm", _MAIL + f"SELECT id, {D.spelled_label('label')} AS label FROM emails")
def lbl_norm(spark, sf):
    return views.emails(spark, sf).select("id", L.label_from_text(F.col("label")).alias("label"))


@query(
    "lbl_numeric",
    _MAIL + "SELECT id, CASE WHEN TRY_CAST(label AS DOUBLE) IN (0, 1) THEN CAST(TRY_CAST(label AS DOUBLE) AS INTEGER) END "
    "AS label FROM emails",
)
def lbl_numeric(spark, sf):
    return views.emails(spark, sf).select("id", L.label_from_number(F.col("label")).alias("label"))


@query("lbl_flip", D.ctes("urls") + "SELECT url_id, CASE label WHEN 1 THEN 0 WHEN 0 THEN 1 END AS label FROM urls")
def lbl_flip(spark, sf):
    return views.urls(spark, sf).select("url_id", L.flip_label(F.col("label")).alias("label"))


@query(
    "lbl_name",
    _MAIL + f"SELECT id, CASE WHEN l = 0 THEN 'LEGITIMATE' WHEN l = 1 THEN 'PHISHING' ELSE 'UNKNOWN' END AS name "
    f"FROM (SELECT id, {D.spelled_label('label')} AS l FROM emails)",
)
def lbl_name(spark, sf):
    label = L.label_from_text(F.col("label"))
    return views.emails(spark, sf).select("id", label.alias("l")).select("id", L.label_name(F.col("l")).alias("name"))


@query("txt_combine", _MAIL + f"SELECT id, {D.tagged('sender', 'subject', 'body')} AS text FROM emails")
def txt_combine(spark, sf):
    parts = [T.clean_text(F.col(c)).alias(c) for c in ("sender", "subject", "body")]
    text = T.tagged_text(F.col("sender"), F.col("subject"), F.col("body"))
    return views.emails(spark, sf).select("id", *parts).select("id", text.alias("text"))


@query("txt_spaphish", D.ctes("urls", "list_mails") + f"SELECT id, {D.subject_body('subject', 'body')} AS text FROM list_mails")
def txt_spaphish(spark, sf):
    parts = [T.clean_text(F.col(c)).alias(c) for c in ("subject", "body")]
    text = T.subject_body_text(F.col("subject"), F.col("body"))
    return views.list_mails(spark, sf).select("id", *parts).select("id", text.alias("text"))


@query("txt_message", _MAIL + f"SELECT id, {D.message('subject', 'sender', 'body')} AS message FROM emails")
def txt_message(spark, sf):
    message = T.message_text(F.col("subject"), F.col("sender"), F.col("body"))
    return views.emails(spark, sf).select("id", message.alias("message"))


_PROMPT = " || chr(10) || ".join("'" + line + "'" for line in V.PROMPT_LINES) + " || chr(10)"


@query(
    "txt_prompt",
    _MAIL + f"SELECT id, {_PROMPT} || '    Subject: ' || subject || chr(10) || '    From: ' || sender || chr(10) || "
    "'    Body: ' || body || chr(10) || '    ' AS prompt, "
    f"{_PROMPT} || '    Subject: ' || subject || chr(10) || '    Body: ' || body || chr(10) || '    ' AS test_prompt "
    "FROM emails",
)
def txt_prompt(spark, sf):
    subject, sender, body = F.col("subject"), F.col("sender"), F.col("body")
    return views.emails(spark, sf).select(
        "id",
        V.verdict_prompt(subject, body, sender).alias("prompt"),
        V.verdict_prompt(subject, body).alias("test_prompt"),
    )


def verdict_responses(spark, sf):
    """Model answers made from the documents: plain, fenced, broken, and with a missing key."""
    flag = F.col("id") % 3 == 0
    answer = F.to_json(F.struct(flag.alias("is_phishing"), F.col("body").alias("explanation")))
    bare = F.to_json(F.struct(F.col("body").alias("explanation")))
    fence = "```"
    return views.emails(spark, sf).select(
        "id",
        L.label_from_text(F.col("label")).alias("label"),
        F.when(F.col("id") % 5 == 0, answer)
        .when(F.col("id") % 5 == 1, F.concat(F.lit(f"{fence}json\n"), answer, F.lit(f"\n{fence}\n")))
        .when(F.col("id") % 5 == 2, F.concat(F.lit(f" {fence}\n"), answer, F.lit(f"\n{fence}")))
        .when(F.col("id") % 5 == 3, F.concat(F.lit("I think: "), F.col("body")))
        .otherwise(bare)
        .alias("response"),
    )


_ANSWERS = (
    "answers AS (SELECT id, lab AS label, id % 5 AS kind, CASE WHEN id % 5 < 3 THEN id % 3 = 0 END AS flag, body, "
    "CASE WHEN id % 5 = 3 THEN 'I think: ' || body END AS raw FROM (SELECT id, body, " + D.spelled_label("label")
    + " AS lab FROM emails))\n"
)


def _verdict_sql() -> str:
    return (
        _MAIL.rstrip() + ", " + _ANSWERS
        + "SELECT id, flag AS is_phishing, CAST(flag AS VARCHAR) AS flag, CASE WHEN kind <> 3 THEN body END AS explanation, "
        f"CASE WHEN kind = 3 THEN '{V.PARSE_ERROR}' END AS error, raw AS raw_response FROM answers"
    )


@query("txt_verdict", _verdict_sql())
def txt_verdict(spark, sf):
    return V.with_verdict(verdict_responses(spark, sf)).select(
        "id", "is_phishing", "flag", "explanation", "error", "raw_response"
    )


@query("txt_verdict_test", _verdict_sql())
def txt_verdict_test(spark, sf):
    return V.with_verdict(verdict_responses(spark, sf), mode="test").select(
        "id", "is_phishing", "flag", "explanation", "error", "raw_response"
    )


@query(
    "ev_verdict",
    _MAIL.rstrip() + ", " + _ANSWERS
    + "SELECT count(*) AS total, count(*) FILTER (WHERE p = label) AS correct, count(*) FILTER (WHERE coalesce(p <> label, true)) AS misclassified, "
    "count(*) FILTER (WHERE p IS NULL) AS unparsed, CAST(count(*) FILTER (WHERE p = label) AS DOUBLE) / count(*) AS accuracy FROM ("
    "SELECT label, CASE WHEN kind = 3 THEN NULL WHEN flag THEN 1 ELSE 0 END AS p FROM answers WHERE label IS NOT NULL)",
)
def ev_verdict(spark, sf):
    from ..operators.metrics import verdict_accuracy

    return verdict_accuracy(V.with_verdict(verdict_responses(spark, sf).where(F.col("label").isNotNull()), mode="test"))


@query("txt_norm", D.ctes("emails", "copies") + f"SELECT id, {D.norm('body')} AS body FROM copies")
def txt_norm(spark, sf):
    return views.copies(spark, sf).select("id", T.normalize_text(F.col("body")).alias("body"))


@query("txt_hash", "SELECT doc_id, " + D.text_hash("text") + " AS hash FROM documents")
def txt_hash(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))


@query("txt_len", "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS len FROM documents")
def txt_len(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", T.text_length(F.col("text")).alias("len"))


@query(
    "txt_truncate",
    "SELECT doc_id, array_to_string(list_slice(list_filter(string_split(" + D.clean("text")
    + ", ' '), lambda w: w <> ''), 1, 256), ' ') AS text FROM documents",
)
def txt_truncate(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", T.truncate_tokens(F.col("text")).alias("text"))


@query("num_clean", _MAIL + "SELECT id, coalesce(TRY_CAST(label AS DOUBLE), 0) AS value FROM emails")
def num_clean(spark, sf):
    return views.emails(spark, sf).select("id", T.numeric_or_zero(F.col("label")).alias("value"))


@query(
    "num_finite",
    "SELECT event_id, CASE WHEN event_id % 5 < 3 OR value IS NULL THEN 0 ELSE value END AS value FROM events",
)
def num_finite(spark, sf):
    odd = F.col("event_id") % 5
    value = (
        F.when(odd == 0, F.lit(float("inf"))).when(odd == 1, F.lit(float("-inf"))).when(odd == 2, F.lit(float("nan")))
        .otherwise(F.col("value"))
    )
    return views.table(spark, sf, "events").select("event_id", T.finite_or_zero(value).alias("value"))


@query(
    "txt_entropy",
    """WITH chars AS (SELECT doc_id, ch, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents)
       WHERE ch <> '' GROUP BY doc_id, ch),
    totals AS (SELECT doc_id, sum(c) AS n FROM chars GROUP BY doc_id)
    SELECT d.doc_id, round(coalesce(e.bits, 0), 6) AS entropy FROM documents d LEFT JOIN (
      SELECT doc_id, -sum(CAST(c AS DOUBLE) / n * log2(CAST(c AS DOUBLE) / n)) AS bits
      FROM chars JOIN totals USING (doc_id) GROUP BY doc_id) e ON e.doc_id = d.doc_id""",
)
def txt_entropy(spark, sf):
    out = char_entropy(views.table(spark, sf, "documents"), "doc_id", "text")
    return out.withColumn("entropy", F.round("entropy", 6))


# Filters


@query("flt_label", D.ctes("emails", "prepared") + "SELECT id, label FROM prepared")
def flt_label(spark, sf):
    from ..plans.text_corpus import prepare_email

    return prepare_email(views.emails(spark, sf), "id", F.col("source")).select("id", "label")


@query("flt_label01", _MAIL + "SELECT id FROM emails WHERE TRY_CAST(label AS DOUBLE) IN (0, 1)")
def flt_label01(spark, sf):
    return views.emails(spark, sf).where(L.label_from_number(F.col("label")).isin(0, 1)).select("id")


@query("flt_text", _MAIL + "SELECT id FROM emails WHERE " + D.strip("urls") + " <> ''")
def flt_text(spark, sf):
    return views.emails(spark, sf).where(T.has_text(F.col("urls"))).select("id")


@query("flt_class", _MAIL + f"SELECT id FROM emails WHERE {D.spelled_label('label')} = 1")
def flt_class(spark, sf):
    return views.emails(spark, sf).where(L.label_from_text(F.col("label")) == 1).select("id")
