"""Sources, sinks, deduplication, sets, ids, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.text import text_hash
from ..functions.url_features import URL_FEATURES
from ..operators import splits as S
from ..operators.dedup import distinct_messages, distinct_text_label, duplicate_counts, label_conflicts
from ..operators.group_split import group_split
from ..operators.overlap import split_overlap
from ..plans import text_corpus as C
from ..plans import url_corpus as U
from ..plans.audits import audit_files
from ..session import scratch_path
from ..sources import columns, readers, writers
from . import duck as D
from . import views
from .registry import query
from .url_queries import REGDOMAIN_SQL, domains

_DATASET = D.ctes(*D.DATASET)
_SPLITS = D.ctes(*D.DATASET, "text_splits")
_URL_SPLITS = D.ctes("urls", "url_splits")


def text_parts(spark, sf):
    return [
        C.prepare_email(views.emails(spark, sf), "id", F.col("source")),
        C.prepare_list_mail(views.list_mails(spark, sf), "id"),
        C.prepare_short_text(views.short_texts(spark, sf), "id"),
    ]


def text_dataset(spark, sf):
    return C.build_text_dataset(text_parts(spark, sf), "id")


def text_splits(spark, sf):
    return C.split_text_dataset(text_dataset(spark, sf))


def url_splits(spark, sf):
    return S.stratified_split(views.urls(spark, sf), "80_10_10", key="url_id")


# Sources


def _mail_csv(spark, sf, name="mails"):
    """The e-mails as CSV files written by Spark, with untidy headers."""
    path = scratch_path(spark, name)
    df = views.emails(spark, sf)
    writers.write_table(df.toDF(*[f" {c.upper()} " for c in df.columns]), path, "csv")
    return path


@query("src_csv", D.ctes("emails") + "SELECT CAST(id AS VARCHAR) AS id, subject, body, label FROM emails")
def src_csv(spark, sf):
    return readers.read_csv(spark, _mail_csv(spark, sf)).select("id", "subject", "body", "label")


@query("src_csv_split", D.ctes("emails") + "SELECT CAST(id AS VARCHAR) AS id, subject, body, label, FALSE AS malformed FROM emails")
def src_csv_split(spark, sf):
    """The same rows from files cut into blocks, as large files are."""
    path = scratch_path(spark, "mails")
    writers.write_table(views.emails(spark, sf).select("id", "subject", "body", "label"), path, "csv")
    (table,) = readers.by_header(spark, [path], large=0)
    return table.select("id", "subject", "body", "label", F.col("_malformed").isNotNull().alias("malformed"))


def _curated_folder(spark, sf):
    """Three folders of CSV files with different columns; one to be skipped, one without a label."""
    base = scratch_path(spark, "curated")
    mails = views.emails(spark, sf)
    writers.write_table(mails.select("id", "subject", "body", "label"), f"{base}/first.csv", "csv")
    writers.write_table(mails.select("label", "sender", "id"), f"{base}/second.csv", "csv")
    writers.write_table(mails.select("id", "label"), f"{base}/third_Vectorized.csv", "csv")
    writers.write_table(mails.select("id", "body"), f"{base}/unlabelled.csv", "csv")
    return base, [f"{base}/{n}.csv" for n in ("first", "second", "third_Vectorized", "unlabelled", "missing")]


_MULTI = (
    D.ctes("emails") + "SELECT CAST(id AS VARCHAR) AS id, 'curated_first' AS source, body, NULL AS sender, label FROM emails "
    "UNION ALL SELECT CAST(id AS VARCHAR), 'curated_second', NULL, sender, label FROM emails"
)


@query("src_multi", _MULTI)
def src_multi(spark, sf):
    _, paths = _curated_folder(spark, sf)
    return readers.read_many(spark, paths).select("id", "source", "body", "sender", "label")


@query(
    "build_email_table",
    D.ctes("emails", "prepared") + """SELECT row_number() OVER (ORDER BY id) AS id, source, subject, body, text, label FROM (
      SELECT id, 'curated_mails' AS source, subject, body, text, label, row_number() OVER (PARTITION BY text, label ORDER BY id) AS rn FROM prepared)
    WHERE rn = 1""",
)
def build_email_table(spark, sf):
    """From CSV files to the prepared e-mail table: stacked, cleaned, one row for each text and label, numbered."""
    base = scratch_path(spark, "email-files")
    mails = views.emails(spark, sf).select("id", "subject", "sender", "body", "urls", "label")
    writers.write_table(mails, f"{base}/mails.csv", "csv")
    return C.prepare_email_files(spark, [f"{base}/mails.csv"]).select("id", "source", "subject", "body", "text", "label")


@query(
    "build_list_table",
    D.ctes("urls", "list_mails", "listed") + "SELECT row_number() OVER (ORDER BY id) AS id, source, text, label FROM listed",
)
def build_list_table(spark, sf):
    return C.distinct_numbered(text_parts(spark, sf)[1], "id").select("id", "source", "text", "label")


@query(
    "build_short_table",
    D.ctes("short_texts", "shorts") + "SELECT row_number() OVER (ORDER BY id) AS id, source, text, label FROM shorts",
)
def build_short_table(spark, sf):
    return C.distinct_numbered(text_parts(spark, sf)[2], "id").select("id", "source", "text", "label")


@query("src_prune", D.ctes("urls") + "SELECT url, label FROM urls")
def src_prune(spark, sf):
    return views.urls(spark, sf).select("url", "label")


@query(
    "src_guard",
    D.ctes("emails") + "SELECT unnest(['first', 'second', 'third_Vectorized', 'unlabelled', 'missing', 'broken']) AS file, "
    "unnest([n, n, n, 0, 0, 0]) AS usable_rows FROM (SELECT count(*) AS n FROM emails)",
)
def src_guard(spark, sf):
    """Usable rows of each file; none when it cannot be read, has no label column or holds a row with too many fields."""
    base, paths = _curated_folder(spark, sf)
    lines = views.emails(spark, sf).select(F.concat_ws(",", "id", F.lit("ham")).alias("line"))
    header, long = (spark.range(1).select(F.lit(x).alias("line")) for x in ("id,label", "0,ham,more,fields"))
    header.unionByName(lines).unionByName(long).coalesce(1).write.text(f"{base}/broken.csv")
    paths = [*paths, f"{base}/broken.csv"]
    counts = []
    for path in paths:
        df = readers.read_csv_or_none(spark, path)
        rows = spark.range(0) if df is None else df
        counts.append(rows.agg(F.lit(readers.file_stem(path)).alias("file"), F.count("*").alias("usable_rows")))
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("src_required", D.ctes("emails", "prepared") + "SELECT id, source, text, label FROM prepared")
def src_required(spark, sf):
    part = text_parts(spark, sf)[0]
    try:
        columns.require(part, ["id", "no_such_column"], "e-mail table")
    except ValueError:
        return columns.require(part, ["id", "source", "text", "label"], "e-mail table").select(
            "id", "source", "text", "label"
        )
    raise AssertionError("a missing column went unnoticed")


@query(
    "src_alias",
    D.ctes("urls", "list_mails", "short_texts") + "SELECT id, class AS label, NULL AS text, NULL AS kind FROM list_mails "
    "UNION ALL SELECT id, target, message, type FROM short_texts",
)
def src_alias(spark, sf):
    mails, shorts = views.list_mails(spark, sf), views.short_texts(spark, sf)
    a = mails.select("id", F.col(columns.first_in_table(mails, columns.ANY_LABEL)).alias("label"))
    b = shorts.select(
        "id",
        F.col(columns.first_by_priority(shorts, columns.LABEL_BY_PRIORITY)).alias("label"),
        F.col(columns.first_by_priority(shorts, columns.TEXT_BY_PRIORITY)).alias("text"),
        F.col(columns.first_by_priority(shorts, columns.SOURCE_BY_PRIORITY)).alias("kind"),
    )
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "src_optional",
    D.ctes("short_texts") + "SELECT id, '' AS subject, " + D.clean("message") + " AS raw_text, " + D.strip("type")
    + " AS source_type FROM short_texts",
)
def src_optional(spark, sf):
    shorts = views.short_texts(spark, sf)
    from ..functions.text import clean_text, strip_text

    return shorts.select(
        "id",
        columns.optional(shorts, "subject").alias("subject"),
        columns.optional(shorts, "raw_text", clean_text(F.col("message"))).alias("raw_text"),
        strip_text(columns.optional(shorts, "TYPE")).alias("source_type"),
    )


@query(
    "src_audit",
    D.ctes("emails") + """SELECT 'first' AS file, count(*) AS n_rows, 4::BIGINT AS n_columns, 'id,subject,body,label' AS column_names,
      CAST(count(*) FILTER (WHERE subject = '') + count(*) FILTER (WHERE body = '') AS BIGINT) AS n_null FROM emails
    UNION ALL SELECT 'second', count(*), 3, 'label,sender,id', 0 FROM emails
    UNION ALL SELECT 'third_Vectorized', count(*), 2, 'id,label', 0 FROM emails
    UNION ALL SELECT 'unlabelled', count(*), 2, 'id,body', CAST(count(*) FILTER (WHERE body = '') AS BIGINT) FROM emails""",
)
def src_audit(spark, sf):
    """Shape and missing values of every file below the raw folder."""
    base, paths = _curated_folder(spark, sf)
    return audit_files(spark, sorted({p.rsplit("/", 1)[0] for p in readers.list_files(spark, base, "*.csv", recursive=True)}))


@query(
    "src_request",
    D.ctes("emails") + f"SELECT id, {D.message('subject', chr(39) * 2, 'body')} AS message FROM emails",
)
def src_request(spark, sf):
    from ..plans.scoring import as_messages

    return as_messages(views.emails(spark, sf).drop("sender"), "id").select("id", "message")


# Sinks: what was written is read back


@query("snk_table", D.ctes("emails", "prepared") + "SELECT id, source, text, label FROM prepared")
def snk_table(spark, sf):
    path = scratch_path(spark, "table")
    writers.write_table(text_parts(spark, sf)[0].select("id", "source", "text", "label"), path)
    return spark.read.parquet(path)


@query("snk_splits", _SPLITS + "SELECT * FROM text_splits")
def snk_splits(spark, sf):
    path = scratch_path(spark, "splits")
    writers.write_splits(text_splits(spark, sf), path)
    return spark.read.parquet(path)


# Deduplication and sets


@query(
    "dd_text_label",
    D.ctes("emails", "copies") + "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang",
)
def dd_text_label(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return distinct_text_label(docs, ["doc_id"], label="lang")


def _repeated_urls(spark, sf):
    """Every URL of every e-mail with the label of its sender's mail: URLs repeat, also with another label."""
    mails = views.emails(spark, sf)
    from ..functions.labels import label_from_text
    from ..functions.urls import extract_urls

    return mails.select(
        "id", label_from_text(F.col("label")).alias("label"),
        F.posexplode(extract_urls(F.col("body"), "live")).alias("pos", "URL"),
    ).select((F.col("id") * 10 + F.col("pos")).alias("key"), "URL", "label")


_REPEATED = (
    "repeated AS (SELECT id * 10 + p - 1 AS key, u AS url, label FROM (SELECT id, label, unnest(f) AS u, "
    f"generate_subscripts(f, 1) AS p FROM (SELECT id, {D.spelled_label('label')} AS label, {D.urls_in('body')} AS f FROM emails)))\n"
)


@query(
    "dd_url_label",
    D.ctes("emails").rstrip() + ", " + _REPEATED
    + 'SELECT min(key) AS key, url AS "URL", label FROM repeated WHERE label IS NOT NULL GROUP BY url, label',
)
def dd_url_label(spark, sf):
    return U.distinct_urls(_repeated_urls(spark, sf), "key")


def _with_copies(spark, sf):
    docs = views.emails(spark, sf).select("id", "source", F.col("body").alias("text"), "label")
    copies = views.copies(spark, sf).select("id", "source", F.col("body").alias("text"), "label")
    return docs.select(F.lit(0).alias("priority"), "*").unionByName(copies.select(F.lit(1).alias("priority"), "*"))


_WITH_COPIES = (
    D.ctes("emails", "copies").rstrip() + ", both_sources AS (SELECT 0 AS priority, id, source, body AS text, label FROM emails "
    "UNION ALL SELECT 1, id, source, body, label FROM copies)\n"
)


@query(
    "dd_hash_first",
    _WITH_COPIES + "SELECT priority, id, source, text, label FROM (SELECT *, row_number() OVER (PARTITION BY "
    + D.text_hash("text") + " ORDER BY priority, id) AS rn FROM both_sources) WHERE rn = 1",
)
def dd_hash_first(spark, sf):
    return distinct_messages(_with_copies(spark, sf), ["priority", "id"])


@query(
    "dd_removed",
    _WITH_COPIES + "SELECT count(*) AS rows, count(DISTINCT h) AS distinct_rows, count(*) - count(DISTINCT h) AS duplicate_rows "
    f"FROM (SELECT {D.text_hash('text')} AS h FROM both_sources)",
)
def dd_removed(spark, sf):
    return duplicate_counts(_with_copies(spark, sf), [text_hash(F.col("text"))])


@query(
    "dd_count",
    _WITH_COPIES + "SELECT source, count(*) AS rows, count(DISTINCT h) AS distinct_rows, count(*) - count(DISTINCT h) AS "
    f"duplicate_rows FROM (SELECT source, {D.text_hash('text')} AS h FROM both_sources) GROUP BY source",
)
def dd_count(spark, sf):
    return duplicate_counts(_with_copies(spark, sf), [text_hash(F.col("text"))], by=["source"])


@query(
    "dd_count_rows",
    D.ctes("urls", "canon", "parts", "features", "url_splits") + "SELECT split, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, "
    "CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows FROM (SELECT s.split, f.* EXCLUDE (url_id), count(*) AS n "
    "FROM features f JOIN url_splits s USING (url_id) GROUP BY ALL) GROUP BY split",
)
def dd_count_rows(spark, sf):
    rows = S.stratified_split(U.url_feature_table(views.urls(spark, sf), "url_id"), "80_10_10", key="url_id")
    return duplicate_counts(rows, [F.col(c) for c in [*URL_FEATURES, "label"]], by=["split"])


@query("set_union", D.ctes(*D.DATASET[:7]) + "SELECT priority, id, source, text, label FROM stacked")
def set_union(spark, sf):
    return C.stack_sources(text_parts(spark, sf), "id")


_PAIRS = """SELECT a AS "left", b AS "right", n AS shared, CASE WHEN n = 0 THEN 'PASS' ELSE 'WARNING' END AS status FROM (
  SELECT 'train' AS a, 'val' AS b, (SELECT count(*) FROM (SELECT k FROM t WHERE split = 'train' INTERSECT SELECT k FROM t WHERE split = 'val')) AS n
  UNION ALL SELECT 'train', 'test', (SELECT count(*) FROM (SELECT k FROM t WHERE split = 'train' INTERSECT SELECT k FROM t WHERE split = 'test'))
  UNION ALL SELECT 'val', 'test', (SELECT count(*) FROM (SELECT k FROM t WHERE split = 'val' INTERSECT SELECT k FROM t WHERE split = 'test')))"""


@query(
    "set_overlap_hash",
    D.ctes("docs", "doc_splits").rstrip() + f", t AS (SELECT split, {D.text_hash('text')} AS k FROM doc_splits)\n" + _PAIRS,
)
def set_overlap_hash(spark, sf):
    """Documents are split before copies are removed, so there is overlap to find."""
    return split_overlap(_document_splits(spark, sf), text_hash(F.col("text")))


def _document_splits(spark, sf):
    docs = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels"), "doc_id")
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("toxic").alias("label"))
    return S.stratified_split(rows, "70_15_15")


@query("set_overlap_id", _SPLITS.rstrip() + ", t AS (SELECT split, id AS k FROM text_splits)\n" + _PAIRS)
def set_overlap_id(spark, sf):
    return split_overlap(text_splits(spark, sf), F.col("id"))


@query(
    "set_overlap_domain",
    _URL_SPLITS.rstrip() + f", groups AS ({REGDOMAIN_SQL}), t AS (SELECT split, domain_group AS k FROM url_splits "
    "JOIN groups USING (url_id))\n" + _PAIRS,
)
def set_overlap_domain(spark, sf):
    """The label-stratified split, which does not look at domains: they overlap."""
    rows = S.stratified_split(domains(spark, sf), "80_10_10", key="url_id")
    return split_overlap(rows, F.col("domain_group"))


@query("jn_label", D.ctes("urls", "canon", "parts", "features") + "SELECT * FROM features")
def jn_label(spark, sf):
    return U.url_feature_table(views.urls(spark, sf), "url_id")


# Ids, splits, samples


@query("win_seq_id", _DATASET + "SELECT * FROM dataset")
def win_seq_id(spark, sf):
    return text_dataset(spark, sf)


@query("spl_70_15_15", _SPLITS + "SELECT id, label, split FROM text_splits")
def spl_70_15_15(spark, sf):
    return text_splits(spark, sf).select("id", "label", "split")


@query("spl_80_10_10", _URL_SPLITS + "SELECT url_id, label, split FROM url_splits")
def spl_80_10_10(spark, sf):
    return url_splits(spark, sf).select("url_id", "label", "split")


@query("spl_70_10_20", "WITH urls AS (" + views.DUCK_URLS + ") SELECT url_id, label, split FROM (" + D.ranked_split("urls", "70_10_20", "url_id") + ")")
def spl_70_10_20(spark, sf):
    return S.stratified_split(views.urls(spark, sf), "70_10_20", key="url_id").select("url_id", "label", "split")


@query("spl_group", D.grouped_split(f"urls AS ({views.DUCK_URLS})", REGDOMAIN_SQL, "url_id"))
def spl_group(spark, sf):
    return group_split(domains(spark, sf), "domain_group", key="url_id").select("url_id", "domain_group", "label", "split")


@query(
    "spl_sample_class",
    D.ctes("emails", "prepared") + """SELECT id, label, CAST(row_number() OVER (ORDER BY h) AS INTEGER) AS position FROM (
      SELECT id, label, h, row_number() OVER (PARTITION BY label ORDER BY h) AS rn FROM (
        SELECT id, label, sha256('1111122222:' || id) AS h FROM prepared)) WHERE rn <= 10""",
)
def spl_sample_class(spark, sf):
    return S.sample_per_class(text_parts(spark, sf)[0].select("id", "label"))


@query(
    "build_url_dataset",
    D.ctes("urls", "canon", "parts", "features") + 'SELECT row_number() OVER (ORDER BY url_id) AS id, \'PhiUSIIL\' AS source, u.url AS "URL", '
    "p.d AS \"Domain\", CAST(f.\"URLLength\" AS DOUBLE) AS \"URLLength\", CAST(0 AS DOUBLE) AS \"DegitRatioInURL\", 1 - u.label AS label "
    "FROM urls u JOIN parts p USING (url_id) JOIN features f USING (url_id)",
)
def build_url_dataset(spark, sf):
    """Raw URL table with text numerics, one of them unreadable, and inverted labels."""
    from ..functions.urls import canonical_url, url_domain

    table = U.url_feature_table(views.urls(spark, sf), "url_id")
    raw = views.urls(spark, sf).select("url_id", F.col("url").alias("URL")).join(table, "url_id").select(
        "url_id", "URL", url_domain(canonical_url(F.col("URL"))).alias("Domain"),
        *[F.col(c).cast("string").alias(c) for c in URL_FEATURES], F.lit("n/a").alias("DegitRatioInURL"), "label",
    )
    return U.prepare_url_dataset(raw, "url_id").select(
        "id", "source", "URL", "Domain", "URLLength", "DegitRatioInURL", "label"
    )


_VECTORS = D.ctes("urls", "canon", "parts", "features")
_VECTOR_GROUPS = (
    "(SELECT count(*) AS n, count(DISTINCT label) AS labels FROM features GROUP BY "
    + ", ".join(f'"{c}"' for c in URL_FEATURES) + ")"
)


@query(
    "agg_vec_dups",
    _VECTORS + "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, "
    f"CAST(count(*) AS DOUBLE) / sum(n) AS unique_ratio, CAST(count(*) AS DOUBLE) / sum(n) * 100 AS unique_pct FROM {_VECTOR_GROUPS}",
)
def agg_vec_dups(spark, sf):
    return label_conflicts(U.url_feature_table(views.urls(spark, sf), "url_id"), URL_FEATURES).drop("conflicting_keys")


@query("agg_vec_conflicts", _VECTORS + f"SELECT count(*) FILTER (WHERE labels > 1) AS conflicting_keys FROM {_VECTOR_GROUPS}")
def agg_vec_conflicts(spark, sf):
    return label_conflicts(U.url_feature_table(views.urls(spark, sf), "url_id"), URL_FEATURES).select("conflicting_keys")


_REP = D.ctes("emails").rstrip() + ", " + _REPEATED


@query(
    "agg_distinct_urls",
    _REP + "SELECT count(*) AS rows, count(DISTINCT url) AS distinct_rows, count(*) - count(DISTINCT url) AS duplicate_rows FROM repeated",
)
def agg_distinct_urls(spark, sf):
    from ..operators.profile import distinct_count

    return distinct_count(_repeated_urls(spark, sf), "URL")


@query(
    "agg_url_conflicts",
    _REP + "SELECT count(*) FILTER (WHERE n > 1) AS conflicting_keys FROM (SELECT count(DISTINCT label) AS n FROM repeated GROUP BY url)",
)
def agg_url_conflicts(spark, sf):
    return label_conflicts(_repeated_urls(spark, sf), ["URL"]).select("conflicting_keys")
