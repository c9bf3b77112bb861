"""Tables the queries run on, derived from the given ones in Spark and, with the same text, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

URLS = """
SELECT page_id AS url_id, url,
  CASE WHEN url LIKE '%spam-farm%' OR url LIKE '%cheap-pills%' OR url LIKE 'http://%ref=x%' THEN 1 ELSE 0 END AS label
FROM {pages}
"""

# No URL, one with trailing punctuation, two different ones, a repeated one; several spellings of the label.
EMAILS = """
SELECT d.doc_id AS id, concat('curated_', d.source) AS source,
  split_part(d.text, chr(10), 1) AS subject,
  concat('user', CAST(d.doc_id % 17 AS STRING), '@', d.source, '.example.com') AS sender,
  concat(d.text, CASE d.doc_id % 4 WHEN 0 THEN ''
     WHEN 1 THEN concat(' Visit ', p.url, '.')
     WHEN 2 THEN concat(' See (', p.url, '), ', q.url, '!')
     ELSE concat(' ', p.url, ' ', p.url) END) AS body,
  CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE concat('[''', p.url, ''', ''', q.url, ''', ''', p.url, ''']') END AS urls,
  CASE WHEN l.toxic IS NULL THEN 'unknown'
       WHEN l.toxic = 1 THEN CASE d.doc_id % 3 WHEN 0 THEN ' Phishing ' WHEN 1 THEN '1' ELSE 'MALICIOUS' END
       ELSE CASE d.doc_id % 3 WHEN 0 THEN 'ham' WHEN 1 THEN '0' ELSE 'Legit' END END AS label
FROM {documents} d
LEFT JOIN {labels} l ON l.doc_id = d.doc_id
LEFT JOIN {pages} p ON p.page_id = d.doc_id % (SELECT count(*) FROM {pages})
LEFT JOIN {pages} q ON q.page_id = (d.doc_id * 7 + 3) % (SELECT count(*) FROM {pages})
"""

# Mails whose URLs sit in a list literal.
LIST_MAILS = """
SELECT page_id AS id, concat('Page ', CAST(page_id AS STRING)) AS subject, html AS body,
  CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('[''', url, ''', ''', upper(substr(url, 1, 4)), substr(url, 5), ''']') END AS urls,
  CASE WHEN label = 1 THEN 'phish' ELSE 'Benign' END AS class
FROM (SELECT u.url_id AS page_id, u.url, u.label, p.html FROM ({urls}) u JOIN {pages} p ON p.page_id = u.url_id) x
"""

SHORT_TEXTS = """
SELECT conv_id * 1000000 + turn AS id, text AS message,
  CASE role WHEN 'user' THEN 'ham' WHEN 'assistant' THEN 'yes' ELSE 'maybe' END AS target,
  concat(' ', role, ' ') AS type
FROM {conversations}
"""

# The documents again, spaced differently and with the other label: copies that must lose.
COPIES = """
SELECT id, 'copies' AS source, concat('  ', replace(body, ' ', '  '), chr(10)) AS body,
  CASE label WHEN '1' THEN '0' WHEN '0' THEN '1' ELSE label END AS label
FROM ({emails}) e
"""

_DUCK = {"pages": "pages", "documents": "documents", "labels": "labels", "conversations": "conversations"}


def _as_duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


DUCK_URLS = _as_duck(URLS.format(**_DUCK))
DUCK_EMAILS = _as_duck(EMAILS.format(**_DUCK))
DUCK_LIST_MAILS = _as_duck(LIST_MAILS.format(urls=DUCK_URLS, **_DUCK))
DUCK_SHORT_TEXTS = _as_duck(SHORT_TEXTS.format(**_DUCK))
DUCK_COPIES = _as_duck(COPIES.format(emails=DUCK_EMAILS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, names: list[str], **frames: DataFrame) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in names}
    return spark.sql(sql, **tables, **frames)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, URLS, ["pages"])


# What ``EMAILS`` looks up for an id, found without the texts: these then move for one join instead of three.
_LOOKED_UP = """
SELECT i.doc_id, named_struct('toxic', l.toxic) AS l, named_struct('url', p.url) AS p, named_struct('url', q.url) AS q
FROM (SELECT DISTINCT doc_id FROM {documents}) i
""" + EMAILS.partition("FROM {documents} d\n")[2].replace("d.doc_id", "i.doc_id")


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked_up = _view(spark, sf_dir, _LOOKED_UP, ["documents", "labels", "pages"])
    sql = EMAILS.partition("FROM {documents} d\n")[0] + "FROM {documents} d LEFT JOIN {looked_up} x ON x.doc_id = d.doc_id"
    return _view(spark, sf_dir, sql, ["documents"], looked_up=looked_up)


def list_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = LIST_MAILS.replace("({urls})", "{urls}")
    return _view(spark, sf_dir, sql, ["pages"], urls=urls(spark, sf_dir))


def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SHORT_TEXTS, ["conversations"])


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COPIES.replace("({emails})", "{emails}"), emails=emails(spark, sf_dir))
