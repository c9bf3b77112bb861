"""URL extraction, URL parts, URL features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import message_text
from ..functions.url_features import URL_FEATURES, with_url_features
from ..functions.urls import canonical_url, extract_urls, url_domain
from ..operators.domains import with_registered_domain
from ..operators.scores import explode_urls, url_totals
from ..plans.url_corpus import url_feature_table
from . import duck as D
from . import views
from .registry import query

# The test pages live under three names; each counts as a public suffix, so that there are many domains.
TEST_SUFFIXES = ["com", "net", "org", "example.com", "example.net", "example.org"]
_MESSAGE_SQL = D.message("subject", "sender", "body")
_LINES = "array_to_string({}, chr(10))"


def with_urls(spark, sf):
    message = message_text(F.col("subject"), F.col("sender"), F.col("body"))
    return views.emails(spark, sf).withColumn("urls", extract_urls(message, "live"))


def _listed(mode: str, x: str, source: str) -> str:
    """First-seen distinct URLs of each row as one text."""
    found = D.urls_in(x, mode)
    return f"""SELECT r.id, coalesce(string_agg(f.u, chr(10) ORDER BY f.p), '') AS urls, count(f.u) AS n
      FROM {source} r LEFT JOIN (SELECT id, u, min(p) AS p FROM (SELECT id, unnest(found) AS u, generate_subscripts(found, 1) AS p
        FROM (SELECT id, {found} AS found FROM {source})) WHERE u <> '' GROUP BY id, u) f ON f.id = r.id GROUP BY r.id"""


def _lines(df):
    return df.select("id", F.array_join("urls", "\n").alias("urls"), F.size("urls").cast("bigint").alias("n"))


@query(
    "url_extract_live",
    D.ctes("emails") + f"SELECT id, {_LINES.format('f')} AS urls, CAST(len(f) AS BIGINT) AS n "
    f"FROM (SELECT id, {D.urls_in(_MESSAGE_SQL)} AS f FROM emails)",
)
def url_extract_live(spark, sf):
    return _lines(with_urls(spark, sf))


@query("url_extract_list", D.ctes("urls", "list_mails") + _listed("list", "urls", "list_mails"))
def url_extract_list(spark, sf):
    return _lines(views.list_mails(spark, sf).withColumn("urls", extract_urls(F.col("urls"), "list")))


@query("url_extract_text", D.ctes("emails") + _listed("text", "body", "emails"))
def url_extract_text(spark, sf):
    return _lines(views.emails(spark, sf).withColumn("urls", extract_urls(F.col("body"), "text")))


@query(
    "url_extract_test",
    D.ctes("emails") + f"SELECT id, {_LINES.format('f')} AS urls, CAST(len(f) AS BIGINT) AS n "
    f"FROM (SELECT id, {D.urls_in('body', 'test')} AS f FROM emails)",
)
def url_extract_test(spark, sf):
    return _lines(views.emails(spark, sf).withColumn("urls", extract_urls(F.col("body"), "test")))


@query(
    "url_count",
    D.ctes("emails") + "SELECT count(*) AS emails, count(*) FILTER (WHERE n > 0) AS emails_with_urls, CAST(sum(n) AS BIGINT) AS total_urls "
    f"FROM (SELECT len({D.urls_in(_MESSAGE_SQL)}) AS n FROM emails)",
)
def url_count(spark, sf):
    return url_totals(with_urls(spark, sf))


@query(
    "url_explode",
    D.ctes("emails") + f"""SELECT r.id, CAST(x.p - 1 AS INTEGER) AS pos, x.u AS url FROM emails r LEFT JOIN (
      SELECT id, unnest(f) AS u, generate_subscripts(f, 1) AS p FROM (SELECT id, {D.urls_in(_MESSAGE_SQL)} AS f FROM emails)
    ) x ON x.id = r.id""",
)
def url_explode(spark, sf):
    return explode_urls(with_urls(spark, sf))


@query("url_canon", D.ctes("urls", "canon") + "SELECT url_id, u AS url FROM canon")
def url_canon(spark, sf):
    return views.urls(spark, sf).select("url_id", canonical_url(F.col("url")).alias("url"))


@query("url_domain", D.ctes("urls", "canon", "parts") + "SELECT url_id, d AS domain FROM parts")
def url_domain_query(spark, sf):
    return views.urls(spark, sf).select("url_id", url_domain(canonical_url(F.col("url"))).alias("domain"))


REGDOMAIN_SQL = (
    "SELECT url_id, url, label, CASE WHEN len(l) > 2 AND l[-2] = 'example' AND l[-1] IN ('com', 'net', 'org') "
    "THEN l[-3] || '.' || l[-2] || '.' || l[-1] "
    "WHEN len(l) = 2 AND l[-2] = 'example' AND l[-1] IN ('com', 'net', 'org') THEN '' "
    "WHEN len(l) >= 2 AND l[-1] IN ('com', 'net', 'org') THEN l[-2] || '.' || l[-1] "
    "WHEN len(l) = 1 AND l[-1] IN ('com', 'net', 'org') THEN '' ELSE l[-1] END AS domain_group "
    "FROM (SELECT url_id, url, label, string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.') AS l FROM urls)"
)


def domains(spark, sf):
    return with_registered_domain(views.urls(spark, sf), TEST_SUFFIXES)


@query("url_regdomain", D.ctes("urls") + f"SELECT url_id, domain_group FROM ({REGDOMAIN_SQL})")
def url_regdomain(spark, sf):
    return domains(spark, sf).select("url_id", "domain_group")


@query("url_features_table", D.ctes("urls", "canon", "parts", "features") + "SELECT * FROM features")
def url_features_table(spark, sf):
    return url_feature_table(views.urls(spark, sf), "url_id")


@query(
    "url_features_alt",
    D.ctes("urls") + f"SELECT url_id, {D.feature_list(D.SIMPLE_FEATURES)} FROM "
    f"(SELECT url_id, url AS u, lower(url) AS w, {D._RAW_HOST.replace('(u,', '(url,')} AS d FROM urls)",
)
def url_features_alt(spark, sf):
    return with_url_features(views.urls(spark, sf), "url", simplified=True).select("url_id", *URL_FEATURES)


def _register_feature(number: int, name: str) -> None:
    sql = D.ctes("urls", "canon", "parts") + f'SELECT url_id, {D.FEATURES[name]} AS "{name}" FROM parts'

    @query(f"f{number:02d}", sql)
    def feature(spark, sf):
        return with_url_features(views.urls(spark, sf)).select("url_id", name)


for _i, _name in enumerate(URL_FEATURES, start=1):
    _register_feature(_i, _name)
