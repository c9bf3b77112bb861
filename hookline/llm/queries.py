"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from . import (
    class_lm, collocations, decontamination, lz_fingerprint, mixing, pairwise_quality, periodic_runs, pii, resharding, simhash,
    suffix_dedup, toxicity, url_rules,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The rules that ``op8_url_rules`` applies: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_entropy_mix")
def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document and how many of them the mix of sources takes."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), Scratch(spark, "mix"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@_query("op2_lz_fingerprint")
def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every document and of its edited text, and how alike they are."""
    return lz_fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


@_query("op3_class_lm")
def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by class bigrams, beside that of an add-one unigram model."""
    return class_lm.score_held_out(_table(spark, sf_dir, "documents"), Scratch(spark, "class-lm"))


@_query("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the base spans, and all spans."""
    found = pii.find(_table(spark, sf_dir, "documents"), Scratch(spark, "pii"))
    return found.select(
        "doc_id", *[pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


@_query("op5_pairwise_quality")
def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document as learned from preference pairs of labelled ones."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return pairwise_quality.score_quality(docs, labels, Scratch(spark, "quality"))


@_query("op6_repeated_passages")
def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of documents, in words, that are passages of 50 words or more shared with another document."""
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"), Scratch(spark, "passages"), length=50)


@_query("op7_simhash_groups")
def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and the smallest id of its group of near copies."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


@_query(
    "op8_url_rules",
    """
    WITH parts AS (
      SELECT page_id,
        translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
      FROM pages),
    rules(rule_host, rule_path, action) AS (
      VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    fits AS (
      SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(action, length(rule_host || rule_path)) AS action
      FROM parts JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      GROUP BY page_id)
    SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
    FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id
    """,
)
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, the longest rule that fits and the verdict for the URL of every page."""
    listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES])
    rules = spark.range(1).select(F.inline(listed))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, rules, Scratch(spark, "urls")).select("page_id", "host", "path", "rule", "verdict")


@_query("op9_toxic_spans")
def op9_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document and the offending spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    tagger = toxicity.fit_tagger(docs, _table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))
    scored = toxicity.score_toxicity(docs, tagger)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "toxic_spans")


@_query("op10_template_leaks")
def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark window, how many they hold, and the smallest item hit."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.with_hits(docs, _table(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"))
    return found.where("hits > 0").select("doc_id", "hits", F.col("item").alias("item_id"))


@_query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of repeated words of every document, a tenth of which have one planted, and digests of all that was found."""
    docs = periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.with_runs(docs).drop("text")
    best = periodic_runs.longest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.lists(F.col("runs")), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


@_query("op12_flow_reshard")
def op12_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near equal bytes, grown from 12 that a hash of the text filled unevenly."""
    docs, scratch = _table(spark, sf_dir, "documents"), Scratch(spark, "reshard")
    by_text = F.pmod(F.crc32(F.coalesce(F.col("text"), F.lit(""))), F.lit(12))
    old = resharding.lay_out(docs, by_text, 12, f"{scratch.root}/old")
    new, _ = resharding.reshard(spark, old, 16, f"{scratch.root}/new", scratch)
    return resharding.with_slots(spark, new, scratch).select(
        "doc_id", resharding.size_of(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@_query(
    "op13_setm_collocations",
    r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
    places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
    totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
    counted AS (
      SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS n
      FROM places, range(1, 6) AS lengths(k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
    candidates AS (
      SELECT * FROM counted c WHERE k > 1 AND NOT EXISTS (
        SELECT 1 FROM counted o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.n >= 100 * c.n
          AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
    cuts AS (
      SELECT c.lang, c.phrase, c.n AS a, x.k AS cut, x.n AS l, y.n AS r, t.n,
        ((1000::HUGEINT * c.n * t.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
      FROM candidates c JOIN totals t ON t.lang = c.lang
        JOIN counted x ON x.lang = c.lang AND x.k < c.k AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1 : x.k], ' ')
        JOIN counted y ON y.lang = c.lang AND y.k = c.k - x.k AND y.phrase = array_to_string(string_split(c.phrase, ' ')[x.k + 1 :], ' ')),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best QUALIFY rank <= 2000
    """,
)
def op13_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of 2 to 5 words of each language that occur 100 times or more, by how much they hold together."""
    docs = _table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.collocations(docs, Scratch(spark, "collocations"))
