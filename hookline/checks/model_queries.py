"""TF-IDF, SVD, models, scoring, streaming."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.url_features import URL_FEATURES
from ..operators import fusion_model as FM
from ..operators import metrics as M
from ..operators import svd as SV
from ..operators import text_model as TM
from ..operators import tfidf as TF
from ..operators import url_model as UM
from ..operators.given_models import TreeEnsemble, WordWeights
from ..operators.selection import select_best
from ..operators.splits import stratified_split
from ..plans import scoring as SC
from ..plans import training as T
from ..plans import url_corpus as U
from ..session import materialize, scratch_path
from ..sources import writers
from ..streaming import jobs
from . import duck as D
from . import views
from .corpus_queries import text_parts, text_splits, url_splits
from .profile_queries import fused
from .registry import ORACLES, query

_FITTED: dict[tuple, object] = {}


def _fitted(spark, sf, name, make):
    """Models are fitted once per session and data folder and shared by the queries."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _train_urls(spark, sf):
    return url_splits(spark, sf).where(F.col("split") == "train").drop("split")


def _feature_splits(spark, sf):
    return _fitted(spark, sf, "feature_splits", lambda: materialize(_split_features(spark, sf), "feature-splits"))


def _split_features(spark, sf):
    return stratified_split(U.url_feature_table(views.urls(spark, sf), "url_id"), "70_10_20", key="url_id")


def _url_model(spark, sf):
    train = _feature_splits(spark, sf).where(F.col("split") == "train")
    return _fitted(spark, sf, "url", lambda: UM.fit_url_model(train))


def _tfidf(spark, sf):
    return _fitted(spark, sf, "tfidf", lambda: TF.fit_tfidf(_train_urls(spark, sf), "url_id", "url"))


def _svd(spark, sf):
    model = _tfidf(spark, sf)
    return _fitted(
        spark, sf, "svd",
        lambda: SV.fit_svd(model, model.weights(_train_urls(spark, sf), "url_id", "url")),
    )


def _url_plus(spark, sf):
    return _fitted(
        spark, sf, "url_plus",
        lambda: UM.fit_url_plus_model(_train_urls(spark, sf), "url_id"),
    )


def _text_rows(spark, sf):
    return _fitted(spark, sf, "text_rows", lambda: materialize(text_splits(spark, sf), "text-splits"))


def _text_counts(spark, sf):
    train = _text_rows(spark, sf).where(F.col("split") == "train")
    return _fitted(spark, sf, "text_counts", lambda: TM.count_words(train))


def _text_model(spark, sf):
    train = _text_rows(spark, sf).where(F.col("split") == "train")
    return _fitted(spark, sf, "text", lambda: TM.fit_text_model(train, counted=_text_counts(spark, sf)))


def _email_models(spark, sf):
    return SC.EmailModels(_text_model(spark, sf), _url_model(spark, sf))


def _multimodal(spark, sf):
    return _fitted(
        spark, sf, "multimodal",
        lambda: materialize(
            SC.score_splits(_text_rows(spark, sf), _text_model(spark, sf), _url_plus(spark, sf)), "multimodal"
        ),
    )


def _fusion_model(spark, sf):
    """Fitted on the text model's validation rows, which the text model has not seen."""
    rows = _multimodal(spark, sf).where(F.col("split") == "val")
    return _fitted(spark, sf, "fusion", lambda: FM.fit_fusion_model(rows))


# TF-IDF

_GRAMS = """grams AS (SELECT url_id, g AS gram, count(*) AS tf FROM (
  SELECT url_id, unnest(list_concat(list_concat(
      list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3)),
      list_transform(range(1, len(t) - 2), lambda i: substr(t, i, 4))),
      list_transform(range(1, len(t) - 3), lambda i: substr(t, i, 5)))) AS g
  FROM (SELECT url_id, regexp_replace(lower(url), '[\\s\\x0B\\x{1c}-\\x{1f}\\x{85}\\p{Z}]{2,}', ' ', 'g') AS t FROM urls))
  GROUP BY url_id, g)"""
_VOCABULARY = (
    ", train AS (SELECT url_id FROM url_splits WHERE split = 'train'), " + _GRAMS
    + f""", vocabulary AS (SELECT *, row_number() OVER (ORDER BY gram) - 1 AS idx,
    ln((1.0::DOUBLE + (SELECT count(*) FROM train)) / (1.0::DOUBLE + df)) + 1 AS idf FROM (
      SELECT gram, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM grams JOIN train USING (url_id) GROUP BY gram
      HAVING count(*) >= 3 ORDER BY tf DESC, gram LIMIT {TF.MAX_FEATURES}))\n"""
)
_WITH_VOCABULARY = D.ctes("urls", "url_splits").rstrip() + _VOCABULARY


@query("tfidf_fit", _WITH_VOCABULARY + "SELECT gram, CAST(idx AS INTEGER) AS idx, tf, df, round(idf, 9) AS idf FROM vocabulary")
def tfidf_fit(spark, sf):
    return _tfidf(spark, sf).vocabulary.withColumn("idf", F.round("idf", 9))


@query(
    "tfidf_transform",
    _WITH_VOCABULARY + """SELECT url_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY url_id)), 9) AS weight FROM (
      SELECT url_id, gram, (ln(CAST(g.tf AS DOUBLE)) + 1) * idf AS w FROM grams g JOIN vocabulary USING (gram))""",
)
def tfidf_transform(spark, sf):
    cells = _tfidf(spark, sf).long_form(views.urls(spark, sf), "url_id", "url")
    return cells.withColumn("weight", F.round("weight", 9))


@query(
    "tfidf_stats",
    _WITH_VOCABULARY + "SELECT (SELECT count(*) FROM vocabulary) AS vocabulary_size, (SELECT count(*) FROM urls) AS n_rows, "
    "(SELECT count(*) FROM grams JOIN vocabulary USING (gram)) AS non_zeros",
)
def tfidf_stats(spark, sf):
    model = _tfidf(spark, sf)
    return TF.tfidf_stats(model, model.weights(views.urls(spark, sf), "url_id", "url"))


# SVD and vectors


_COMPONENTS = f"least({SV.N_COMPONENTS}, (SELECT count(*) FROM vocabulary))"


@query(
    "svd_fit",
    _WITH_VOCABULARY + f"SELECT unnest(range({_COMPONENTS})) AS component, TRUE AS descending, TRUE AS solves, TRUE AS orthogonal, "
    "TRUE AS within_total",
)
def svd_fit(spark, sf):
    """Each singular value with what makes it one: order, orthogonality, the sum of squares, and A'A v = s^2 v.

    The residual is held against the own s^2 of the component: within 1e-3 for the first quarter, 0.25 for all; values
    that are 0 but for rounding against the largest.
    """
    model = _svd(spark, sf)
    rows = _tfidf(spark, sf).weights(_train_urls(spark, sf), "url_id", "url")
    squares = model.singular_values**2
    residual, apart = SV.pair_errors(model, rows)
    bound = [max((1e-3 if i < len(squares) / 4 else 0.25) * s, 1e-9 * squares[0]) for i, s in enumerate(squares)]
    within = bool(squares.sum() <= rows.count() + 1e-6)
    table = [
        (i, bool(i == 0 or squares[i] <= squares[i - 1] + 1e-9), bool(residual[i] <= bound[i]), bool(apart[i] < 1e-8), within)
        for i in range(len(squares))
    ]
    return spark.createDataFrame(table, "component bigint, descending boolean, solves boolean, orthogonal boolean, within_total boolean")


@query("svd_transform", _WITH_VOCABULARY + f"SELECT url_id, {_COMPONENTS} AS components, TRUE AS within_length FROM urls")
def svd_transform(spark, sf):
    """A projection has as many numbers as components and is never longer than its row, whose length is 1."""
    weights = _tfidf(spark, sf).weights(views.urls(spark, sf), "url_id", "url")
    square = F.aggregate("svd", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return _svd(spark, sf).transform(weights).select("url_id", F.size("svd").cast("bigint").alias("components"), (square <= 1 + 1e-4).alias("within_length"))


@query("svd_explained", _WITH_VOCABULARY + "SELECT TRUE AS a_share, (SELECT count(*) FROM train) AS n_rows")
def svd_explained(spark, sf):
    weights = materialize(_tfidf(spark, sf).weights(_train_urls(spark, sf), "url_id", "url"), "weights")
    share = F.col("explained_variance_ratio").between(0.5, 1 + 1e-6).alias("a_share")
    return SV.explained_variance(weights, _svd(spark, sf).transform(weights)).select(share, F.lit(weights.count()).alias("n_rows"))


@query(
    "jn_hstack",
    (_WITH_VOCABULARY + ", " + D.ctes("canon", "parts", "features")[5:]).rstrip()
    + f""" SELECT url_id, f.label, 25 + {_COMPONENTS} AS n_features, TRUE AS svd_within_length,
      round({' + '.join(f'{i + 1} * CAST("{c}" AS DOUBLE)' for i, c in enumerate(URL_FEATURES))}, 6) AS lexical_sum FROM features f""",
)
def jn_hstack(spark, sf):
    """The joined vector: its size, the lexical cells by a sum that weighs each place, and the length of the rest."""
    rows = UM.plus_features(views.urls(spark, sf), _tfidf(spark, sf), _svd(spark, sf), "url_id", keep=["label"])
    cells = rows.select("url_id", "label", vector_to_array("features").alias("x"))
    square = F.aggregate(F.slice("x", 26, 1 << 20), F.lit(0.0), lambda a, x: a + x * x)
    lexical = sum((F.col("x")[i] * (i + 1) for i in range(25)), F.lit(0.0))
    return cells.select(
        "url_id", "label", F.size("x").cast("bigint").alias("n_features"), (square <= 1 + 1e-4).alias("svd_within_length"),
        F.round(lexical, 6).alias("lexical_sum"),
    )


_FEATURE_ROWS = ", ".join(f'CAST("{c}" AS DOUBLE)' for c in URL_FEATURES)


@query(
    "vec_assemble",
    D.ctes("urls", "canon", "parts", "features")
    + f"SELECT url_id, unnest(range(25)) AS pos, unnest([{_FEATURE_ROWS}]) AS value FROM features",
)
def vec_assemble(spark, sf):
    """The vectors as (url_id, pos, value)."""
    table = U.url_feature_table(views.urls(spark, sf), "url_id")
    cells = F.posexplode(vector_to_array("features")).alias("pos", "value")
    return UM.assemble(table).select("url_id", cells).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "vec_scale",
    D.ctes("emails", "scored") + "SELECT id, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 8) AS {c}" for c in FM.FUSION_FEATURES
    ) + " FROM scored",
)
def vec_scale(spark, sf):
    rows = fused(spark, sf).select("id", *FM.FUSION_FEATURES)
    scaled = Pipeline(stages=FM.scaling_stages(rows.count())).fit(rows).transform(rows)
    values = vector_to_array("features")
    return scaled.select("id", *[F.round(values[i], 8).alias(c) for i, c in enumerate(FM.FUSION_FEATURES)])


@query(
    "snk_matrix",
    _WITH_VOCABULARY + f""", cells AS (SELECT url_id, count(*) AS non_zeros, sum(idx) AS places FROM grams JOIN vocabulary USING (gram) GROUP BY url_id)
    SELECT url_id, {_COMPONENTS} AS components, label, coalesce(non_zeros, 0) AS non_zeros, CAST(coalesce(places, 0) AS BIGINT) AS places,
      CASE WHEN non_zeros > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM urls LEFT JOIN cells USING (url_id)""",
)
def snk_matrix(spark, sf):
    """What the saved matrix holds when it is read again: places and length of the sparse rows, size of the dense ones."""
    path = scratch_path(spark, "matrix")
    model = _tfidf(spark, sf)
    weights = model.weights(views.urls(spark, sf), "url_id", "url")
    dense = _svd(spark, sf).transform(model.vectors(weights)).join(views.urls(spark, sf).select("url_id", "label"), "url_id")
    writers.write_matrix(dense.select("url_id", "tfidf", "svd", "label"), path)
    vector = F.unwrap_udt("tfidf")  # its cells as saved, not a number for each term of the vocabulary
    cells = spark.read.parquet(path).withColumn("x", F.filter(
        F.arrays_zip(vector["indices"].alias("i"), vector["values"].alias("v")), lambda c: c["v"] != 0
    ))
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c["v"] * c["v"])
    return cells.select(
        "url_id", F.size("svd").cast("bigint").alias("components"), "label", F.size("x").cast("bigint").alias("non_zeros"),
        F.aggregate("x", F.lit(0).cast("bigint"), lambda a, c: a + c["i"]).alias("places"), F.round(F.sqrt(square), 6).alias("length"),
    )


# Models


_FEW_URLS, _FEW_TEXTS = 20, 100  # below so many test rows, or with one class only, no quality is asserted


def _verified(scored, probability="probability", by_accuracy=True, few=_FEW_URLS):
    """Rows and positives that the metrics saw, and whether they beat naming the larger class every time: the scores must
    order the classes and, unless the classes overlap too much for it, the accuracy exceed the larger one's share. Null
    where the rows are too few or of one class, for which no order is defined."""
    m = M.evaluate_scores(scored, probability=probability)
    positives = F.col("confusion_matrix")[1][0] + F.col("confusion_matrix")[1][1]
    larger = F.greatest(positives, F.col("samples") - positives) / F.col("samples")
    better = (F.col("roc_auc") > 0.5) & (F.lit(not by_accuracy) | (F.col("accuracy") >= larger))
    enough = (F.col("samples") >= few) & (larger < 1)
    return m.select(F.col("samples").alias("n"), positives.alias("positives"), F.when(enough, better).alias("better"))


def _held(table, where="split = 'test'", few=_FEW_URLS):
    return (
        f"SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives, "
        f"CASE WHEN count(*) >= {few} AND count(DISTINCT label) = 2 THEN TRUE END AS better FROM {table} WHERE {where}"
    )


_URL_PARTS = D.ctes("urls") + ", feature_splits AS (" + D.ranked_split("urls", "70_10_20", "url_id") + ")\n"
_URL_SPLITS = D.ctes("urls", "url_splits")
_TEXTS = D.ctes(*D.DATASET, "text_splits")


@query("mdl_url", _URL_PARTS + _held("feature_splits"))
def mdl_url(spark, sf):
    test = _feature_splits(spark, sf).where(F.col("split") == "test")
    return _verified(UM.probability_of_phishing(_url_model(spark, sf).transform(UM.finite_features(test))))


@query("mdl_url_plus", _URL_SPLITS + _held("url_splits"))
def mdl_url_plus(spark, sf):
    test = url_splits(spark, sf).where(F.col("split") == "test")
    return _verified(_url_plus(spark, sf).score(test, "url_id", keep=["label"]))


@query("mdl_learning_curve", f"SELECT CAST(unnest(range(1, {UM.TREES + 1})) AS INTEGER) AS round, TRUE AS falling, TRUE AS positive")
def mdl_learning_curve(spark, sf):
    rows = _feature_splits(spark, sf)
    curve = UM.learning_curve(_url_model(spark, sf), rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val"))
    before = F.lag("train_log_loss").over(Window.orderBy("round"))
    return curve.select(
        "round", F.coalesce(F.col("train_log_loss") <= before + 1e-3, F.lit(True)).alias("falling"),
        ((F.col("train_log_loss") > 0) & (F.col("val_log_loss") > 0)).alias("positive"),
    )


_NAMES = ", ".join(f"'{c}'" for c in URL_FEATURES)


@query("mdl_importance", f"SELECT unnest([{_NAMES}]) AS feature, TRUE AS a_share, TRUE AS whole, TRUE AS unused_is_zero")
def mdl_importance(spark, sf):
    """The shares of all features sum to 1; a feature that never varies has none."""
    table = UM.feature_importance(_url_model(spark, sf), spark)
    total = table.agg(F.sum("importance")).first()[0]
    fixed = F.col("feature").isin("NoOfSelfRedirect", "HasExternalFormSubmit", "NoOfExternalRef")
    return table.select(
        "feature", F.col("importance").between(0, 1).alias("a_share"), F.lit(abs(total - 1) < 1e-6).alias("whole"),
        (~fixed | (F.col("importance") == 0)).alias("unused_is_zero"),
    )


@query("srt_importance", "SELECT CAST(unnest(range(1, 26)) AS INTEGER) AS place, TRUE AS in_order")
def srt_importance(spark, sf):
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    table = UM.feature_importance(_url_model(spark, sf), spark).withColumn("place", place)
    before = F.lag("importance").over(Window.orderBy("place"))
    return table.select("place", F.coalesce(F.col("importance") <= before, F.lit(True)).alias("in_order"))


@query("mdl_text", _TEXTS + _held("text_splits", few=_FEW_TEXTS))
def mdl_text(spark, sf):
    test = _text_rows(spark, sf).where(F.col("split") == "test")
    return _verified(TM.score_text(_text_model(spark, sf), test), "text_probability", by_accuracy=False, few=_FEW_TEXTS)


@query("mdl_text_score", _TEXTS + "SELECT id, TRUE AS in_range, TRUE AS split_apart FROM text_splits")
def mdl_text_score(spark, sf):
    """Every text gets a probability; on the training rows the two labels' means lie apart."""
    scored = materialize(TM.score_text(_text_model(spark, sf), _text_rows(spark, sf)).select("id", "label", "split", "text_probability"), "text-scores")
    means = scored.where("split = 'train'").agg(*[F.avg(F.when(F.col("label") == k, F.col("text_probability"))) for k in (0, 1)]).first()
    return scored.select("id", F.col("text_probability").between(0, 1).alias("in_range"), F.lit(bool(means[1] > means[0] + 0.2)).alias("split_apart"))


@query("mdl_text_score_custom", "SELECT doc_id, CAST(length(text) % 100 AS DOUBLE) / 100 AS text_probability FROM documents")
def mdl_text_score_custom(spark, sf):
    """A model of the caller's own, here one that looks at the length only."""

    def make_predict():
        import numpy as np

        return lambda texts: np.array([len(t) % 100 / 100 for t in texts])

    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    return TM.score_text_with(make_predict, docs, batch_size=256).select("doc_id", "text_probability")


@query("mdl_url_score_fitted", f"SELECT id, pos, url, TRUE AS in_range, TRUE AS one_score FROM ({ORACLES['url_explode']})")
def mdl_url_score_fitted(spark, sf):
    """Every URL of every mail with a probability, the same wherever the URL occurs; none without a URL."""
    exploded = SC.explode_urls(SC.as_messages(views.emails(spark, sf), "id"), "id")
    scored = materialize(SC.score_distinct_urls(exploded, _url_plus(spark, sf), "id"), "url-scored")
    spread = scored.where("url IS NOT NULL").groupBy(F.col("url").alias("u")).agg((F.max("probability") == F.min("probability")).alias("one"))
    fine = F.when(F.col("url").isNull(), F.col("probability").isNull()).otherwise(F.col("probability").between(0, 1))
    return scored.join(spread, F.col("url") == F.col("u"), "left").select(
        "id", "pos", "url", fine.alias("in_range"), F.coalesce("one", F.lit(True)).alias("one_score")
    )


@query("mdl_fusion", _TEXTS + _held("text_splits", few=_FEW_TEXTS))
def mdl_fusion(spark, sf):
    """Classes are weighed alike here, so the order of the scores must hold rather than the accuracy."""
    test = _multimodal(spark, sf).where(F.col("split") == "test")
    return _verified(FM.score_fusion(_fusion_model(spark, sf), test), "fused_probability", by_accuracy=False, few=_FEW_TEXTS)


@query(
    "mdl_coefficients",
    _TEXTS + f"""SELECT feature, TRUE AS finite, feature <> 'text_probability' OR CASE WHEN n >= {_FEW_TEXTS} THEN TRUE END AS text_counts
    FROM (SELECT unnest([{', '.join(f"'{c}'" for c in FM.FUSION_FEATURES)}, 'intercept']) AS feature),
      (SELECT count(*) AS n FROM text_splits WHERE split = 'val')""",
)
def mdl_coefficients(spark, sf):
    """All numbers of the fusion model; learned from enough rows, a higher text probability raises the risk."""
    table = FM.fusion_coefficients(_fusion_model(spark, sf), spark)
    enough = _multimodal(spark, sf).where(F.col("split") == "val").count() >= _FEW_TEXTS
    finite = F.col("coefficient").isNotNull() & ~F.isnan("coefficient") & (F.abs("coefficient") < 1e6)
    raises = F.when(F.lit(enough), F.col("coefficient") > 0)
    return table.select("feature", finite.alias("finite"), ((F.col("feature") != "text_probability") | raises).alias("text_counts"))


@query("mdl_select_best", "SELECT CAST(i AS INTEGER) AS step, 'reg=' || x AS name, TRUE AS follows FROM (SELECT unnest([1, 2]) AS i, unnest(['0.1', '0.01']) AS x)")
def mdl_select_best(spark, sf):
    """A candidate is kept exactly if its F1 is above that of all before it."""
    rows = _text_rows(spark, sf)
    train, val = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val")
    counted = _text_counts(spark, sf)
    candidates = [(f"reg={reg}", lambda reg=reg: TM.fit_text_model(train, reg=reg, counted=counted)) for reg in (0.1, 0.01)]

    def predict(model):
        return TM.score_text(model, val).select("label", (F.col("text_probability") >= 0.5).cast("int").alias("predicted"))

    history = select_best(candidates, predict, spark)[2]
    best = F.max("f1").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return history.select("step", "name", (F.col("kept") == (F.col("f1") > F.coalesce(best, F.lit(-1.0)))).alias("follows"))


@query(
    "snk_model",
    _TEXTS + "SELECT 'text' AS model, count(*) AS n, TRUE AS equal FROM text_splits UNION ALL SELECT 'url_plus', count(*), TRUE FROM pages",
)
def snk_model(spark, sf):
    """All models saved, loaded again, and compared on every URL and text."""
    base = scratch_path(spark, "models")
    text, plus = _text_model(spark, sf), _url_plus(spark, sf)
    writers.save_model(text, f"{base}/text")
    writers.save_feature_names(spark, URL_FEATURES, f"{base}/features")
    plus.save(spark, f"{base}/url_plus")
    loaded, loaded_plus = writers.load_model(f"{base}/text"), UM.UrlPlusModel.load(spark, f"{base}/url_plus")
    urls, rows = views.urls(spark, sf), _text_rows(spark, sf)

    def compared(a, b, key, value, name):
        both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
        return both.agg(F.lit(name).alias("model"), F.count("*").alias("n"), (F.max(F.abs(F.col("x") - F.col("y"))) < 1e-6).alias("equal"))

    return compared(plus.score(urls, "url_id"), loaded_plus.score(urls, "url_id"), "url_id", "probability", "url_plus").unionByName(
        compared(TM.score_text(text, rows), TM.score_text(loaded, rows), "id", "text_probability", "text")
    )


@query(
    "snk_metrics",
    _TEXTS + """SELECT 'text' AS model, count(*) FILTER (WHERE split = 'train') AS train_samples, count(*) FILTER (WHERE split = 'val') AS val_samples,
      count(*) FILTER (WHERE split = 'test') AS test_samples, count(*) FILTER (WHERE split = 'val' AND label = 1) AS val_positives,
      count(*) FILTER (WHERE split = 'test' AND label = 1) AS test_positives, TRUE AS in_range FROM text_splits""",
)
def snk_metrics(spark, sf):
    """The record of a training run, written and read again: sample counts, confusion totals, metrics within range."""
    path = scratch_path(spark, "metrics")
    record = T.train_text_model(_text_rows(spark, sf))[1]
    writers.write_metrics(record, path)
    back = spark.read.schema(record.schema).json(path)

    def positives(part):
        return (F.col(part)["confusion_matrix"][1][0] + F.col(part)["confusion_matrix"][1][1]).alias(f"{part}_positives")

    inside = F.lit(True)
    for part in ("val", "test"):
        for name in ("accuracy", "precision", "recall", "f1", "roc_auc"):
            inside = inside & F.col(part)[name].between(0, 1)
    return back.select("model", "train_samples", "val_samples", "test_samples", positives("val"), positives("test"), inside.alias("in_range"))


# Scoring


def _consistent(response):
    """What one response must say of itself, whatever the models: level and flag from the score, the score from its parts."""
    score = F.col("risk_score")
    level = F.when(score > 70, "High").when(score > 50, "Medium").otherwise("Low")
    edge = F.abs(score - 70) < 0.01
    edge = edge | (F.abs(score - 50) < 0.01)
    parts = F.abs(score - (0.6 * F.col("text_probability") + 0.4 * F.col("url_probability"))) <= 0.0151
    return response.select(
        "id", F.array_join("urls", " ").alias("urls"), F.col("url_count").cast("bigint").alias("url_count"),
        (edge | ((F.col("risk_level") == level) & (F.col("is_phishing") == (score >= 50)))).alias("level_fits"), parts.alias("risk_fits"),
        ((F.col("url_count") > 0) | (F.col("url_probability") == 0)).alias("zero_without_urls"),
    )


_RESPONSES = (
    D.ctes("emails") + "SELECT id, array_to_string(f, ' ') AS urls, CAST(len(f) AS BIGINT) AS url_count, TRUE AS level_fits, TRUE AS risk_fits, "
    f"TRUE AS zero_without_urls FROM (SELECT id, {D.urls_in(D.message('subject', 'sender', 'body'))} AS f FROM emails)"
)


@query("sc_email_fitted", _RESPONSES)
def sc_email_fitted(spark, sf):
    return _consistent(SC.score_emails(views.emails(spark, sf), _email_models(spark, sf)))


def _in_range(*extra):
    """Kept columns and whether both probabilities are some, with none for the URLs of a row without any."""
    fine = F.col("text_probability").between(0, 1) & F.col("url_probability").between(0, 1)
    return [*extra, F.col("url_count").cast("bigint").alias("url_count"), (fine & ((F.col("url_count") > 0) | (F.col("url_probability") == 0))).alias("in_range")]


@query(
    "sc_multimodal_fitted",
    _TEXTS + f"SELECT id, source, split, label, CAST(len(list_distinct({D.urls_in('text', 'text')})) AS BIGINT) AS url_count, TRUE AS in_range FROM text_splits",
)
def sc_multimodal_fitted(spark, sf):
    return _multimodal(spark, sf).select(*_in_range("id", "source", "split", "label"))


@query(
    "sc_fusion_set_fitted",
    D.ctes("urls", "list_mails", "listed") + f"SELECT id, l.label, CAST(len({D.urls_in(D.clean('m.urls'), 'list')}) AS BIGINT) AS url_count, TRUE AS in_range "
    "FROM listed l JOIN list_mails m USING (id)",
)
def sc_fusion_set_fitted(spark, sf):
    rows = SC.score_listed_urls(text_parts(spark, sf)[1], _text_model(spark, sf), _url_plus(spark, sf))
    return rows.select(*_in_range("id", "label"))


# Scoring with given models: a node table and word weights, fixed here, so that SQL can compute the same numbers. Their
# values are multiples of 1/64, whose sums are exact in any order.

GIVEN_TREES = TreeEnsemble((
    (0, 0, "IsHTTPS", 0.5, 1, 2, None), (0, 1, "NoOfOtherSpecialCharsInURL", 7.0, 3, 4, None), (0, 2, "URLLength", 30.0, 5, 6, None),
    (0, 3, None, None, None, None, 0.40625), (0, 4, None, None, None, None, 1.109375), (0, 5, None, None, None, None, -0.953125),
    (0, 6, None, None, None, None, -0.265625),
    (1, 0, "NoOfDegitsInURL", 2.0, 1, 2, None), (1, 1, "DomainLength", 14.5, 3, 4, None), (1, 2, None, None, None, None, 0.6875),
    (1, 3, None, None, None, None, -0.359375), (1, 4, "LetterRatioInURL", 0.75, 5, 6, None), (1, 5, None, None, None, None, 0.8125),
    (1, 6, None, None, None, None, -0.171875),
    (2, 0, "NoOfEqualsInURL", 0.0, 1, 2, None), (2, 1, None, None, None, None, -0.234375), (2, 2, None, None, None, None, 0.921875),
    (3, 0, None, None, None, None, 0.046875),
), base=-0.015625)
GIVEN_WORDS = WordWeights({
    "visit": 0.890625, "see": 0.546875, "de": -0.421875, "der": -0.765625, "la": 0.328125, "src1": 1.046875, "hehely": 0.671875,
    "orantion": -0.578125, "http": 0.234375, "example": 0.109375, "7": 0.453125, "user3": 0.796875,
}, intercept=-0.484375)


def _values(rows):
    def cell(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _words_probability(text):
    words = f"list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+'))"
    table = "MAP {" + ", ".join(f"'{w}': {v}::DOUBLE" for w, v in GIVEN_WORDS.weights.items()) + "}"
    margin = f"{GIVEN_WORDS.intercept}::DOUBLE + coalesce(list_sum(list_transform({words}, lambda w: coalesce({table}[w], 0.0::DOUBLE))), 0.0::DOUBLE)"
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({margin})))"


def _url_scores(source):
    """CTE ``url_scores`` (id, pos, url, probability) of the rows (id, pos, url) of ``source``: each row walks down each tree."""
    pairs = ", ".join(f"'{c}': CAST(\"{c}\" AS DOUBLE)" for c in URL_FEATURES)
    return f"""nodes(tree, node, feature, threshold, low, high, val) AS (VALUES {_values(GIVEN_TREES.nodes)}),
    listed_urls AS ({source}),
    u_canon AS (SELECT DISTINCT url AS url0, {D.CANON} AS u FROM listed_urls WHERE url IS NOT NULL),
    u_parts AS (SELECT url0, u, lower(u) AS w, {D.DOMAIN} AS d FROM u_canon),
    u_features AS (SELECT url0, {D.feature_list()} FROM u_parts),
    u_maps AS (SELECT url0, MAP {{{pairs}}} AS x FROM u_features),
    walk AS (SELECT url0, x, tree, 0 AS node FROM u_maps, (SELECT DISTINCT tree FROM nodes) t
      UNION ALL SELECT url0, x, tree, CASE WHEN x[feature] <= threshold THEN low ELSE high END FROM walk JOIN nodes USING (tree, node)
      WHERE feature IS NOT NULL),
    per_url AS (SELECT url0, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({GIVEN_TREES.base}::DOUBLE + sum(val)))) AS probability
      FROM walk JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY url0),
    url_scores AS (SELECT id, pos, url, probability FROM listed_urls LEFT JOIN per_url ON url0 = url)"""


def _recursive(ctes):
    return "WITH RECURSIVE " + ctes.strip().removeprefix("WITH ")


def _percent(x):
    return f"CAST(format('{{:.2f}}', 100 * ({x})) AS DOUBLE)"


_MAIL_URLS = f"found AS (SELECT id, {D.message('subject', 'sender', 'body')} AS message, {D.urls_in(D.message('subject', 'sender', 'body'))} AS f FROM emails)"
_EXPLODED = "SELECT id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos, unnest(f) AS url FROM found"
_RESPONSE_VALUES = _recursive(D.ctes("emails")) + f""", {_MAIL_URLS}, {_url_scores(_EXPLODED)},
  best AS (SELECT id, max(probability) AS url_p FROM url_scores GROUP BY id),
  fusion AS (SELECT id, f, t, coalesce(url_p, 0.0::DOUBLE) AS p, 0.6::DOUBLE * t + 0.4::DOUBLE * coalesce(url_p, 0.0::DOUBLE) AS risk
    FROM (SELECT id, f, {_words_probability('message')} AS t FROM found) LEFT JOIN best USING (id))
  SELECT id, array_to_string(f, ' ') AS urls, CAST(len(f) AS BIGINT) AS url_count, {_percent('risk')} AS risk_score,
    CASE WHEN risk >= 0.7::DOUBLE THEN 'High' WHEN risk >= 0.5 THEN 'Medium' ELSE 'Low' END AS risk_level, risk >= 0.5 AS is_phishing,
    {_percent('t')} AS text_probability, {_percent('p')} AS url_probability FROM fusion"""


def _response_values(scored):
    return scored.select(
        "id", F.array_join("urls", " ").alias("urls"), F.col("url_count").cast("bigint").alias("url_count"), "risk_score", "risk_level",
        "is_phishing", "text_probability", "url_probability",
    )


def _given_models():
    return SC.EmailModels(GIVEN_WORDS, GIVEN_TREES)


@query("sc_email", _RESPONSE_VALUES)
def sc_email(spark, sf):
    """The whole response of every mail: score, level, flag and both probabilities."""
    return _response_values(SC.score_emails(views.emails(spark, sf), _given_models()))


@query(
    "mdl_url_score",
    _recursive(D.ctes("emails")) + f""", {_MAIL_URLS}, {_url_scores(_EXPLODED + " UNION ALL SELECT id, NULL, NULL FROM found WHERE len(f) = 0")}
    SELECT id, pos, url, round(probability, 9) AS probability FROM url_scores""",
)
def mdl_url_score(spark, sf):
    """The probability of every URL of every mail; each distinct URL is scored once."""
    exploded = SC.explode_urls(SC.as_messages(views.emails(spark, sf), "id"), "id")
    return SC.score_distinct_urls(exploded, GIVEN_TREES, "id").select("id", "pos", "url", F.round("probability", 9).alias("probability"))


def _table_values(extra, rows, text, urls):
    """Twin of a scored table: kept columns, both probabilities and the number of URLs."""
    return f""", found AS (SELECT id, {extra}, {text} AS body, {urls} AS f FROM {rows}), {_url_scores(_EXPLODED)},
    best AS (SELECT id, max(probability) AS url_p FROM url_scores GROUP BY id)
    SELECT id, {extra}, round({_words_probability('body')}, 9) AS text_probability, round(coalesce(url_p, 0.0::DOUBLE), 9) AS url_probability,
      CAST(len(f) AS BIGINT) AS url_count FROM found LEFT JOIN best USING (id)"""


def _rounded(scored, *extra):
    return scored.select(
        *extra, F.round("text_probability", 9).alias("text_probability"), F.round("url_probability", 9).alias("url_probability"),
        F.col("url_count").cast("bigint").alias("url_count"),
    )


@query("sc_multimodal", _recursive(_TEXTS) + _table_values("source, split, label", "text_splits", "text", f"list_distinct({D.urls_in('text', 'text')})"))
def sc_multimodal(spark, sf):
    """Both probabilities of every text of the splits."""
    return _rounded(SC.score_splits(_text_rows(spark, sf), GIVEN_WORDS, GIVEN_TREES), "id", "source", "split", "label")


@query(
    "sc_fusion_set",
    _recursive(D.ctes("urls", "list_mails", "listed")) + ", listed_mails AS (SELECT id, l.label, l.text, m.urls FROM listed l JOIN list_mails m USING (id))"
    + _table_values("label", "listed_mails", "text", D.urls_in(D.clean("urls"), "list")),
)
def sc_fusion_set(spark, sf):
    """Both probabilities of mails whose URLs sit in a list."""
    return _rounded(SC.score_listed_urls(text_parts(spark, sf)[1], GIVEN_WORDS, GIVEN_TREES), "id", "label")


# Streaming


def _arrivals(spark, sf):
    """What arrives, batch after batch: all mails, the same a minute later, two other mails that move the clock on, and all
    mails once more, two hours after the first time."""
    mails = views.emails(spark, sf).select("id", "subject", "sender", "body")
    clock = spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("tick").alias("subject"), F.lit("").alias("sender"), F.lit("a").alias("body"))
    for rows, minute in ((mails, 0), (mails, 1), (clock, 120), (clock.withColumn("body", F.lit("b")), 120), (mails, 120)):
        yield rows.withColumn("ts", F.timestamp_seconds(F.lit(1704067200 + 60 * minute)))


@query("st_score", _RESPONSE_VALUES)
def st_score(spark, sf):
    """The responses of the stream."""
    sink, checkpoint = scratch_path(spark, "scored"), scratch_path(spark, "scored-checkpoint")
    path = scratch_path(spark, "incoming-once")
    views.emails(spark, sf).select("id", "subject", "sender", "body").write.parquet(path)
    incoming = spark.readStream.schema("id bigint, subject string, sender string, body string").parquet(path)
    jobs.score_stream(incoming, _given_models(), sink, checkpoint).awaitTermination()
    return _response_values(spark.read.parquet(sink).drop("batch_id"))


@query(
    "st_dedupe",
    D.ctes("emails") + f"SELECT 2 * count(*) + 2 AS kept, count(*) + 2 AS messages FROM (SELECT DISTINCT sha256({D.message('subject', 'sender', 'body')}) "
    f"AS h FROM emails WHERE {D.strip('body')} <> '')",
)
def st_dedupe(spark, sf):
    """Copies within the delay are dropped; once the watermark has passed it, a message comes through again."""
    sink, checkpoint = scratch_path(spark, "deduped"), scratch_path(spark, "deduped-checkpoint")
    path = scratch_path(spark, "incoming")
    for arrived in _arrivals(spark, sf):  # written by many tasks; the stream goes on where it stopped, its state kept
        arrived.write.mode("append").parquet(path)
        incoming = spark.readStream.schema(arrived.schema).parquet(path)
        jobs.append_stream(jobs.drop_resent(incoming), sink, checkpoint).awaitTermination()
    return spark.read.schema("message_hash string").parquet(sink).agg(
        F.count("*").alias("kept"), F.countDistinct("message_hash").alias("messages")
    )
