import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hookline.functions.url_features import with_url_features
from hookline.operators import fusion_model as FM
from hookline.operators import svd as SV
from hookline.operators import text_model as TM
from hookline.operators import tfidf as TF
from hookline.operators import url_model as UM
from hookline.operators.selection import select_best

URLS = [
    "http://a.com/login", "http://b.com/login", "https://c.org/Login  page", "ab", "", "http://a.com/aaaaaa", "http://a.com/",
    "https://é.org/😀😀😀", "http://a.com/login?x=1", "https://login.b.com/", "https://c.org/a\t\tb",
]


def ngrams(s):
    s = re.sub(r"\s\s+", " ", s.lower())
    return [s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1)]


def tfidf_by_hand(train, rows, min_df, limit):
    docs = [Counter(ngrams(s)) for s in train]
    tf, df = Counter(), Counter()
    for d in docs:
        tf.update(d)
        df.update(d.keys())
    kept = sorted((g for g in tf if df[g] >= min_df), key=lambda g: (-tf[g], g))[:limit]
    vocabulary = {g: i for i, g in enumerate(sorted(kept))}
    idf = {g: math.log((1 + len(train)) / (1 + df[g])) + 1 for g in kept}
    matrix = np.zeros((len(rows), len(vocabulary)))
    for r, s in enumerate(rows):
        for g, n in Counter(ngrams(s)).items():
            if g in vocabulary:
                matrix[r, vocabulary[g]] = (1 + math.log(n)) * idf[g]
        norm = np.linalg.norm(matrix[r])
        matrix[r] /= norm or 1.0
    return vocabulary, matrix


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "id long, url string")
    model = TF.fit_tfidf(df, "id", "url", min_documents=2, max_features=60)
    weights = model.weights(df, "id", "url").persist()
    yield df, model, weights
    weights.unpersist()


def dense(model, weights):
    out = np.zeros((len(URLS), model.size))
    for r in weights.collect():
        out[r["id"], r["indices"]] = r["weights"]
    return out


def test_tfidf_matches_direct_computation(fitted):
    _, model, weights = fitted
    vocabulary, matrix = tfidf_by_hand(URLS, URLS, 2, 60)
    assert {r["gram"]: r["idx"] for r in model.vocabulary.collect()} == vocabulary
    assert weights.count() == len(URLS)  # also the URLs without any known n-gram
    np.testing.assert_allclose(dense(model, weights), matrix, atol=1e-12)


def test_tfidf_needs_one_exchange(fitted):
    df, model, _ = fitted
    plan = model.weights(df.where("id >= 0"), "id", "url")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_vocabulary_cut(spark):
    grams = spark.createDataFrame([(f"g{i:03d}", 1 + i % 7, 3) for i in range(200)], "gram string, tf long, df long")
    rows = sorted(grams.collect(), key=lambda r: (-r["tf"], r["gram"]))
    for most in (0, 1, 28, 29, 100, 199, 200, 500):
        kept = TF._most_frequent(grams, most)
        assert sorted(r["gram"] for r in kept.collect()) == sorted(r["gram"] for r in rows[:most])
        assert "TakeOrdered" not in kept._jdf.queryExecution().executedPlan().toString()


def test_tfidf_save_and_load(spark, fitted, tmp_path):
    df, model, weights = fitted
    model.save(str(tmp_path / "m"))
    again = TF.TfidfModel.load(spark, str(tmp_path / "m"))
    np.testing.assert_allclose(dense(again, again.weights(df, "id", "url")), dense(model, weights))


def test_svd_matches_dense_svd(spark, fitted, tmp_path):
    _, model, weights = fitted
    matrix = dense(model, weights)
    svd = SV.fit_svd(model, weights, components=5)
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    np.testing.assert_allclose(svd.singular_values, s[:5], rtol=1e-4)
    for k in range(3):
        assert abs(svd.factors[:, k] @ vt[k]) > 0.999
    projected = svd.transform(weights)
    got = {r["id"]: r["svd"] for r in projected.collect()}
    for i in range(len(URLS)):
        np.testing.assert_allclose(got[i], matrix[i] @ svd.factors, atol=1e-5)
    want = np.var(matrix @ svd.factors, axis=0).sum() / np.var(matrix, axis=0).sum()
    assert SV.explained_variance(weights, projected).first()[0] == pytest.approx(want, rel=1e-4)
    svd.save(spark, str(tmp_path / "svd"))
    np.testing.assert_allclose(SV.SvdModel.load(spark, str(tmp_path / "svd")).factors, svd.factors)


def test_svd_of_a_block_that_is_not_sent_out(spark, fitted, monkeypatch):
    """Cut into ranges of seven terms, the block gives the values, vectors and projections of the dense matrix."""
    _, model, weights = fitted
    small = SV.fit_svd(model, weights, components=5)
    monkeypatch.setattr(SV, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(SV, "RANGE_BYTES", 8 * 15 * 7)
    weights = weights.withColumn("_svd_note", F.lit("kept"))
    cut = SV.fit_svd(model, weights, components=5)
    np.testing.assert_allclose(cut.singular_values, small.singular_values, rtol=1e-9)
    projected = cut.transform(weights)
    plan = projected._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and {"_svd_note", "svd"} <= set(projected.columns)
    matrix, got = dense(model, weights), {r["id"]: r["svd"] for r in projected.collect()}
    assert len(got) == len(URLS)
    for i in range(len(URLS)):
        np.testing.assert_allclose(got[i], matrix[i] @ cut.factors, atol=1e-5)


@pytest.mark.parametrize("whole", [True, False])
def test_svd_of_fewer_rows_than_components(spark, fitted, monkeypatch, whole):
    """Values beyond the rank are 0, their vectors are still at right angles; each pair solves its equation."""
    _, model, weights = fitted
    few = weights.where("id < 6")
    if not whole:
        monkeypatch.setattr(SV, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(SV, "RANGE_BYTES", 8 * 20 * 9)
    svd = SV.fit_svd(model, few, components=20)
    want = np.linalg.svd(dense(model, few), compute_uv=False)[:6]
    np.testing.assert_allclose(svd.singular_values[:6], want, atol=1e-6)
    assert svd.components == 20 and svd.singular_values[6:].max() < 1e-6
    residual, apart = SV.pair_errors(svd, few)
    assert residual.max() < 1e-6 and apart.max() < 1e-8


def test_svd_of_no_rows(spark, fitted):
    _, model, weights = fitted
    svd = SV.fit_svd(model, weights.where("id < 0"), components=3)
    assert svd.singular_values.max() == 0 and SV.pair_errors(svd, weights.where("id < 0"))[1].max() < 1e-8


@pytest.fixture(scope="module")
def labelled_urls(spark):
    rows = [(i, f"https://site{i}.example.com/page/{i}", 0) for i in range(60)]
    rows += [(100 + i, f"http://10.0.0.{i}/login-pay/verify?password={i}&x=%41", 1) for i in range(40)]
    return spark.createDataFrame(rows, "id long, url string, label int").repartition(2).persist()


def test_url_model(spark, labelled_urls, tmp_path):
    table = with_url_features(labelled_urls)
    model = UM.fit_url_model(table, trees=5, depth=3)
    scored = UM.score_urls(model, labelled_urls).collect()
    assert all((r["probability"] >= 0.5) == bool(r["label"]) for r in scored)
    assert UM.score_urls(model, spark.createDataFrame([(None,)], "url string")).first()["probability"] is None
    curve = UM.learning_curve(model, table, table).orderBy("round").collect()
    assert len(curve) == 5 and curve[-1]["train_log_loss"] < curve[0]["train_log_loss"]
    probabilities = [min(max(r["probability"], 1e-15), 1 - 1e-15) for r in scored]
    loss = -np.mean([math.log(p if r["label"] else 1 - p) for p, r in zip(probabilities, scored)])
    assert curve[-1]["train_log_loss"] == pytest.approx(loss, rel=1e-6)
    importance = UM.feature_importance(model, spark).collect()
    assert len(importance) == 25 and sum(r["importance"] for r in importance) == pytest.approx(1.0)
    with pytest.raises(ValueError, match="Bank"):
        UM.fit_url_model(table.drop("Bank"))


def test_url_plus_model(spark, labelled_urls, tmp_path):
    model = UM.fit_url_plus_model(labelled_urls, "id", trees=3, depth=3, components=4, max_features=200)
    got = {r["id"]: r["probability"] for r in model.score(labelled_urls, "id").collect()}
    assert len(got) == 100
    assert all((p >= 0.5) == (i >= 100) for i, p in got.items())
    model.save(spark, str(tmp_path / "plus"))
    again = UM.UrlPlusModel.load(spark, str(tmp_path / "plus"))
    assert {r["id"]: r["probability"] for r in again.score(labelled_urls, "id").collect()} == got


def test_text_model(spark, tmp_path):
    rows = [(i, "verify your account password now " + "x" * (i % 3), 1) for i in range(30)]
    rows += [(100 + i, "meeting notes and lunch plans " + "y" * (i % 3), 0) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = TM.fit_text_model(df, hash_size=1 << 10)
    scored = TM.score_text(model, df)
    assert scored.columns == ["id", "text", "label", "text_probability"]
    assert all((r["text_probability"] >= 0.5) == bool(r["label"]) for r in scored.collect())
    other = TM.score_text(model, df.withColumnRenamed("text", "message"), "message")
    assert other.columns == ["id", "message", "label", "text_probability"]

    def make_predict():
        import numpy as np

        return lambda texts: np.array([float("verify" in t) for t in texts])

    custom = TM.score_text_with(make_predict, df).collect()
    assert all(r["text_probability"] == r["label"] for r in custom)

    candidates = [("weak", lambda: TM.fit_text_model(df, hash_size=2, iterations=1)), ("good", lambda: model), ("same", lambda: model)]

    def predict(m):
        return TM.score_text(m, df).select("label", (F.col("text_probability") >= 0.5).cast("int").alias("predicted"))

    name, best, history = select_best(candidates, predict, spark)
    assert name == "good" and best is model
    assert [r["kept"] for r in history.orderBy("step").collect()] == [True, True, False]


def fusion_by_hand(x, y):
    """Newton steps on the balanced, L2-penalised logistic loss with C = 1."""
    z = (x - x.mean(0)) / x.std(0)
    n, ones = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    design = np.hstack([z, np.ones((n, 1))])
    beta, penalty = np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (weight * (p - y)) + penalty @ beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + penalty
        beta -= np.linalg.solve(hessian, gradient)
    return beta


def test_fusion_model_matches_newton(spark):
    rng = np.random.default_rng(7)
    y = (rng.random(300) < 0.2).astype(int)
    x = np.column_stack([np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1), np.clip(rng.normal(0.4 + 0.1 * y, 0.3), 0, 1), rng.integers(0, 5, 300)])
    df = spark.createDataFrame([(int(i), int(b), float(p), float(q), int(c)) for i, (b, (p, q, c)) in enumerate(zip(y, x))],
                               "id long, label int, text_probability double, url_probability double, url_count int")
    model = FM.fit_fusion_model(df)
    got = {r["feature"]: r["coefficient"] for r in FM.fusion_coefficients(model, spark).collect()}
    want = fusion_by_hand(x, y)
    assert [got[f] for f in [*FM.FUSION_FEATURES, "intercept"]] == pytest.approx(want, abs=1e-4)
    weights = {r["label"]: r["weight"] for r in FM.balanced_weights(df).select("label", "weight").distinct().collect()}
    assert weights[1] == pytest.approx(300 / (2 * y.sum()))
    from pyspark.ml import Pipeline

    scaled = Pipeline(stages=FM.scaling_stages(300)).fit(df).transform(df)
    values = np.array([r[0] for r in scaled.orderBy("id").select(vector_to_array("features")).collect()])
    np.testing.assert_allclose(values, (x - x.mean(0)) / x.std(0), atol=1e-9)
    assert FM.score_fusion(model, df).columns[-1] == "fused_probability"
