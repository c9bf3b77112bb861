import json

import pytest
from pyspark.sql import functions as F

from hookline.checks.corpus_queries import text_splits
from hookline.functions.url_features import with_url_features
from hookline.operators.splits import stratified_split
from hookline.plans import audits, training
from hookline.session import materialize
from hookline.sources import writers


@pytest.fixture(scope="module")
def dataset(spark, sf):
    return materialize(text_splits(spark, sf), "dataset")


@pytest.fixture(scope="module")
def urls(spark):
    rows = [(i, f"https://s{i}.example.com/{i}", 0) for i in range(60)] + [(100 + i, f"http://10.0.0.{i}/pay?pwd={i}", 1) for i in range(40)]
    return materialize(spark.createDataFrame(rows, "id long, url string, label int").coalesce(1), "urls")


def test_validate_and_profile(dataset):
    reports = audits.validate_splits(dataset)
    assert {r["column"]: r["n_null"] for r in reports["missing"].collect()} == dict.fromkeys(dataset.columns, 0)
    assert all(r["duplicate_rows"] == 0 for r in reports["duplicates"].collect())
    for name in ("shared_texts", "shared_ids"):
        assert {r["status"] for r in reports[name].collect()} == {"PASS"}
    shares = {}
    for r in reports["labels"].collect():
        shares.setdefault(r["split"], 0.0)
        shares[r["split"]] += r["pct"]
    assert shares == pytest.approx({"train": 100.0, "val": 100.0, "test": 100.0})
    profile = audits.profile_splits(dataset)
    assert profile["limits"].count() == 30 and profile["quantiles"].count() == 3
    total = profile["source_by_label"].agg(F.sum("legitimate") + F.sum("phishing")).first()[0]
    assert total == dataset.count()
    with pytest.raises(ValueError, match="split"):
        audits.validate_splits(dataset.drop("split"))


def test_audit_urls(spark, urls):
    twice = urls.unionByName(urls.withColumn("label", 1 - F.col("label")))
    reports = audits.audit_urls(twice, with_url_features(twice))
    row = reports["urls"].first()
    assert (row["rows"], row["distinct_keys"], row["conflicting_keys"], row["unique_ratio"]) == (200, 100, 100, 0.5)
    assert {r["n"] for r in reports["labels"].collect()} == {100}


def test_train_url_model(spark, urls, tmp_path):
    _, record = training.train_url_model(with_url_features(urls), "id", trees=3, depth=2)
    writers.write_metrics(record, str(tmp_path / "m"))
    saved = json.loads(spark.read.text(str(tmp_path / "m")).first()[0])
    assert (saved["train_samples"], saved["val_samples"], saved["test_samples"]) == (70, 10, 20)
    assert saved["test"]["f1"] == 1.0 and saved["test"]["confusion_matrix"] == [[12, 0], [0, 8]]
    assert len(saved["feature_importance"]) == 25


def test_train_url_plus_model(spark, urls):
    split = stratified_split(urls, "80_10_10")
    _, record = training.train_url_plus_model(split, "id", trees=2, depth=2, components=3, max_features=100)
    assert record.first()["test"]["samples"] == 10


def test_train_text_and_fusion(spark, dataset):
    model, record = training.train_text_model(dataset, hash_size=1 << 10, iterations=5)
    row = record.first()
    assert row["val"]["samples"] == row["val_samples"] and row["test"]["roc_auc"] is not None
    scored = dataset.select(
        "id", "label", (F.length("text") % 100 / 100.0).alias("text_probability"),
        (F.col("label") * 0.5 + F.col("id") % 7 / 14.0).alias("url_probability"), (F.col("id") % 3).alias("url_count"),
    )
    _, record = training.train_fusion_model(scored)
    row = record.first()
    assert set(row["coefficients"]) == {"text_probability", "url_probability", "url_count", "intercept"}
    assert row["coefficients"]["url_probability"] > 0 and row["test"]["roc_auc"] > 0.8
