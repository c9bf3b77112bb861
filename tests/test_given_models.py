import math
import random
import re

import pytest
from pyspark.sql import functions as F

from hookline.checks.model_queries import GIVEN_TREES, GIVEN_WORDS
from hookline.functions.url_features import URL_FEATURES, with_url_features
from hookline.operators import url_model as UM
from hookline.operators.given_models import TreeEnsemble, WordWeights


def plain_margin(model, row):
    total = model.base
    nodes = {r[:2]: r for r in model.nodes}
    for tree in {r[0] for r in model.nodes}:
        node = nodes[tree, 0]
        while node[2] is not None:
            x = row[node[2]]
            node = nodes[tree, node[4] if x is not None and x <= node[3] else node[5]]
        total += node[6]
    return total


def grown(rng, tree, depth):
    rows, todo = [], [(0, 0)]
    while todo:
        node, level = todo.pop()
        if level == depth or rng.random() < 0.2:
            rows.append((tree, node, None, None, None, None, rng.randint(-64, 64) / 64))
        else:
            rows.append((tree, node, rng.choice("abc"), float(rng.randint(0, 9)), 2 * node + 1, 2 * node + 2, None))
            todo += [(2 * node + 1, level + 1), (2 * node + 2, level + 1)]
    return rows


def test_every_tree_is_walked(spark):
    rng = random.Random(2)
    model = TreeEnsemble(tuple(r for t in range(30) for r in grown(rng, t, 6)), base=0.25)
    rows = [tuple(rng.choice([None, *map(float, range(10))]) for _ in "abc") for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    scored = df.withColumn("m", model.margin({c: F.col(c) for c in "abc"}))
    assert all(r.m == plain_margin(model, r.asDict()) for r in scored.collect())
    assert TreeEnsemble.from_table(model.table(spark), 0.25).margin({c: F.col(c) for c in "abc"}) is not None
    assert sorted(TreeEnsemble.from_table(model.table(spark)).nodes) == sorted(model.nodes)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_leaves_only_and_no_trees(spark):
    one = spark.range(1)
    assert one.select(TreeEnsemble(((0, 0, None, None, None, None, 0.5),), 1.0).margin({})).first()[0] == 1.5
    assert one.select(TreeEnsemble((), -2.0).margin({})).first()[0] == -2.0


def test_a_fitted_model_as_node_table(spark, sf):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("url", "CAST(page_id % 3 = 0 AS INT) AS label")
    model = UM.fit_url_model(with_url_features(pages), trees=4, depth=3)
    table = TreeEnsemble.from_boosted(UM.boosted_trees(model), URL_FEATURES, spark)
    want = {r.url: r.probability for r in UM.score_urls(model, pages).collect()}
    got = {r.url: r.probability for r in table.score_urls(pages).collect()}
    assert len(want) > 100 and got == pytest.approx(want, abs=1e-12)


def test_words(spark):
    texts = [None, "", "See visit VISIT", "src1/7 http://user3", "Größe de.der", "nothing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for row in GIVEN_WORDS.score_text(df).collect():
        words = set(re.findall(r"[^\W_]+", (texts[row.i] or "").lower()))
        margin = GIVEN_WORDS.intercept + sum(GIVEN_WORDS.weights.get(w, 0.0) for w in words)
        assert row.text_probability == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-15)
    assert WordWeights({}, 0.0).score_text(df).first().text_probability == 0.5


def test_null_urls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "https://a.com")], "id int, url string")
    got = {r.id: r.probability for r in GIVEN_TREES.score(df, "id").collect()}
    assert got[1] is None and 0 < got[2] < 1 and 0 < got[3] < 1
