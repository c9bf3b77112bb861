import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from hookline.operators import boosting as B
from hookline.operators.given_models import TreeEnsemble
from hookline.session import Scratch


def plain_tree(rows, labels, margins, s, depth=None):
    """(feature, threshold, low, high) or a leaf value, by trying every cut at a value that occurs."""
    depth = s.depth if depth is None else depth
    p = [1 / (1 + math.exp(-m)) for m in margins]
    g = [math.floor((a - y) * B._UNIT + 0.5) / B._UNIT for a, y in zip(p, labels)]
    h = [math.floor(a * (1 - a) * B._UNIT + 0.5) / B._UNIT for a in p]
    G, H = sum(g), sum(h)
    best = (B._LEAST_GAIN,)
    for j in range(len(rows[0])) if depth else ():
        for cut in sorted({r[j] for r in rows})[:-1]:
            left = [i for i, r in enumerate(rows) if r[j] <= cut]
            gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
            if hl >= s.child_weight and H - hl >= s.child_weight:
                gain = gl**2 / (hl + s.l2) + (G - gl) ** 2 / (H - hl + s.l2) - G**2 / (H + s.l2)
                if gain > best[0] + 1e-12:
                    best = (gain, j, cut, left)
    if len(best) == 1:
        return -s.step * G / (H + s.l2)
    _, j, cut, left = best
    parts = [left, [i for i in range(len(rows)) if i not in set(left)]]
    return (j, cut, *(plain_tree([rows[i] for i in own], [labels[i] for i in own], [margins[i] for i in own], s, depth - 1) for own in parts))


def value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    cells = rng.integers(0, 12, (240, 4)).astype(float)
    labels = ((cells[:, 0] + cells[:, 1] > 12) ^ (rng.random(240) < 0.1)).astype(int)
    rows = [(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(cells, labels))]
    return rows, spark.createDataFrame(rows, "id int, x array<double>, label int").repartition(3)


def test_trees_equal_a_plain_search(spark, table, monkeypatch):
    monkeypatch.setattr(B, "_ADVANCE", 2)
    rows, df = table
    s = B.Boosting(trees=5, depth=3, step=0.3, rows=1.0, columns=1.0, child_weight=1.5)
    model = B.fit_boosted(df, "x", 4, settings=s)
    margins = [0.0] * len(rows)
    for _ in range(s.trees):
        tree = plain_tree([r[1] for r in rows], [r[2] for r in rows], margins, s)
        margins = [m + value(tree, r[1]) for m, r in zip(margins, rows)]
    scored = model.transform(df.withColumn("features", array_to_vector("x"))).select("id", vector_to_array("probability")[1].alias("p")).collect()
    want = {r[0]: 1 / (1 + math.exp(-m)) for r, m in zip(rows, margins)}
    assert {r.id: r.p for r in scored} == pytest.approx(want, abs=1e-6)
    nodes = TreeEnsemble.from_boosted(model, list("abcd"), spark)
    got = df.withColumn("m", nodes.margin({c: F.get("x", F.lit(i)) for i, c in enumerate("abcd")})).collect()
    assert {r.id: 1 / (1 + math.exp(-r.m)) for r in got} == pytest.approx(want, abs=1e-6)


def test_samples_and_single_class(spark, table):
    rows, df = table
    s = B.Boosting(trees=4, depth=3, step=0.3, rows=0.6, columns=0.5)
    cuts = B.feature_cuts(df, "x", 4, 256)
    a, b = (B.grow(df, "x", "label", cuts, s, Scratch(spark, "grow")) for _ in range(2))
    assert a == b and all(len({f for f in t.feature if f >= 0}) <= 2 for t in a)
    share = B._drawn(np.arange(20000), 3, 0.6, 42).mean()
    assert abs(share - 0.6) < 0.02
    ones = df.withColumn("label", F.lit(1))
    model = B.fit_boosted(ones, "x", 4, settings=B.Boosting(trees=3, depth=2))
    p = model.transform(ones.withColumn("features", array_to_vector("x"))).select(vector_to_array("probability")[1]).first()[0]
    assert 0.5 < p < 0.6
    assert B.fit_boosted(df.limit(0), "x", 4, settings=B.Boosting(trees=2, depth=2)).getNumTrees == 2


def test_a_cut_leaves_weight_on_both_sides():
    sums = np.zeros((2, 256), np.int64)
    sums[:, [1, 5, 9]] = (np.array([[-3.0, 1.0, 4.0], [0.4, 2.0, 2.0]]) * B._UNIT).astype(np.int64)
    gain, cut, g, h, all_g, all_h = B.best_cut(sums, 1.0, 1.0)
    assert (cut, g, all_g) == (5, -2.0, 2.0) and h == pytest.approx(2.4) and all_h == pytest.approx(4.4)
    assert gain == pytest.approx(4 / 3.4 + 16 / 3.0 - 4 / 5.4)
    assert B.best_cut(sums, 1.0, 3.0)[0] == -1.0
