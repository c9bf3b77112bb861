"""Trees, cuts and products of wide tables: as exact as before, with the table read a few times only."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from hookline.operators import boosting as B
from hookline.operators import svd as SV
from hookline.session import Scratch


def wide(spark, n=600, width=70):
    cells = np.random.default_rng(7).integers(0, 40, (n, width)).astype(float)
    rows = [(r.tolist(), int(r[0] + r[1] > 38 or i % 9 == 0)) for i, r in enumerate(cells)]
    return cells, spark.createDataFrame(rows, "x array<double>, y int").repartition(3)


def test_cuts_of_many_features_take_one_pass(spark, monkeypatch):
    cells, df = wide(spark)
    monkeypatch.setattr(DataFrame, "first", None)  # a pass for each 64 features
    got = B.feature_cuts(df, "x", 70, 16)
    ordered = np.sort(cells, axis=0)
    places = np.ceil(np.arange(1, 16) / 16 * len(cells)).astype(int) - 1
    assert len(got) == 70 and all((c == np.unique(ordered[places, j])).all() for j, c in enumerate(got))
    assert [len(c) for c in B.feature_cuts(df.limit(0), "x", 3, 16)] == [0, 0, 0]


def test_cuts_of_runs_are_near_their_ranks(spark):
    values = np.random.default_rng(3).permutation(6000)
    df = spark.createDataFrame([([float(v)],) for v in values], "x array<double>").repartition(2)
    (got,) = B.feature_cuts(df, "x", 1, 4)  # a run is 15 rows of 3,000
    assert len(got) == 3 and np.abs(got - np.array([1500, 3000, 4500])).max() <= 6000 / 400


def test_features_are_binned_by_many_tasks(spark):
    _, df = wide(spark)
    table, n, tasks = B._binned(df, "x", "y", B.feature_cuts(df, "x", 70, 16), Scratch(spark, "binned"))
    assert (n, tasks) == (600, 1) and len(table.inputFiles()) > 1


def test_margins_go_on_from_job_to_job(spark, monkeypatch):
    _, df = wide(spark)
    cuts = B.feature_cuts(df, "x", 70, 16)
    s = B.Boosting(trees=24, depth=4, step=0.3, rows=0.8, columns=0.7)
    whole = B.grow(df, "x", "y", cuts, s, Scratch(spark, "whole"))
    monkeypatch.setattr(B, "_ADVANCE", 1)
    parts = B.grow(df, "x", "y", cuts, s, Scratch(spark, "parts"))
    monkeypatch.setattr(B, "_ADVANCE", 25)
    assert any(len(t.feature) > 5 for t in whole) and [t.feature for t in parts] == [t.feature for t in whole]
    assert np.allclose([v for t in parts for v in t.value], [v for t in whole for v in t.value])


def test_sums_at_once_equal_sums_by_feature(monkeypatch):
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 30, (900, 12)).astype(np.uint8)
    bins[:, 4] = 3  # never varies
    labels = (bins[:, 0] + bins[:, 7] > 30).astype(np.int8)
    s, draws = B.Boosting(trees=6, depth=5, step=0.3), [np.sort(rng.choice(12, 9, replace=False)) for _ in range(6)]

    def trees():
        return list(B._trees_of_one_task(iter([(bins, labels, np.arange(900), np.zeros(900))]), 900, 12, 0, draws, s))

    at_once = trees()
    monkeypatch.setattr(B, "_FEW", 0)
    assert at_once == trees() and all(len(t.feature) > 3 and 4 not in t.feature for t in at_once)


def test_rows_too_light_for_a_cut_are_not_summed(monkeypatch):
    bins, labels = np.arange(40, dtype=np.uint8)[:, None], (np.arange(40) % 2).astype(np.int8)
    margins = np.where(labels == 1, 9.0, -9.0)  # a Hessian of 0.005 in all
    monkeypatch.setattr(B, "best_cuts", None)
    (tree,) = B._trees_of_one_task(iter([(bins, labels, np.arange(40), margins)]), 40, 1, 0, [np.array([0])], B.Boosting(rows=1.0))
    assert tree.feature == [-1] and type(tree.value[0]) is float


def test_products_hold_a_megabyte_not_all_cells():
    cells, block = np.ones(20_000), np.ones((100, 300))
    owner, picked = np.repeat(np.arange(200), 100), np.tile(np.arange(100), 200)
    into = np.zeros((200, 300))
    tracemalloc.start()
    SV._add(into, owner, picked, cells, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (into == 100).all() and peak < 8 << 20
