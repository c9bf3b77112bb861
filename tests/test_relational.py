import hashlib
import random
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from hookline.operators import dedup as DD
from hookline.operators import metrics as M
from hookline.operators import profile as P
from hookline.operators import splits as S
from hookline.operators.group_split import group_split, place_heavy_groups
from hookline.operators.lookup import lookup_join
from hookline.operators.ordered import exact_quantiles, prefix_sums, sequence_id
from hookline.operators.overlap import split_overlap
from hookline.plans import text_corpus as C


def test_keep_first_with_hot_message(spark):
    rows = [(i % 3, i, "HOT  message" if i % 3 == 0 else f"text {i % 40}", i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "priority int, id long, text string, label int").repartition(7)
    got = sorted(tuple(r) for r in DD.distinct_messages(df, ["priority", "id"]).collect())
    want = {}
    for r in sorted(rows):
        want.setdefault(" ".join(r[2].lower().split()), r)
    assert got == sorted(want.values())
    counts = DD.duplicate_counts(df, [F.col("text")]).first()
    assert (counts["rows"], counts["duplicate_rows"]) == (600, 600 - len({r[2] for r in rows}))


def test_keep_first_aggregates_hashes_only(spark):
    df = spark.range(200).selectExpr("id", "cast(id % 3 AS int) AS priority", "concat('t', id % 9) AS text", "cast(id % 2 AS int) AS label")
    for out in (DD.distinct_text_label(df, ["id"]), DD.distinct_messages(df, ["priority", "id"])):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_later_copy_loses_with_other_label(spark):
    a = spark.createDataFrame([(1, "mail", "Same  Text", 1), (2, "mail", " ", 0)], "id long, source string, text string, label int")
    b = spark.createDataFrame([(1, "x", "same text", 0), (2, "x", "new", 0), (3, "x", "bad label", 5)], "id long, source string, text string, label int")
    rows = C.build_text_dataset([a, b], "id").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "mail", "Same  Text", 1), (2, "x", "new", 0)]


def test_conflicts(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0), ("c", None)], "u string, label int")
    r = DD.label_conflicts(df, ["u"]).first()
    assert (r["rows"], r["distinct_keys"], r["duplicate_rows"], r["conflicting_keys"]) == (5, 3, 2, 1)


def test_sequence_id_is_gap_free_over_many_partitions(spark):
    ids = random.Random(1).sample(range(10**6), 5000)
    df = spark.createDataFrame([(i % 2, i) for i in ids], "p int, k long").repartition(13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sequence_id(df, ["p", "k"]).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["id"] for r in rows] == list(range(1, 5001))
    assert [(r["p"], r["k"]) for r in rows] == sorted((i % 2, i) for i in ids)


def test_prefix_sums_and_quantiles(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([np.zeros(500), rng.random(700).round(2), rng.normal(size=300)])
    df = spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(values)], "v double, g string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = df.groupBy("v").agg(F.count("*").alias("n"))
        rows = sorted((r["v"], r["n"], r["n_before"]) for r in prefix_sums(counted, "v", ["n"]).collect())
        probabilities = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
        whole = exact_quantiles(df, "v", probabilities).first()
        grouped = {r["g"]: list(r)[1:] for r in exact_quantiles(df, "v", probabilities, by=["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    before = 0
    for _, n, b in rows:
        assert b == before
        before += n
    assert list(whole) == pytest.approx(np.quantile(values, probabilities))
    for g in "ab":
        part = [v for i, v in enumerate(values) if ("a" if i % 3 else "b") == g]
        assert grouped[g] == pytest.approx(np.quantile(part, probabilities))


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]).first()["q0"] is None


def test_lookup_join_with_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 5000}" if i % 7 else None) for i in range(20000)]
    df = spark.createDataFrame(rows, "id long, key string")
    counts = Counter(k for _, k in rows if k)
    lookup = spark.createDataFrame([(k, len(k), n) for k, n in counts.items() if k != "k1"], "key string, size int, n long")
    got = {r["id"]: r["size"] for r in lookup_join(df, lookup, "key", "id", "n", total=len(rows)).collect()}
    assert got == {i: (len(k) if k and k != "k1" else None) for i, k in rows}
    inner = lookup_join(df, lookup, "key", "id", "n", total=len(rows), how="inner")
    assert inner.count() == sum(1 for _, k in rows if k and k != "k1")


def test_rows_without_a_key_spread_over_the_tasks(spark):
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(20000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN concat('k', id) END AS key")
        lookup = df.where("key IS NOT NULL").selectExpr("key", "id AS size", "1L AS n")
        out = lookup_join(df, lookup, "key", "id", "n", total=5000).withColumn("task", F.spark_partition_id())
        per_task = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 20000 and len(per_task) == 8 and max(per_task) < 2 * 20000 / 8


def split_by_hand(rows, scheme):
    """rows: (id, label). Plain statement of the contract."""
    sch = S.SCHEMES[scheme]

    def deal(avail, share):
        total = sum(avail.values())
        kept = total - ceil(share * total)
        exact = {k: divmod(v * kept, total) if total else (v, 0) for k, v in avail.items()}
        out = {k: e[0] for k, e in exact.items()}
        for k in sorted(avail, key=lambda k: (-exact[k][1], k))[: kept - sum(out.values())]:
            out[k] += 1
        return out

    n = Counter(label for _, label in rows)
    kept = deal(n, sch.held)
    if sch.from_rest:
        train = deal(kept, sch.second)
        cuts = {k: (train[k], kept[k]) for k in n}
    else:
        val = deal({k: n[k] - kept[k] for k in n}, sch.second)
        cuts = {k: (kept[k], kept[k] + val[k]) for k in n}
    out = {}
    for label in n:
        order = sorted((i for i, lab in rows if lab == label), key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())
        for place, i in enumerate(order, start=1):
            out[i] = "train" if place <= cuts[label][0] else "val" if place <= cuts[label][1] else "test"
    return out


@pytest.mark.parametrize("scheme", ["80_10_10", "70_15_15", "70_10_20"])
@pytest.mark.parametrize("n,ones", [(1000, 13), (57, 1), (3, 0), (1, 1)])
def test_stratified_split(spark, scheme, n, ones):
    rows = [(i * 7, 1 if i < ones else 0) for i in range(n)]
    df = spark.createDataFrame([*rows, (-1, None)], "id long, label int")
    got = {r["id"]: r["split"] for r in S.stratified_split(df, scheme).collect()}
    assert got == split_by_hand(rows, scheme)


def test_split_sizes():
    assert S.cut_sizes({0: 90, 1: 10}, S.SCHEMES["80_10_10"]) == {0: (72, 81), 1: (8, 9)}
    assert S.cut_sizes({0: 70, 1: 30}, S.SCHEMES["70_10_20"]) == {0: (49, 56), 1: (21, 24)}


def test_sample_per_class(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "id long, label int")
    picked = S.sample_per_class(df).collect()
    assert Counter(r["label"] for r in picked) == {0: 10, 1: 10}
    assert sorted(r["position"] for r in picked) == list(range(1, 21))
    assert sorted(r["id"] for r in picked) == sorted(r["id"] for r in S.sample_per_class(df.repartition(9)).collect())


def test_group_split_keeps_groups_whole(spark):
    rng = random.Random(3)
    rows = []
    for i in range(9000):
        group = "" if i % 3 == 0 else f"big{rng.randrange(4)}" if i % 5 == 0 else f"d{rng.randrange(3000)}"
        rows.append((i, group, int(rng.random() < 0.2)))
    df = spark.createDataFrame(rows, "id long, g string, label int")
    out = group_split(df, "g").collect()
    assert len(out) == len(rows)
    seen = defaultdict(set)
    for r in out:
        seen[r["g"]].add(r["split"])
    assert all(len(s) == 1 for s in seen.values())
    share = Counter(r["split"] for r in out if r["g"].startswith("d"))
    total = sum(share.values())
    assert abs(share["train"] / total - 0.8) < 0.02 and abs(share["val"] / total - 0.1) < 0.02
    overlap = split_overlap(group_split(df, "g"), F.col("g")).collect()
    assert all(r["shared"] == 0 and r["status"] == "PASS" for r in overlap)


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"g{i % 10}", 0) for i in range(40)], "id long, g string, label int")
    out = group_split(df, "g").collect()
    assert len(out) == 40 and len({r["split"] for r in out if r["g"] is None}) == 1


def test_column_pruning_and_sketch(spark, sf):
    from hookline.checks.corpus_queries import src_prune

    plan = src_prune(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "struct<url:string>" in plan
    df = spark.createDataFrame([(i % 50,) for i in range(500)], "v int")
    assert tuple(P.distinct_count(df, "v").first()) == (500, 50, 450)
    assert abs(P.distinct_count(df, "v", approximate=True).first()["distinct_rows"] - 50) <= 5


def test_heavy_groups_spread():
    groups = [(f"g{i}", 100, 0) for i in range(10)] + [(f"h{i}", 0, 10) for i in range(5)]
    placed = place_heavy_groups(groups, (1000, 50), 5)
    assert Counter(placed[f"g{i}"] for i in range(10)) == {f: 2 for f in range(5)}
    assert Counter(placed[f"h{i}"] for i in range(5)) == {f: 1 for f in range(5)}


def test_overlap(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "val"), ("b", "test"), ("b", "test"), ("c", "train")], "k string, split string")
    assert {(r["left"], r["right"]): (r["shared"], r["status"]) for r in split_overlap(df, F.col("k")).collect()} == {
        ("train", "val"): (1, "WARNING"), ("train", "test"): (0, "PASS"), ("val", "test"): (1, "WARNING"),
    }


def auc_by_hand(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_auc_with_heavy_ties(spark):
    rng = random.Random(0)
    rows = [(int(rng.random() < 0.3), rng.choice([0.0, -0.0, 0.5, round(rng.random(), 2)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert M.roc_auc(df).first()[0] == pytest.approx(auc_by_hand(rows), abs=1e-12)
    one_class = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    assert M.roc_auc(one_class).first()[0] is None


def test_binary_metrics_without_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "label int, predicted int")
    r = M.binary_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    assert r["accuracy"] == pytest.approx(2 / 3)
    report = {x["name"]: x for x in M.classification_report(df).collect()}
    assert report["LEGITIMATE"]["recall"] == 1.0 and report["PHISHING"]["support"] == 1
    assert report["macro avg"]["precision"] == pytest.approx(1 / 3)
    assert report["weighted avg"]["recall"] == pytest.approx(2 / 3)


def test_evaluate_scores(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.6), (1, 0.5), (1, 0.9)], "label int, probability double")
    r = M.evaluate_scores(df).first()
    assert r["confusion_matrix"] == [[1, 1], [0, 2]] and r["samples"] == 4 and r["roc_auc"] == 0.75


def test_profile(spark):
    df = spark.createDataFrame(
        [("a", "x" * 10, 0), ("a", "x" * 1500, 1), ("b", None, 1), (None, "y" * 30, 0)], "source string, text string, label int"
    )
    stats = P.length_stats(df).first()
    assert (stats["min_len"], stats["max_len"], stats["median_len"], stats["n_empty"], stats["n_below_20"]) == (0, 1500, 20.0, 1, 2)
    assert {r["bucket"]: r["n"] for r in P.length_buckets(df).collect()}["> 1000"] == 1
    quantiles = P.length_quantiles(df).first()
    assert list(quantiles) == pytest.approx(np.quantile([10, 1500, 0, 30], P.LENGTH_QUANTILES))
    assert [tuple(r) for r in P.null_counts(df).collect()] == [("source", 1), ("text", 1)]
    assert {r["source"]: (r["legitimate"], r["phishing"]) for r in P.source_by_label(df).collect()} == {"a": (1, 1), "b": (0, 1), None: (1, 0)}
    assert P.source_counts(df, keep_null=False).count() == 2
    assert [r["value"] for r in P.label_candidates(df).orderBy("place").collect()] == ["0", "1"]
    assert P.label_candidates(df.drop("label")).count() == 0
    assert P.shape(df).first()["n_rows"] == 4
