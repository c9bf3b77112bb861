"""What queries do must grow with their rows only, not with rows times components, nor pass through one task."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from hookline.checks import corpus_queries as C
from hookline.checks import model_queries as Q
from hookline.checks import views
from hookline.functions.url_features import URL_FEATURES
from hookline.operators import boosting as B
from hookline.operators import svd as SV
from hookline.operators import text_model as TM
from hookline.operators import url_model as UM
from hookline.session import Scratch


def pages(spark, path, n=60):
    rows = [(i, f"http{'s' * (i % 2)}://host{i % 7}.example.{('com', 'org')[i % 2]}/{'login' if i % 3 else 'spam-farm'}/{i % 11}?ref=x", "<p>") for i in range(n)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_svd_fit_counts_its_rows_once(spark, tmp_path, monkeypatch):
    counted, plain = [], DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda df: counted.append(df) or plain(df))
    rows = Q.svd_fit(spark, pages(spark, tmp_path)).collect()
    assert len(rows) > 20 and all(r.solves and r.within_total for r in rows)
    assert len(counted) < 12


def test_trees_of_a_small_table_take_a_job_for_many(spark, monkeypatch):
    df = spark.createDataFrame([([float(i % 7), float(i % 5)], int(i % 7 > 3) ^ int(i % 11 == 0)) for i in range(200)], "x array<double>, y int").repartition(3)
    s = B.Boosting(trees=8, depth=4, step=0.3)
    cuts = B.feature_cuts(df, "x", 2, 256)
    levels, plain = [], B._level
    monkeypatch.setattr(B, "_level", lambda *a: levels.append(a) or plain(*a))
    one = B.grow(df, "x", "y", cuts, s, Scratch(spark, "one"))
    assert not levels
    monkeypatch.setattr(B, "_TASK", 64)  # rows in many tasks, whatever the layout of the table
    many = B.grow(df.coalesce(1), "x", "y", cuts, B.Boosting(trees=8, depth=4, step=0.3, rows=1.0), Scratch(spark, "many"))
    monkeypatch.setattr(B, "_TASK", 1 << 24)
    alone = B.grow(df.coalesce(1), "x", "y", cuts, B.Boosting(trees=8, depth=4, step=0.3, rows=1.0), Scratch(spark, "alone"))
    assert levels and many == alone and len(one) == 8 and any(len(t.feature) > 3 for t in one)


def test_learning_curve_equals_the_library_and_reads_once(spark, monkeypatch):
    rows = [(i, *[float((i * (j + 3)) % 7) for j in range(len(URL_FEATURES))], int((i * 3) % 7 > 3)) for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"`{c}` double" for c in URL_FEATURES) + ", label int").repartition(3)
    model = UM.fit_url_model(df, trees=4, depth=3)
    train, val = df.where("id < 60"), df.where("id >= 60")
    trees = UM.boosted_trees(model)
    want = [trees.evaluateEachIteration(UM.assemble(t).withColumn("label", F.col("label").cast("double"))) for t in (train, val)]
    monkeypatch.setattr(type(trees), "evaluateEachIteration", None)
    got = UM.learning_curve(model, train, val).collect()
    assert [r["round"] for r in got] == [1, 2, 3, 4]
    for name, values in zip(("train_log_loss", "val_log_loss"), want):
        assert [r[name] for r in got] == pytest.approx([v / 2 for v in values])


def test_mails_are_not_written_by_one_task(spark, sf, monkeypatch):
    monkeypatch.setattr(DataFrame, "coalesce", lambda df, n: pytest.fail("all rows in one task"))
    assert C.src_csv_split(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(list(Q._arrivals(spark, sf))) == 5


def test_texts_of_the_mails_meet_one_join(spark, sf):
    def joins_with_texts(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        here = node.nodeName() == "Join" and any(node.children().apply(0).output().apply(i).name() == "text" for i in range(children[0].output().size()))
        return here + sum(map(joins_with_texts, children))

    assert joins_with_texts(views.emails(spark, sf)._jdf.queryExecution().optimizedPlan()) == 1


def test_no_block_passes_through_the_driver(spark, tmp_path, monkeypatch):
    collected, plain = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: collected.append(df.columns) or plain(df))
    monkeypatch.setattr(SV, "_collected", lambda *a: pytest.fail("a block on the driver"))
    sf = pages(spark, tmp_path)
    assert all(r.within_length for r in plain(Q.svd_transform(spark, sf)))
    assert all(r.svd_within_length and r.n_features > 25 for r in plain(Q.jn_hstack(spark, sf)))
    assert collected


def test_saved_matrix_is_read_by_its_cells(spark, tmp_path):
    sf = pages(spark, tmp_path)
    out = Q.snk_matrix(spark, sf)
    assert "UDF(" not in out._jdf.queryExecution().analyzed().toString()  # no array with a number for each term
    want = {r.url_id: r.indices for r in Q._tfidf(spark, sf).weights(views.urls(spark, sf), "url_id", "url").collect()}
    got = {r.url_id: r for r in out.collect()}
    assert len(got) == 60 and all(got[i].non_zeros == len(c) > 0 and got[i].places == sum(c) for i, c in want.items())
    assert all(r.length == 1.0 for r in got.values())


def test_words_of_the_training_texts_are_counted_once(spark, sf, monkeypatch):
    fitted, counted = [], []
    for stage in (TM.IDF, TM.LogisticRegression):
        monkeypatch.setattr(stage, "fit", lambda self, df, plain=stage.fit: fitted.append(df) or plain(self, df))
    df = spark.createDataFrame([(f"pay now {i}" if i % 2 else f"see you {i}", i % 2) for i in range(40)], "text string, label int")
    model = TM.fit_text_model(df, hash_size=64)
    assert len(fitted) == 2 and not any("_words" in f._jdf.queryExecution().analyzed().toString() for f in fitted)
    whole = Pipeline(stages=[
        *model.stages[:2], TM.IDF(inputCol="_counts", outputCol="_weighted"),
        TM.LogisticRegression(featuresCol="_weighted", labelCol="label", regParam=1e-3, maxIter=50),
    ]).fit(df.withColumn("label", F.col("label").cast("double")))
    got, want = ([r.text_probability for r in TM.score_text(m, df).orderBy("text").collect()] for m in (model, whole))
    assert got == pytest.approx(want, abs=1e-6)


def test_candidates_share_the_counted_words(spark, sf, monkeypatch):
    counted, plain = [], TM.count_words
    monkeypatch.setattr(Q, "_FITTED", {})
    monkeypatch.setattr(TM, "count_words", lambda *a: counted.append(a) or plain(*a))
    assert all(r.follows for r in Q.mdl_select_best(spark, sf).collect()) and len(counted) == 1
