import pytest
from pyspark.sql import functions as F

from hookline import session
from hookline.operators import text_model as TM
from hookline.operators import url_model as UM
from hookline.functions.url_features import URL_FEATURES, with_url_features
from hookline.plans import scoring as SC
from hookline.plans import text_corpus as C
from hookline.plans import url_corpus as U
from hookline.sources import columns, readers, writers
from hookline.streaming import jobs


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' Subject ,BODY,Label\n"He said ""hi""","line 1\nline 2"," ham "\nx,,1\n', encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["subject", "body", "label"]
    assert [tuple(r) for r in df.collect()] == [('He said "hi"', "line 1\nline 2", " ham "), ("x", None, "1")]


def test_many_files(spark, tmp_path, caplog):
    (tmp_path / "b.csv").write_text("label,body\n1,one\n")
    (tmp_path / "a.csv").write_text("subject,label\ns,0\n")
    (tmp_path / "c_VECTORIZED.csv").write_text("label,body\n1,skip\n")
    (tmp_path / "d.csv").write_text("body\nnolabel\n")
    (tmp_path / "e.txt").write_text("label\n1\n")
    paths = readers.list_files(spark, str(tmp_path))
    assert [readers.file_stem(p) for p in paths] == ["a", "b", "c_VECTORIZED", "d"]
    df = readers.read_many(spark, [*paths, str(tmp_path / "missing.csv")])
    assert sorted((r["source"], r["label"], r["body"], r["subject"]) for r in df.collect()) == [
        ("curated_a", "0", None, "s"), ("curated_b", "1", "one", None),
    ]
    assert readers.read_many(spark, [str(tmp_path / "d.csv")]) is None


def test_malformed_rows_put_their_file_out(spark, tmp_path):
    (tmp_path / "fine.csv").write_text('id,label\n1,"a\nb"\n')
    (tmp_path / "long.csv").write_text("id,label\n1,x\n2,phish,extra,more\n")
    (tmp_path / "short.csv").write_text("id,label\n1,x\n2\n")
    (tmp_path / "with space+.csv").write_text("label,id\nx,7\n")
    rows = readers.read_many(spark, readers.list_files(spark, str(tmp_path))).collect()
    assert sorted((r["source"], r["id"], r["label"]) for r in rows) == [("curated_fine", "1", "a\nb"), ("curated_with space+", "7", "x")]
    assert readers.read_csv_or_none(spark, str(tmp_path / "long.csv")) is None
    bad = [r["_malformed"] for t in readers.by_header(spark, [str(tmp_path / "long.csv")]) for r in t.collect()]
    assert bad == [None, "2,phish,extra,more"]


def test_jobs_and_scans_do_not_grow_with_the_files(spark, tmp_path):
    for i in range(50):
        (tmp_path / f"f{i}.csv").write_text(f"id,label\n{i},x\n" if i % 2 else f"label,id\nx,{i}\n")
    paths = [str(tmp_path / f"f{i}.csv") for i in range(50)]
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for n in (36, 50):  # both beyond 32, from where Spark lists files in a job of its own
        spark.sparkContext.setJobGroup(f"csv-{n}", "")
        df = readers.read_many(spark, paths[:n])
        jobs[n] = len(tracker.getJobIdsForGroup(f"csv-{n}"))
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2 and df.count() == n
    assert jobs[50] == jobs[36]


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "Target int, LABEL int, Message int, raw_text int")
    assert columns.first_in_table(df, columns.ANY_LABEL) == "Target"
    assert columns.first_by_priority(df, columns.LABEL_BY_PRIORITY) == "LABEL"
    assert columns.first_by_priority(df, columns.TEXT_BY_PRIORITY) == "raw_text"
    assert columns.first_by_priority(df, ["nothing"]) is None
    with pytest.raises(ValueError, match="'a', 'b'"):
        columns.require(df, ["a", "Target", "b"])


def test_prepare_sources(spark):
    mail = spark.createDataFrame([(1, " S ", "B\n b", "phish"), (2, "x", "y", "??")], "id long, Subject string, body string, label string")
    row = C.prepare_email(mail, "id", F.lit("m")).collect()
    assert [tuple(r) for r in row] == [(1, "m", "S", "", "B b", "", "Subject: S\nBody: B b", 1)]
    listed = spark.createDataFrame([(1, "t", "0"), (2, "t", "0"), (3, "t", "1"), (4, None, "1")], "id long, body string, class string")
    got = sorted((r["id"], r["text"], r["label"]) for r in C.prepare_list_mail(listed, "id").collect())
    assert got == [(1, "Subject: \nBody: t", 0), (3, "Subject: \nBody: t", 1), (4, "Subject: \nBody: ", 1)]
    short = spark.createDataFrame([(1, " a ", "spam", "no"), (2, " ", "x", "yes"), (3, "a", "y", "no")], "id long, message string, type string, target string")
    got = C.prepare_short_text(short, "id").collect()
    assert [(r["id"], r["text"], r["raw_text"], r["source_type"], r["label"]) for r in got] == [(1, "a", "a", "spam", 0)]
    with pytest.raises(ValueError, match="text"):
        C.prepare_short_text(short.drop("message"), "id")


def test_url_dataset(spark):
    numbers = {c: F.lit("1.5") for c in U.URL_NUMERIC}
    raw = spark.createDataFrame(
        [(1, "http://a", 1), (2, "http://a", 1), (3, "http://a", 0), (4, None, 1), (5, "http://b", None)], "k long, URL string, label int"
    ).withColumns(numbers).withColumn("Domain", F.lit(None).cast("string")).withColumn("Bank", F.lit("bad"))
    rows = U.prepare_url_dataset(raw, "k").orderBy("id").collect()
    assert [(r["id"], r["URL"], r["label"], r["Domain"], r["Bank"], r["Pay"]) for r in rows] == [
        (1, "http://a", 0, "", 0.0, 1.5), (2, "http://a", 1, "", 0.0, 1.5), (3, "", 0, "", 0.0, 1.5),
    ]
    with pytest.raises(ValueError, match="Crypto"):
        U.prepare_url_dataset(raw.drop("Crypto"), "k")


def test_domain_split(spark):
    df = spark.createDataFrame([(i, f"http://a{i % 50}.example.co.uk/{i}", i % 2) for i in range(400)], "id long, url string, label int")
    out = U.split_by_domain(df, ["co.uk"]).collect()
    assert len(out) == 400
    per_group = {}
    for r in out:
        per_group.setdefault(r["domain_group"], set()).add(r["split"])
    assert per_group == {"example.co.uk": per_group["example.co.uk"]} and len(per_group["example.co.uk"]) == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "q"\nb ', "train"), (2, "c", "val")], "id long, text string, split string")
    writers.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s") + "/split=val").count() == 1
    writers.write_table(df, str(tmp_path / "t"), "csv")
    assert sorted(r["text"] for r in readers.read_csv(spark, str(tmp_path / "t")).collect()) == [' a "q"\nb ', "c"]
    writers.write_metrics(df.limit(1), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    writers.save_feature_names(spark, URL_FEATURES, str(tmp_path / "f"))
    names = [r["feature"] for r in spark.read.json(str(tmp_path / "f")).orderBy("position").collect()]
    assert names == URL_FEATURES


def test_shared_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.shared_dir(spark) == configured.rstrip("/")
    df = session.materialize(spark.range(10), "t")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def models(spark):
    urls = [(f"https://site{i}.example.com/{i}", 0) for i in range(30)] + [(f"http://10.0.0.{i}/pay?password={i}", 1) for i in range(30)]
    table = with_url_features(spark.createDataFrame(urls, "url string, label int").coalesce(1))
    texts = [(f"verify account now {i}", 1) for i in range(20)] + [(f"lunch plans today {i}", 0) for i in range(20)]
    text = spark.createDataFrame(texts, "text string, label int").coalesce(1)
    return SC.EmailModels(TM.fit_text_model(text, hash_size=512), UM.fit_url_model(table, trees=3, depth=2))


MAILS = [
    (1, "verify account", "a@b", "see http://10.0.0.5/pay?password=5. or https://site1.example.com/1"),
    (2, "lunch", None, "plans today"),
    (3, None, None, None),
    (4, "verify", "x", "http://[::1] http://10.0.0.5/pay?password=5 http://10.0.0.5/pay?password=5"),
]
MAIL_SCHEMA = "id long, subject string, sender string, body string"


def test_a_mail_that_is_sent_again_is_scored_again(spark, models):
    mails = spark.createDataFrame([(1, "a", "one"), (2, "b", "two"), (1, "c", "three http://x.com/y")], "id long, subject string, body string")
    rows = sorted((r["id"], r["url_count"]) for r in SC.score_emails(mails, models).collect())
    assert rows == [(1, 0), (1, 1), (2, 0)]


def test_score_emails(spark, models):
    mails = spark.createDataFrame(MAILS, MAIL_SCHEMA)
    rows = {r["id"]: r for r in SC.score_emails(mails, models).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[2]["url_probability"] == 0.0 and rows[2]["urls"] == [] and rows[3]["url_count"] == 0
    assert rows[4]["url_count"] == 3 and rows[4]["urls"][0] == "http://[::1"
    single = {r["url"]: r["probability"] for r in UM.score_urls(models.url, spark.createDataFrame([(u,) for u in rows[1]["urls"]], "url string")).collect()}
    assert rows[1]["url_probability"] == round(max(single.values()) * 100, 2)
    text = TM.score_text(models.text, SC.as_messages(mails, "id"), "message").collect()
    for r in text:
        assert rows[r["id"]]["text_probability"] == round(r["text_probability"] * 100, 2)
        risk = 0.6 * r["text_probability"]
        if not rows[r["id"]]["urls"]:
            assert rows[r["id"]]["risk_score"] == round(risk * 100, 2) and rows[r["id"]]["risk_level"] != "High"
    plan = SC.score_emails(mails, models)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_missing_columns_count_as_empty(spark, models):
    row = SC.score_emails(spark.createDataFrame([(1, "hi")], "id long, body string"), models).first()
    assert row["url_count"] == 0


def test_distinct_urls_are_scored_once_and_joined_back(spark):
    rows = [(i, "http://10.0.0.1/pay" if i % 3 else f"https://s{i}.com/") for i in range(200)]
    urls = spark.createDataFrame([(i, u, int("pay" in u)) for i, u in rows], "id long, url string, label int")
    distinct = urls.dropDuplicates(["url"]).select("id", "url", "label")
    model = UM.fit_url_plus_model(distinct, "id", trees=2, depth=2, components=3, max_features=50, min_documents=1)
    exploded = urls.select("id", F.lit(0).alias("pos"), "url").unionByName(
        spark.createDataFrame([(999, None, None)], "id long, pos int, url string")
    )
    got = {r["id"]: r["probability"] for r in SC.score_distinct_urls(exploded, model, "id").collect()}
    direct = {r["id"]: r["probability"] for r in model.score(urls, "id").collect()}
    assert got.pop(999) is None
    assert got == pytest.approx(direct)
    text = TM.fit_text_model(spark.createDataFrame([("a b", 0), ("c d", 1)], "text string, label int"), hash_size=64)
    mails = urls.select("id", F.lit("a").alias("text"), F.concat(F.lit("['"), "url", F.lit("']")).alias("url"), "label")
    listed = SC.score_listed_urls(mails, text, model).collect()
    assert len(listed) == 200 and all(r["url_count"] == 1 for r in listed)
    with pytest.raises(ValueError, match="no URL"):
        SC.score_listed_urls(mails.withColumn("url", F.lit("")), text, model)


def test_stream_scores_equal_batch_scores(spark, models, tmp_path):
    mails = spark.createDataFrame(MAILS, MAIL_SCHEMA).repartition(3)
    mails.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MAIL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.score_stream(stream, models, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("batch_id").collect()))
    assert got == sorted(map(str, SC.score_emails(mails, models).collect()))


def test_resent_mails_are_dropped(spark, tmp_path):
    rows = [(1, "s", "a", "body", 0), (2, "s", "a", "body", 60), (3, "s", "a", "other", 61), (4, "s", "a", "  ", 62)]
    df = spark.createDataFrame(rows, MAIL_SCHEMA + ", t long").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t"))).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.append_stream(jobs.drop_resent(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["body"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["body", "other"]
