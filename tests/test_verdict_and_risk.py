import json

import pytest
from pyspark.sql import functions as F

from hookline.functions import risk as R
from hookline.functions import verdict as V
from hookline.operators.metrics import verdict_accuracy
from hookline.operators.scores import with_max_over_urls


def verdicts(spark, responses, mode="live"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(responses)], "i int, response string")
    return V.with_verdict(df, mode=mode).orderBy("i").collect()


def test_live_verdicts(spark):
    ok = json.dumps({"is_phishing": True, "explanation": "a \"b\"\nc"})
    rows = verdicts(spark, [ok, f"```json\n{ok}\n```", f"  ```\n{ok}```  ", "{broken", '{"x": 1}', "[1]", "", None, "3"])
    assert [r["is_phishing"] for r in rows] == [True, True, True, None, None, None, None, None, None]
    assert rows[1]["explanation"] == 'a "b"\nc'
    assert [r["error"] is not None for r in rows] == [False, False, False, True, False, True, True, True, True]
    assert rows[3]["raw_response"] == "{broken" and rows[4]["raw_response"] is None
    assert [r["predicted"] for r in rows] == [1, 1, 1, None, 0, None, None, None, None]


def test_test_mode_drops_first_line(spark):
    rows = verdicts(spark, ['```json\n{"is_phishing": false}\n```', '```{"is_phishing": 1}```', '```\n{\n"is_phishing": true}```'], "test")
    assert rows[0]["is_phishing"] is False and rows[0]["predicted"] == 0
    assert rows[1]["predicted"] == 1
    assert rows[2]["error"] == V.PARSE_ERROR  # the first line holds the opening brace


@pytest.mark.parametrize("value,want", [("true", 1), ("false", 0), ("null", 0), ("0", 0), ("2", 1), ('""', 0), ('"no"', 1), ("[]", 0), ("[0]", 1)])
def test_truthiness(spark, value, want):
    assert verdicts(spark, ['{"is_phishing": %s}' % value])[0]["predicted"] == want


def test_accuracy_counts_parse_failures(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, None)], "label int, predicted int")
    r = verdict_accuracy(df).first()
    assert (r["total"], r["correct"], r["misclassified"], r["unparsed"]) == (3, 1, 2, 1)


def test_prompt(spark):
    df = spark.createDataFrame([("S", None, "B")], "s string, f string, b string")
    with_sender = df.select(V.verdict_prompt(F.col("s"), F.col("b"), F.col("f"))).first()[0]
    assert with_sender.startswith("\n    You are an expert in phishing email detection.\n\n    Analyze")
    assert with_sender.endswith("    Email:\n    Subject: S\n    From: None\n    Body: B\n    ")
    assert "From" not in df.select(V.verdict_prompt(F.col("s"), F.col("b"))).first()[0]


def test_percent_rounds_like_python(spark):
    values = [0.5, 0.02675, 0.12345, 0.00125, 0.00375, 1.0, 0.0, 0.61235, 0.999949, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    assert [r[0] for r in df.select(R.percent(F.col("p"))).collect()] == [round(v * 100, 2) for v in values]


def test_levels(spark):
    df = spark.createDataFrame([(0.5,), (0.7,), (0.4999999,), (0.6999999,)], "r double")
    assert [tuple(r) for r in df.select(R.is_phishing(F.col("r")), R.risk_level(F.col("r"))).collect()] == [
        (True, "Medium"), (True, "High"), (False, "Low"), (True, "Medium"),
    ]


def test_no_url_never_reaches_high(spark):
    df = spark.createDataFrame([(1.0, [])], "t double, scores array<double>")
    row = with_max_over_urls(df, F.col("scores")).withColumn("risk", R.fused_risk(F.col("t"), F.col("url_probability"))).first()
    assert row["url_probability"] == 0.0 and row["risk"] == 0.6
