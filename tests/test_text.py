import hashlib
import math
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hookline.functions import labels as L
from hookline.functions import text as T
from hookline.operators.profile import char_entropy

ROWS = [
    "plain words here", "  two  blanks\tand a tab ", "no\xa0break", "vertical\x0btab", "unit\x1fseparator", "next\x85line",
    " em　wide ", "", "   ", None, "ΑΣ straße İx", "line\r\nline\n\n", "😀 emoji .",
]


def column(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")


def values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def clean(s):
    return re.sub(r"\s+", " ", s or "").strip()


def norm(s):
    return " ".join((s or "").strip().lower().split())


def test_cleaning_matches_python(spark):
    df = column(spark, ROWS)
    c = F.col("s")
    assert values(df, T.clean_text(c)) == [clean(s) for s in ROWS]
    assert values(df, T.strip_text(c)) == [(s or "").strip() for s in ROWS]
    assert values(df, T.normalize_text(c)) == [norm(s) for s in ROWS]
    assert values(df, T.text_hash(c)) == [hashlib.sha256(norm(s).encode()).hexdigest() for s in ROWS]
    assert values(df, T.text_length(c)) == [len(s or "") for s in ROWS]
    assert values(df, T.has_text(c)) == [bool((s or "").strip()) for s in ROWS]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab\t\n\x0b\x1c\x1f \x85\xa0  　é"), max_size=20), min_size=1, max_size=30))
def test_whitespace_property(spark, rows):
    df = column(spark, rows)
    assert values(df, T.clean_text(F.col("s"))) == [clean(s) for s in rows]
    assert values(df, T.strip_text(F.col("s"))) == [s.strip() for s in rows]


def test_composed_texts(spark):
    df = spark.createDataFrame([("a@b", "Hi", "Text"), ("", "", "Body"), ("", "", "")], "f string, s string, b string")
    f, s, b = F.col("f"), F.col("s"), F.col("b")
    assert [r[0] for r in df.select(T.tagged_text(f, s, b)).collect()] == [
        "Sender: a@b\nSubject: Hi\nBody: Text", "Body: Body", "",
    ]
    assert df.select(T.subject_body_text(s, b)).first()[0] == "Subject: Hi\nBody: Text"
    assert df.select(T.message_text(s, f, b)).first()[0] == "Subject: Hi\nFrom: a@b\n\nText"


def test_truncate_keeps_first_words(spark):
    df = column(spark, [" ".join(f"w{i}" for i in range(300)), "", "one"])
    got = values(df, T.truncate_tokens(F.col("s")))
    assert got[0].split(" ") == [f"w{i}" for i in range(256)]
    assert got[1:] == ["", "one"]


def test_entropy(spark):
    rows = ["", "aaaa", "abab", "hello 😀 world"]
    got = {r["i"]: r["entropy"] for r in char_entropy(column(spark, rows), "i", "s").collect()}
    for i, s in enumerate(rows):
        want = -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0
        assert math.isclose(got[i], want, abs_tol=1e-12)


def test_labels(spark):
    spelled = ["1", "1.0", "Phish", " HAM ", "yes", "maybe", None, " legit\n", "FALSE"]
    df = column(spark, spelled)
    c = F.col("s")
    assert values(df, L.label_from_text(c)) == [1, None, 1, 0, 1, None, None, 0, 0]
    assert values(df, L.label_from_number(c)) == [1, 1, None, None, None, None, None, None, None]
    numbers = spark.createDataFrame([(0, 0), (1, 1), (2, 7), (3, None)], "i int, s int")
    assert values(numbers, L.flip_label(c)) == [1, 0, None, None]
    assert values(numbers, L.label_name(c)) == ["LEGITIMATE", "PHISHING", "UNKNOWN", "UNKNOWN"]


def test_numbers(spark):
    df = column(spark, ["1.5", "x", None, "-2"])
    assert values(df, T.numeric_or_zero(F.col("s"))) == [1.5, 0.0, 0.0, -2.0]
    odd = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, float("inf"), float("-inf"), float("nan"), None])], "i int, s double")
    assert values(odd, T.finite_or_zero(F.col("s"))) == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_thresholds(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.4999), (2, 0.7)], "i int, s double")
    assert values(df, L.threshold_label(F.col("s"))) == [1, 0, 1]
    assert values(df, L.argmax_label(1 - F.col("s"), F.col("s"))) == [0, 0, 1]


def test_entropy_of_long_texts_and_rare_characters(spark):
    letters = [chr(0x4E00 + i) for i in range(5000)]
    rows = [
        " ".join(letters[i % 5000] + "ab" for i in range(20000)),  # 5,001 different characters besides a and b
        "\U0001f600\U0001f601\U0001f600x\n\n\r \u2028",
        "a" * 100_000,
        "$.*\\2($1)",
    ]

    def plain(text):
        return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())

    found = char_entropy(column(spark, rows), "i", "s")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: r["entropy"] for r in found.collect()}
    assert len(got) == len(rows)
    assert all(math.isclose(got[i], plain(t), abs_tol=1e-9) for i, t in enumerate(rows))
