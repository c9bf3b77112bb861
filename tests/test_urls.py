import pytest
from pyspark.sql import functions as F

from hookline.functions.url_features import URL_FEATURES, with_url_features
from hookline.functions.urls import canonical_url, extract_urls, url_domain
from hookline.operators.domains import COMMON_SUFFIXES, read_suffix_rules, with_registered_domain

GOLDEN = {
    "": ",".join("0" * 25),
    "  Example.com/a%20b ": "24,11,0,0,1,1,0.0416667,16,0.666667,2,0,0,0,6,0.25,0,0,0,0,0,0,0,0,0,0",
    "http://user@evil.com:8080/x\\y?pwd=1": "35,8,0,0,1,2,0.0571429,20,0.571429,5,1,1,0,10,0.285714,0,0,0,0,0,1,0,0,0,0",
    "HTTPS://netflix.com/http://bank.example.org": "43,11,0,0,0,0,0,33,0.767442,0,0,0,0,10,0.232558,1,1,0,0,1,0,1,0,0,0",
    "http://[::1]/": "13,1,0,0,0,0,0,4,0.307692,1,0,0,0,8,0.615385,0,0,0,0,0,0,0,0,0,0",
    "http://999.1.1.1/": "17,9,0,2,0,0,0,4,0.235294,6,0,0,0,7,0.411765,0,0,0,0,0,0,0,0,0,0",
    "https://a.b.c.example.co.uk/wallet": "34,19,0,4,0,0,0,25,0.735294,0,0,0,0,9,0.264706,1,0,0,0,0,0,0,0,1,0",
}


def test_golden_features(spark):
    df = spark.createDataFrame([(u,) for u in GOLDEN], "url string")
    for row in with_url_features(df).collect():
        want = [float(v) for v in GOLDEN[row["url"]].split(",")]
        assert [row[c] for c in URL_FEATURES] == pytest.approx(want, abs=1e-6), row["url"]


# For each feature the smallest URL that sets it, and the value; every other feature of interest stays as "z" has it.
SMALLEST = {
    "Crypto": ("usdt", 1), "Pay": ("pay", 1), "Bank": ("bank", 1), "HasPasswordField": ("pwd", 1), "HasSocialNet": ("x.com", 1),
    "NoOfURLRedirect": ("z/http://", 1), "IsHTTPS": ("https://z", 1), "NoOfAmpersandInURL": ("z/&", 1), "NoOfQMarkInURL": ("z?", 1),
    "NoOfEqualsInURL": ("z/=", 1), "NoOfDegitsInURL": ("z7", 1), "NoOfObfuscatedChar": ("z/%7e", 1), "HasObfuscation": ("@z", 1),
    "NoOfSubDomain": ("u.v.w", 1), "IsDomainIP": ("0.0.0.0", 1), "DomainLength": ("z", 1), "URLLength": ("z", 8),
    "NoOfLettersInURL": ("z", 5), "NoOfOtherSpecialCharsInURL": ("z", 3), "SpacialCharRatioInURL": ("z", 3 / 8),
    "LetterRatioInURL": ("z", 5 / 8), "ObfuscationRatio": ("z%7e", 1 / 11),
    "NoOfSelfRedirect": ("z", 0), "HasExternalFormSubmit": ("z", 0), "NoOfExternalRef": ("z", 0),
}


def test_smallest_url_of_each_feature(spark):
    assert set(SMALLEST) == set(URL_FEATURES)
    urls = sorted({u for u, _ in SMALLEST.values()})
    rows = {r["url"]: r for r in with_url_features(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    for name, (url, value) in SMALLEST.items():
        assert rows[url][name] == pytest.approx(value, abs=1e-9), name
        if url != "z" and name not in ("IsHTTPS",):
            assert rows["z"][name] == 0, name


def test_feature_plan_is_one_narrow_stage(spark):
    df = with_url_features(spark.range(5).select(F.concat(F.lit("x.com/"), "id").alias("url")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_unicode_digits_and_null(spark):
    row = with_url_features(spark.createDataFrame([("http://a.com/x²٣½",)], "url string")).first()
    assert row["NoOfDegitsInURL"] == 2  # the superscript and the Arabic digit, not the fraction
    assert row["NoOfOtherSpecialCharsInURL"] == sum(not c.isalnum() for c in "http://a.com/x²٣½")
    assert with_url_features(spark.createDataFrame([(None,)], "url string")).first()["URLLength"] == 0


def test_simplified_features(spark):
    df = spark.createDataFrame([("http://U@A.com:80/%41?x=facebook",), ("https://1.2.3.4/http://z",)], "url string")
    a, b = with_url_features(df, simplified=True).collect()
    assert (a["DomainLength"], a["HasObfuscation"], a["NoOfObfuscatedChar"], a["HasSocialNet"]) == (10, 1, 1, 1)
    assert (b["IsDomainIP"], b["NoOfURLRedirect"], b["IsHTTPS"]) == (1, 1, 1)
    c = with_url_features(spark.createDataFrame([("HTTP://a.com",)], "url string"), simplified=True).first()
    assert c["NoOfURLRedirect"] == -1


def extracted(spark, text, mode):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(extract_urls(F.col("t"), mode)).first()[0]


def test_extraction_modes(spark):
    literal = "['http://a.com', 'http://a.com', 'http://b.com/x,y']"
    assert extracted(spark, literal, "list") == ["http://a.com", "http://b.com/x"]
    assert extracted(spark, literal, "live") == ["http://a.com'", "http://a.com'", "http://b.com/x,y'"]
    text = "See HTTP://A.com (https://b.org). <https://b.org> http://c.com/p, http://c.com/p!"
    assert extracted(spark, text, "live") == ["https://b.org", "https://b.org", "http://c.com/p", "http://c.com/p"]
    assert extracted(spark, text, "test") == extracted(spark, text, "live")
    assert extracted(spark, text, "text") == ["HTTP://A.com", "https://b.org", "http://c.com/p"]
    for mode in ("live", "list", "text", "test"):
        assert extracted(spark, None, mode) == []
        assert extracted(spark, "no link here", mode) == []
    assert extracted(spark, "http://a\xa0b http://c　d", "live") == ["http://a", "http://c"]


def test_broken_ipv6_host_does_not_fail(spark):
    urls = extracted(spark, "go to http://[::1]", "live")
    assert urls == ["http://[::1"]
    df = spark.createDataFrame([(urls[0],)], "url string")
    assert df.select(url_domain(canonical_url(F.col("url")))).first()[0] == "["


def test_registered_domain(spark):
    cases = {
        "https://a.b.example.co.uk/x": "example.co.uk", "http://www.Google.COM": "google.com", "localhost/x": "localhost",
        "http://1.2.3.4/": "1.2.3.4", "http://co.uk": "", "http://foo.unknownlabel": "unknownlabel", "": "", None: "",
        "user:pw@mail.example.com:25": "example.com", "http://a.b.ck/": "a.b.ck", "http://x.a.b.ck/": "a.b.ck",
        "http://www.ck": "www.ck", "http://q.www.ck": "www.ck", "http://[::1]:80/": "[::1]", "example.com.": "example.com",
    }
    df = spark.createDataFrame([(u, i) for i, u in enumerate(cases)], "url string, i int")
    rules = [*COMMON_SUFFIXES, "ck", "*.ck", "!www.ck"]
    got = {r["url"]: r["domain_group"] for r in with_registered_domain(df, rules).collect()}
    assert got == cases
    no_rules = with_registered_domain(df.limit(1), []).first()
    assert no_rules["domain_group"] == "uk"


def test_rules_of_a_file_are_all_used(spark, tmp_path):
    names = [f"s{i}" for i in range(3000)]
    folded = ["// comment", "", "zz", "*.zz", "!keep.zz", "ZZ", *names, "co.last"]
    (tmp_path / "rules.dat").write_text("\n".join(folded))
    rules = read_suffix_rules(spark, str(tmp_path / "rules.dat"))
    assert rules.count() == len(folded) - 2
    df = spark.createDataFrame([("http://a.b.co.zz/",), ("http://x.keep.zz",), ("http://q.r.s2999/",), ("http://a.b.co.last/",)], "url string")
    got = [r["domain_group"] for r in with_registered_domain(df, rules).collect()]
    assert sorted(got) == sorted(["b.co.zz", "keep.zz", "r.s2999", "b.co.last"])
