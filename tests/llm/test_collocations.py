import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from hookline.llm import collocations
from hookline.llm.queries import ORACLES, QUERIES


def plain(rows, most=5, least=100, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, most + 1):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    covered = set()
    for (lang, words), n in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = lang, words[i : i + k]
                if n >= counts[part]:
                    covered.add(part)
    out = {}
    for (lang, words), a in often.items():
        if (lang, words) not in covered:
            cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
            score, _, left, right = min((1000 * a * totals[lang] // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, x, y, totals[lang], -s)
        for lang, found in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)
    )


def check(df, scratch, **settings):
    want = plain([(r.lang, r.text) for r in df.select("lang", "text").collect()], **settings)
    assert sorted(map(tuple, collocations.collocations(df, scratch, **settings).collect())) == want
    return want


def test_documents(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert len(check(docs, scratch)) > 50


def test_top_of_a_language_and_short_lengths(documents, scratch):
    assert check(documents, scratch, least=10, top=7)
    assert check(documents, scratch, most=3, least=20)
    assert check(documents, scratch, most=2, least=20)


@pytest.mark.parametrize("sent", [0, 500_000])
def test_small_vocabulary(spark, scratch, monkeypatch, sent):
    monkeypatch.setattr(collocations, "_SENT", sent)
    rng = random.Random(5)
    rows = [(rng.choice(["x", None, "y"]), "".join(rng.choice(["a ", "B ", "c\t", "é ", "a, ", "b\n", "\x0b", "  "]) for _ in range(rng.randint(0, 60)))) for _ in range(400)]
    rows += [("x", "one same text of many copies here")] * 300
    assert check(spark.createDataFrame(rows, "lang string, text string"), scratch, least=20)


def test_numbers_are_those_of_the_engine_and_collisions_are_solved(spark, scratch, monkeypatch):
    row = spark.sql("SELECT xxhash64('3', 'en', 'naïve') AS h").first()
    assert collocations._Items("3", "en")["naïve".encode()] == row.h % 2**64
    numbered = collocations.item_number
    asked = []

    def weak(salt):  # the first numbering gives all words one number
        asked.append(salt)
        return F.lit(1).cast("bigint") if salt == "0" else numbered(salt)

    monkeypatch.setattr(collocations, "item_number", weak)
    docs = spark.createDataFrame([("en", "a b c d e f"), ("de", "a b, c d")] * 5, "lang string, text string")
    assert check(docs, scratch, least=3) and asked == ["0", "1"]


def test_scores_beyond_64_bits(spark):
    big = 10**14 + 7
    cells = [(big, 9 * 10**14, big + 5, big + 9), (5, 10**15 - 1, 5, 5), (100, 7, 100, 100), (10**15 - 1,) * 4]
    df = spark.createDataFrame(cells, "a bigint, n bigint, l bigint, r bigint")
    got = df.select(collocations.exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [1000 * a * n // (x * y) for a, n, x, y in cells]


def test_query_and_sql(spark, sf):
    got = QUERIES["op13_setm_collocations"](spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(ORACLES["op13_setm_collocations"]).fetchall())


def test_odd_rows_and_empty(odd, documents, scratch):
    assert check(odd, scratch, least=2)
    assert collocations.collocations(documents.limit(0), scratch).count() == 0
    assert collocations.collocations(documents, scratch, least=10**9).count() == 0
