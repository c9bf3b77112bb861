import hashlib
import random
import zlib

import pytest

from hookline.llm import periodic_runs
from hookline.llm.queries import QUERIES


def plain_runs(own, least=12):
    """All runs by the definition: every period, every stretch of equal words at its distance."""
    found = set()
    for q in range(1, len(own) // 2 + 1):
        start = None
        for i in range(len(own) - q + 1):
            if i < len(own) - q and own[i] == own[i + q]:
                start = i if start is None else start
            elif start is not None:
                length = i + q - start
                stretch = own[start : start + length]
                smaller = any(stretch[p:] == stretch[:-p] for p in range(1, q))
                if length >= max(least, 2 * q) and not smaller:
                    found.add((start, length, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(name, text):
    own = (text or "").encode().split()
    n = len(own)
    if name is not None and n:
        h = zlib.crc32(str(name).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = own[:a] + [own[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(own)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
    return (
        name, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            own = []
            while len(own) < rng.choice([5, 30, 90]):
                piece = [rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.randint(1, 12))]
                own += piece * rng.choice([1, 1, 2, 3, 5]) + piece[: rng.randint(0, len(piece))]
            texts.append(own)
        got, _ = periodic_runs._searched([b" ".join(t) for t in texts], 2)
        assert got == [plain_runs(t, 2) for t in texts]


def test_runs_of_words_as_in_known_strings():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 250:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for word in (fibonacci[-1], "a" * 100, "ab" * 60 + "a", "aab" * 9 + "aac" * 9, "abaababaab" * 5):
        own = [c.encode() for c in word]
        assert periodic_runs.find_runs(periodic_runs._codes([own]), 2) == plain_runs(own, 2)


def test_query_matches_plain(spark, sf, documents):
    got = QUERIES["op11_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert all(t == "bigint" for _, t in got.dtypes[:6])
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect() if len((r.text or "").split()) < 500]
    short = {r[0] for r in rows}
    want = sorted(plain_row(*r) for r in rows)
    assert sorted(tuple(r) for r in got.collect() if r.doc_id in short) == want
    assert sum(r[1] > 0 for r in want) > 0.05 * len(want)


def test_odd_rows_and_empty(spark, odd, documents):
    out = periodic_runs.with_runs(periodic_runs.with_planted_runs(odd), names=("hits", "score"))
    assert sorted(out.columns) == sorted(odd.columns)
    rows = {(r.n_chars, r.hits is not None, r.score is not None) for r in out.collect()}
    assert len(rows) == 11 and all(r[1:] == (True, True) for r in rows)
    got = [tuple(r)[1:] for r in out.where("n_chars = 8").selectExpr("size(hits)", "hits[0].start", "hits[0].length", "hits[0].period").collect()]
    assert all(0 <= r[0] and r[2] >= 97 for r in got if r[2])
    assert periodic_runs.with_runs(documents.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "x y " * 100_000), (2, "x y " * 100_000), (None, "q")], "doc_id bigint, text string")
    assert [r.runs for r in periodic_runs.with_runs(long).orderBy("doc_id").collect()] == [[], [(0, 200_000, 2)], [(0, 200_000, 2)]]
