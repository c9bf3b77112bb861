import random
from collections import defaultdict

import pytest

from hookline.llm import suffix_dedup


def plain(rows, length):
    """(id, first, end) of maximal stretches whose runs of ``length`` words all occur under another id too."""
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows if i is not None]
    where = defaultdict(set)
    for i, w in texts:
        for k in range(len(w) - length + 1):
            where[tuple(w[k : k + length])].add(i)
    starts = defaultdict(set)
    for i, w in texts:
        starts[i] |= {k for k in range(len(w) - length + 1) if len(where[tuple(w[k : k + length])]) > 1}
    out = set()
    for i, found in starts.items():
        for s in sorted(found):
            if s - 1 not in found:
                e = s
                while e + 1 in found:
                    e += 1
                out.add((i, s, e + length))
    return out


def check(df, scratch, **settings):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = suffix_dedup.repeated_passages(df, scratch, **settings).collect()
    assert {(r.doc_id, r.first_word, r.end_word) for r in got} == plain(rows, settings.get("length", 50))
    assert len({(r.doc_id, r.first_word) for r in got}) == len(got)
    assert all(r.also_in != r.doc_id and r.n_words == r.end_word - r.first_word for r in got)
    return got


def test_documents(spark, scratch):
    assert check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), scratch)


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_passages(spark, scratch, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4 if seed == 2 else 400)}"
    passages = [[word() for _ in range(rng.randint(10, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += p[a : rng.randint(a, len(p))] + [word() for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), scratch, length=12, gram=3, window=6)


def test_odd_rows_and_empty(spark, odd, documents, scratch):
    check(odd, scratch)
    assert suffix_dedup.repeated_passages(documents.limit(0), scratch).count() == 0
    same = spark.createDataFrame([(1, " ".join(map(str, range(80))))] * 3, "doc_id bigint, text string")
    assert suffix_dedup.repeated_passages(same, scratch).count() == 0


def test_bounds(documents, scratch):
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(documents, scratch, length=20, gram=8, window=16)
