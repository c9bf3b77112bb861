import random
from collections import Counter
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from hookline.llm import simhash
from hookline.llm.components import components


def plain_print(text, width=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_groups(rows):
    """Row number to the smallest id of its group, by comparing all pairs."""
    prints = [plain_print(t) for _, t in rows]
    roots = plain_roots(range(len(rows)), [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4])
    low = {}
    for i, r in roots.items():
        if rows[i][0] is not None:
            low[r] = min(rows[i][0], low.get(r, rows[i][0]))
    return prints, [low.get(roots[i]) for i in range(len(rows))]


def check(df, scratch):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    prints, groups = plain_groups(rows)
    got = simhash.near_duplicates(df, scratch).select("doc_id", simhash.hex_print("fp").alias("f"), "component_id")
    assert Counter(map(tuple, got.collect())) == Counter((r[0], f"{p:016x}", g) for r, p, g in zip(rows, prints, groups, strict=True))


def test_documents_against_all_pairs(documents, scratch):
    check(documents, scratch)


def test_odd_rows(odd, scratch):
    check(odd, scratch)


def test_empty(documents, scratch):
    assert simhash.near_duplicates(documents.limit(0), scratch).count() == 0
    assert simhash.keep_one(documents.limit(0), scratch).count() == 0


def test_long_text_is_counted_in_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 701}" for i in range(3000))
    monkeypatch.setattr(simhash, "_CHUNK", 128)
    assert simhash.fingerprint(text) % (1 << 64) == plain_print(text)


def test_crowded_keys_are_compared_in_chunks(spark, scratch, monkeypatch):
    monkeypatch.setattr(simhash, "_GROUP", 4)
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for blocks in (5, 6, 8):
        links = simhash.hamming_links(prints, scratch, 4, blocks).collect()
        mask = (1 << 64) - 1
        assert all(((r.u & mask) ^ (r.v & mask)).bit_count() <= 64 for r in links)
        want = plain_roots(signed, [(a, b) for a, b in combinations(signed, 2) if ((a & mask) ^ (b & mask)).bit_count() <= 4])
        assert plain_roots(signed, [(r.u, r.v) for r in links]) == want


def test_components(spark, scratch):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)]
    rng.shuffle(links)
    df = spark.createDataFrame([(max(a, b) - 500, min(a, b) - 500) if rng.random() < 0.5 else (a - 500, b - 500) for a, b in links], "u bigint, v bigint")
    want = plain_roots({x - 500 for p in links for x in p}, [(a - 500, b - 500) for a, b in links])
    got = {r.node: r.root for r in components(df, scratch).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(df.limit(0), scratch).count() == 0


def test_keep_one(documents, odd, scratch):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        _, groups = plain_groups(rows)
        kept = simhash.keep_one(df, scratch)
        assert kept.columns == df.columns
        named = {g for g in groups if g is not None}
        got = [r.doc_id for r in kept.collect()]
        assert sorted(x for x in got if x is not None) == sorted(named)
        assert len(got) == len(set(got))


def test_no_window_and_no_cross_join(documents, scratch):
    plan = simhash.near_duplicates(documents, scratch)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan and "SinglePartition" not in plan


def test_uneven_join_keeps_every_row(spark, scratch):
    from hookline.llm.frames import join_uneven

    rows = scratch.table(spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id"))
    lookup = scratch.table(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    got = join_uneven(rows, lookup, "k", "n", 5000)
    assert got.count() == 5000 and got.columns == ["k", "id", "first"]
    assert got.where("k = 7").select("first").distinct().collect()[0].first == 0
