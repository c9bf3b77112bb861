import math

from hookline.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Source to target: share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not above:
            return {s: most * sizes[s] if s in full else share[s] for s in order}
        full |= above


def check(df, scratch, slack):
    rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in df.collect()]
    sizes, largest = {}, {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    want = plain_targets(sizes)
    out = mixing.mix(df.select("doc_id", "text", "source"), scratch)
    got = out.collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack * largest[s] + 1e-6
    again = mixing.mix(df.select("doc_id", "text", "source"), scratch, keep=["doc_id"])
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in again.collect()) == sorted((str(r.doc_id), r["size"], r.taken) for r in got)
    return {s: sum(r.rate * r["size"] for r in got if r.source == s) for s in sizes}, want


def test_documents(documents, scratch):
    rates, want = check(documents, scratch, 1.0)
    for s, t in want.items():
        assert math.isclose(rates[s], t, rel_tol=1e-5, abs_tol=1e-3)


def test_uneven_sources_hit_their_caps(spark, scratch):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else f"small{i % 3}") for i in range(600)] + [(1000 + i, "x y z", None) for i in range(5)]
    rates, want = check(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), scratch, 2.0)
    assert any(math.isclose(want[s], 3 * sum(len(t.split()) for _, t, x in rows if x == s)) for s in want)


def test_rows_that_repeat_meet_their_targets(spark, scratch):
    rows = [(None if i % 2 else 7, "five words of a text", f"s{i % 3 + 1}") for i in range(3000)]
    check(spark.createDataFrame([(None, *r[1:]) for r in rows], "doc_id bigint, text string, source string"), scratch, 1.0)
    check(spark.createDataFrame([(i if i % 3 else 5, "t " * (1 + i % 4 if i % 3 else 3), "a" if i % 5 else "b") for i in range(3000)], "doc_id bigint, text string, source string"), scratch, 1.0)


def test_odd_rows(odd, scratch):
    out = mixing.mix(odd, scratch)
    assert set(odd.columns) - {"size"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    got = out.collect()
    assert len(got) == odd.count()
    assert all(r["size"] == 0 and r.taken == 0 for r in got if not (r.text or "").strip(" \t\n\x0b"))
    assert out.select("given", "none", "src", "u").first() is not None


def test_empty_and_wordless(spark, documents, scratch):
    assert mixing.mix(documents.limit(0), scratch).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(blank, scratch).collect()] == [(0, 0.0), (0, 0.0)]
