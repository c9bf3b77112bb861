import math
import zlib
from collections import Counter

import numpy as np
import pytest

from hookline.llm import class_lm


def plain_words(text):
    return (text or "").encode().lower().split()


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain_base(rows):
    """(id, held_out, n_tokens, n_known, N, base) by the add-one rule."""
    counts, ends = Counter(), 0
    for i, t in rows:
        if not is_held(i):
            counts.update(plain_words(t))
            ends += 1
    total, types = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for i, t in rows:
        c = [counts[w] for w in plain_words(t)] + [ends]
        out.append((i, is_held(i), len(c), sum(x > 0 for x in c), total, sum(math.log10((x + 1) / (total + types + 1)) for x in c)))
    return out


def check(df, scratch, **settings):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = class_lm.score_held_out(df, scratch, **settings).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(plain_base(rows), key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert g[6] <= 1e-9 and math.isfinite(g[6])
    return got


def test_base_and_gain_on_held_out_texts(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in check(docs, scratch, dictionary=4000, core=600) if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.3 * sum(r.n_tokens for r in got)


def test_dictionary_size_changes_no_score(documents, scratch):
    wide = class_lm.score_held_out(documents, scratch, core=300, dictionary=100_000)
    slim = class_lm.score_held_out(documents, scratch, core=300, dictionary=300)
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in (wide, slim))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_probabilities_add_up(documents, scratch):
    model, rest = class_lm.fit(documents.select("text"), scratch, core=200, dictionary=500)
    tail = rest.collect()
    count = np.concatenate((model.count, [r.n for r in tail]))
    group = np.concatenate((model.group, [r.group for r in tail])).astype(int)
    for h in range(len(model.follow)):
        seen = (10 ** model.follow[h, group] * (count - model.discount) / model.size[group]).sum()
        assert math.isclose(seen + 10 ** model.follow[h, 0] + 10 ** model.unknown[h], 1.0, rel_tol=1e-6)


def test_exchange_raises_likelihood(documents, scratch):
    counts = scratch.table(class_lm.word_counts(documents))
    main = class_lm._frequent(counts, 300)[0].collect()
    number = {bytes(r.word): i for i, r in enumerate(sorted(main, key=lambda r: (-r.n, r.word)), 1)}
    contexts = class_lm._contexts(documents, "text", number, scratch)
    group = np.array([0, *(1 + i % 7 for i in range(len(number)))])

    def value(table):
        return class_lm._flow(table).sum() - class_lm._flow(table.sum(axis=0)).sum() - class_lm._flow(table.sum(axis=1)).sum()

    table = class_lm._transitions(contexts, group, 8)
    moves = class_lm._moves(contexts, group, table, 8, 1)
    assert moves
    for r in moves[:5]:  # the gain of a single move is exact: it rises, and no other class would do better
        values = []
        for k in range(1, 8):
            changed = group.copy()
            changed[r.id] = k
            values.append(value(class_lm._transitions(contexts, changed, 8)))
        assert values[r.to - 1] == pytest.approx(max(values)) and values[r.to - 1] > value(table)


def test_odd_rows_and_empty(odd, documents, scratch):
    check(odd, scratch)
    assert class_lm.score_held_out(documents.limit(0), scratch).count() == 0


def test_nothing_to_learn_from(spark, scratch):
    held = next(i for i in range(100) if is_held(i))
    df = spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")
    assert [tuple(r) for r in class_lm.score_held_out(df, scratch).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]
