"""The two trained document scores: held-out accuracy, inputs, odd rows; and the chain model against all label paths."""

import itertools
import math
import zlib

import numpy as np
import pytest

from hookline.llm import pairwise_quality, toxicity
from hookline.llm.labelled import best_cut, labelled_sample

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels, "doc_id").select(label, "predicted", "score").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    hit = sum(r[label] and r.predicted for r in rows)
    return sum(r[label] == r.predicted for r in rows) / len(rows), hit / sum(r.predicted for r in rows), hit / sum(r[label] for r in rows)


def test_quality(corpus, scratch):
    docs, labels = corpus
    got = pairwise_quality.score_quality(docs, labels, scratch)
    right, precision, recall = accuracy(got, labels, "quality")
    assert right > 0.97 and precision > 0.97 and recall > 0.97
    assert got.where("crc32(cast(doc_id AS string)) % 4 = 2").where("not held_out").count() == 0


def test_toxicity(corpus, scratch):
    docs, labels = corpus
    tagger = toxicity.fit_tagger(docs, labels, scratch)
    got = toxicity.score_toxicity(docs, tagger).withColumn("held_out", toxicity.held_out("doc_id"))
    right, precision, recall = accuracy(got, labels, "toxic")
    assert right > 0.97 and precision > 0.9 and recall > 0.85
    worst = got.where("toxic_spans != ''").orderBy("score", ascending=False).limit(20).collect()
    for r in worst:
        for span in r.toxic_spans.split(","):
            a, b = map(int, span.split(":"))
            assert r.text[a:b].strip() == r.text[a:b] != ""


@pytest.mark.parametrize("steps", [1, 2, 5])
def test_chain_against_all_paths(steps):
    rng = np.random.default_rng(steps)
    scores, trans, start = rng.normal(size=(3, steps)), rng.normal(size=(2, 2)), 0.3
    lengths = np.array([steps, max(1, steps - 1), 1])
    found, pairs = toxicity._chain(scores, lengths, trans, start)
    want_pairs = np.zeros((2, 2))
    for row, n in enumerate(lengths):
        mass, marginal, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(start * path[0] + sum(scores[row, t] * y for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            mass += w
            marginal += w * np.array(path)
            for a, b in zip(path, path[1:], strict=False):
                both[a, b] += w
        assert np.allclose(found[row, :n], marginal / mass)
        want_pairs += both / mass
    assert np.allclose(pairs, want_pairs)


def test_odd_rows(spark, odd, documents, scratch):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, None, 1), (2, 0, 1), (None, 1, 1), (4, 5, 0), (5, 1, 1), (6, 0, 0), (7, 1, 0), (8, 0, 1), (9, 1, 1), (10, 0, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    for taken in (labels, labels.limit(0), labels.where("quality = 1 and toxic = 1")):
        got = pairwise_quality.score_quality(odd, taken, scratch).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        tagger = toxicity.fit_tagger(odd, taken, scratch, iterations=2)
        scored = toxicity.score_toxicity(odd, tagger)
        assert scored.columns.count("score") == 1
        rows = scored.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.predicted == 0 for r in rows if not (r.text or "").split())
    assert pairwise_quality.score_quality(documents.limit(0), labels, scratch).count() == 0
    assert toxicity.score_toxicity(documents.limit(0), tagger).count() == 0


def test_sample_leaves_out_held_rows_and_stays_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(3, 0), (None, 1)], "doc_id bigint, toxic int")
    rows = labelled_sample(labels, "doc_id", "toxic", 3, 1, 40).collect()
    assert len(rows) == 80 and all(zlib.crc32(str(r.id).encode()) % 3 != 1 for r in rows)
    free = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert math.isclose(sum(r.weight for r in rows), len(free))


def test_best_cut():
    assert 0.2 < best_cut([(0.9, 1, 1.0), (0.8, 1, 1.0), (0.2, 0, 5.0), (0.1, 0, 1.0)]) < 0.8
    assert best_cut([]) == 0.0 and best_cut([(0.4, 0, 1.0)]) > 0.4


def test_features_are_finite():
    for text in (None, "", "a", "A" * 10_000, "! " * 50, "😀 漢字\n\n"):
        values = pairwise_quality.features(text)
        assert len(values) == len(pairwise_quality.FEATURES) and all(math.isfinite(v) for v in values)
