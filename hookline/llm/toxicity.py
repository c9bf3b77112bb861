"""Toxic spans by a linear-chain conditional random field over words; documents by what its marginals add up to.

The CRF has two states a word, toxic or not. Emissions are sums of hashed features of the word (itself, its starts and
its end), transitions are four weights. Labels are given for documents only, so words are labelled from them first: in a
toxic document the words count as toxic that bear a feature markedly more frequent in toxic documents, all others not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .frames import append_columns
from .labelled import best_cut, fold_is, labelled_sample, logit

_SIZE = 1 << 18
_CELLS = 1 << 20  # words, padding included, that are worked on at a time
_CHARS = 1 << 22  # characters cut into words at a time
_CACHE = 1 << 18
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_WORD = re.compile(r"\S+")


def _core(token: str) -> str:
    return token.lower().strip(_EDGE)


def _traits(core: str) -> list[str]:
    """The word, its starts of 4 to 7 letters and its last 4."""
    return ["w" + core, *("p" + core[:k] for k in range(4, 8) if len(core) >= k), "s" + core[-4:]]


def _slots(core: str) -> list[int]:
    """Feature numbers of a word; 0 is the bias, an empty word has nothing else."""
    return [0, *(1 + xxhash.xxh32_intdigest(t) % (_SIZE - 1) for t in _traits(core))] if core else [0]


def _chain(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float):
    """Forward-backward over padded rows of word scores, longest row first. Marginals of state 1, and pair sums (2 x 2).

    All is kept as ratios of state 1 to state 0, so one number a row is carried along.
    """
    rows, steps = scores.shape
    odds = np.exp(np.clip(scores, -30, 30))
    a = np.exp(trans)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows longer than t
    fore, back = np.zeros_like(odds), np.ones_like(odds)
    ratio = np.full(rows, math.exp(start))
    for t in range(steps):
        n = active[t]
        if t:
            ratio[:n] = (a[0, 1] + ratio[:n] * a[1, 1]) / (a[0, 0] + ratio[:n] * a[1, 0])
        ratio[:n] *= odds[:n, t]
        fore[:n, t] = ratio[:n]
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        x = odds[:n, t + 1] * back[:n, t + 1]
        back[:n, t] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
        r = fore[:n, t]
        z = a[0, 0] + a[0, 1] * x + r * (a[1, 0] + a[1, 1] * x)
        pairs += [[(a[0, 0] / z).sum(), (a[0, 1] * x / z).sum()], [(r * a[1, 0] / z).sum(), (r * a[1, 1] * x / z).sum()]]
    both = fore * back
    return both / (1 + both), pairs


def _padded(lengths: np.ndarray):
    """Groups of row numbers, longest first, whose padded size stays within ``_CELLS`` (a longer row is a group of its own)."""
    order = np.argsort(-lengths, kind="stable")
    low = 0
    while low < len(order):
        width = max(1, int(lengths[order[low]]))
        high = low + max(1, _CELLS // width)
        yield order[low:high], width
        low = high


@dataclass
class SpanTagger:
    """A fitted CRF with the weights that turn its marginals into a document score."""

    weights: np.ndarray
    trans: np.ndarray
    start: float
    combine: tuple[float, ...] = ()
    shift: float = 0.0

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text, the probability of each blank-separated word to be toxic. Whole texts, however long."""
        cache = _Scores(self.weights)
        out: list[np.ndarray] = []
        low = size = 0
        for high, text in enumerate(texts, 1):
            size += len(text or "")
            if size > _CHARS or high == len(texts):
                out += self._some(texts[low:high], cache)
                low, size = high, 0
        return out

    def _some(self, texts: list[str | None], cache: _Scores) -> list[np.ndarray]:
        tokens = [t.split() if t else [] for t in texts]
        lengths = np.array([len(t) for t in tokens], np.int64)
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        for group, width in _padded(lengths):
            scores = np.zeros((len(group), width))
            for row, i in enumerate(group):
                scores[row, : lengths[i]] = list(map(cache.__getitem__, tokens[i]))
            found, _ = _chain(scores, lengths[group], self.trans, self.start)
            for row, i in enumerate(group):
                out[i] = found[row, : lengths[i]].copy()
        return out

    def summary(self, p: np.ndarray) -> list[float]:
        """What a document is judged by: toxic words expected, their share, the surest one."""
        return [math.log1p(p.sum()), 30 * p.sum() / (len(p) + 30), float(p.max())] if len(p) else [0.0, 0.0, 0.0]

    def score(self, p: np.ndarray) -> float:
        """Between 0 and 1; 0.7 is the cut with the best F1 among the rows learned from. Without words it is 0."""
        if not len(p):
            return 0.0
        x = sum(w * v for w, v in zip(self.combine, self.summary(p), strict=True)) - self.shift + logit(0.7)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


class _Scores(dict):
    """Word to emission score, computed when first met. Emptied when it grows too large."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        value = self[token] = float(self.weights[_slots(_core(token))].sum())
        return value


def spans(text: str | None, p: np.ndarray, least: float = 0.5) -> str:
    """``start:end`` of runs of toxic words in code points, end exclusive, comma-joined."""
    if not len(p) or p.max() < least:
        return ""
    found: list[list[int]] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if p[i] >= least:
            if i == last + 1:
                found[-1][1] = m.end()
            else:
                found.append([m.start(), m.end()])
            last = i
    return ",".join(f"{a}:{b}" for a, b in found)


def _marked_traits(sample: DataFrame, least_docs: int = 5, least_odds: float = 1.0, least_g: float = 30.0) -> set[str]:
    """Features found in far more toxic documents than chance allows (likelihood ratio), of those in the sample."""

    def count(batches):
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                cores = {_core(t) for t in (text or "").split()} - {""}
                seen[label].update({x for c in cores for x in _traits(c)})
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())],
                names=["trait", "a", "b"],
            )

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    counts = sample.select("text", "label").mapInArrow(count, "trait string, a bigint, b bigint").groupBy("trait").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def part(k: Column, n: float, p: Column) -> Column:
        hit = F.when(k > 0, k * F.ln(k / (n * p))).otherwise(0.0)
        return hit + F.when(k < n, (n - k) * F.ln((n - k) / (n * (1 - p) + 1e-9))).otherwise(0.0)

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    p = (a + b) / (n1 + n0)
    odds = F.ln((a + 0.3) / (n1 + 0.6)) - F.ln((b + 0.3) / (n0 + 0.6))
    marked = counts.where((a >= least_docs) & (odds >= least_odds) & (2 * (part(a, n1, p) + part(b, n0, p)) >= least_g))
    return {r["trait"] for r in marked.select("trait").collect()}


def _packed(sample: DataFrame, marked: set[str], window: int) -> DataFrame:
    """The sample as a few rows of arrays: features of the distinct words, words, labels and lengths of windows."""

    def pack(batches):
        for batch in batches:
            number: dict[str, int] = {}
            words, labels, lengths = [], [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                cores = [_core(t) for t in (text or "").split()]
                words += [number.setdefault(c, len(number)) for c in cores]
                labels += [int(label == 1 and c != "" and not marked.isdisjoint(_traits(c))) for c in cores]
                lengths += [min(window, len(cores) - k) for k in range(0, len(cores), window)]
            slots = [_slots(c) for c in number]
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.asarray(x, np.int32).tobytes()], pa.binary()) for x in (
                    [s for x in slots for s in x], [len(x) for x in slots], words, labels, lengths,
                )], names=["slots", "widths", "words", "labels", "lengths"],
            )

    return sample.select("text", "label").mapInArrow(pack, "slots binary, widths binary, words binary, labels binary, lengths binary")


def _gradient(pack: DataFrame, weights: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the log-likelihood of the packed sample. Each task sends one vector of the fixed feature count."""
    sent = pack.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        grad, steps, first = np.zeros(_SIZE), np.zeros((2, 2)), 0.0
        for batch in batches:
            for row in batch.to_pylist():
                slots, widths, words, labels, lengths = (np.frombuffer(row[k], np.int32) for k in ("slots", "widths", "words", "labels", "lengths"))
                if not len(words):
                    continue
                of_slot = np.repeat(np.arange(len(widths)), widths)
                score = np.bincount(of_slot, sent.value[slots], len(widths))
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                off = np.zeros(len(words))
                for group, width in _padded(lengths.astype(np.int64)):
                    inside = np.arange(width) < lengths[group][:, None]
                    at = np.where(inside, starts[group][:, None] + np.arange(width), 0)
                    y = np.where(inside, labels[at], 0)
                    p, pairs = _chain(np.where(inside, score[words[at]], 0.0), lengths[group].astype(np.int64), trans, start)
                    off[at[inside]] = (y - p)[inside]
                    both = inside[:, 1:]
                    seen = [[(both & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)]
                    steps += np.array(seen) - pairs
                    first += (y[:, 0] - p[:, 0]).sum()
                by_word = np.bincount(words, off, len(widths))
                grad += np.bincount(slots, by_word[of_slot], _SIZE)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (grad.astype(np.float32).astype(np.float64), steps, np.array([first]))], names=["g", "t", "s"])

    total, steps, first = np.zeros(_SIZE), np.zeros(4), 0.0
    for row in pack.mapInArrow(run, "g binary, t binary, s binary").toLocalIterator():
        total += np.frombuffer(row["g"])
        steps += np.frombuffer(row["t"])
        first += np.frombuffer(row["s"])[0]
    sent.unpersist()
    return total, steps.reshape(2, 2), first


def fit_tagger(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", label: str = "toxic",
    folds: int = 3, held: int = 1, most: int = 3000, iterations: int = 15, window: int = 256, penalty: float = 0.05,
) -> SpanTagger:
    """The tagger learned from at most ``most`` documents of either label, none of them from the held-out fold.

    The likelihood is climbed by full gradient steps with a step size of its own for each feature; every step runs over
    the sample in parallel. Without toxic or without clean rows nothing can be learned: every score is then close to 0.
    """
    drawn = F.broadcast(labelled_sample(labels, id, label, folds, held, most))  # a few thousand ids
    sample = scratch.table(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(drawn, "id").repartition(8, F.xxhash64("id")))
    if sample.select("label").distinct().count() < 2:
        return SpanTagger(np.zeros(_SIZE), np.zeros((2, 2)), 0.0, (0.0, 0.0, 0.0), 20.0)
    pack = scratch.table(_packed(sample, _marked_traits(sample), window))
    weights, trans, start = np.zeros(_SIZE), np.array([[0.0, -2.0], [0.0, 0.0]]), -2.0
    weights[0] = -3.0
    seen, seen_t, seen_s = np.full(_SIZE, 1e-6), np.full((2, 2), 1e-6), 1e-6
    for _ in range(iterations):
        g, t, s = _gradient(pack, weights, trans, start)
        g -= penalty * weights
        t -= penalty * trans
        seen, seen_t, seen_s = seen + g * g, seen_t + t * t, seen_s + s * s
        weights = weights + g / np.sqrt(seen)
        trans = trans + 0.5 * t / np.sqrt(seen_t)
        start += 0.5 * s / math.sqrt(seen_s)
    tagger = SpanTagger(weights, trans, start)

    def summaries(texts):
        return [pa.array([tagger.summary(p) for p in tagger.marginals(texts)], pa.list_(pa.float64()))]

    judged = scratch.table(append_columns(sample, "text", {"x": "array<double>"}, summaries).select("label", "weight", array_to_vector("x").alias("x")))
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1e-4, maxIter=50).fit(judged)
    tagger.combine = tuple(float(c) for c in model.coefficients)
    values = [(float(model.coefficients.dot(r["x"])), r["label"], r["weight"]) for r in judged.toLocalIterator()]  # the bounded sample
    tagger.shift = best_cut(values)
    return tagger


def score_toxicity(
    docs: DataFrame, tagger: SpanTagger, text: str = "text", names: tuple[str, str, str] = ("score", "predicted", "toxic_spans")
) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.7) and toxic_spans, under these or other ``names``.

    A null or empty text has no words, so it gets the lowest score.

    Rows are judged one by one, by the whole text alone; repeated rows get equal scores; an empty table stays empty;
    columns named like a result are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def make(texts):
        found = sent.value.marginals(texts)
        scores = [sent.value.score(p) for p in found]
        return [
            pa.array(scores, pa.float64()), pa.array([int(s >= 0.7) for s in scores], pa.int32()),
            pa.array([spans(t, p) for t, p in zip(texts, found, strict=True)], pa.string()),
        ]

    return append_columns(docs, text, dict(zip(names, ("double", "int", "string"), strict=True)), make)


def held_out(id: str = "doc_id") -> Column:
    return fold_is(id, 3, 1)
