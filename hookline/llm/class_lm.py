"""Class-based bigrams after Brown: words exchange classes, classes follow each other, words come from classes.

P(word | history) = P(class | class of the last core word before) * P(word | class). Core words, the most frequent
ones, are clustered by exchange; all other training words join the class that explains their neighbours best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .frames import words
from .labelled import fold_is

_FLUSH = 1 << 20
_STEPS = 16  # counts are told apart by sixteenths of their binary logarithm when a frequency cut is sought


@dataclass
class ClassModel:
    """Log10 tables over classes (class 0 is the end of a text) and the dictionary of frequent words.

    ``follow[h, c]`` is log P(c | h), ``unknown[h]`` log P(a word not seen | h). ``words`` maps a dictionary word to its
    number; ``group``, ``count`` and ``core`` say its class, its training count and whether it makes history. ``size``
    holds each class's tokens, ``discount`` what is taken from every seen word of a class for those not seen.
    """

    words: dict[bytes, int]
    group: np.ndarray
    count: np.ndarray
    core: np.ndarray
    follow: np.ndarray
    unknown: np.ndarray
    size: np.ndarray
    discount: float
    tokens: int
    types: int
    ends: int

    @property
    def floor(self) -> float:
        return float(self.tokens + self.types + 1)


def _flat(rows: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: Counter = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                seen.update(words(body))
                if len(seen) > _FLUSH:
                    yield _flat(seen)
                    seen = Counter()
        if seen:
            yield _flat(seen)

    return docs.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, *most: int) -> list[DataFrame]:
    """For each bound the words above a count cut, as many as the bound allows; found from a small histogram."""
    step = F.floor(F.log2("n") * _STEPS)
    table = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    out = []
    for bound in most:
        total, cut = 0, float("inf")
        for value, n in table:
            total += n
            if total > bound:
                break
            cut = value
        out.append(counts.where(step >= cut) if cut != float("inf") else counts.where(F.lit(False)))
    return out


def _contexts(docs: DataFrame, text: str, number: dict[bytes, int], scratch: Scratch) -> DataFrame:
    """For each core word (0 is the end of a text) the core words that come next and before, with counts.

    Words that are not core are skipped. A row holds at most as many entries as there are core words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(number)
    width = len(number) + 1

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []
        size = 0

        def pairs():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((codes // width).astype(np.int32)), pa.array((codes % width).astype(np.int32)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

        get = sent.value.get
        for batch in batches:
            for body in batch.column(0).to_pylist():
                ids = [0, *filter(None, map(get, words(body))), 0]
                line = np.array(ids, np.int64)
                held.append(line[:-1] * width + line[1:])
                size += len(line)
                if size > 4 * _FLUSH:
                    yield pairs()
                    held, size = [], 0
        if held:
            yield pairs()

    table = scratch.table(docs.select(text).mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")))
    right = table.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("next"), F.collect_list("n").alias("next_n"))
    left = table.groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("last"), F.collect_list("n").alias("last_n"))
    return scratch.table(right.join(left, "id").repartition(16, "id"))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's list begins and ends, and the words and counts of all lists one after another."""
    words_, n = batch.column(name), batch.column(f"{name}_n")
    edges = words_.offsets.to_numpy()
    low, high = edges[0], edges[-1]
    first = n.offsets[0].as_py()
    counts = n.values.to_numpy()[first : first + high - low]
    return edges - low, words_.values.to_numpy()[low:high], counts


def _flow(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _transitions(contexts: DataFrame, group: np.ndarray, classes: int) -> np.ndarray:
    """Tokens by class of the word before and class of the word, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((classes, classes))
        for batch in batches:
            ids = batch.column("id").to_numpy()
            edges, words_, n = _lists(batch, "next")
            own = np.repeat(group[ids], np.diff(edges))
            total += np.bincount(own * classes + group[words_], n, classes * classes).reshape(classes, classes)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = contexts.mapInArrow(run, "m binary").collect()  # one small matrix a task
    return sum((np.frombuffer(r["m"]).reshape(classes, classes) for r in parts), np.zeros((classes, classes)))


def _moves(contexts: DataFrame, group: np.ndarray, table: np.ndarray, classes: int, turn: int) -> list:
    """(id, class) of the words whose exchange to another class raises the likelihood most; every second word, by ``turn``.

    The gain of a single move is exact. Moves of one round do not see each other, hence only half of the words may move.
    """
    rows, cols = table.sum(axis=1), table.sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, best = [], []
            next_at, next_all, next_n = _lists(batch, "next")
            last_at, last_all, last_n = _lists(batch, "last")
            for i, word in enumerate(batch.column("id").to_pylist()):
                if word == 0 or word % 2 != turn:
                    continue
                own = group[word]
                a, b = slice(next_at[i], next_at[i + 1]), slice(last_at[i], last_at[i + 1])
                nxt, last, n_next, n_last = next_all[a], last_all[b], next_n[a], last_n[b]
                self_n = n_next[nxt == word].sum()
                r, c = np.bincount(group[nxt], n_next, classes), np.bincount(group[last], n_last, classes)
                r[own] -= self_n
                c[own] -= self_n
                out, into = n_next.sum(), n_last.sum()
                rest = table.copy()
                rest[own] -= r
                rest[:, own] -= c
                rest[own, own] -= self_n
                rest_rows, rest_cols = rows.copy(), cols.copy()
                rest_rows[own] -= out
                rest_cols[own] -= into
                gain = (_flow(rest + r) - _flow(rest)).sum(axis=1) + (_flow(rest + c[:, None]) - _flow(rest)).sum(axis=0)
                diag = np.diagonal(rest)
                gain += _flow(diag + r + c + self_n) - _flow(diag + r) - _flow(diag + c) + _flow(diag)
                gain -= _flow(rest_rows + out) - _flow(rest_rows) + _flow(rest_cols + into) - _flow(rest_cols)
                gain[0] = -np.inf  # the end of a text keeps its class for itself
                to = int(gain.argmax())
                if to != own and gain[to] > gain[own] + 1e-6:
                    ids.append(word)
                    best.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(best, pa.int32())], names=["id", "to"])

    return contexts.mapInArrow(run, "id int, to int").collect()  # at most one row a core word


def _join_classes(docs: DataFrame, text: str, number: dict[bytes, int], group: np.ndarray, table: np.ndarray, scratch: Scratch):
    """(word, n, group) of all words that are not core, and tokens by class of the core word before and own class.

    A word goes to the class with the highest likelihood of the core words around its occurrences.
    """
    classes = len(table)
    sent = docs.sparkSession.sparkContext.broadcast({w: int(group[i]) for w, i in number.items()})

    def around(batches: Iterator[pa.RecordBatch]):
        get = sent.value.get
        own: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def flat():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            word, codes = np.divmod(codes, classes * classes)
            names = pa.array(list(own), pa.binary()).take(pa.array(word))
            return pa.RecordBatch.from_arrays([
                names, pa.array((codes // classes).astype(np.int16)), pa.array((codes % classes).astype(np.int16)), pa.array(n.astype(np.int64)),
            ], names=["word", "before", "after", "n"])

        for batch in batches:
            for body in batch.column(0).to_pylist():
                tokens = words(body)
                cls = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
                at = np.nonzero(cls < 0)[0]
                if not len(at):
                    continue
                core = np.nonzero(cls >= 0)[0]
                near = np.concatenate([[0], cls[core], [0]])  # the end of a text before and after it
                left = np.searchsorted(core, at)
                word = np.fromiter((own.setdefault(tokens[i], len(own)) for i in at.tolist()), np.int64, len(at))
                held.append((word * classes + near[left]) * classes + near[left + 1])
                size += len(at)
                if size > 4 * _FLUSH or 2 * len(own) > _FLUSH:
                    yield flat()
                    own, held, size = {}, [], 0
        if held:
            yield flat()

    smooth = table + 0.5
    came = np.log(smooth / smooth.sum(axis=1, keepdims=True))  # log P(class | before)
    goes = np.log((smooth / smooth.sum(axis=1, keepdims=True)).T)  # [after, class]: log P(after | class)

    def assign(batches: Iterator[pa.RecordBatch]):
        flow = np.zeros((classes, classes))
        held = None

        def settle(rows: pa.Table, whole: bool):
            """Words complete so far, and the rows of the last word, which may go on in the next batch."""
            names, (before, after, n) = rows.column("word"), (rows.column(c).to_numpy() for c in ("before", "after", "n"))
            new = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy()
            cuts = np.nonzero(np.concatenate([[True], new]))[0]
            upto = len(names) if whole else int(cuts[-1])
            cuts = cuts[cuts < upto]
            if not len(cuts):
                return None, rows
            before, after, n = before[:upto].astype(np.int64), after[:upto], n[:upto].astype(float)
            best, counts = np.zeros(len(cuts), np.int64), np.add.reduceat(n, cuts)
            edges = np.append(cuts, upto)
            for low in range(0, len(cuts), 1 << 15):
                high = min(len(cuts), low + (1 << 15))
                a, b = edges[low], edges[high]
                fit = (came[before[a:b]] + goes[after[a:b]]) * n[a:b, None]
                sums = np.add.reduceat(fit, cuts[low:high] - a, axis=0)
                sums[:, 0] = -np.inf
                best[low:high] = sums.argmax(axis=1)
            into = np.repeat(best, np.diff(edges))
            flow[:] += np.bincount(before * classes + into, n, classes * classes).reshape(classes, classes)
            return (names.take(pa.array(cuts)).combine_chunks(), counts, best), rows.slice(upto)

        for batch in chain(batches, [None]):
            parts = [held] if held is not None else []
            if batch is not None and batch.num_rows:
                parts.append(pa.Table.from_batches([batch]))
            if not parts:
                continue
            done, held = settle(pa.concat_tables(parts), batch is None)
            if done:
                yield pa.RecordBatch.from_arrays([
                    done[0], pa.array(done[1].astype(np.int64)), pa.array(done[2].astype(np.int16)), pa.nulls(len(done[0]), pa.binary()),
                ], names=["word", "n", "group", "flow"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int16()), pa.array([flow.tobytes()], pa.binary())], names=["word", "n", "group", "flow"])

    rows = docs.select(text).mapInArrow(around, "word binary, before smallint, after smallint, n bigint")
    dealt = rows.repartition("word").sortWithinPartitions("word")
    both = scratch.table(dealt.mapInArrow(assign, "word binary, n bigint, group smallint, flow binary"))
    parts = both.where("flow is not null").select("flow").collect()  # one small matrix a task
    flow = sum((np.frombuffer(r["flow"]).reshape(classes, classes) for r in parts), np.zeros((classes, classes)))
    return both.where("flow is null").select("word", "n", "group"), flow


def fit(
    docs: DataFrame, scratch: Scratch, text: str = "text", classes: int = 32, core: int = 8192, dictionary: int = 200_000, rounds: int = 8
) -> tuple[ClassModel, DataFrame]:
    """The model learned from all texts of ``docs``, and the table (word, n, group) of the words outside its dictionary.

    ``core`` bounds the words that exchange classes, ``dictionary`` the words sent to every task; both are cut by count, so
    what the driver holds does not grow with the corpus. All other words stay in a table.
    """
    counts = scratch.table(word_counts(docs, text))
    totals = counts.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    texts = docs.count()
    main, known = _frequent(counts, core, dictionary)
    order = sorted(((r["n"], bytes(r["word"])) for r in main.collect()), key=lambda x: (-x[0], x[1]))
    number = {w: i for i, (_, w) in enumerate(order, 1)}
    group = np.array([0, *(1 + i % (classes - 1) for i in range(len(order)))])
    contexts = _contexts(docs, text, number, scratch)
    table = _transitions(contexts, group, classes)
    for turn in range(rounds):
        for r in _moves(contexts, group, table, classes, turn % 2):
            group[r["id"]] = r["to"]
        table = _transitions(contexts, group, classes)
    rest, flow = _join_classes(docs, text, number, group, table, scratch)
    follow = table + flow
    in_class = rest.groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.sum((F.col("n") == 1).cast("int")).alias("once"), F.sum((F.col("n") == 2).cast("int")).alias("twice")).collect()
    size = np.bincount(group, [texts, *(n for n, _ in order)], classes).astype(float)
    types = np.bincount(group, minlength=classes).astype(float)
    once = sum(r["once"] for r in in_class) + sum(n == 1 for n, _ in order)
    twice = sum(r["twice"] for r in in_class) + sum(n == 2 for n, _ in order)
    for r in in_class:
        size[r["group"]] += r["n"]
        types[r["group"]] += r["types"]
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.1
    prior = size / max(1.0, size.sum())
    chance = (follow + classes * prior) / (follow.sum(axis=1, keepdims=True) + classes)
    spare = np.divide(discount * types, size, out=np.ones(classes), where=size > 0)
    spare[0] = 0.0
    with np.errstate(divide="ignore"):
        logs, unknown = np.log10(np.maximum(chance, 1e-12)), np.log10(np.maximum(chance @ spare, 1e-12))
    if not texts:
        unknown[:] = 0.0
    held = known.join(rest.drop("n"), "word", "left").collect()  # at most ``dictionary`` rows
    names = {bytes(r["word"]): i for i, r in enumerate(held)}
    model = ClassModel(
        names, np.array([group[number[bytes(r["word"])]] if bytes(r["word"]) in number else r["group"] for r in held], np.int64),
        np.array([r["n"] for r in held], np.int64), np.array([bytes(r["word"]) in number for r in held], bool),
        logs, unknown, size, discount, int(totals["n"]) + texts, int(totals["types"]) + (texts > 0), texts,
    )
    return model, rest.join(known.select("word"), "word", "left_anti")


def score(docs: DataFrame, model: ClassModel, rest: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``; both scores are log10.

    Words of the dictionary are scored where the text is. Other words, rare by definition, are counted per text and
    class of the core word before, looked up in ``rest`` by a join, and their terms added to the text's sum.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[id].dataType.simpleString()
    classes = len(model.follow)

    def run(batches: Iterator[pa.RecordBatch]):
        m = sent.value
        emit = np.log10(np.maximum(m.count - m.discount, 1e-12)) - np.log10(np.maximum(m.size[m.group], 1e-12)) if len(m.words) else np.zeros(0)
        plain = np.log10((m.count + 1) / m.floor)
        end = np.log10((m.ends + 1) / m.floor)
        get = m.words.get
        for batch in batches:
            out, names, history, times, offsets = [], [], [], [], [0]
            for body in batch.column(1).to_pylist():
                tokens = words(body)
                ids = np.array([get(w, -1) for w in tokens], np.int64)
                known = np.nonzero(ids >= 0)[0]
                before = np.zeros(len(ids) + 1, np.int64)
                if len(known):
                    mine = ids[known]
                    last = np.full(len(ids) + 1, -1)
                    at = known[m.core[mine]]
                    last[at + 1] = at
                    last = np.maximum.accumulate(last)
                    before = np.where(last >= 0, m.group[ids[np.maximum(last, 0)]], 0)
                    value = (m.follow[before[known], m.group[mine]] + emit[mine]).sum()
                    base = plain[mine].sum()
                else:
                    value = base = 0.0
                value += m.follow[before[-1], 0] if m.ends else m.unknown[0]
                seen = Counter((tokens[i], int(before[i])) for i in np.nonzero(ids < 0)[0].tolist())
                names += [w for w, _ in seen]
                history += [h for _, h in seen]
                times += list(seen.values())
                offsets.append(len(names))
                out.append((len(tokens) + 1, len(known) + (m.ends > 0), base + end, value))
            rare = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(history, pa.int16()), pa.array(times, pa.int32())], names=["word", "h", "k"])
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)],
                names=["id", "n_tokens", "n_known", "base", "value", "rare"],
            )

    schema = f"id {kind}, n_tokens bigint, n_known bigint, base double, value double, rare array<struct<word:binary,h:smallint,k:int>>"
    first = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
    first = scratch.table(first.withColumn("row", F.monotonically_increasing_id()))
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(rest, "word", "left")

    def cell(values: np.ndarray, place):
        return F.element_at(F.array(*[F.lit(float(v)) for v in values.ravel()]), (place + 1).cast("int"))

    seen = F.col("n").isNotNull()
    per_class = np.log10(np.maximum(model.size, 1e-12))
    term = F.when(seen, cell(model.follow - per_class[None, :], F.col("h") * classes + F.col("group")) + F.log10(F.greatest(F.col("n") - model.discount, F.lit(1e-12))))
    sums = rare.groupBy("row").agg(
        F.sum(F.col("k") * term.otherwise(cell(model.unknown, F.col("h")))).alias("more"),
        F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(model.floor))).alias("more_base"),
        F.sum(F.when(seen, F.col("k")).otherwise(0)).alias("more_known"),
    )

    def plus(a: str, b: str):
        return F.col(a) + F.coalesce(b, F.lit(0))

    return first.drop("rare").join(sums, "row", "left").select(
        F.col("id").alias(id), "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("value", "more").alias("score"),
    )


def score_held_out(
    docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, **settings
) -> DataFrame:
    """``score`` of all rows with held_out, by a model learned from the rows outside the held-out fold.

    Null texts are empty: one token, the end. A row without id is learned from. Rows that repeat are counted and scored
    one by one; without training rows nothing is known and every score is 0; other columns are not read.
    """
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    model, rest = fit(own.where(~fold_is("id", folds, held)).select("text"), scratch, **settings)
    found = score(own, model, rest, scratch, "id", "text")
    return found.select(F.col("id").alias(id), fold_is("id", folds, held).alias("held_out"), *found.columns[1:])
