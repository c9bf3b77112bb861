"""Collocations by set-oriented mining (SETM): occurrence relations joined place by place, counted and cut level by level.

A relation holds the occurrences of the frequent phrases of one length, sorted by text and place. Merged with itself one
place on, it gives the occurrences of the phrases one word longer; these are grouped and counted, and only occurrences of
frequent groups are kept for the next length. Every part of a frequent phrase is frequent, so none is missed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import sequence_id
from ..session import Scratch

_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_BLANKS = bytes.maketrans(b".,;:!?", b" " * 6)
_FLUSH = 1 << 18  # distinct words a task counts before it hands them on
_CACHE = 1 << 16  # words of a language whose numbers a task keeps
_CHUNK = 1 << 16  # words whose pairs are handed on together
_SENT = 500_000  # frequent groups up to this many are broadcast, some 50 MB; more are joined by a shuffle
_DEALS = 64


class _Items(dict):
    """Word to its number within a language: XXH64 of the word, seeded with that of the salt and the language."""

    def __init__(self, salt: str, lang: str):
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(lang.encode(), seed=xxhash.xxh64_intdigest(salt.encode(), seed=42))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, seed=self.seed)
        return value


def item_number(salt: str) -> Column:
    """What ``_Items`` gives the columns lang and word."""
    return F.xxhash64(F.lit(salt), "lang", "word")


def _pieces(text: str | None) -> list[list[bytes]]:
    """The words of each piece of a text, A-Z in lower case."""
    return [p.split() for p in (text or "").encode().lower().translate(_BREAKS).split(b"\n")]


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n) over all texts, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: dict[str, Counter] = {}

        def flat():
            return [pa.RecordBatch.from_arrays([
                pa.array([name] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64()),
            ], names=["lang", "word", "n"]) for name, own in seen.items()]

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(name, Counter()).update((body or "").encode().lower().translate(_BLANKS).split())
                if sum(map(len, seen.values())) > _FLUSH:
                    yield from flat()
                    seen = {}
        yield from flat()

    found = _texts(docs, text, lang).mapInArrow(run, "lang string, word binary, n bigint")
    return found.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _adjacent(docs: DataFrame, text: str, lang: str, salt: str) -> DataFrame:
    """(doc, at, x, y): the numbers of each two words that stand side by side in a piece.

    Words leave a text sorted by place, so the relation of single words is merged with itself as it is read. Between
    pieces a place is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        items: dict[str, _Items] = {}

        def joined(held: list, ends: list[int], docs_: list[int], own: list[int]):
            pieces = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
            number = np.array(held, np.uint64).view(np.int64)
            first = np.nonzero(pieces[1:] == pieces[:-1])[0]
            doc = np.array(docs_, np.int64)[pieces[first]]
            at = first + pieces[first] - np.array(own, np.int64)[pieces[first]]
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(number[first]), pa.array(number[first + 1])], names=["doc", "at", "x", "y"])

        held, ends, docs_, own = [], [], [], []  # numbers; per piece its end, its document and where that begins
        for batch in batches:
            for doc, name, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name not in items:
                    if len(items) >= 64:
                        items.clear()
                    items[name] = _Items(salt, name)
                get, begin = items[name].__getitem__, len(held) + len(ends)
                for words in _pieces(body):
                    if len(words) > 1:
                        held += map(get, words)
                        ends.append(len(held))
                        docs_.append(doc)
                        own.append(begin)
                if len(held) >= _CHUNK:
                    yield joined(held, ends, docs_, own)
                    held, ends, docs_, own = [], [], [], []
        if held:
            yield joined(held, ends, docs_, own)

    rows = _texts(docs, text, lang).select(F.monotonically_increasing_id().alias("doc"), "lang", "text")
    return rows.mapInArrow(run, "doc bigint, at bigint, x bigint, y bigint")


def _kept(rows: DataFrame, groups: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Semi-join of occurrences with their frequent groups, taking along the columns of these: a broadcast up to ``_SENT``
    groups, beyond that a shuffle, in which adaptive execution splits the keys of very many rows."""
    return rows.join(F.broadcast(groups) if size <= _SENT else groups, keys)


def frequent_phrases(
    docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", most: int = 5, least: int = 100
) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n): the words of each language; and for each length 1, 2, … the written table (id, lang, words, n, before, after, x, y) of the phrases that occur ``least``
    times or more in the pieces of all texts of a language; up to ``most`` words or the length that has none.

    x and y are the ids of the phrase without its last and without its first word; ``before`` and ``after`` count the
    phrase's first 1, 2, … and last 1, 2, … words. Words are numbered by a 64-bit hash; if a frequent word shares its number
    with another one, all are numbered anew with another salt, so counts are exact. Frequent phrases of every length are
    then numbered from 1 on, as small numbers take less room in what is written and shuffled.
    """
    counts = scratch.table(word_counts(docs, text, lang))
    totals = scratch.table(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    salt = 0
    while True:
        named = counts.withColumn("id", item_number(str(salt)))
        if named.groupBy("id").agg(F.count("*").alias("k"), F.max("n").alias("n")).where(f"k > 1 AND n >= {int(least)}").isEmpty():
            break
        salt += 1
    none = F.array().cast("array<bigint>")
    frequent = scratch.table(named.where(F.col("n") >= least).withColumnRenamed("id", "item"))
    words = sequence_id(frequent, ["lang", "word"]).select(
        "id", "item", "lang", F.array("word").alias("words"), "n", none.alias("before"), none.alias("after"), F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("bigint").alias("y")
    )
    words = scratch.table(words)
    levels, size = [words.drop("item")], words.count()
    rows = _adjacent(docs, text, lang, str(salt))
    for side in ("x", "y"):
        rows = _kept(rows, words.select(F.col("item").alias(side), F.col("id").alias(f"{side}_id")), [side], size)
    rows = scratch.table(rows.select("doc", "at", F.col("x_id").alias("x"), F.col("y_id").alias("y")))
    while len(levels) < most:
        groups = rows.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        groups = scratch.table(sequence_id(groups, ["x", "y"]))
        size = groups.count()
        if not size:
            break
        head = levels[-1].select(F.col("id").alias("x"), "lang", F.col("words").alias("front"), F.col("n").alias("x_n"), F.col("before").alias("x_before"))
        tail = levels[-1].select(F.col("id").alias("y"), F.element_at("words", -1).alias("last"), F.col("n").alias("y_n"), F.col("after").alias("y_after"))
        levels.append(scratch.table(groups.join(head, "x").join(tail, "y").select(
            "id", "lang", F.concat("front", F.array("last")).alias("words"), "n", F.concat("x_before", F.array("x_n")).alias("before"),
            F.concat("y_after", F.array("y_n")).alias("after"), "x", "y",
        )))
        if len(levels) == most:
            break
        kept = _kept(rows, groups.select("x", "y", "id"), ["x", "y"], size).select("doc", "at", "id")
        places = Window.partitionBy("doc").orderBy("at")  # both sides of the merge are this one sorted run
        merged = kept.select("doc", "at", F.col("id").alias("x"), F.lead("id").over(places).alias("y"), F.lead("at").over(places).alias("next"))
        after = scratch.table(merged.where(F.col("next") == F.col("at") + 1).select("doc", "at", "x", "y"))
        scratch.drop(rows)
        rows = after
    return totals, levels


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) for counts below 10^15, by decimals of up to 38 digits."""
    def digits(x: Column, k: int) -> Column:
        return x.cast(f"decimal({k},0)")

    over, under = digits(a, 15) * digits(n, 17) * digits(F.lit(1000), 4), digits(left, 15) * digits(right, 15)
    return F.call_function("div", over, under)


def collocations(
    docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", most: int = 5, least: int = 100, top: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``most`` words of each language.

    n is the number of words of the language, a that of the phrase, l and r those of its two parts at the cut with the
    lowest score floor(1000 a n / (l r)), the first of equal ones. Phrases with fewer than ``least`` occurrences are left
    out, and those that stand within a longer one as frequent as they are; a longer one reaches them word by word, so
    only phrases one word longer need be asked. Order: score, a, both descending, then phrase.

    A text is split at ``.,;:!?`` and line breaks; phrases do not cross these. Null texts are empty, a null language is
    ``und``, rows that repeat count one by one, other columns are not read, an empty table gives an empty one. Each language
    is first ranked within 64 deals of its phrases, so no task ranks more than 64 times ``top``.
    """
    totals, levels = frequent_phrases(docs, scratch, text, lang, most, least)
    found = None
    for place, level in enumerate(levels[1:], 1):
        rows = level.select("id", "lang", "words", "n", "before", "after")
        if place + 1 < len(levels):
            longer = levels[place + 1]
            over = longer.select(F.col("x").alias("id"), "n").unionByName(longer.select(F.col("y").alias("id"), "n"))
            rows = rows.join(over.groupBy("id").agg(F.max("n").alias("over")), "id", "left").where(F.col("over").isNull() | (F.col("over") < F.col("n"))).drop("over")
        rows = rows.drop("id")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = levels[0].where(F.lit(False)).select("lang", "words", "n", "before", "after")
    found = found.withColumnRenamed("n", "a").join(totals, "lang")

    def cut(k: Column) -> Column:
        left, right = F.get("before", k - 1), F.get("after", F.size("before") - k)
        return F.struct(exact_score(F.col("a"), F.col("n"), left, right).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    scored = found.select(
        "lang", F.concat_ws(" ", "words").alias("phrase"), "a", "n", F.array_min(F.transform(F.sequence(F.lit(1), F.size("before")), cut)).alias("best")
    ).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(_DEALS)))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
