"""Repeated passages by sparse suffixes: those at minimiser positions are kept, equal ones brought together, matches extended.

Of all suffixes only those are kept that begin at a minimiser: the smallest hash of 8 words among 16 neighbouring
positions. A passage of 50 words holds 16 such positions from its start, so wherever it occurs the same one of them is
kept, with 35 words of the passage or more still to come. Sorted by these 35 words, the occurrences would be neighbours;
here a hash of these words brings them together in place of the sort, since only equal suffixes are asked for and groups
of equal hashes are reduced in each task before they move, which a sort cannot. Equal 64-bit hashes count as equal words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .frames import join_uneven, words

_CACHE = 1 << 16
_CHUNK = 1 << 18  # words whose places are handed on together


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()  # of this Python worker, bounded


def _hashed(text: str | None) -> np.ndarray:
    return np.array(list(map(_HASHES.__getitem__, words(text))), np.uint64)


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words, from sums of powers in which a run's place cancels out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, base = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        out = out * base + hashes[k : k + n]
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def minimisers(hashes: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the smallest (leftmost of equal) hash of ``gram`` words in every ``window`` neighbouring ones."""
    grams = _runs(hashes, gram)
    if len(grams) < window:
        return np.zeros(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1)
    return np.unique(low + np.arange(len(low)))


def _spans(starts: np.ndarray, others: list, length: int) -> list[tuple[int, int, object]]:
    """Sorted starts of repeated runs joined to maximal spans (first word, end, one document that repeats it)."""
    out: list[tuple[int, int, object]] = []
    for s, other in zip(starts.tolist(), others, strict=True):
        if out and s == out[-1][1] - length + 1:
            out[-1] = (out[-1][0], s + length, min(out[-1][2], other))
        else:
            out.append((s, s + length, other))
    return out


def repeated_passages(
    docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", length: int = 50, gram: int = 8, window: int = 16
) -> DataFrame:
    """(id, first_word, end_word, n_words, also_in): every maximal stretch of a document in which each ``length`` words in a
    row also occur in another document. ``also_in`` is one such other document. Documents without any have no row.

    Words are folded to lower case (A-Z). First the kept suffixes are written with the hash of their first words; of each
    group of equal neighbours only the smallest and largest document are needed to know that two documents share it, so
    a passage found in a third of all documents is one row after the map side, and the way back to its suffixes is a join
    that broadcasts such frequent keys. Then only documents with shared suffixes are read again, and every run of
    ``length`` words that may hold one is compared in the same way: this extends a match to the left up to the window
    and to the right, run by run. No pairs are formed.

    Null and short texts have no passage; rows without id are not compared, as the result could not name them; rows with
    equal id are one document, and what only they share is not repeated; other columns are not read.
    """
    kept = length - window + 1
    if kept < gram:
        raise ValueError("length must be at least window + gram - 1")
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))

    def listed_places(batch: pa.RecordBatch, keys: list, at: list, owner: list) -> pa.RecordBatch:
        ids = batch.column(0).take(pa.array(np.concatenate(owner)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), ids, pa.array(np.concatenate(at))], names=["key", "id", "at"])

    def seeds(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys, at, owner, size = [], [], [], 0
            for place, body in enumerate(batch.column(1)):
                hashes = _hashed(body.as_py())
                size += len(hashes)
                if len(hashes) >= length:
                    own = minimisers(hashes, gram, window)
                    own = own[own <= len(hashes) - kept]
                    keys.append(_runs(hashes, kept)[own].view(np.int64))
                    at.append(own.astype(np.int32))
                    owner.append(np.full(len(own), place))
                if keys and size > _CHUNK:
                    yield listed_places(batch, keys, at, owner)
                    keys, at, owner, size = [], [], [], 0
            if keys:
                yield listed_places(batch, keys, at, owner)

    def shared(found: DataFrame) -> DataFrame:
        sides = found.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
        return scratch.table(sides.where("low < high"))

    found = scratch.table(rows.mapInArrow(seeds, f"key bigint, id {kind}, at int"))
    common = shared(found)
    marked = join_uneven(found, common.select("key", "n"), "key", "n", found.count())
    anchors = scratch.table(marked.groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("at")))
    scratch.drop(found)

    def extended(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys, at, owner, size = [], [], [], 0
            for place, (body, anchor) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                hashes = _hashed(body.as_py())
                size += len(hashes)
                if len(hashes) >= length:  # else a short row under an id that also has a long one
                    starts = np.unique((anchor.values.to_numpy(zero_copy_only=False)[:, None] - np.arange(window)).ravel())
                    starts = starts[(starts >= 0) & (starts <= len(hashes) - length)]
                    keys.append(_runs(hashes, length)[starts].view(np.int64))
                    at.append(starts.astype(np.int32))
                    owner.append(np.full(len(starts), place))
                if keys and size > _CHUNK:
                    yield listed_places(batch, keys, at, owner)
                    keys, at, owner, size = [], [], [], 0
            if keys:
                yield listed_places(batch, keys, at, owner)

    runs = scratch.table(rows.join(anchors, "id").select("id", "text", "at").mapInArrow(extended, f"key bigint, id {kind}, at int"))
    matched = join_uneven(runs, shared(runs), "key", "n", runs.count())
    other = F.when(F.col("id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("also_in")
    listed = matched.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("at", other))).alias("runs"))

    def joined(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for name, runs_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = {}
                for r in runs_:
                    first.setdefault(r["at"], r["also_in"])
                starts = np.array(list(first), np.int64)
                out += [(name, a, b, b - a, o) for a, b, o in _spans(starts, list(first.values()), length)]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["id", "first_word", "end_word", "n_words", "also_in"]
            )

    return listed.mapInArrow(joined, f"id {kind}, first_word int, end_word int, n_words int, also_in {kind}").withColumnRenamed("id", id)
