"""Lempel-Ziv fingerprints: the phrases of an incremental parse, hashed, kept as one minimum for each of 256 bins.

Two texts that compress well together share many phrases; the share of equal bins estimates the likeness (Jaccard) of
their phrase sets.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BINS = 256
_EMPTY = "--"
_STEP = 1 << 21  # above any code point, so trie node and character make one number
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, extended as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) <= n:
            k = np.uint64(pow(int(_BASE), len(self.up), 1 << 64)), np.uint64(pow(int(_BASE), -len(self.up), 1 << 64))
            self.up, self.down = np.concatenate((self.up, self.up * k[0])), np.concatenate((self.down, self.down * k[1]))
        return self.up, self.down


_POWERS = _Powers()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _extend(codes: list[int], trie: dict[int, int], node: int, ends: list[int], at: int) -> int:
    """Parses on: adds each new phrase to the trie and its end to ``ends``; returns the node of the unfinished phrase."""
    get = trie.get
    free = (len(trie) + 1) * _STEP
    for c in codes:
        at += 1
        key = node + c
        step = get(key)
        if step is None:
            trie[key] = free
            free += _STEP
            ends.append(at)
            node = 0
        else:
            node = step
    return node


def _signature(codes: np.ndarray, ends: list[int]) -> str:
    """256 bins of two hex digits each, ``--`` for a bin without phrase."""
    if not ends:
        return _EMPTY * BINS
    last = np.array(ends)
    first = np.concatenate(([0], last[:-1]))
    up, down = _POWERS.upto(len(codes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])))
    h = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h = np.sort(h ^ (h >> np.uint64(31)))
    bins, at = np.unique(h >> np.uint64(56), return_index=True)
    cells = [_EMPTY] * BINS
    for b, v in zip(bins.tolist(), (h[at] & np.uint64(255)).tolist(), strict=True):
        cells[b] = f"{v:02x}"
    return "".join(cells)


def fingerprint(text: str | None) -> str:
    """512 characters; equal texts have equal ones. Null counts as empty."""
    codes = _codes(text or "")
    ends: list[int] = []
    _extend(codes.tolist(), {}, 0, ends, 0)
    return _signature(codes, ends)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first characters of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def both_fingerprints(text: str, following: str) -> tuple[str, str]:
    """The fingerprints of a text and of its edited form. Their common first half is parsed once."""
    codes, half = _codes(text), len(text) // 2
    mid = len(codes) - half
    listed = codes.tolist()
    trie: dict[int, int] = {}
    ends: list[int] = []
    node = _extend(listed[:mid], trie, 0, ends, 0)
    known, shared = len(trie), list(ends)
    tail = _codes(following[:half])
    _extend(tail.tolist(), trie, node, shared, mid)
    changed = _signature(np.concatenate((codes[:mid], tail)), shared)
    while len(trie) > known:
        trie.popitem()  # the newest entries, so the trie is again that of the first half
    _extend(listed[mid:], trie, node, ends, mid)
    return _signature(codes, ends), changed


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness of two phrase sets, 0 to 1; 1 for two empty texts, less chance matches of a byte."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(a.encode(), np.uint16), np.frombuffer(b.encode(), np.uint16)
    none = np.frombuffer(_EMPTY.encode(), np.uint16)[0]
    used = int(((x != none) | (y != none)).sum())
    same = int(((x == y) & (x != none)).sum())
    return max(0.0, (same / used - 1 / 256) / (1 - 1 / 256)) if used else 1.0


def _walk(rows: Iterator[tuple[bool, object, str]]) -> Iterator[tuple]:
    """Results for the rows (is a copy, id, text) of one run after another, in order.

    Each run ends with a copy of the row that follows it (more than one if that row's id is repeated; the first
    counts). One row is held until the next is known, one until the next is fingerprinted.
    """
    held = waiting = None
    for row in rows:
        if held is not None and held[0]:
            if row[0]:
                continue
            yield (*waiting, likeness(waiting[3], fingerprint(held[2])))
            waiting = None
        elif held is not None:
            own, changed = both_fingerprints(held[2], row[2])
            if waiting is not None:
                yield (*waiting, likeness(waiting[3], own))
            digest = hashlib.sha256(edited(held[2], row[2]).encode()).hexdigest()
            waiting = (held[1], len(held[2]), digest, own, changed, likeness(own, changed))
        held = row
    if waiting is not None:
        yield (*waiting, likeness(waiting[3], fingerprint(held[2])))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", runs: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The next document is the one with the next smaller id; rows of equal id follow each other by text, rows without id
    come last, the first row follows the last. Null texts are empty; a single row follows itself; an empty table gives
    an empty one; other columns are not read.

    Texts move once: the ids alone are read first and cut into ``runs`` of about equal size (default: as many as there
    are shuffle partitions), then each row goes to the task of its run, and the first row of each run also, as a copy,
    to the end of the run before it. Only the bounds of the runs, a number each, pass through the driver.
    """
    spark = docs.sparkSession
    runs = runs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = (
        f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    cuts = rows.agg(F.percentile_approx("id", [i / runs for i in range(1, runs)] or [0.5], 10000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))

    @F.arrow_udf("int")
    def run_of(ids: pa.Array) -> pa.Array:
        """0 for ids from the highest cut up and so on down; rows without id come last."""
        return pa.array([len(cuts) + 1 if i is None else len(cuts) - bisect_right(cuts, i) for i in ids.to_pylist()], pa.int32())

    heads = {r["run"]: r["id"] for r in rows.groupBy(run_of("id").alias("run")).agg(F.max("id").alias("id")).collect()}
    if not heads:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id)
    order = sorted(heads)
    starts = spark.createDataFrame(  # one row a run; the first run follows the last
        [(r, heads[r], order[i - 1]) for i, r in enumerate(order)], f"run int, head {kind}, earlier int"
    )
    placed = rows.withColumn("run", run_of("id")).join(F.broadcast(starts), "run")
    copied = F.when(F.col("id").eqNullSafe(F.col("head")), F.struct(F.col("earlier").alias("run"), F.lit(True).alias("copy")))
    dealt = placed.withColumn("to", F.explode(F.array_compact(F.array(F.struct("run", F.lit(False).alias("copy")), copied))))
    dealt = dealt.select("to.run", "to.copy", "id", "text").repartitionById(len(cuts) + 2, F.col("run"))
    dealt = dealt.sortWithinPartitions("run", "copy", F.desc_nulls_last("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]):
        out: list[tuple] = []
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        given = (r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def packed():
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=names)

        for row in _walk(given):
            out.append(row)
            if len(out) == 2000:
                yield packed()
                out = []
        if out:
            yield packed()

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id)
