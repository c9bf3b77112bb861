"""SimHash near-duplicates: pigeonhole blocks find the candidates, the Hamming distance decides."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .components import components
from .frames import append_columns, fresh, join_uneven, words

#: Shingles whose bits are counted at a time, and fingerprints compared at a time in one task.
_CHUNK = 1 << 16
_GROUP = 1024


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text, repeats of a shingle counted; 0 for a text without words."""
    parts = words(text)
    if not parts:
        return 0
    joined = b" ".join(parts)
    width = min(shingle, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(parts) - width + 1
    for low in range(0, total, _CHUNK):
        high = min(total, low + _CHUNK)
        spans = zip(starts[low:high].tolist(), ends[low + width - 1 : high + width - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.dtype(">u8"), high - low)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of each text. Null texts count as empty."""

    def make(texts):
        return [pa.array([fingerprint(t, shingle, seed) for t in texts], pa.int64())]

    return append_columns(docs, text, {out: "bigint"}, make)


def _forest(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, smallest member) of the components among a few thousand fingerprints at most."""
    bits = values.view(np.uint64)  # the count of a negative number would be that of its absolute value
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= max_bits
    left, right = np.nonzero(np.triu(near, 1))
    root = np.arange(len(values))
    while len(left):
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (before == root).all():
            break
    inner = np.nonzero(root != np.arange(len(values)))[0]
    return values[inner], values[root[inner]]


def hamming_links(prints: DataFrame, scratch: Scratch, max_bits: int = 4, blocks: int = 6) -> DataFrame:
    """Links (u, v) that join exactly the fingerprints connected by steps of at most ``max_bits`` differing bits.

    ``prints`` has one row for each distinct ``fp``. The 64 bits are cut into ``blocks`` blocks; two fingerprints that
    differ in ``max_bits`` bits agree on ``blocks - max_bits`` blocks at least, so they meet under one of these
    combinations. Six blocks give keys of 21 bits, fit for some ten million fingerprints; seven give 27 bits, eight 32:
    the links are the same, only the work differs. Keys held by one fingerprint alone are dropped after counting. A key
    with more than ``_GROUP`` fingerprints is cut into chunks, and each pair of chunks is compared in a task of its
    own, so memory is bounded. Out of each comparison come the links of a spanning forest, never all pairs.
    """
    if blocks <= max_bits:
        raise ValueError("there must be more blocks than differing bits")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)
    ])).alias("k")).select("fp", "k.part", "k.bits")
    shared = scratch.table(keyed.groupBy("part", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    chunk = F.expr(f"int(pmod(xxhash64(fp, part), ceil(n / {_GROUP})))")
    chunks = F.ceil(F.col("n") / _GROUP).cast("int")
    met = (
        keyed.join(shared, ["part", "bits"])
        .withColumn("own", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .groupBy("part", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
    )

    def links(batches):
        for batch in batches:
            found = [_forest(np.array(x, np.int64), max_bits) for x in batch.column(0).to_pylist() if len(x) > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])

    return met.mapInArrow(links, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4,
    seed: int = 42, blocks: int = 6,
) -> DataFrame:
    """(id, fp, root, component_id), one row for each row of ``docs``.

    ``root`` names the group of linked fingerprints, ``component_id`` is the smallest id in it (null if all its ids are
    null). Equal fingerprints are reduced to one before anything is compared, so a group of copies of any size is one
    fingerprint. Null texts count as empty; all texts without words share fingerprint 0; repeated rows stay, an empty
    table gives an empty table; other columns are not read.
    """
    rows = scratch.table(with_fingerprint(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "fp", shingle, seed).select("id", "fp"))
    prints = scratch.table(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    linked = scratch.table(components(scratch.table(hamming_links(prints.select("fp"), scratch, max_bits, blocks)), scratch))
    grouped = scratch.table(
        prints.join(linked, prints["fp"] == linked["node"], "left")
        .select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    )
    groups = scratch.table(grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    named = scratch.table(join_uneven(grouped.select("fp", "root", "copies"), groups, "root", "n", prints.count()))
    return join_uneven(rows, named, "fp", "copies", rows.count()).select(F.col("id").alias(id), "fp", "root", "component_id")


def hex_print(column: str):
    """A signed 64-bit value as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (nulls last, then by fingerprint).

    Of rows that repeat both id and fingerprint one stays. Columns are those of ``docs``.
    """
    found = near_duplicates(docs, scratch, id, text, **settings)
    best = found.groupBy("root").agg(F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), "fp")).alias("b"))
    best = best.select(F.col("b.id").alias("_best_id"), F.col("b.fp").alias("_best_fp"))
    given = {k: settings[k] for k in ("shingle", "seed") if k in settings}
    own = fresh("fp", docs)
    marked = with_fingerprint(docs, text, own, **given)
    kept = marked.join(best, marked[id].eqNullSafe(best["_best_id"]) & (marked[own] == best["_best_fp"]), "left_semi")
    return kept.dropDuplicates([id, own]).select(*[F.col(f"`{c}`") for c in docs.columns])
