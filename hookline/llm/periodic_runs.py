"""Runs of repeated words by a dictionary of basic factors.

For every power of two L the stretches of L words are named, equal ones alike, from the names of their halves. Where a
name comes again within less than 2 L words, the distance is proposed as a period; the proposal is extended to both
sides as far as it holds, and stretches that several names or periods propose are kept once, under the smallest period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import append_columns

_CHUNK = 1 << 16  # words of several texts that are searched together
_SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _codes(texts: list[list[bytes]]) -> np.ndarray:
    """One number a word, equal only for equal words of one text, so that nothing repeats across texts."""
    out: list[int] = []
    base = 0
    for own in texts:
        table: dict[bytes, int] = {}
        out += [table.setdefault(w, base + len(table)) for w in own]
        base += len(table)
    return np.array(out, np.int64)


def _proposals(at: np.ndarray, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) proposed by factors of ``size`` words: their places, ascending, and their names.

    Places of one name that follow each other within half of ``size`` lie at equal distances, the smallest period of the
    factor: an arithmetic progression. What it repeats is found with shorter factors. Two progressions of one name are
    the same stretch come again. Where one of them breaks off within a run, the run maps it onto the other: their first
    or their last places lie a period apart. Where the two touch, every step of the progressions gives a period, that of
    a run around the seam. A distance below 2 ``size`` spans at most three gaps between progressions.
    """
    order = np.argsort(name, kind="stable")
    at, name = at[order], name[order]
    joined = (name[1:] == name[:-1]) & (2 * (at[1:] - at[:-1]) <= size)
    first = np.nonzero(np.concatenate(([True], ~joined)))[0]
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    step = np.where(last > first, at[np.minimum(first + 1, len(at) - 1)] - at[first], 0)
    places, periods = [], []
    for ahead in range(1, 4):
        same = np.nonzero(name[first[ahead:]] == name[first[:-ahead]])[0]
        for edge in (first, last):
            places.append(at[edge[same]])
            periods.append(at[edge[same + ahead]] - at[edge[same]])
        if ahead == 1:
            end, begin = at[last[same]], at[first[same + 1]]
            places.append(end)
            periods.append(begin - end)
            unit = np.maximum(step[same], step[same + 1])
            seam = (unit > 0) & (begin - end < size + 2 * unit)
            same, end, begin, unit = same[seam], end[seam], begin[seam], unit[seam]
            back = last[same] - first[same]
            times = np.minimum(back + last[same + 1] - first[same + 1], (2 * size - 1 - begin + end) // np.maximum(unit, 1))
            times = np.maximum(times, 0)
            own = np.repeat(np.arange(len(same)), times)
            turn = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + 1
            places.append(end[own] - np.minimum(turn, back[own]) * unit[own])
            periods.append((begin - end)[own] + turn * unit[own])
    place, period = np.concatenate(places), np.concatenate(periods)
    near = (period >= size) & (period < 2 * size)
    return place[near], period[near]


def _agrees(a: np.ndarray, b: np.ndarray, most: int, back: bool) -> int:
    """How many words agree from the front of two long arrays, or from their back, ``most`` at most."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        if back:
            same = a[len(a) - done - step : len(a) - done][::-1] == b[len(b) - done - step : len(b) - done][::-1]
        else:
            same = a[done : done + step] == b[done : done + step]
        if not same.all():
            return done + int(same.argmin())
        done += step
        step *= 4
    return done


def find_runs(codes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs: maximal stretches whose smallest period fits in twice, ``least`` words or more.

    Sorted by start, then period. Factors that occur once are dropped from the dictionary, as all longer ones that hold
    them occur once, so it shrinks fast in ordinary prose.
    """
    at, name, size = np.arange(len(codes)), codes, 1
    found: dict[tuple[int, int], int] = {}
    while len(at) > 1:
        places, periods = _proposals(at, name, size)
        order = np.lexsort((places, periods))
        last, upto = 0, -1
        for place, period in zip(places[order].tolist(), periods[order].tolist(), strict=True):
            if period == last and place < upto:
                continue  # within the stretch just extended
            behind, ahead = codes[:place], codes[: place + period]
            left = _agrees(behind, ahead, place, True)
            here = place + size
            right = _agrees(codes[here:], codes[here + period :], max(0, len(codes) - here - period), False)
            last, upto = period, here + right
            length = upto - (place - left) + period
            if length >= max(least, 2 * period):
                found.setdefault((place - left, length), period)  # periods ascend with the size and within it
        next_ = np.searchsorted(at, at + size)
        next_[next_ == len(at)] = 0
        twin = at[next_] == at + size
        at, pair = at[twin], name[twin] * (name.max() + 1) + name[next_[twin]]
        _, name, times = np.unique(pair, return_inverse=True, return_counts=True)
        again = times[name] > 1
        at, name, size = at[again], name[again], 2 * size
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def _kept(own: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run after its first period, joined by one space."""
    if not runs:
        return b" ".join(own)
    stay = np.ones(len(own), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return b" ".join([own[i] for i in np.nonzero(stay)[0].tolist()])


def _searched(bodies: list[bytes | None], least: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """The runs and the collapsed text of every text, some ``_CHUNK`` words or one text at a time."""
    runs: list[list[tuple[int, int, int]]] = []
    texts: list[bytes] = []
    held: list[list[bytes]] = []
    size = 0
    for i, body in enumerate(bodies):
        held.append((body or b"").split())
        size += len(held[-1])
        if size < _CHUNK and i < len(bodies) - 1:
            continue
        edges = np.cumsum([0, *map(len, held)])
        own: list[list[tuple[int, int, int]]] = [[] for _ in held]
        for start, length, period in find_runs(_codes(held), least):
            text = int(np.searchsorted(edges, start, "right")) - 1
            own[text].append((start - int(edges[text]), length, period))
        runs += own
        texts += map(_kept, held, own)
        held, size = [], 0
    return runs, texts


def with_runs(
    docs: DataFrame, text: str = "text", least: int = 12, names: tuple[str, str] = ("runs", "collapsed")
) -> DataFrame:
    """``docs`` with its runs (start and length in words, period; by start, then period) and the collapsed text, under these
    or other ``names``.

    Words are what lies between ASCII blanks. A run is a maximal stretch of words with smallest period p, at least
    ``least`` and 2 p words long. The collapsed text has the words that are in no run after that run's first p words,
    joined by one space; so a text without runs only has its blanks made even.

    Documents are searched one by one where they are, without shuffle; a very long text needs memory in proportion to
    its words. Null and empty texts have no run and collapse to the empty text. Rows that repeat are judged one by one,
    other columns pass, columns named like a result are replaced, an empty table stays empty.
    """

    def make(bodies: list[bytes | None]) -> list[pa.Array]:
        runs, texts = _searched(bodies, least)
        flat = [r for own in runs for r in own]
        fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
        edges = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        listed = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
        return [listed, pa.array(texts, pa.binary()).cast(pa.string())]

    return append_columns(docs, text, {names[0]: RUNS, names[1]: "string"}, make, as_bytes=True)


def with_planted_runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where about a tenth of the texts go on, from some word, by repeating a stretch of their own.

    With h the CRC-32 of the id in digits and g = h div 10, the texts of h divisible by 10 are changed: from word
    a = g mod n on, word i becomes word a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8). A row without id and a
    text without words stay as they are.
    """
    h = F.crc32(F.col(id).cast("string"))
    g = F.floor(h / 10)
    listed = F.filter(F.split(F.col(text), _SPACE), lambda w: w != "")

    def planted(own: Column) -> Column:
        n = F.greatest(F.size(own), F.lit(1)).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(own, (a + (i - a) % p).cast("int")))
        return F.concat_ws(" ", F.concat(F.slice(own, F.lit(1), a.cast("int")), tail))

    bound = F.transform(F.array(listed), planted)  # binds the words, so that they are split once a text
    changed = F.when((h % 10 == 0) & F.regexp_like(F.col(text), F.lit(r"[^\x20\x09-\x0D]")), F.get(bound, F.lit(0)))
    return docs.withColumn(text, F.coalesce(changed, F.col(text)))


def lists(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run, one after another."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))


def longest(runs: Column) -> Column:
    """The longest run, of equal ones that with the smallest start, then period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))

