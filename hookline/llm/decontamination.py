"""Benchmark decontamination by templates: typed placeholders for what a copyist changes, then windows looked up by hash.

Numbers, names and units become ``<num>``, ``<name>`` and ``<unit>``, so a question with other numbers or names has the same
template. What stood in the slots must then change in a consistent way: equal values stay equal, different ones different.
"""

from __future__ import annotations

from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import Scratch
from .frames import append_columns, fresh

#: Units of measure and currency signs that count as one type.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec min h hr hrs hours hour minutes minute seconds second days day weeks "
    "week months month years year mph kmh km/h m/s hz khz mhz ghz w kw v kb mb gb tb usd eur gbp dollars dollar euros euro cents "
    "cent percent pounds pound miles mile meters meter metres metre kilometers kilometres inches inch feet foot grams gram liters "
    "litres degrees celsius fahrenheit $ € £ % °c °f".split()
)
#: Items with fewer words than this are found as whole lines only, with the same numbers, names and units.
SHORT = 5
#: Cardinal numbers that are written as words; tens and units may be joined by a hyphen.
SPELLED = {
    word: str(value)
    for value, word in enumerate(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
        "nineteen".split()
    )
} | {word: str(10 * tens) for tens, word in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%")
_NUM, _NAME, _UNIT, _HEAD = "<num>", "<name>", "<unit>", "<head>"
_BASE = 0x9E3779B97F4A7C15  # odd, so powers never vanish
_MASK = (1 << 64) - 1
_CACHE = 1 << 19
_CHUNK = 1 << 15  # words looked up at once
_PAIRS = 1 << 20  # places compared with windows at once
_HASH = {x: xxhash.xxh64_intdigest(x.encode()) for x in (_NUM, _NAME, _UNIT, "in")}
_NOTHING, _WORD, _SLOT, _CAPITAL, _SPELLED = -1, 0, 1, 2, 3  # kinds of pieces; a capitalised word may be a name


def _number(low: str) -> str | None:
    """The value of a number written as a word or as two with a hyphen, else null."""
    tens, _, unit = low.partition("-")
    if unit in SPELLED and len(SPELLED[unit]) == 1 and unit != "zero" and tens.endswith("ty") and tens in SPELLED:
        return str(int(SPELLED[tens]) + int(SPELLED[unit]))
    return SPELLED.get(low)


def _form(piece: str) -> tuple[int, int, str, bool, bool]:
    """(hash, kind, value, ends a sentence, capital) of a blank-separated piece; a spelled number has its word's hash."""
    if piece.isalpha() and piece.islower() and piece not in UNITS and piece not in SPELLED:
        return xxhash.xxh64_intdigest(piece.encode()), _WORD, piece, False, False
    core = piece.strip(_EDGE)
    ends = piece.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":")
    if not core:
        return 0, _NOTHING, "", ends, False
    bare = core.replace(",", "").replace(".", "").replace("%", "").replace("$", "")
    low = core.lower()
    if bare.isdigit():
        return _HASH[_NUM], _SLOT, _NUM + bare, ends, False
    if low in UNITS and low != "in":
        return _HASH[_UNIT], _SLOT, _UNIT + low, ends, False
    own = xxhash.xxh64_intdigest(low.encode())
    if (value := _number(low)) is not None:
        return own, _SPELLED, _NUM + value, ends, False
    capital = core[0].isupper()
    return own, _CAPITAL if capital and not core.isupper() else _WORD, low, ends, capital


class _Forms(dict):
    """Blank-separated piece to a number, with the forms by number. Number 0 is "in" as a unit."""

    def __init__(self):
        super().__init__()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.form: list[tuple[int, int, str, bool, bool]] = [(_HASH[_UNIT], _SLOT, _UNIT + "in", False, False)]
        self.digest, self.kind = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int8)
        self.digest[0], self.kind[0] = _HASH[_UNIT], _SLOT

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self.form)
        form = _form(piece)
        self.form.append(form)
        if k == len(self.kind):
            self.digest, self.kind = (np.concatenate([x, np.zeros_like(x)]) for x in (self.digest, self.kind))
        self.digest[k], self.kind[k] = form[0], form[1]
        return k


_FORMS = _Forms()  # of this Python worker, bounded


def counted(spelled: list[bool]) -> list[bool]:
    """Which spelled numbers are quantities: those in a row of fewer than three. "one two three" is plain words."""
    out = list(spelled)
    at = 0
    while at < len(out):
        end = at
        while end < len(out) and spelled[end]:
            end += 1
        if end - at >= 3:
            out[at:end] = [False] * (end - at)
        at = max(end, at + 1)
    return out


def template(text: str | None, forms: _Forms, names: Set[str] = frozenset()) -> tuple[list[int], list[str]]:
    """Hashes of the words of a benchmark text and, beside them, the value of each slot ("" for a plain word).

    A name is a word of ``names`` in any case, or one that is capitalised within a sentence. A capitalised word that begins
    a sentence or a line may be a name or not, and is a ``<head>``. "in" is a unit after a number only. A number may be
    spelled ("five", "twenty-five"), but three and more spelled ones in a row are counting and stay words. Pieces without
    a letter, digit or unit are dropped. Null is empty.
    """
    read: list[tuple[int, int, str, bool]] = []  # hash, kind, value, begins a sentence
    for line in (text or "").split("\n"):
        begins = True
        for piece in line.split():
            digest, kind, value, ends, _ = forms.form[forms[piece]]
            if kind != _NOTHING:
                read.append((digest, kind, value, begins))
            begins = ends or (begins and kind == _NOTHING)
    amounts = counted([kind == _SPELLED for _, kind, _, _ in read])
    hashes: list[int] = []
    slots: list[str] = []
    for (digest, kind, value, begins), amount in zip(read, amounts, strict=True):
        if amount:
            digest, kind = _HASH[_NUM], _SLOT
        elif kind == _WORD and value == "in" and hashes and hashes[-1] == _HASH[_NUM]:
            digest, kind, value = _HASH[_UNIT], _SLOT, _UNIT + value
        hashes.append(digest)
        if kind == _SLOT:
            slots.append(value)
        elif kind != _SPELLED and (value in names or (kind == _CAPITAL and not begins)):
            slots.append(_NAME + value)
        else:
            slots.append(_HEAD + value if kind == _CAPITAL else "")
    return hashes, slots


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` words, by their polynomial in a fixed base. A word of 0 adds nothing."""
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + hashes[k : k + len(out)]
    return out


def consistent(ours: list[str], theirs: list[str]) -> bool:
    """Whether the slot values of one window map one to one onto those of the other. Values start with their type."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for a, b in zip(ours, theirs, strict=True):
        if bool(a) != bool(b) or there.setdefault(a, b) != b or back.setdefault(b, a) != a:
            return False
    return True


def benchmark_names(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(name): the words that any item capitalises within a sentence, in lower case."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            slots = {s for body in batch.column(0).to_pylist() for s in template(body, _FORMS)[1]}
            yield pa.RecordBatch.from_arrays([pa.array([s[len(_NAME) :] for s in slots if s.startswith(_NAME)], pa.string())], names=["name"])

    return benchmark.select(F.col(text).alias("text")).mapInArrow(run, "name string").distinct()


def benchmark_windows(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = 10, least: int = 3, known: Set[str] = frozenset()
) -> DataFrame:
    """(hash, width, item, words, slots) of every window of every item; equal ones once, under the smallest item.

    Names and heads are slots, with 0 for their word, so the hash is that of all other words. In a window with fewer than
    two other words both are plain words, so a list of names is found as it stands. An item shorter than ``width`` is one window of its own length. One with fewer
    than ``SHORT`` words is one window too, but counts only as a whole line with equal values; one with fewer than
    ``least`` words, which ordinary language is full of, gives no window. Null and empty items give none. ``known`` are the
    names of the benchmark.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: list[tuple] = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, slots = template(body, _FORMS, known)
                w = min(width, len(hashes))
                if w < least:
                    continue
                if len(_FORMS) >= _CACHE:
                    _FORMS.clear()
                for at in range(len(hashes) - w + 1):
                    words, own = hashes[at : at + w], slots[at : at + w]
                    if sum(not s.startswith((_NAME, _HEAD)) for s in own) >= 2:
                        own = [_NAME + s[len(_HEAD) :] if s.startswith(_HEAD) else s for s in own]
                    else:
                        own = ["" if s.startswith((_NAME, _HEAD)) else s for s in own]
                    words = np.array([0 if s.startswith(_NAME) else x for x, s in zip(words, own, strict=True)], np.uint64)
                    out.append((int(window_hashes(words, w).view(np.int64)[0]), w, name, words.view(np.int64).tolist(), own))
            if out:
                kinds = (pa.int64(), pa.int32(), batch.schema.field(0).type, pa.list_(pa.int64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["hash", "width", "item", "words", "slots"])

    kind = benchmark.schema[item].dataType.simpleString()
    found = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(
        run, f"hash bigint, width int, item {kind}, words array<bigint>, slots array<string>"
    )
    return found.groupBy("hash", "width", "words", "slots").agg(F.min("item").alias("item"))


class _Anchors:
    """The windows whose longest stretch without names has one length, found by the hash of that stretch.

    Windows that differ only in where their names are need no lookup each: there are at most ``width`` lengths.
    """

    def __init__(self, rows: list[tuple[int, int]]):
        rows = sorted(rows)
        self.windows = np.array([k for _, k in rows], np.int64)
        self.keys, self.first, self.count = np.unique(np.array([h for h, _ in rows], np.uint64), return_index=True, return_counts=True)
        size = max(14, (64 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - size)
        self.bits = np.zeros(1 << size, np.bool_)
        self.bits[self.keys >> self.shift] = True

    def find(self, stretches: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of stretches and the windows that have them for anchor, in blocks."""
        at = np.nonzero(self.bits[stretches >> self.shift])[0]
        own = stretches[at]
        key = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        fits = self.keys[key] == own
        at, key = at[fits], key[fits]
        ends = np.cumsum(self.count[key])
        for lo in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS):
            pair = np.arange(lo, min(lo + _PAIRS, int(ends[-1])))
            of = np.searchsorted(ends, pair, "right")
            yield at[of], self.windows[self.first[key[of]] + pair - (ends[of] - self.count[key[of]])]


class _Windows:
    """Windows of a benchmark block, looked up by their anchors, then by the hash of all words but the names, then word by
    word and slot by slot.

    What a document has in the place of a name is read by the window, so case and line breaks of the copy do not matter.
    """

    def __init__(self, rows: list, known: Set[str]):
        self.known = known
        self.words = [[w & _MASK for w in r["words"]] for r in rows]
        self.slots, self.items = [r["slots"] for r in rows], [r["item"] for r in rows]
        self.hash = np.array([r["hash"] & _MASK for r in rows], np.uint64)
        self.width = np.array([r["width"] for r in rows], np.int64)
        self.named = np.zeros((len(rows), max((r["width"] for r in rows), default=1)), np.bool_)
        self.offset = np.zeros(len(rows), np.int64)
        groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, (slots, words) in enumerate(zip(self.slots, self.words, strict=True)):
            at, length, run = 0, 0, 0
            for i, slot in enumerate(slots):
                self.named[k, i] = slot.startswith(_NAME)
                run = 0 if self.named[k, i] else run + 1
                if run > length:
                    at, length = i + 1 - run, run
            self.offset[k] = at
            stretch = window_hashes(np.array(words[at : at + length], np.uint64), length)
            groups.setdefault((length, len(slots)), []).append((int(stretch[0]), k))
        self.groups = {key: _Anchors(own) for key, own in sorted(groups.items())}

    def hits(self, texts: list[str | None], forms: _Forms) -> list[tuple[int, object]]:
        """For each text the number of its windows that are benchmark windows, and the smallest item of these."""
        out: list[tuple[int, object]] = []
        pieces: list[np.ndarray] = []
        first = n = 0
        for i, text in enumerate(texts):
            split = (text or "").split()
            pieces.append(np.fromiter(map(forms.__getitem__, split), np.int64, len(split)))
            n += len(split)
            if n >= _CHUNK or i == len(texts) - 1:
                out += self._hits(pieces, texts[first : i + 1], forms)
                pieces, first, n = [], i + 1, 0
                if len(forms) >= _CACHE:
                    forms.clear()
        return out

    def _hits(self, pieces: list[np.ndarray], texts: list[str | None], forms: _Forms) -> list[tuple[int, object]]:
        pieces = [p[forms.kind[p] != _NOTHING] for p in pieces]
        ends = np.cumsum([len(p) for p in pieces])
        ids = np.concatenate(pieces)
        words = forms.digest[ids]
        inner = np.ones(len(ids) + 1, np.bool_)  # places that do not begin a text
        inner[0] = inner[ends] = False
        spelled = np.nonzero(forms.kind[ids] == _SPELLED)[0]
        for row in np.split(spelled, np.nonzero((np.diff(spelled) > 1) | ~inner[spelled[1:]])[0] + 1):
            if len(row) < 3:
                words[row] = np.uint64(_HASH[_NUM])
        inches = np.nonzero(words[1:] == np.uint64(_HASH["in"]))[0] + 1
        inches = inches[(words[inches - 1] == np.uint64(_HASH[_NUM])) & inner[inches] & (forms.kind[ids[inches]] == _WORD)]
        words[inches], ids[inches] = np.uint64(_HASH[_UNIT]), 0
        counts, items = [0] * len(ends), [[] for _ in ends]
        found: dict[tuple[int, int], list] = {}
        stretches, reach = words, 1
        for (length, width), anchors in self.groups.items():
            while reach < length:
                stretches, reach = stretches[:-1] * np.uint64(_BASE) + words[reach:], reach + 1
            for place, window in anchors.find(stretches):
                place = place - self.offset[window]
                inside = (place >= 0) & (place + width <= len(words))
                place, window = place[inside], window[inside]
                left = np.zeros(len(place), np.uint64)
                for k in range(width):
                    left = left * np.uint64(_BASE) + np.where(self.named[window, k], np.uint64(0), words[place + k])
                same = left == self.hash[window]
                for at, k in zip(place[same].tolist(), window[same].tolist(), strict=True):
                    if self._fits(k, words[at : at + width].tolist(), [forms.form[i] for i in ids[at : at + width].tolist()]):
                        found.setdefault((at, width), []).append(self.items[k])
        lines: dict[int, set[tuple[int, int]]] = {}
        for (at, width), same in found.items():
            doc = int(np.searchsorted(ends, at, "right"))
            if at + width > ends[doc]:
                continue
            if width < SHORT:
                begin = int(ends[doc]) - len(pieces[doc])
                if doc not in lines:
                    lines[doc] = set(_lines(texts[doc], forms))
                if (at - begin, at - begin + width) not in lines[doc]:
                    continue
            counts[doc] += 1
            items[doc] += [x for x in same if x is not None]
        return [(n, min(i, default=None)) for n, i in zip(counts, items, strict=True)]

    def _fits(self, window: int, digests: list[int], forms: list[tuple]) -> bool:
        """Whether the words of a text are those of a window but for the slots, and its slots map one to one.

        A name may be replaced by a capitalised word or one the benchmark knows as a name; in a text without capitals by
        any word, if four fifths of the window are equal. In a window of fewer than ``SHORT`` words the slots are equal.
        """
        ss = self.slots[window]
        theirs: list[str] = []
        changed = other = 0
        for w, s, digest, (_, kind, value, _, capital) in zip(self.words[window], ss, digests, forms, strict=True):
            slot = digest in (_HASH[_NUM], _HASH[_UNIT])
            if s.startswith(_NAME):
                if slot or kind == _SPELLED:
                    return False
                theirs.append(_NAME + value)
                if theirs[-1] != s:
                    changed += 1
                    other += not capital and value not in self.known
            elif w != digest:
                return False
            else:
                theirs.append(value if slot else "")
        if len(ss) < SHORT:
            return theirs == ss
        if other and (5 * changed > len(ss) or any(f[4] for f in forms)):
            return False
        return consistent(ss, theirs)


def _lines(text: str | None, forms: _Forms) -> Iterator[tuple[int, int]]:
    """First word and end of each line of a text, in words that are kept."""
    at = 0
    for line in (text or "").split("\n"):
        n = sum(forms.form[forms[piece]][1] != _NOTHING for piece in line.split())
        yield at, at + n
        at += n


def with_hits(
    docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text: str = "text", item: str = "item_id",
    benchmark_text: str = "text", width: int = 10, block: int = 200_000, names: tuple[str, str] = ("hits", "item"),
) -> DataFrame:
    """``docs`` with hits (windows of the text that are a benchmark window) and item (the smallest item hit, else null),
    under these or other ``names``.

    The benchmark is the query set: its windows are sent to all tasks, ``block`` at a time (some 50 MB), and documents are
    read as a stream, once for each block; no document is shuffled, so neither a passage that a third of all documents
    share nor a very long text gathers anywhere. Null and empty texts have no hits, repeated rows are judged one by one,
    columns named like a result are replaced. An empty benchmark leaves 0 hits.
    """
    item_type = benchmark.schema[item].dataType
    kind = item_type.simpleString()
    known = frozenset(r["name"] for r in benchmark_names(benchmark, benchmark_text).collect())
    found = scratch.table(benchmark_windows(benchmark, item, benchmark_text, width, known=known))
    blocks = max(1, -(-found.count() // block))
    hits, first = names
    out = docs.withColumns({hits: F.lit(0).cast("long"), first: F.lit(None).cast(kind)})
    own_hits, own_first = fresh("block_hits", out), fresh("block_item", out)
    for k in range(blocks):
        part = found.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == k).select("hash", "width", "words", "slots", "item")
        sent = docs.sparkSession.sparkContext.broadcast(_Windows(part.collect(), known))  # about ``block`` rows

        def make(texts, sent=sent):
            pairs = sent.value.hits(texts, _FORMS)
            return [pa.array([n for n, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], to_arrow_type(item_type))]

        step = append_columns(out, text, {own_hits: "bigint", own_first: kind}, make)
        step = step.withColumns({hits: F.col(hits) + F.col(own_hits), first: F.least(first, own_first)})
        out = step.drop(own_hits, own_first)
    return out
