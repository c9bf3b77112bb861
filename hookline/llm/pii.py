"""Personal data: generators propose spans, boosted trees judge them by format and context, calibrated cuts select.

Only DataFrame functions and Spark ML run here. Four strict rules give the base spans, which always stay. Wider rules
propose more; those that resemble base spans in form and surroundings, as gradient boosted trees see it, are added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .frames import fresh

#: In the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone")
_MARK = "\x01"

#: The base rules. Possessive quantifiers and the look-behind change no match: a match inside a run of allowed characters
#: would also be found at the run's start, or where the last match ended. They keep the search linear and the stack flat.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: The wide rules: high recall, little precision.
_WIDE = {
    "email": r"(?:(?<![^\s@|<>\x22(),;:])|\G)[^\s@|<>\x22(),;:]{1,64}+(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}+(?![0-9.]*[0-9])",
    "card": r"(?<![0-9+])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}(?:[\x20.-]?[0-9]{1,7})?+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?[0-9]{0,3}+[\x20.-]?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
}

_FEATURES = ("kind", "chars", "digits", "letters", "blanks", "points", "groups", "longest", "cue", "warning", "glued_left", "glued_right", "line_start", "repeats")
_CUES = r"(?i)mail|phone|tel|call|fax|mobile|card|visa|pay|host|server|address|contact|\bip\b"
_WARNINGS = r"(?i)token|key|hash|sha|md5|version|isbn|issn|order|invoice|page|figure|\bv[0-9]|=\s*\W?$"


def _spans(text: Column, pattern: str) -> Column:
    """Matches from left to right as (start, end, value), in characters, end exclusive.

    Marks are set around the matches and the text is cut at them, so positions come from adding up lengths. A mark in the
    text itself is replaced by another control character first, which no rule uses.
    """
    clean = F.replace(text, F.lit(_MARK), F.lit("\x02"))
    parts = F.split(F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    span = "struct<start:int,end:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.expr(f"cast(array() as array<{span}>)").alias("found"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        item = F.array(F.struct(a["at"].alias("start"), end.alias("end"), x.alias("value")))
        return F.struct(end.alias("at"), (~a["match"]).alias("match"), F.when(a["match"], F.concat(a["found"], item)).otherwise(a["found"]).alias("found"))

    return F.aggregate(parts, start, step, lambda a: a["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & _luhn(F.substring(digits, 1, 19))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _base_spans(text: Column) -> Column:
    """All base spans as (start, kind, end), kind by its place in ``KINDS``."""
    def of(i: int, kind: str) -> Column:
        fine = F.filter(_spans(text, _BASE[kind]), lambda s: _valid(kind, s["value"]))
        return F.transform(fine, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def _candidates(text: Column) -> Column:
    """Spans of the wide rules with the numbers the trees see. None of these is a check the base rules make."""
    def one(i: int, kind: str) -> Column:
        def look(s: Column) -> Column:
            value = s["value"]
            left = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
            right = F.substring(text, s["end"] + 1, F.lit(1))
            groups = F.regexp_extract_all(value, F.lit("([0-9]+|[A-Za-z]+)"))
            numbers = {
                "chars": F.length(value), "digits": F.length(_digits(value)), "letters": F.length(F.regexp_replace(value, r"[^\p{L}]", "")),
                "blanks": F.length(F.regexp_replace(value, "[^ ]", "")), "points": F.length(F.regexp_replace(value, "[^.]", "")),
                "groups": F.size(groups), "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
                "cue": left.rlike(_CUES), "warning": left.rlike(_WARNINGS), "glued_left": left.rlike(r"[\p{L}\p{N}_=/]$"),
                "glued_right": right.rlike(r"[\p{L}\p{N}_=/]"), "line_start": left.rlike(r"(^|\n)$"),
                "repeats": F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("([0-9])")))),
            }
            return F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lit(float(i)).alias("kind"), *[numbers[n].cast("double").alias(n) for n in _FEATURES[1:]]
            )

        return F.transform(_spans(text, _WIDE[kind]), look)

    return F.concat(*[one(i, k) for i, k in enumerate(KINDS)])


def propose(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, print, n_chars, base, candidates) for each row; ``print`` is a hash of the text. Null texts are empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id).alias("id"), F.xxhash64(body).alias("print"), F.length(body).alias("n_chars"), _base_spans(body).alias("base"), _candidates(body).alias("candidates")
    )


def _judged(found: DataFrame) -> DataFrame:
    """One row for each distinct candidate: id, print, its numbers, and whether it covers a base span of its kind (label).

    Candidates inside a base span of their kind are left out: they are in the result anyway.
    """
    rows = found.select("id", "print", "base", F.explode("candidates").alias("c"))
    same = F.filter("base", lambda b: b["kind"] == F.col("c.kind"))
    covers = F.exists(same, lambda b: (b["start"] >= F.col("c.start")) & (b["end"] <= F.col("c.end")))
    inside = F.exists(same, lambda b: (b["start"] <= F.col("c.start")) & (b["end"] >= F.col("c.end")) & ((b["start"] < F.col("c.start")) | (b["end"] > F.col("c.end"))))
    return rows.where(~inside).select("id", "print", covers.cast("int").alias("label"), "c.*")


@dataclass
class SpanJudge:
    """Boosted trees and a cut for each kind; without a model nothing is added."""

    model: GBTClassificationModel | None
    cuts: dict[int, float]

    def select(self, found: DataFrame) -> DataFrame:
        """(id, print, added): the spans added to each text that gets any, as (start, kind, end)."""
        if self.model is None or not self.cuts:
            none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)").alias("added")
            return found.select("id", "print", none).where(F.lit(False))
        scored = _scored(self.model, _judged(found))
        cut = F.element_at(F.create_map(*[F.lit(x) for k, v in self.cuts.items() for x in (float(k), v)]), F.col("kind"))
        span = F.struct("start", F.col("kind").cast("int").alias("kind"), "end")
        return scored.where(F.col("p") >= cut).groupBy("id", "print").agg(F.collect_set(span).alias("added"))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(rows)


def _scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(_assembled(rows)).withColumn("p", vector_to_array("probability")[1])


def fit_judge(found: DataFrame, scratch: Scratch, most: int = 20_000, trees: int = 10, depth: int = 4, precision: float = 0.9) -> SpanJudge:
    """Trees learned from ``most`` distinct texts at most, drawn by hash; ``found`` should be a written table.

    A candidate is taken for right if it covers a base span of its kind. The trees are grown on three quarters of the
    texts or on ``most`` of these; over the candidates of all other texts each kind gets the lowest cut at which the share
    of right ones is ``precision`` or more. Copies of a text count once in both. A kind for which no cut reaches that adds
    nothing.
    """
    growing = F.pmod(F.xxhash64("print", F.lit("check")), F.lit(4)) != 0
    texts = scratch.table(found.where(F.size("candidates") > 0).where(growing).select("print").distinct())
    total = texts.count()
    if total > most:
        bucket = F.pmod(F.xxhash64("print", F.lit("draw")), F.lit(max(1, 64 * total // most)))
        sizes = {r["bucket"]: r["count"] for r in texts.where(bucket < 128).groupBy(bucket.alias("bucket")).count().collect()}
        part = drawn = 0
        while drawn + sizes.get(part, 0) <= most and part < 128:
            drawn, part = drawn + sizes.get(part, 0), part + 1
        growing = growing & (bucket < part)
    learn = scratch.table(_judged(found.where(growing)).drop("id").dropDuplicates(["print", "start", "end", "kind"]))
    if learn.select("label").distinct().count() < 2:
        return SpanJudge(None, {})
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label").fit(_assembled(learn))
    step = F.floor(F.col("p") * 200).alias("step")
    judged = _scored(model, _judged(found.where(~growing))).select("print", "start", "end", "kind", "label", step).distinct()
    steps = judged.groupBy("kind", "step").agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()  # 4 kinds, 201 steps
    cuts = {}
    for kind in range(len(KINDS)):
        right = n = 0
        for r in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            right, n = right + r["right"], n + r["n"]
            if right >= precision * n:
                cuts[kind] = r["step"] / 200
    return SpanJudge(model, cuts)


def find(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(id, print, base, spans) for each row of ``docs``: the base spans and all spans, sorted by start, kind and end.

    Texts are searched whole, once, and stay where they are; what is joined are spans by id and text hash. Null and
    empty texts have no spans; rows that repeat are judged one by one; other columns are not read; an empty table gives
    an empty one.
    """
    found = scratch.table(propose(docs, id, text))
    added = scratch.table(fit_judge(found, scratch, **settings).select(found))
    same = found["id"].eqNullSafe(added["id"]) & (found["print"] == added["print"])
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    both = F.array_distinct(F.concat(found["base"], F.coalesce(added["added"], none)))
    return found.join(added, same, "left").select(found["id"].alias(id), found["print"], F.sort_array("base").alias("base"), F.sort_array(both).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span (sorted by start) replaced by its kind, as ``<EMAIL>``. Overlapping spans count as one, of the first's kind."""
    merged = F.aggregate(spans, F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"), _merge)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(a: Column, s: Column) -> Column:
        kept = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.struct(s["end"].alias("at"), F.concat(a["out"], kept, F.element_at(names, s["kind"] + 1)).alias("out"))

    done = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.aggregate(merged, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, done)


def redact(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", chars: str = "n_chars", **settings) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind, and the column ``chars``, if there is one, counted anew.

    All rows stay, with the columns they had; a null text stays null.
    """
    found = find(docs, scratch, id, text, **settings).where(F.size("spans") > 0).dropDuplicates([id, "print"])
    mine, theirs, own = fresh("print", docs), fresh("found_id", docs), fresh("found_spans", docs)
    other = fresh("found_print", docs)
    found = scratch.table(found.select(F.col(id).alias(theirs), F.col("print").alias(other), F.col("spans").alias(own)))
    marked = docs.withColumn(mine, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    out = marked.join(found, F.col(id).eqNullSafe(F.col(theirs)) & (F.col(mine) == F.col(other)), "left")
    out = out.withColumn(text, F.when(F.col(own).isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col(own))))
    if chars in docs.columns:
        length = F.length(text).cast(docs.schema[chars].dataType)
        out = out.withColumn(chars, F.when(F.col(own).isNull(), F.col(chars)).otherwise(length))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _merge(found: Column, s: Column) -> Column:
    last = F.try_element_at(found, F.lit(-1))
    joined = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
    head = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))
    return F.when(last["end"] > s["start"], F.concat(head, F.array(joined))).otherwise(F.concat(found, F.array(s)))
