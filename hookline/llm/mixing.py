"""Mixing sources to target weights by entropy balancing: tilted rates from Newton steps on the dual, rounded to copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import sequence_id
from ..session import Scratch
from .frames import word_count

_KEY = ["none", "src"]
_BINS = 1024
_STEPS = 80
_ROUNDS = 4  # the shift is found to 2 / _BINS ** _ROUNDS, far below the spread of rows that repeat
_SPREAD = 2.0**-16


def _by_source(column: str) -> list[Column]:
    """A source as two columns that never are null, so that a null source is a source like any other."""
    return [F.col(column).isNull().alias("none"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("src")]


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float, scratch: Scratch) -> DataFrame:
    """One row a source: key columns, weight, source_size, target.

    Sources in code point order, null last, take the weights in turn. Targets share the sum of all sizes by weight; a
    target above ``most`` times its source stops there and the excess is shared again by weight among the others, until
    none is above. Every round fixes a source at least; the table has one row a source.
    """
    totals = scratch.table(sizes.groupBy(*_KEY).agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    open_ = scratch.table(
        sequence_id(totals, _KEY, "place").withColumn("weight", share)
        .select(*_KEY, "weight", "source_size", "docs", (F.col("source_size") * float(most)).alias("cap"))
    )
    total = float(open_.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = 0.0, -1
    above = F.lit(False)
    while True:  # the level only rises, so a source above its cap stays above
        row = open_.agg(
            F.sum(F.when(above, F.col("cap"))).alias("used"), F.sum(F.when(~above, F.col("weight"))).alias("weight"),
            F.coalesce(F.sum(above.cast("int")), F.lit(0)).alias("n"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        level, capped = (total - (row["used"] or 0.0)) / row["weight"], row["n"]
        above = F.col("weight") * F.lit(level) > F.col("cap")
    target = F.when(above, F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    return scratch.table(open_.select(*_KEY, "weight", "source_size", "docs", target.alias("target")))


def tilts(sizes: DataFrame, targets: DataFrame, most: float, scratch: Scratch, tolerance: float = 1e-7) -> DataFrame:
    """(key columns, scale, tilt): the rate of a document is ``min(most, exp(tilt * size / scale))``.

    These rates lie closest in entropy to taking each document once, among all rates whose words meet the targets. The
    dual is convex and falls apart into one variable a source; its Newton step needs the words taken and their
    derivative, two sums that each iteration gathers over a table of (source, size, documents). A step that leaves the
    bracket known so far is halved into it. A source whose target is its cap has no finite tilt and gets one that
    saturates every document.
    """
    counted = scratch.table(sizes.where("size > 0").groupBy(*_KEY, "size").agg(F.count("*").alias("n")))
    state = scratch.table(targets.where("source_size > 0").select(
        *_KEY, "target", "source_size", (F.col("source_size") / F.col("docs")).alias("scale"), F.lit(0.0).alias("tilt"),
        F.lit(-1e300).alias("low"), F.lit(1e300).alias("high"), (F.col("target") >= F.lit(most) * F.col("source_size") * (1 - 1e-9)).alias("done"),
    ))
    state = state.withColumn("tilt", F.when(F.col("done"), F.lit(1e18)).when(F.col("target") <= 0, F.lit(-1e18)).otherwise(F.col("tilt")))
    state = state.withColumn("done", F.col("done") | (F.col("target") <= 0))
    for _ in range(_STEPS):
        if state.where("not done").isEmpty():
            break
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * x, F.lit(50.0))))
        sums = counted.join(state.where("not done").select(*_KEY, "scale", "tilt"), _KEY).groupBy(*_KEY).agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
        )
        off = F.col("got") - F.col("target")
        step = state.join(sums, _KEY, "left").withColumn("off", off)
        step = step.withColumns({
            "low": F.when(F.col("off") < 0, F.greatest("low", "tilt")).otherwise(F.col("low")),
            "high": F.when(F.col("off") > 0, F.least("high", "tilt")).otherwise(F.col("high")),
            "met": F.col("done") | (F.abs("off") <= F.lit(tolerance) * F.col("target")),
        })
        move = F.greatest(F.lit(-2.0) - F.abs("tilt"), F.least(F.lit(2.0) + F.abs("tilt"), -F.col("off") / F.greatest("slope", F.lit(1e-300))))
        aim = F.col("tilt") + move
        inside = (aim > F.col("low")) & (aim < F.col("high"))
        after = scratch.table(step.select(
            *_KEY, "target", "source_size", "scale",
            F.when(F.col("met"), F.col("tilt")).when(inside, aim).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"),
            "low", "high", F.col("met").alias("done"),
        ))
        scratch.drop(state)
        state = after
    return state.select(*_KEY, "scale", "tilt")


def _shift(rows: DataFrame, targets: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Per source, the number added to all of its ``z`` (rate plus a fixed uniform number) so that rounding down meets the target.

    As the shift grows from -1 to 1 every document passes whole numbers at known places, each adding its size. The
    places are binned, the bins summed per source, and the bin in which the target is met is binned again.
    """
    n = _BINS
    base = rows.select(*_KEY, "size", "z", F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.col("z") - 1))).alias("least"))
    steps = base.select(*_KEY, "size", F.explode(F.array(*[
        F.when((F.col("least") < j) & (F.lit(j) - F.col("z") <= 1), F.lit(float(j)) - F.col("z")) for j in range(1, most + 1)
    ])).alias("at")).where("at is not null")
    steps = scratch.table(steps)
    start = base.groupBy(*_KEY).agg(F.sum(F.col("size") * F.col("least")).alias("sum"))
    range_ = scratch.table(targets.join(start, _KEY).select(*_KEY, "target", "sum", F.lit(-1.0).alias("low"), F.lit(2.0 / n).alias("width")))
    for _ in range(_ROUNDS):
        cells = (
            steps.join(range_, _KEY).withColumn("cell", F.floor((F.col("at") - F.col("low")) / F.col("width")))
            .where(F.col("cell").between(0, n - 1) | ((F.col("cell") == n) & (F.col("at") <= 1.0)))
            .groupBy(*_KEY, F.least("cell", F.lit(n - 1)).alias("cell")).agg(F.sum("size").alias("words"))
        )
        listed = cells.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("cell", "words"))).alias("cells"))  # at most n a source
        walk = F.aggregate(
            "cells", F.struct(F.lit(-1).cast("long").alias("cell"), F.col("sum").cast("double").alias("sum"), F.lit(0).cast("long").alias("next")),
            lambda a, c: F.when((a["next"] > 0) | (a["sum"] + c["words"] > F.col("target")), F.struct(
                F.when(a["next"] > 0, a["cell"]).otherwise(c["cell"]).alias("cell"), a["sum"].alias("sum"),
                F.when(a["next"] > 0, a["next"]).otherwise(c["words"]).alias("next"),
            )).otherwise(F.struct(c["cell"].alias("cell"), (a["sum"] + c["words"]).alias("sum"), F.lit(0).cast("long").alias("next"))),
        )
        found = range_.join(listed, _KEY, "left").withColumn("w", walk)
        met = F.col("w.next") > 0
        nearer = met & (F.col("w.sum") + F.col("w.next") - F.col("target") < F.col("target") - F.col("w.sum"))
        range_ = scratch.table(found.select(
            *_KEY, "target", F.coalesce("w.sum", "sum").alias("sum"), (F.col("width") / n).alias("width"),
            (F.col("low") + F.when(met, F.col("w.cell")).otherwise(F.lit(n)) * F.col("width")).alias("low"),
            F.when(nearer, F.col("width")).otherwise(F.lit(0.0)).alias("round_up"),
        ))
    return range_.select(*_KEY, (F.col("low") + F.col("round_up")).alias("shift"))


def mix(
    docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 42, keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` with size, source_size, target, rate, copies and taken.

    Every document is taken a whole number of times, 0 to ``most``; ``taken`` is copies times size. Rates come from
    ``tilts``; a number drawn from the id, source and size decides the rounding, and one small shift a source makes the
    words taken meet the target up to about one document. Rows of equal id, source and size, as are those without id,
    draw numbers that differ by up to 2^-16 with the row's place in the input, so they round one by one and a source of
    copies meets its target too. Runs over the same files agree. A null text has size 0 and is taken 0 times; a null
    source is a source of its own, after all others; an empty table stays empty; columns named like a result are replaced. The joins put one row a source next to the
    documents: that table's size is known when it is read, so the optimiser broadcasts it while it is small and
    shuffles otherwise.
    """
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    given = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("given")
    counted = docs.select(given, *_by_source(source), F.col(id).alias("id"), word_count(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("place"))

    def uniform(*of: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*of, F.lit(seed)), 11) / F.lit(float(1 << 53))

    draw = uniform("id", *_KEY, "size") * (1 - _SPREAD) + uniform("place") * _SPREAD
    drawn = counted.select("given", *_KEY, "size", draw.alias("u"))
    if text in kept:  # read the texts again rather than write them out
        rows, sizes = drawn, scratch.table(drawn.drop("given"))
    else:
        rows = sizes = scratch.table(drawn)
    targets = source_targets(sizes, weights, most, scratch)
    tilted = scratch.table(targets.join(tilts(sizes, targets, most, scratch), _KEY, "left"))
    exponent = F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))
    rate = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(most)), F.exp(exponent)))
    at = sizes.where("size > 0").join(tilted.select(*_KEY, "tilt", "scale"), _KEY).select(*_KEY, "size", (rate + F.col("u")).alias("z"))
    settled = scratch.table(tilted.join(_shift(at, targets, most, scratch), _KEY, "left"))
    out = rows.join(settled.select(*_KEY, "source_size", "target", "tilt", "scale", "shift"), _KEY).withColumn("rate", rate)
    whole = F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.col("rate") + F.col("u") + F.coalesce("shift", F.lit(0.0)))))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(whole).cast("int")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(
        *[F.col("given")[c].alias(c) for c in kept], *added
    )
