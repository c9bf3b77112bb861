"""URL rules by a sort-merge range join: a rule is an interval of sorted keys, one sweep finds the intervals that hold a key.

Only DataFrame functions are used. A rule names a host (with all its subdomains) and a start of the path. Hosts are
turned around label by label (``en.example.net`` becomes ``net.example.en.``), so all subdomains of a host share a prefix
and a prefix is one interval in sorted order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number within a partition in its lower 33 bits


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels of a host from last to first, each closed by a dot; an empty host has an empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _with_stack(nodes: DataFrame) -> DataFrame:
    """Per distinct ``key``: ``stack``, the payloads of all nodes whose key is a prefix of it, itself included, shortest first."""
    ends = nodes.select("key", F.explode(F.expr("transform(sequence(0, length(key)), n -> substring(key, 1, n))")).alias("prefix"))
    above = nodes.select(F.col("key").alias("prefix"), F.struct(F.length("key").alias("n"), F.col("key"), "payload").alias("node"))
    return ends.join(above, "prefix").groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("stack"))


def sweep(points: DataFrame, nodes: DataFrame, tie: str, scratch: Scratch) -> DataFrame:
    """``points`` with ``active``: the nodes whose key is a prefix of the point's ``key``, shortest first.

    ``nodes`` has one row for each ``key`` and a ``payload``. Points and nodes are sorted together by key and swept in
    order. The stack of active nodes at a point is that of the last node before it, less what ended in between: a
    prefix P of the point sorts before it, and any node between P and the point starts with P, so P is on that node's
    stack. The sort orders equal keys by ``tie``, a unique column of the points, hence a key that holds a third of all
    points still spreads over many tasks; what a task needs from those before it is one stack, passed on as one row for
    each task.
    """
    stacks = _with_stack(nodes).withColumn("point", F.lit(False))
    events = points.withColumn("point", F.lit(True)).unionByName(stacks, allowMissingColumns=True)
    order = events.orderBy("key", "point", tie).withColumn("mark", F.monotonically_increasing_id())
    order = scratch.table(order).withColumn("part", F.shiftrightunsigned("mark", _ROW_BITS))
    seen = Window.partitionBy("part").orderBy("mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = order.groupBy("part").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("mark"))).alias("last"))
    carried = carried.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    swept = order.withColumn("own", F.last("stack", ignorenulls=True).over(seen)).join(F.broadcast(carried), "part")
    active = F.filter(F.coalesce("own", "carried"), lambda node: F.startswith(F.col("key"), node["key"]))
    return swept.where("point").select(*points.columns, F.coalesce(active, F.expr("array()").cast(stacks.schema["stack"].dataType)).alias("active"))


def judge_urls(pages: DataFrame, rules: DataFrame, scratch: Scratch, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (as ``host`` + ``path``, null if none fits) and verdict.

    ``rules`` has columns host, path and verdict; of rules with the same host and path the smallest verdict counts. A
    rule fits its host and all subdomains if the path starts with the rule's; the longest (host and path together, then
    the longer host) wins. First the hosts are swept: which hosts with rules hold this one? Then the paths, once for
    each such host, of which there are at most as many as the host has labels. Null URLs and URLs without ``://`` have
    empty host and path and fit no rule of a real host. Rows that repeat are judged one by one; columns named like a
    result are replaced; empty tables, of pages or of rules, are fine.
    """
    added = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in added]
    rows = scratch.table(pages.select(
        F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("given"),
        url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
    ))
    named = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict")).withColumn("hkey", host_key(F.col("host")))
    )
    named = scratch.table(named)
    hosts = named.select(F.col("hkey").alias("key"), F.lit(0).alias("payload")).distinct()
    points = rows.select("rid", "path", host_key(F.col("host")).alias("key"))
    within = sweep(points, hosts, "rid", scratch).select("rid", "path", F.explode("active.key").alias("at"))
    within = within.select(F.concat("at", F.lit("\x00"), "path").alias("key"), "rid", F.concat_ws(" ", "rid", "at").alias("tie"))
    paths = named.select(
        F.concat("hkey", F.lit("\x00"), "path").alias("key"),
        F.struct(F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict").alias("payload"),
    )
    fits = sweep(within, paths, "tie", scratch).where(F.size("active") > 0).select("rid", F.element_at("active", -1)["payload"].alias("r"))
    best = fits.groupBy("rid").agg(F.max(F.struct(F.length("r.rule").alias("n"), "r.host_length", "r.rule", "r.verdict")).alias("b"))
    return rows.join(best, "rid", "left").select(
        *[F.col("given")[c].alias(c) for c in kept], "host", "path",
        F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"),
    )
