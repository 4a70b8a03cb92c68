"""URL rules by a sort-merge range join of reversed-host keys.

A rule (host, path) fits its host and all subdomains if the path of the URL starts with the
rule's path.  The key of a rule is its host with the labels reversed, then its path; all keys
that continue it form an interval.  Intervals of rules are nested or apart, so at any key the
open ones form a stack, and the innermost is the longest rule.  A URL is looked up once for
each of its parent hosts, and the deepest host that fits decides.

The sweep: rule ends and URLs are range-sorted together; each slice is swept from the stack
top that the slice before left behind.  No rule is broadcast, however long the list.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule;
rules without host are ignored; of equal rules ``block`` wins; equal URLs are judged row by row;
empty tables of URLs or rules work.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import SMALL_ROWS, lookup, positioned

SLICES = 256             # of a sweep, at least, where there are rows enough
SLICE_ROWS = 1_000_000   # rows of a slice, at most


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, letters, letters.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(reversed_labels: Column) -> Column:
    """Bytes that sort by reversed host; a byte that sorts first closes the host."""
    return F.concat(F.array_join(reversed_labels, ".").cast("binary"), F.lit(bytes([0])))


def labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def keyed_rules(rules: DataFrame) -> DataFrame:
    return stage(
        rules.filter("host <> '' and path is not null")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
        .select(host_key(labels(F.col("host"))).alias("host_key"), F.size(labels(F.col("host"))).alias("n_labels"), "path",
                F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("top")), "rules")


def boundaries(keyed: DataFrame) -> DataFrame:
    """Where the top of the stack changes: at a rule's start to the rule, at its end to the rule around it."""
    whole = F.concat("host_key", F.col("path").cast("binary"))
    starts = keyed.select(whole.alias("key"), "top")
    shorter = keyed.filter("path <> ''").select(
        whole.alias("key"), "host_key", "path", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("_n"))
    around = (
        shorter.select("key", "_n", F.concat("host_key", F.expr("substring(path, 1, _n)").cast("binary")).alias("_outer"))
        .join(starts.select(F.col("key").alias("_outer"), F.col("top").alias("_top")), "_outer")
        .groupBy("key").agg(F.max_by("_top", "_n").alias("_top")))
    ends = starts.select("key").join(around, "key", "left").select(
        F.concat("key", F.lit(bytes([255]))).alias("key"), F.col("_top").alias("top"))  # no UTF-8 text has the byte 255
    return starts.unionByName(ends)


def sweep(points: DataFrame, marks: DataFrame) -> DataFrame:
    """``points`` (key, row, depth) with ``top``, that of the last of ``marks`` (key, top) at or before the key."""
    nothing = F.lit(None).cast(marks.schema["top"].dataType)
    every = points.select("key", F.lit(1).alias("kind"), "row", "depth", nothing.alias("top")).unionByName(
        marks.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("row"), F.lit(0).alias("depth"), "top"))
    placed = positioned(every, ["key", "kind", "row", "depth"], "sweep", "position")
    rows = placed.count()
    width = max(1, math.ceil(rows / max(SLICES, rows / SLICE_ROWS)))
    sliced = placed.withColumn("slice", F.floor((F.col("position") - 1) / width))
    mark = F.when(F.col("kind") == 0, F.struct("top"))  # a mark may hold an empty stack
    left = sliced.groupBy("slice").agg(F.max_by(mark, F.when(F.col("kind") == 0, F.col("position"))).alias("left"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    carried = left.select("slice", F.last("left", True).over(before).alias("carried"))
    upto = Window.partitionBy("slice").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    swept = sliced.withColumn("open", F.last(mark, True).over(upto)).filter("kind = 1")
    return (lookup(swept, stage(carried, "carried"), "slice")
            .select("row", "depth", F.coalesce("open", "carried")["top"].alias("top")))


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``urls`` (url, ...) with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    ``rules`` has host, path and verdict.  ``urls`` should be narrow; it is staged.  Where the
    hosts that have rules are few, only parent hosts among them enter the sweep.
    """
    rows = stage(urls.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
                 .withColumn("_row", F.monotonically_increasing_id()), "urls")
    keyed = keyed_rules(rules)
    deepest = keyed.agg(F.max("n_labels")).first()[0] or 0
    upper = rows.filter("host <> ''").select(
        "_row", "path", labels(F.col("host")).alias("_labels")).withColumn("_n", F.least(F.size("_labels"), F.lit(deepest)))
    parents = upper.filter("_n > 0").select(
        "_row", "path", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("depth"), "_labels").select(
        F.col("_row").alias("row"), "path", "depth", host_key(F.expr("slice(_labels, 1, depth)")).alias("host_key"))
    hosts = keyed.select("host_key").distinct()
    if hosts.count() <= SMALL_ROWS:
        parents = parents.join(F.broadcast(hosts), "host_key", "left_semi")
    points = parents.select(F.concat("host_key", F.col("path").cast("binary")).alias("key"), "row", "depth")
    found = (sweep(points, boundaries(keyed)).filter("top is not null")
             .groupBy("row").agg(F.max_by("top", "depth").alias("_top")).withColumnRenamed("row", "_row"))
    return (rows.join(found, "_row", "left")
            .withColumn("rule", F.col("_top.rule")).withColumn("verdict", F.coalesce("_top.verdict", F.lit(default)))
            .drop("_row", "_top"))


def judge_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Digest of the judgement of ``pages``: one row per page."""
    return judge_urls(pages.select("page_id", "url"), rules).drop("url")
