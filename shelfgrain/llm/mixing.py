"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id and queued; a document's virtual
finish time is the sum of its source's words up to and including it, divided by the source's
target.  All copies of all documents are range-sorted by finish time and taken until the total
budget is used.  A source whose target exceeds its size is queued again, three times at most.

Defined cases: null and empty texts have no words and are never taken; a null source is a
source of its own, last in order; ties in finish time are broken by source, hash, id and copy;
equal rows are interchangeable; an empty table gives an empty mix.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import SMALL_ROWS, WORD, positioned, running

MOST_REPEATS = 3
BUCKET_ROWS = 50_000   # rows of a source that one window partition should hold, about


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], repeats: int = MOST_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with the words each source should supply, as ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn.  A target stops at
    ``repeats`` times the source; the excess is shared out again by weight, which ends at
    min(repeats * size, share * weight) for one common share.  The share is found by
    aggregates over the sources, one per round; it only grows and stops when no source is
    newly above its limit.
    """
    keyed = sizes.withColumn("_last", F.col("source").isNull())
    numbered = positioned(keyed, ["_last", "source"], "sources")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        ((F.col("_position") - 1) % len(weights) + 1).cast("int"))
    weighed = stage(numbered.select("source", "source_size", turn.alias("_weight"),
                                    (F.col("source_size") * repeats).alias("_most")), "sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    share, settled = 0.0, -1
    while True:
        full = F.col("_most") <= F.lit(share) * F.col("_weight")
        n, used, open_weight = weighed.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0))).first()
        if n == settled or not open_weight:
            break
        settled, share = n, (total - used) / open_weight
    target = F.least(F.col("_most").cast("double"), F.lit(share) * F.col("_weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def queue(rows: DataFrame) -> DataFrame:
    """``rows`` (source, doc_id, size, ...) with ``_ahead``, the words of the source before the row.

    The order is the md5 of the id, then id and size.  A source may hold a third of all rows,
    so it is cut into ranges of the hash, more of them for larger tables; the ranges' sums give
    each its offset.
    """
    n = rows.count()
    digits = max(2, math.ceil(math.log(max(n, 1) / BUCKET_ROWS, 16))) if n else 2
    cut = rows.withColumn("_bucket", F.substring("_hash", 1, digits))
    within = running(cut, "size", ["source", "_bucket"], ["_hash", "doc_id", "size"], "_inside")
    sums = cut.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    offsets = running(sums, "_sum", ["source"], ["_bucket"], "_before").select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_of"), "_before")
    return (
        within.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_of")))
        .withColumn("_ahead", F.col("_before") + F.col("_inside"))
        .drop("_source", "_of", "_before", "_inside", "_bucket")
    )


def mix(rows: DataFrame, weights: Sequence[int], repeats: int = MOST_REPEATS) -> DataFrame:
    """``rows`` (source, doc_id, size) with ``source_size``, ``target`` and ``copies`` taken.

    ``rows`` should be narrow and staged.  Whole documents are taken in order of finish time
    while the budget, the words of all rows, covers them.
    """
    hashed = rows.withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, repeats).withColumnRenamed("source", "_named")
    queued = stage(
        queue(hashed).join(targets, F.col("source").eqNullSafe(F.col("_named"))).drop("_named"), "queue")
    queued = queued.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))
    finish = lambda copy: (F.col("source_size") * copy + F.col("_ahead") + F.col("size")) / F.col("target")
    key = lambda copy: F.struct(finish(copy).alias("finish"), F.col("_source").alias("source"), F.col("_hash").alias("hash"),
                                F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("size").alias("size"), F.lit(copy).alias("copy"))
    some = queued.filter("size > 0")
    copies = some.select(F.explode(F.array(*[key(c) for c in range(repeats)])).alias("_key")).select("_key.*")
    budget, rows_in_use = some.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not rows_in_use:
        return queued.select("doc_id", "source", "size", "source_size", "target", F.lit(0).alias("copies"))
    last = last_within(copies, budget)
    kept = [F.when(F.lit(last is not None) & (F.col("size") > 0) & not_after(key(c), last), 1).otherwise(0) for c in range(repeats)]
    return queued.select("doc_id", "source", "size", "source_size", "target", sum(kept[1:], kept[0]).alias("copies"))


def not_after(key: Column, last) -> Column:
    if last is None:
        return F.lit(False)
    return key <= F.struct(F.lit(last.finish).alias("finish"), F.lit(last.source).alias("source"), F.lit(last.hash).alias("hash"),
                           F.lit(last.id).cast("long").alias("id"), F.lit(last.size).cast("long").alias("size"), F.lit(last["copy"]).alias("copy"))


def last_within(items: DataFrame, budget: int):
    """The last of ``items``, globally sorted, up to which the running sum of ``size`` stays within ``budget``.

    Slices of the range-partitioned sort are summed; only the slice that crosses the budget is
    then summed row by row.
    """
    order = ["finish", "source", "hash", "id", "size", "copy"]
    sliced = positioned(items, order, "finish")
    rows = sliced.count()
    width = max(1, min(100_000, math.ceil(math.sqrt(rows))))  # rows in a block
    blocks = sliced.groupBy(F.floor((F.col("_position") - 1) / width).alias("_block")).agg(F.sum("size").alias("_sum"))
    # Blocks of blocks: at most a few hundred rows are summed in one task.
    coarse = blocks.groupBy(F.floor(F.col("_block") / 4096).alias("_over")).agg(F.sum("_sum").alias("_over_sum"))
    before = Window.orderBy("_over").rowsBetween(Window.unboundedPreceding, -1)
    over = (coarse.withColumn("_start", F.coalesce(F.sum("_over_sum").over(before), F.lit(0)))
            .filter(F.col("_start") <= budget).orderBy(F.desc("_over")).first())
    inside = running(blocks.filter(F.floor(F.col("_block") / 4096) == over["_over"]).withColumn("_one", F.lit(1)),
                     "_sum", ["_one"], ["_block"], "_start")
    block = (inside.withColumn("_start", F.col("_start") + over["_start"]).filter(F.col("_start") <= budget)
             .orderBy(F.desc("_block")).first())
    start, first = block["_start"], block["_block"] * width
    ranked = running(sliced.filter((F.col("_position") > first) & (F.col("_position") <= first + width))
                     .withColumn("_one", F.lit(1)), "size", ["_one"], ["_position"], "_ahead")
    inside = ranked.filter(F.col("_ahead") + F.col("size") + start <= budget).orderBy(F.desc("_position")).first()
    if inside is None and first:
        inside = sliced.filter(F.col("_position") == first).first()
    return inside


def mix_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Digest of the mix of ``docs``: how many words of each document are taken, repeats counted."""
    rows = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return mix(rows, weights).select("doc_id", "size", "source_size", "target",
                                     (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns as they are.

    The number of copies is looked up by id, source and size.  Rows that agree in all three share
    their copies, the first of them taking what is over.
    """
    keys = ["doc_id", "source", "size"]
    rows = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    taken = stage(mix(rows, weights).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
                  .filter("copies > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("copies").alias("_copies"), F.col("n").alias("_n")), "taken")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")     # own columns may have any name
    held = docs.select(row).withColumn("_words", n_words(F.col("_row.text")))
    same = (F.col("_row.doc_id").eqNullSafe(F.col("_doc_id")) & F.col("_row.source").eqNullSafe(F.col("_source"))
            & (F.col("_words") == F.col("_size")))
    small = taken.count() <= SMALL_ROWS
    found = held.join(F.broadcast(taken) if small else taken.hint("merge"), same)
    once = found.filter("_n = 1").withColumn("_times", F.col("_copies"))
    several = (found.filter("_n > 1")
               .withColumn("_k", F.row_number().over(Window.partitionBy("_doc_id", "_source", "_size").orderBy(F.xxhash64("_row.text"))))
               .withColumn("_times", F.expr("_copies div _n + if(_k <= _copies % _n, 1, 0)")).drop("_k"))
    every = once.unionByName(several).filter("_times > 0")
    return every.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_row.*")
