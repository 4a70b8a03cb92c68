"""Sharding by rendezvous hashing over weighted shards.

Every shard draws a pseudo-random number for a record key; the shard with the largest
``weight / -ln(draw)`` gets the record.  Key and shards alone decide, so records keep their
shard whatever else is in the table, and a shard that is added only takes records into itself.

Defined cases: a null key is a key like any other; equal keys share a shard; equal rows get
slots of their own; an empty table stays empty.  Columns other than the key and the text are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import positioned


def scores(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """One struct (score, minus the shard number) per shard, as an array."""
    shards = F.array(*[F.struct(F.lit(first + k).alias("shard"), F.lit(float(w)).alias("weight"))
                       for k, w in enumerate(weights)])

    def score(shard: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, shard["shard"]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((shard["weight"] / -F.log(draw)).alias("score"), (-shard["shard"]).alias("minus"))

    return F.transform(shards, score)


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], added: float = 1.0) -> DataFrame:
    """``df`` with ``shard`` and with ``grown_shard``, the shard after one of weight ``added`` has joined.

    Ties go to the lower shard.  Row by row: no shuffle, and the plan does not grow with the number of shards.
    """
    if not weights or min(weights) <= 0 or added <= 0:
        raise ValueError("every shard needs a positive weight")
    best = F.array_max(scores(F.col(key), weights))
    new = scores(F.col(key), [added], first=len(weights))[0]
    return (
        df.withColumn("_best", best).withColumn("_new", new)
        .withColumn("shard", (-F.col("_best.minus")).cast("int"))
        .withColumn("grown_shard", F.when(F.col("_new") > F.col("_best"), F.lit(len(weights)))
                    .otherwise(-F.col("_best.minus")).cast("int"))
        .drop("_best", "_new")
    )


def with_slots(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number the rows of each ``shard`` from 0 in ``order``, by one range-partitioned sort of narrow rows.

    A shard may hold more rows than one task can sort: its rows lie in many slices, and the
    number is the position in the whole less the rows of the shards before.
    """
    placed = positioned(df, ["shard", *order], "sharded")
    counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (placed.join(F.broadcast(starts), "shard")  # one row per shard
            .withColumn("slot", F.col("_position") - F.col("_start") - 1).drop("_position", "_start"))


def shard_documents(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Digest of the sharding of ``docs``: one row per document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                         F.crc32(text).alias("text_crc32"))
    placed = with_slots(assign_shards(narrow, "doc_id", weights), ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
