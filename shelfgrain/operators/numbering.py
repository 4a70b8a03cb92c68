"""Positions in a global order, without a single-partition window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage

SLICE_ROWS = 5_000_000  # rows sorted by one task
ROW_BITS = 33  # ``monotonically_increasing_id`` keeps the row number in the lower 33 bits


def with_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows 1..n in ``order``, which must be unique.

    Range-partitioned sort, a row number inside each partition, and the sizes of the
    partitions before it as an offset.  The numbered slices are written to the shared
    folder first: range bounds come from a sample, so a second evaluation could cut
    elsewhere.  A large input gets more slices than the usual shuffle.  The offsets have one row per partition, which bounds the broadcast.
    """
    slices = math.ceil(df.count() / SLICE_ROWS)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *order) if slices > usual else df.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order)
    sliced = stage(ordered.withColumn("_slot", F.monotonically_increasing_id()), "position")
    part = F.shiftright("_slot", ROW_BITS)
    sizes = sliced.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    row = F.col("_slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        sliced.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_offset") + row + 1).alias(name))
    )


def with_product_id(products: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sequential ``product_id`` in output order.

    Sampling the range bounds evaluates the input a second time, so the records are staged
    first: pages are parsed once.
    """
    return with_position(stage(products, "records"), order, "product_id")
