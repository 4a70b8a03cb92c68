"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.joins import lookup_join
from ..operators.numbering import with_position
from ..session import ship_package, stage

WORD = r"[^\x20\x09-\x0D]+"  # a word is a run of anything but ASCII white space
WHITE = b" \t\n\v\f\r"
SLICE_BYTES = 1 << 20        # text handled at once by the numpy kernels
SMALL_ROWS = 200_000         # rows of a few numbers that may be broadcast: under 20 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Send rows to Python by hundreds, not by ten thousands: a row may hold a whole text or set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    spark.conf.set(key, str(min(500, rows) if rows > 0 else 500))


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn from: crc32 of the id as text leaves 1 when divided by 3.

    A row without id is not held out, and nothing is learnt from it either.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column as bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


_remembered: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """What a Python worker keeps from task to task for an operator; it serves all of them in turn, so what others kept goes."""
    if operator not in _remembered:
        _remembered.clear()
    return _remembered.setdefault(operator, {})


def tidy(operator: str, run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that keeps nothing of other operators meanwhile, and no spare memory of Arrow's afterwards."""
    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(operator)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return tidied


def annotate(df: DataFrame, source: str, name: str, schema: T.StructType,
             facts: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with a struct column ``name`` that ``facts`` makes of column ``source``, row by row.

    One pass in the tasks that scan ``df``; no shuffle.
    """
    ship_package(df.sparkSession)
    at = df.columns.index(source)
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])   # own columns may have any names
    out = T.StructType([*plain.schema.fields, T.StructField("made", schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            made = facts(as_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "made"])

    return plain.mapInArrow(tidy(name, run), out).toDF(*df.columns, name)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of 64 bits (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15             # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0..n-1 modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` neighbouring 64-bit values."""
    count = len(values) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * powers(INVERSE, count))


_is_white = np.zeros(256, dtype=bool)
_is_white[list(WHITE)] = True
_letters = mixed(np.arange(1, 257, dtype=np.uint64))
_lowered = _letters.copy()
_lowered[ord("A"):ord("Z") + 1] = _letters[ord("a"):ord("z") + 1]


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of a text."""
    inside = np.zeros(len(text) + 2, dtype=np.int8)
    inside[1:-1] = ~_is_white[text]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, A-Z taken as a-z.

    Long texts are hashed in slices cut between words, so that memory stays bounded.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        if end < len(data):
            white = np.flatnonzero(_is_white[data[at:end]])
            if len(white):
                end = at + int(white[-1]) + 1
            else:  # a word longer than a slice
                white = np.flatnonzero(_is_white[data[end:]])
                end = end + int(white[0]) + 1 if len(white) else len(data)
        part = data[at:end]
        starts, ends = word_spans(part)
        if len(starts):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_lowered[part] * powers(BASE, len(part)), out=sums[1:])
            span = (sums[ends] - sums[starts]) * powers(INVERSE, len(part))[starts]
            out.append(mixed(span ^ mixed((ends - starts).astype(np.uint64))))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows; of all words if there are fewer than ``width``."""
    words = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if not len(words):
        return words
    return np.unique(rolling(words, min(width, len(words))))


def positioned(df: DataFrame, order: list[str], label: str, name: str = "_position") -> DataFrame:
    """``df`` numbered 1..n in ``order`` by a range-partitioned sort; the input is staged first."""
    return with_position(stage(df, label), order, name)


def lookup(rows: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join to a stored table with one narrow row per key.

    Up to ``SMALL_ROWS`` counted rows are broadcast.  Beyond that, the rows per key are counted: keys that hold
    many are joined by broadcast, so that their rows stay in their tasks, and the others are merged on the key.
    """
    if small.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(small), key, how)
    return lookup_join(rows, small, rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), key, how)


def least_reachable(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, component) per node named there.

    ``component`` is the smallest node of the component.  Each round every component takes
    the smallest neighbour as its parent, parents are followed to the root, and the links
    are renamed; the number of components with open links at least halves.  Every round is
    written to the shared folder.
    """
    links = stage(links.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = stage(both.select(F.col("a").alias("node")).distinct()
                  .withColumn("component", F.col("node")), "components")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage(both.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("parent"))
                       .withColumn("parent", F.least("child", "parent")), "parents")
        while True:
            up = parent.select(F.col("child").alias("parent"), F.col("parent").alias("_up"))
            jumped = stage(parent.join(up, "parent").select("child", F.col("_up").alias("parent"),
                                                            (F.col("_up") != F.col("parent")).alias("_moved")), "parents")
            done = jumped.filter("_moved").isEmpty()
            parent = jumped.drop("_moved")
            if done:
                break
        named = stage(named.join(parent.withColumnRenamed("child", "component"), "component", "left")
                      .select("node", F.coalesce("parent", "component").alias("component")), "components")
        links = stage(
            links.join(parent.select(F.col("child").alias("a"), F.col("parent").alias("_a")), "a")
            .join(parent.select(F.col("child").alias("b"), F.col("parent").alias("_b")), "b")
            .filter("_a <> _b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    return named


def running(df: DataFrame, value: str, within: list[str], order: list[str], name: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one, inside a group of bounded size."""
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
