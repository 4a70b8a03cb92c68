"""Vector code compression: codebooks for parts of vectors, trained by dual-tree Lloyd rounds.

Vectors are cut into equal parts; every part position has a codebook of its own.  A block of vectors
has a tree for each part (halved at the median of its widest side, down to ``LEAF`` vectors), and
so has a codebook.  Both trees are walked at once: the distance bounds between the boxes of a
node of vectors and a node of entries discard entries that cannot be nearest to any vector there.
A node with one entry left is assigned as a whole, with its cached sum; leaves that stay uncertain
compare whole numbers.  All bounds are whole numbers too, so the result is that of plain rounds.

Blocks are cut where vectors are scanned, put into the order of their trees and staged once.  A task
adds up its blocks, so a round shuffles at most one row per task, part and entry; the driver
sees the codebooks, whose size does not depend on the table.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; shorter
vectors (empty ones too) are filled up with zeros at the end to the longest, and that to a multiple of the
number of parts; components beyond what 64-bit sums can hold (2^27 for 64 components) are cut to that; rows
without id come last when the first entries are chosen, rows of one id in the order of their components;
repeated rows count each; labels are told apart by how they read as text, and null is one of them; an
empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import lookup_join
from ..session import ship_package, spread, stage

PARTS = 4
ENTRIES = 256              # of a codebook; codes are two hexadecimal digits
ROUNDS = 4
SCALE = 1024
LEAF = 16                  # vectors in a leaf, at most
BLOCK_VALUES = 1 << 18     # components of the vectors that share trees: 4,096 vectors of 64


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end among ``n`` rows in the order of their tree."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def depth(n: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(n / leaf)))


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which every node of the tree is a range."""
    n = len(points)
    order = np.arange(n)
    for level in range(depth(n, leaf)):
        cut = bounds(n, level)
        own = points[order]
        widest = np.argmax(np.maximum.reduceat(own, cut[:-1]) - np.minimum.reduceat(own, cut[:-1]), axis=1)
        node = np.repeat(np.arange(1 << level), np.diff(cut))
        order = order[np.lexsort((own[np.arange(n), widest[node]], node))]
    return order


class Tree:
    """Boxes of all nodes over rows that stand in the order of their tree, and cached sums."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points = points
        self.depth = depth(len(points), leaf)
        self.cuts = [bounds(len(points), level) for level in range(self.depth + 1)]
        self.low = [np.minimum.reduceat(points, cut[:-1]) for cut in self.cuts]
        self.high = [np.maximum.reduceat(points, cut[:-1]) for cut in self.cuts]
        self.sums = np.concatenate((np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(points, axis=0)))


class Codebook:
    """A tree over the distinct entries; ``index`` has the lowest index of each."""

    def __init__(self, entries: np.ndarray):
        distinct, index = np.unique(entries, axis=0, return_index=True)
        order = tree_order(distinct, 1)
        self.index = index[order]
        self.tree = Tree(distinct[order], 1)


def assigned(vectors: Tree, book: Codebook) -> Iterator[tuple[int, int, int | np.ndarray]]:
    """Ranges (start, end) of the vectors with their nearest entry: one for all, or one for each."""
    entries = book.tree
    level_v = level_e = 0
    v = e = np.zeros(1, dtype=np.int64)              # pairs of nodes that are still possible, sorted by v
    while True:
        low, high = vectors.low[level_v][v], vectors.high[level_v][v]
        low_e, high_e = entries.low[level_e][e], entries.high[level_e][e]
        gap = np.maximum(0, np.maximum(low - high_e, low_e - high))
        reach = np.maximum(high_e - low, high - low_e)
        least, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        closest = np.repeat(np.minimum.reduceat(most, first), np.diff(np.append(first, len(v))))
        stays = least <= closest
        v, e = v[stays], e[stays]
        if level_e == entries.depth:
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            many = np.diff(np.append(first, len(v))) > 1
            cut = vectors.cuts[level_v]
            for at in first[~many]:
                yield int(cut[v[at]]), int(cut[v[at] + 1]), int(book.index[entries.cuts[-1][e[at]]])
            open_nodes = np.isin(v, v[first[many]])
            v, e = v[open_nodes], e[open_nodes]
            if not len(v):
                return
            if level_v == vectors.depth:
                break
        if level_v < vectors.depth:
            v, e = np.stack((2 * v, 2 * v + 1)).ravel(), np.tile(e, 2)
            level_v += 1
        if level_e < entries.depth:
            v, e = np.tile(v, 2), np.stack((2 * e, 2 * e + 1)).ravel()
            level_e += 1
            sizes = np.diff(entries.cuts[level_e])
            v, e = v[sizes[e] > 0], e[sizes[e] > 0]
        order = np.argsort(v, kind="stable")
        v, e = v[order], e[order]
    cut = vectors.cuts[level_v]
    first = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v))
    for begin, end in zip(first[:-1], first[1:]):
        start, stop = int(cut[v[begin]]), int(cut[v[begin] + 1])
        left = entries.cuts[-1][e[begin:end]]
        left = left[np.argsort(book.index[left])]
        step = entries.points[left]
        own = vectors.points[start:stop]
        distance = (step * step).sum(axis=1) - 2 * own @ step.T        # the square of the vector is the same for all
        yield start, stop, book.index[left][np.argmin(distance, axis=1)]


def largest_component(width: int) -> int:
    """Components up to this size keep squared distances of ``width`` components below 2^62."""
    return min((1 << 30), math.isqrt((1 << 60) // max(1, width)))


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """Scaled components, one row per vector, filled up to ``width``."""
    lengths = vectors.value_lengths().to_numpy().astype(np.int64)
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    most = largest_component(width)
    values = np.clip(values, -most, most).astype(np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of vectors: ids, labels, and for every part its components in tree order with that order."""
    each = width // PARTS
    names = ["ids", "labels", *[f"points{k}" for k in range(PARTS)], *[f"order{k}" for k in range(PARTS)]]

    def block(ids: pa.Array, labels: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
        points, orders = [], []
        for k in range(PARTS):
            own = numbers[:, k * each:(k + 1) * each]
            order = tree_order(own, LEAF) if each else np.arange(len(own))
            points.append(own[order].astype(np.int32).tobytes())
            orders.append(order.astype(np.int32).tobytes())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, *[pa.array([b], pa.binary()) for b in points + orders]], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, BLOCK_VALUES // max(1, width))
        ids, labels, numbers, held = [], [], [], 0
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                if held and held + len(part) > most:
                    yield block(pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(numbers))
                    ids, labels, numbers, held = [], [], [], 0
                ids.append(part.column(0))
                labels.append(part.column(2))
                numbers.append(whole_numbers(part.column(1), width))
                held += len(part)
        if held:
            yield block(pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(numbers))

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"ids array<{types['vec_id']}>", f"labels array<{types['label']}>", *[f"{n} binary" for n in names[2:]]])
    return rows.select("vec_id", "embedding", "label").mapInArrow(run, schema)


def trees(batch: pa.RecordBatch, row: int, each: int) -> list[Tree]:
    return [Tree(np.frombuffer(batch.column(f"points{k}")[row].as_py(), dtype=np.int32).astype(np.int64).reshape(-1, each), LEAF) for k in range(PARTS)]


def sums_of(stored: DataFrame, books: list[np.ndarray], each: int) -> DataFrame:
    """(part, entry, rows, s0, s1, ...): for every entry the sum of what is assigned to it."""
    sums = [f"s{k}" for k in range(each)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        total = np.zeros((PARTS, ENTRIES, each), dtype=np.int64)
        count = np.zeros((PARTS, ENTRIES), dtype=np.int64)
        for batch in batches:
            for row in range(len(batch)):
                for k, tree in enumerate(trees(batch, row, each)):
                    for start, end, entry in assigned(tree, own[k]):
                        if isinstance(entry, int):
                            total[k, entry] += tree.sums[end] - tree.sums[start]
                            count[k, entry] += end - start
                        else:
                            np.add.at(total[k], entry, tree.points[start:end])
                            np.add.at(count[k], entry, 1)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(count[part, entry]), *[pa.array(total[part, entry, k]) for k in range(each)]],
            names=["part", "entry", "rows", *sums])

    made = stored.select(*[f"points{k}" for k in range(PARTS)]).mapInArrow(run, ", ".join(f"{n} long" for n in ["part", "entry", "rows", *sums]))
    return made.groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *[F.sum(s).alias(s) for s in sums])


def codes_of(stored: DataFrame, books: list[np.ndarray], each: int, types: dict[str, str]) -> DataFrame:
    """(vec_id, label, code, error) for every vector of the blocks."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books] if each else []
        for batch in batches:
            for row in range(len(batch)):
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                codes = np.zeros((len(ids), PARTS), dtype=np.uint8)
                error = np.zeros(len(ids), dtype=np.int64)
                for k, tree in enumerate(trees(batch, row, each) if each else []):
                    order = np.frombuffer(batch.column(f"order{k}")[row].as_py(), dtype=np.int32)
                    for start, end, entry in assigned(tree, own[k]):
                        step = tree.points[start:end] - books[k][entry]
                        codes[order[start:end], k] = entry
                        error[order[start:end]] += (step * step).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[at:at + 2 * PARTS] for at in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"])

    return stored.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def train(rows: DataFrame, stored: DataFrame, width: int) -> list[np.ndarray]:
    """The codebook of every part position after all rounds."""
    each = width // PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow()["embedding"].combine_chunks()
    numbers = whole_numbers(first, width)
    books = [numbers[:, k * each:(k + 1) * each] for k in range(PARTS)]
    for _ in range(ROUNDS if each else 0):
        books = [b.copy() for b in books]
        for row in sums_of(stored, books, each).collect():       # at most PARTS * ENTRIES rows
            books[row["part"]][row["entry"]] = np.array(row[3:], dtype=np.int64) // row["rows"]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the usable rows of ``vectors`` (vec_id, embedding, label), staged, and the codebooks."""
    spark = vectors.sparkSession
    ship_package(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = spread(vectors.select("vec_id", "embedding", "label")).filter(F.col("embedding").isNotNull() & finite)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    if longest is None:
        return spark.createDataFrame([], f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), []
    width = -(-longest // PARTS) * PARTS
    stored = stage(blocks(rows, width), "vector-blocks")
    books = train(rows, stored, width)
    return stage(codes_of(stored, books, width // PARTS, types), "vector-codes"), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Digest of the compression: one row per usable vector."""
    coded, books = compress_vectors(vectors)
    keyed = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = stage(keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows")), "label-errors")
    return (lookup_join(keyed, sums.drop("_rows"), sums, "_label")
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
