"""Near duplicates among embeddings by counting collisions of projections.

Vectors are projected on many random directions.  Near vectors lie close together on most
of these lines: on each, the window around a query holds a near vector with a known probability.
Lines are taken in groups; windows of a group's lines are cells of a shifted grid, and sorting by
all cells of a group brings together vectors that share them.  For each pair brought
together, the lines on which the window around one vector holds the other are counted, and pairs that
pass a count calibrated for recall are verified by their cosine in double precision.

Equal vectors are collapsed first.  A pair that meets in several groups of lines is handled in
the first.  Large cells are cut into blocks, every two of which meet in one task; blocks have a bounded
size.  Tasks return sums per vector and a spanning forest of their links, never the pairs.

Defined cases: null, empty and zero vectors and those with null or non-finite components link with nothing, nor do vectors
of different lengths; equal vectors link with each other; rows without id count as links of others but have no
component; rows equal in id and vector count each; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package, stage
from .common import least_reachable

LEAST_COSINE = 0.95
MISSED = 2e-4             # share of pairs at the least cosine that may be missed, at most
CHANCE = 0.1              # vectors unlike a given one that share its cell by chance, about
CELL = 1.5                # width of a cell; a vector of length one has a spread of one on a line
COUNTED = 64              # lines on which windows are counted
BLOCK = 1024              # vectors of a cell compared at once
SEED = 20


def spread(cosine: float) -> float:
    """Standard deviation of the difference of two vectors on a line."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def same_cell(cosine: float, width: float) -> float:
    """Probability that two vectors share a cell of a randomly shifted grid."""
    s = spread(cosine)
    t = np.linspace(0, width, 2001)
    density = 2 * np.exp(-t * t / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
    return float(np.trapezoid((1 - t / width) * density, t))


def lines_per_group(n: int) -> int:
    """Lines of a group: so many that unlike vectors seldom share all cells; grows with the logarithm of the table."""
    return max(4, math.ceil(math.log(max(n, 1) / CHANCE) / -math.log(same_cell(0.0, CELL))))


def calibrate(cosine: float, missed: float, per_group: int) -> tuple[int, float, int]:
    """Groups of lines, half width of the window, and collisions that a pair has to reach.

    Half of the misses are left to the groups, half to the count.
    """
    meet = same_cell(cosine, CELL) ** per_group
    groups = math.ceil(math.log(missed / 2) / math.log(1 - meet))
    window = 1.0 * spread(cosine)
    inside = math.erf(window / spread(cosine) / math.sqrt(2))
    below, reach = 0.0, 0
    while reach < COUNTED:
        below += math.comb(COUNTED, reach) * inside ** reach * (1 - inside) ** (COUNTED - reach)
        if below > missed / 2:
            break
        reach += 1
    return groups, window, reach


@functools.lru_cache(maxsize=8)
def lines(dimension: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions and shifts of the grids, and the directions on which windows are counted."""
    draw = np.random.default_rng([SEED, dimension])
    return draw.standard_normal((total, dimension)), draw.uniform(0, CELL, total), draw.standard_normal((COUNTED, dimension))


def unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, grid: np.ndarray, shift: np.ndarray, groups: int) -> np.ndarray:
    """A 64-bit name of the cells of each vector in each group."""
    at = np.floor((x @ grid.T + shift) / CELL).astype(np.int64).astype(np.uint64).reshape(len(x), groups, len(grid) // groups)
    factors = np.random.default_rng(SEED).integers(1, 1 << 62, len(grid) // groups, dtype=np.uint64) | np.uint64(1)
    return (at * factors).sum(axis=2, dtype=np.uint64).view(np.int64)


class Comparer:
    """Compares the vectors of every two blocks of a cell; rows come sorted by cell and blocks."""

    def __init__(self, cosine: float, groups: int, per_group: int, window: float, reach: int) -> None:
        self.cosine, self.groups, self.per_group, self.window, self.reach = cosine, groups, per_group, window, reach

    def run(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells are at most two blocks large; one that goes on in the next batch is kept until then."""
        rest: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            starts = self.starts(frame)
            if len(starts):
                yield self.compare(frame.iloc[:starts[-1]], starts)
                rest = frame.iloc[starts[-1]:]
        if rest is not None and len(rest):
            yield self.compare(rest, np.array([0]))

    @staticmethod
    def starts(frame: pd.DataFrame) -> np.ndarray:
        keys = frame[["dimension", "group_no", "cell", "low", "high"]].to_numpy(dtype=np.int64)
        return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.empty(0, dtype=np.int64)

    def compare(self, frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        columns = {c: frame[c].to_numpy() for c in ("dimension", "group_no", "low", "high", "node", "mine", "copies")}
        vectors = frame["v"].to_numpy()
        ends = np.append(starts[1:], len(frame))
        for first, end in zip(starts.tolist(), ends.tolist()):
            if end - first > 1:
                at = first + np.argsort(columns["node"][first:end])
                a, b = self.pairs(unit(list(vectors[at])), int(columns["dimension"][first]), int(columns["group_no"][first]),
                                  columns["mine"][at] if columns["low"][first] != columns["high"][first] else None)
                if len(a):
                    out.append(self.sums(a, b, columns["node"][at], columns["copies"][at]))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"node": [], "links": [], "root": []})

    def pairs(self, x: np.ndarray, dimension: int, own: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that are linked and met in no group before ``own``."""
        grid, shift, counted = lines(dimension, self.groups * self.per_group)
        on_lines = (x @ counted.T).astype(np.float32)
        firsts, seconds = [], []
        if len(x) <= 32:
            whole = [np.triu_indices(len(x), 1)]
        else:
            whole = ((np.full(len(x) - k - 1, k), np.arange(k + 1, len(x))) for k in range(len(x) - 1))
        for a, b in whole:
            if side is not None:
                apart = side[a] != side[b]
                a, b = a[apart], b[apart]
            near = (np.abs(on_lines[a] - on_lines[b]) <= self.window).sum(axis=1) >= self.reach   # windows around the first
            a, b = a[near], b[near]
            linked = (x[a] * x[b]).sum(axis=1) >= self.cosine
            firsts.append(a[linked])
            seconds.append(b[linked])
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        if own and len(a):
            rows, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            cells = cells_of(x[rows], grid[:own * self.per_group], shift[:own * self.per_group], own)
            place = place.reshape(2, -1)
            fresh = np.ones(len(a), dtype=bool)
            for k in range(own):                     # pairs that met in a group before are left to it
                fresh &= cells[place[0], k] != cells[place[1], k]
            a, b = a[fresh], b[fresh]
        return a, b

    @staticmethod
    def sums(a: np.ndarray, b: np.ndarray, node: np.ndarray, copies: np.ndarray) -> pd.DataFrame:
        """Links of each vector, copies counted, and the smallest vector of the part of the links it is in."""
        sums = np.bincount(a, weights=copies[b], minlength=len(node)) + np.bincount(b, weights=copies[a], minlength=len(node))
        root = np.arange(len(node))
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        used = np.flatnonzero(sums)
        return pd.DataFrame({"node": node[used], "links": sums[used].astype(np.int64), "root": node[root[used]]})


def near_vectors(rows: DataFrame, cosine: float = LEAST_COSINE, missed: float = MISSED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each of ``rows`` (vec_id, embedding)."""
    ship_package(rows.sparkSession)
    given = rows.select("vec_id", F.col("embedding").alias("v"))
    sound = (F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
             & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    named = stage(given.withColumn("v", F.when(sound, F.col("v"))).withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64(F.transform("v", lambda x: x + 0.0)))), "vectors")
    # Equal vectors: told apart from others with the same hash by the vector itself.
    distinct = stage(named.filter("v is not null").groupBy("key", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                     .withColumn("node", F.xxhash64("v", F.lit(7))), "distinct")

    per_group = lines_per_group(distinct.count())
    groups, window, reach = calibrate(cosine, missed, per_group)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dimension, part in frame.groupby(frame["v"].map(len)):
                grid, shift, _ = lines(int(dimension), groups * per_group)
                for at in range(0, len(part), 2000):
                    some = part.iloc[at:at + 2000]
                    cells = cells_of(unit(list(some["v"])), grid, shift, groups)
                    yield pd.DataFrame({"dimension": np.int32(dimension), "group_no": np.tile(np.arange(groups, dtype=np.int32), len(some)),
                                        "cell": cells.ravel(), "node": np.repeat(some["node"].to_numpy(), groups)})

    placed = stage(distinct.select("node", "v").mapInPandas(place, "dimension int, group_no int, cell long, node long"), "cells")
    where = ["dimension", "group_no", "cell"]
    full = stage(placed.groupBy(*where).agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x")).filter("m > 1"), "cells")
    # Members of cells with company, dealt to blocks by a hash; each two blocks of a cell meet.
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    met = (placed.join(full.select(*where, blocks.alias("blocks")), where)
           .withColumn("mine", mine)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select(*where, "node", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")))
    order = [*where, "low", "high"]
    given = (met.join(distinct.select("node", "v", "copies"), "node")
             .repartition(*order).sortWithinPartitions(*order)
             .select(*order, "node", "mine", "copies", "v"))
    compare = Comparer(cosine, groups, per_group, window, reach)
    met_links = stage(given.mapInPandas(compare.run, "node long, links long, root long"), "links")
    links = met_links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = least_reachable(met_links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # Components are named by their smallest id.
    nodes = distinct.select("node", "key", "v", "rep", "copies").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = stage(nodes, "nodes")
    names = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = nodes.join(names, "component").select("key", F.col("v").alias("_v"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (named.join(known.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("v") == F.col("_v")), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
