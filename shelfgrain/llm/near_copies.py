"""N-gram Jaccard self-join with PartEnum signatures.

Two sets of word shingles with a Jaccard similarity of at least ``g`` differ in few shingles.  Set
sizes are cut into bands; for a band the shingle domain is partitioned by a hash, into more parts
than similar sets can differ in, and the subsets of parts that are enumerated are single ones.  A
signature is a part together with the shingles that a set has in it.  All differences between
similar sets spoil at most ``differences`` non-empty parts of either, so whatever the order of
signatures, the first ``differences + 1`` of both have one in common: only those are made.

The order puts parts with shingles that are common in the corpus last.  A pass over all texts finds
these: shingles that come in several texts of a task, added up over the tasks; the most frequent
``MOST_COMMON`` go out to the tasks, which bounds the broadcast.  The order never changes the result, only the
number of candidates.

Equal sets are collapsed first.  Up to ``FEW`` members of a bucket of equal signatures are compared with each other
if they share as many signatures as similar sets of their sizes have to: the subsets of so many parts, counted rather than written out.
A larger bucket is cut by the sizes of its sets first; what is still large has a leader, the member that shares the most of its signatures, and all members are compared to it.  Those linked to it are in one
component, whatever links them to each other.  For the rest the domain is partitioned anew, into
what is common with the leader and what differs from it: with D(x) the shingles in which x and its leader differ, x and y of
sizes a and b are similar only if D(x) and D(y) share (|D(x)| + |D(y)| - (a + b)(1 - g)/(1 + g)) / 2
shingles.  If one of them is not linked to the leader, that is at least one, and usually more than
half of them: the signatures of a member on this level are the first shingles of its D, own ones
before those it lacks, as many as that bound asks for, and the place of a shared one bounds what can still be shared.  So a group of near copies
is a star around its leader plus few pairs, whatever its size.  Pairs inside a component are not made.
All pairs are decided on the shingles themselves, by 48 bits of their hashes.

Defined cases: null, empty and wordless texts have no shingles, link with nothing and are
components of their own; texts with fewer words than a shingle have one; rows without id have no
component; rows of one id are one document, linked to whatever any of them is linked to; texts are
read whole; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import lookup_join
from ..session import ship_package, sized, stage
from .common import SMALL_ROWS, as_bytes, fresh, least_reachable, mixed, shingle_set, short_batches, tidy

WIDTH = 5
ABOVE = (3, 4)             # similarity, as a fraction
BANDS = 8                  # ratio of the sizes in a band
INJECTIVE = 32             # below this size, every shingle is a part of its own
MOST_COMMON = 1 << 20      # common shingles, at most: 8 MB
LEAST_COMMON = 3           # texts that have a common shingle, at least
PENDING = 1 << 21          # shingles counted at once in a task
SALTS = 64
BYTES = 6                  # of a shingle's hash, where sets are compared
GROUP = 64                 # sets compared to a leader in one go
FEW = 8                    # members of a bucket that need no leader
SIZE_STEP = 1.34           # more than 4/3, the ratio of the sizes of similar sets


def differences(size: int) -> int:
    """Most non-empty parts of a set of this size that the differences to a similar set can spoil.

    Sets of sizes a <= b with similarity g differ in at most (a + b)(1 - g)/(1 + g) shingles, and b <= a/g.
    """
    top, bottom = ABOVE
    return size * (bottom - top) // top


def bands_for(size: int) -> list[int]:
    """The band of a set (its upper size), and the next one if a larger similar set may lie there."""
    upper = INJECTIVE
    while size >= upper:
        upper *= BANDS
    top, bottom = ABOVE
    return [upper] if size * bottom // top < upper else [upper, upper * BANDS]


def parts_of(upper: int) -> int:
    """Parts of the domain for a band: so many that a set of it has far more non-empty parts than can be spoilt."""
    return 0 if upper == INJECTIVE else 4 * upper if upper < 512 else upper


def signatures(shingles: np.ndarray, common: np.ndarray, upper: int) -> tuple[np.ndarray, np.ndarray]:
    """A signature for each non-empty part of a set, and whether the part has a common shingle."""
    parts = parts_of(upper)
    scattered = mixed(shingles ^ mixed(np.array([upper], dtype=np.uint64)))
    at = np.searchsorted(common, shingles)
    late = (common[np.minimum(at, len(common) - 1)] == shingles) if len(common) else np.zeros(len(shingles), dtype=bool)
    if not parts:
        return scattered, late
    part = mixed(shingles + np.uint64(1)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return mixed(np.add.reduceat(scattered[order], first) ^ mixed(part[first])), np.logical_or.reduceat(late[order], first)


def chosen(shingles: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set that are enumerated, those without common shingles first, and which have some."""
    need = differences(len(shingles)) + 1
    out, flags = [], []
    for upper in bands_for(len(shingles)):
        found, late = signatures(shingles, common, upper)
        if len(found) < need:
            raise ValueError("a set falls into too few parts")   # see parts_of: as good as impossible
        order = np.lexsort((found, late))[:need]
        out.append(found[order])
        flags.append(late[order])
    return np.concatenate(out), np.concatenate(flags)


def survey(docs: DataFrame) -> DataFrame:
    """One pass over all texts: per document (doc_id, n, digest of the set), and shingles common in a task (shingle, count)."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        size = 0

        def common() -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate(pending), return_counts=True)
            many = counts > 1
            n = int(many.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, ids.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                                               pa.array(shingles[many].view(np.int64)), pa.array(counts[many])], names=names)

        names = ["doc_id", "n", "digest", "shingle", "count"]
        for batch in batches:
            ids, sizes, digests = batch.column(0), [], []
            for text in as_bytes(batch.column(1)):
                found = shingle_set(text.as_py(), WIDTH)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                if len(found):
                    pending.append(found)
                    size += len(found)
                if size > PENDING:
                    yield common()
                    pending, size = [], 0
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
        if pending:
            yield common()

    return docs.select("doc_id", "text").mapInArrow(tidy("near copies", run), f"doc_id {id_type.simpleString()}, n long, digest binary, shingle long, count long")


def enumerate_signatures(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(signature, id, late) for every document with shingles."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for at in range(0, len(texts), 500):
                owner, found, late = [], [], []
                for k, text in enumerate(texts.slice(at, 500)):
                    shingles = shingle_set(text.as_py(), WIDTH)
                    if len(shingles):
                        own, own_late = chosen(shingles, common)
                        found.append(own)
                        late.append(own_late)
                        owner.append(np.full(len(own), at + k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(late))],
                        names=["signature", "id", "late"])

    return docs.select("doc_id", "text").mapInArrow(tidy("near copies", run), f"signature long, id {docs.schema['doc_id'].dataType.simpleString()}, late boolean")


def most_common(seen: DataFrame) -> np.ndarray:
    """The most frequent shingles of the survey, sorted: as many whole classes of frequency as fit."""
    counts = stage(seen.filter("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("n")).filter(F.col("n") >= LEAST_COMMON), "common")
    # Frequencies by powers of two: at most 64 classes.
    classes = sorted(((r["power"], r["m"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    least, total = 64, 0
    for power, m in classes:
        if total + m > MOST_COMMON:
            break
        least, total = power, total + m
    found = counts.filter(F.floor(F.log2("n")) >= least).select("shingle").toArrow()["shingle"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def packed(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), dtype=np.uint8)
    out[:, :BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel().astype(np.int64)


def shortened(shingles: np.ndarray) -> np.ndarray:
    """Sorted distinct low bytes of hashes."""
    return np.unique(shingles & np.uint64((1 << 8 * BYTES) - 1))


def shingle_table(docs: DataFrame) -> DataFrame:
    """(id, n, shingles): the sorted hashes of the shingles, shortened, as bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for at in range(0, len(texts), 500):
                sets = [shortened(shingle_set(t.as_py(), WIDTH)) for t in texts.slice(at, 500)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([packed(s) for s in sets], pa.binary())], names=["id", "n", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidy("near copies", run), f"id {docs.schema['doc_id'].dataType.simpleString()}, n long, shingles binary")


def linked(d: Column, n: Column, m: Column) -> Column:
    """Whether sets of sizes n and m that differ in d shingles are similar."""
    top, bottom = ABOVE
    return d * (top + bottom) <= (n + m) * (bottom - top)


def least_shared(n: Column, m: Column) -> Column:
    """Signatures that similar sets of sizes n and m share: those they have, less those their differences can spoil."""
    top, bottom = ABOVE
    made = F.floor(F.least(n, m) * (bottom - top) / top) + 1
    return F.greatest(F.lit(1), made - F.floor((n + m) * (bottom - top) / (top + bottom)))


def listed(d: int, n: int, leader: int, near: bool) -> int:
    """How many of the differences to its leader a set lists.

    All that may be the first one shared with a similar set.  If the set is ``near``, linked to
    the leader, only similar sets that are not matter.
    """
    top, bottom = ABOVE
    least = max(1, d - n * (bottom - top) // top)                                # the other set is at most n/g in size
    if near:
        least = max(least, -(-((top + bottom) * d + (leader - n) * (bottom - top) + 1) // (2 * (top + bottom))))
    return max(0, d - least + 1)


def told(pairs: DataFrame, sets: DataFrame, common: np.ndarray) -> DataFrame:
    """``pairs`` (c, id, led) with sizes nc and n, the number d of shingles in which they differ and, where c leads, those the set lists; staged."""
    late = shortened(common).astype(np.int64)
    kind = pairs.schema["c"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, d, lists = [], [], [], []
            before, head = None, np.empty(0, dtype=np.int64)
            for x, c, led in zip(batch.column("shingles").to_pylist(), batch.column("head").to_pylist(), batch.column("led").to_pylist()):
                if c != before:
                    before, head = c, unpacked(c)
                own = unpacked(x)
                shared = np.isin(own, head, assume_unique=True)
                both = int(shared.sum())
                n.append(len(own))
                m.append(len(head))
                d.append(len(own) + len(head) - 2 * both)
                near = d[-1] * sum(ABOVE) <= (n[-1] + m[-1]) * (ABOVE[1] - ABOVE[0])
                count = listed(d[-1], n[-1], m[-1], near) if led else 0
                added = own[~shared] if led else own[:0]
                if len(added) and len(late):
                    added = added[np.argsort(late[np.minimum(np.searchsorted(late, added), len(late) - 1)] == added, kind="stable")]
                if count > len(added):
                    added = np.concatenate((added, np.setdiff1d(head, own, assume_unique=True)))
                lists.append(packed(added[:count].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("id"), batch.column("led"), pa.array(m, pa.int64()), pa.array(n, pa.int64()),
                                              pa.array(d, pa.int64()), pa.array(lists, pa.binary())], names=["c", "id", "led", "nc", "n", "d", "differences"])

    heads = stage(pairs.groupBy("c").agg(F.count(F.lit(1)).alias("_rows")), "leaders").withColumn("blocks", F.ceil(F.col("_rows") / GROUP))
    rows = lookup_join(pairs, heads.select("c", "blocks"), heads, "c").select("c", "id", "led", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    own = sets.select("id", "shingles").join(sized(rows), "id")
    whole = (sets.select(F.col("id").alias("c"), F.col("shingles").alias("head")).join(sized(heads.select("c", "blocks")), "c")
             .select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "head"))
    return stage(own.join(whole, ["c", "block"]).select("c", "id", "led", "shingles", "head")
                 .mapInArrow(tidy("near copies", run), f"c {kind}, id {kind}, led boolean, nc long, n long, d long, differences binary"), "told")


def differences_listed(rows: DataFrame) -> DataFrame:
    """One row per listed shingle of ``rows`` (c, id, n, d, component, differences), with its place and a key for leader and shingle."""
    kind = rows.schema["c"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [unpacked(x) for x in batch.column("differences").to_pylist()]
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            if sizes.sum():
                at = pa.array(np.repeat(np.arange(len(lists)), sizes))
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                leader = np.repeat(batch.column("leader").to_numpy().view(np.uint64), sizes)
                key = mixed(leader ^ mixed(np.concatenate(lists).astype(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in ("id", "n", "d", "component")], pa.array(place.astype(np.int32)), pa.array(key)],
                                                 names=["id", "n", "d", "component", "place", "key"])

    return rows.select(F.xxhash64("c").alias("leader"), "id", F.col("n").cast("int"), F.col("d").cast("int"), "component", "differences").mapInArrow(
        tidy("near copies", run), f"id {kind}, n int, d int, component {kind}, place int, key long")


def with_component(rows: DataFrame, key: str, components: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of ``key``, which is itself where nothing is linked."""
    moved = components.filter("node <> component").select(F.col("node").alias(key), F.col("component").alias("_to"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return lookup_join(rows, moved, counts, key, "left").withColumn(name, F.coalesce("_to", key)).drop("_to")


def by_size(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Large buckets cut by the sizes of their sets, in steps a little wider than similar sets can differ: a set is in its own and the next one."""
    step = F.floor(F.log(F.col("n")) / math.log(SIZE_STEP))
    cut = members.join(sizes, "id").select(
        F.explode(F.array(step, step + 1)).alias("_step"), "signature", "id", "times").select(F.xxhash64("signature", "_step").alias("signature"), "id", "times")
    counts = stage(cut.groupBy("signature").agg(F.count(F.lit(1)).alias("m")).withColumn("_rows", F.col("m")), "cut-buckets")
    return lookup_join(cut, counts.select("signature", "m"), counts, "signature").filter("m > 1").select("signature", "id", "m", "times")


def bucket_links(members: DataFrame, sets: DataFrame, common: np.ndarray) -> DataFrame:
    """Links (a, b) that connect all that similar ``members`` (signature, id, m, times) of equal signatures connect; staged.

    ``m`` is the number of members that a signature has, ``times`` that of signatures with the same members.
    """
    top, bottom = ABOVE
    sizes = sets.select("id", "n")
    members = members.filter(F.col("m") <= FEW).unionByName(by_size(members.filter(F.col("m") > FEW), sizes))
    few = members.filter(F.col("m") <= FEW).groupBy("signature").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("times").alias("times"))
    first = few.select("ids", "times", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    among = first.select(F.element_at("ids", F.col("k")).alias("c"), F.explode(F.slice("ids", F.col("k") + 1, F.lit(FEW))).alias("id"), "times")
    among = (among.groupBy("c", "id").agg(F.sum("times").alias("times")).join(sizes, "id")
             .join(sizes.select(F.col("id").alias("c"), F.col("n").alias("nc")), "c")
             .filter(F.col("times") >= least_shared(F.col("n"), F.col("nc"))).filter(F.least("n", "nc") * bottom >= F.greatest("n", "nc") * top))
    many = members.filter(F.col("m") > FEW)
    weights = stage(many.groupBy("id").agg(F.count(F.lit(1)).alias("_in")).join(sizes, "id")
                    .select("id", (F.col("_in") / F.col("n")).alias("w")), "weights")
    heads = stage(many.join(sized(weights), "id").groupBy("signature").agg(F.max(F.struct("w", "id"))["id"].alias("c"), F.count(F.lit(1)).alias("_rows")), "heads")
    led = lookup_join(many, heads.select("signature", "c"), heads, "signature").filter("id <> c").select("c", "id", F.lit(True).alias("led"))
    pairs = stage(among.select("c", "id", F.lit(False).alias("led")).unionByName(led).groupBy("c", "id").agg(F.max("led").alias("led")), "pairs")
    known = told(pairs, sets, common)
    links = known.filter(linked(F.col("d"), F.col("n"), F.col("nc"))).select(F.col("c").alias("a"), F.col("id").alias("b"))
    if heads.isEmpty():
        return links
    components = least_reachable(links)
    placed = with_component(with_component(known.filter("led"), "id", components, "component"), "c", components, "_own")
    # Members of other components than their leader, and all those they may be linked to.
    placed = stage(placed.withColumn("open", F.col("component") != F.col("_own")).drop("_own"), "placed")
    groups = stage(placed.groupBy("c").agg(F.count(F.lit(1)).alias("_rows"), F.max("open").alias("_open")).filter("_open and _rows > 1").select("c", "_rows"), "groups")
    if groups.isEmpty():
        return links
    inside = lookup_join(placed, groups.select("c"), groups, "c")
    probes = differences_listed(inside.filter("open"))
    least = F.ceil(((top + bottom) * F.col("d") + (F.col("nc") - F.col("n")) * (bottom - top) + 1) / (2 * (top + bottom)))
    kept = F.greatest(F.lit(0), F.least(F.octet_length("differences") / BYTES, F.col("d") - least + 1)).cast("int")
    index = differences_listed(inside.withColumn("differences", F.substring(F.col("differences"), F.lit(1), kept * BYTES)))
    index = index.select("key", *[F.col(k).alias(f"_{k}") for k in ("id", "n", "d", "component", "place")])
    shared = F.least(F.col("d") - F.col("place"), F.col("_d") - F.col("_place"))
    possible = (2 * (top + bottom) * shared >= (top + bottom) * (F.col("d") + F.col("_d")) - (bottom - top) * (F.col("n") + F.col("_n")))
    alike = F.least("n", "_n") * bottom >= F.greatest("n", "_n") * top
    meets = [probes["key"] == index["key"], F.col("component") != F.col("_component"), alike, possible]
    found = (probes.join(index, reduce(lambda x, y: x & y, meets)).select(F.least("id", "_id").alias("c"), F.greatest("id", "_id").alias("id")).distinct()
             .withColumn("led", F.lit(False)))
    more = told(stage(found, "pairs"), sets, common).filter(linked(F.col("d"), F.col("n"), F.col("nc")))
    return stage(links.unionByName(more.select(F.col("c").alias("a"), F.col("id").alias("b"))), "links")


def filtered(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """``docs`` whose ``key`` is (``left_semi``) or is not (``left_anti``) a doc_id of ``ids``, without a shuffle while those are few."""
    side = ids.select(F.col("doc_id").alias(key))
    return docs.join(F.broadcast(side) if side.count() <= SMALL_ROWS else side.hint("merge"), key, how)


def near_copies(docs: DataFrame) -> DataFrame:
    """Components of near copies: (doc_id, n_shingles, component_id), one row for each row of ``docs`` (doc_id, text)."""
    ship_package(docs.sparkSession)
    short_batches(docs.sparkSession)
    seen = stage(survey(docs), "survey")
    sets_of = seen.filter("digest is not null").select("doc_id", "n", "digest")
    named = sets_of.filter("n > 0 and doc_id is not null")
    common = most_common(seen)
    # Equal sets: the smallest id stands for them.
    stands = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_rows"))
    reps = stage(stands, "sets")
    ids = stage(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")), "ids")
    others = stage(ids.select("doc_id").join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_anti"), "copies")
    alone = filtered(docs.select("doc_id", "text").filter("doc_id is not null"), others, "left_anti")
    again = stage(ids.filter("_rows > 1").select("doc_id"), "repeated")
    repeated = not again.isEmpty()
    if repeated:
        # Texts of one id are told apart here and brought together at the end.
        alone = filtered(alone, again, "left_anti").unionByName(filtered(alone, again, "left_semi").distinct())
        alone = stage(alone.withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))), "texts")
    salt = F.when(F.col("late"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0)
    made = enumerate_signatures(alone, common).withColumn("_salt", salt)
    bucket = Window.partitionBy("signature", "_salt")
    # A signature of common shingles may be held by very many documents; these are kept unseen.
    shared = stage(made.withColumn("_m", F.count(F.lit(1)).over(bucket)).filter("late or _m > 1").select("signature", "id"), "shared")
    # Of buckets with the same members, one is enough.
    buckets = shared.groupBy("signature").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    kept = stage(buckets.filter("m > 1").groupBy("m", "x", "y").agg(F.min("signature").alias("signature"), F.count(F.lit(1)).alias("times")).select("signature", "m", "times"), "buckets")
    members = stage(shared.join(kept, "signature").distinct(), "members")
    candidates = stage(members.select(F.col("id").alias("doc_id")).distinct(), "candidates")
    links = None
    if not candidates.isEmpty():
        sets = shingle_table(filtered(alone, candidates, "left_semi"))
        links = bucket_links(members, stage(sets, "shingles"), common)
        if repeated:
            links = links.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    # Ids with several texts connect these.
    several = sets_of.filter("n > 0 and doc_id is not null").join(reps.select("digest", "rep"), "digest")
    doubles = several.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("doc_id", "a")
    twice = several.join(doubles, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")
    links = twice if links is None else links.unionByName(twice)
    components = least_reachable(links)
    copies = reps.filter("_rows > 1").select("digest", "rep")
    moved = components.filter("node <> component")
    # Only copies and linked sets need more than their own id.
    placed = reps.join(moved.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("_component"), "_rows", "rep")
    changed = stage(placed.filter("_rows > 1 or _component <> rep").select("digest", "_component"), "components")
    small = changed.count() <= SMALL_ROWS
    return (sets_of.join(F.broadcast(changed) if small else changed.hint("merge"), "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: of the rows whose id names it, the one with the least digest.

    Rows without id take part under the digest of their text, after all ids.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    key, keyed = "doc_id", docs
    text = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))
    if not docs.filter("doc_id is null").isEmpty():
        key = fresh(docs, "_key")
        keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"),
                                              F.when(F.col("doc_id").isNull(), text).alias("digest")))
    components = stage(near_copies(keyed.select(F.col(key).alias("doc_id"), "text")), "near-copies")
    dropped = components.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = filtered(keyed, stage(dropped, "dropped"), "left_anti", key)
    again = stage(components.filter("component_id = doc_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept.select(*own)
    row = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(own)])
    one = (filtered(kept, again, "left_semi", key).groupBy(F.col(key).alias("_id"))
           .agg(F.min_by(row, F.struct(text, F.to_json(row))).alias("_row"))
           .select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)]))
    return filtered(kept, again, "left_anti", key).select(*own).unionByName(one)
