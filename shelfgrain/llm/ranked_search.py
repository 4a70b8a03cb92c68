"""Ranked lexical search by pipelined term partitioning.

The terms of the queries are dealt to owners, rare ones first, so that every owner holds about as many
postings.  A bundle holds the sparse accumulators of one query for one slice of documents; it
passes through the owners one after the other.  At each, a cogroup by slice brings bundles and the owner's
postings together, and the owner adds the whole-number contributions of its terms.  After the last
owner the best documents of each query are selected.

Slices are runs of documents within a scan task, so an owner is never one task and a document that is repeated
any number of times spreads like others.  Along the way an accumulator is dropped only if it cannot reach
the result: each bundle reports the score of its last place, the best of these bounds the final
one from below, and the largest contribution of every term still to come bounds what an accumulator can
gain.  The result is that of adding up everything.

Queries are taken in blocks whose texts have ``QUERY_BYTES`` together, about; what is sent to the tasks
(terms, weights, bounds) is bounded by that.  Texts are read once per block.

Defined cases: null and empty texts, and those without terms, are no documents and find nothing; texts
of any length are read whole; repeated rows of documents rank each, repeated queries are answered each; rows
without id rank after all others of their score; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import ship_package, sized_stage, stage, work_path
from .common import SLICE_BYTES, as_bytes

BEST = 50
OWNERS = 4
QUERY_BYTES = 128 << 10    # of the queries of a block, each counted with 200 bytes more
SLICE_DOCS = 4096          # documents of a slice, at most
SLICE_POSTINGS = 1 << 20   # postings of a slice, about

_plain = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time; slices are cut between terms."""
    at = 0
    while at < len(text):
        part = text[at:at + SLICE_BYTES].translate(_plain)
        at += len(part)
        if at < len(text) and part[-1] != 32:
            space = part.rfind(b" ")
            if space >= 0:
                at -= len(part) - space - 1
                part = part[:space]
            else:                                     # a term longer than a slice
                while at < len(text) and part[-1] != 32:
                    more = text[at:at + SLICE_BYTES].translate(_plain)
                    space = more.find(b" ") + 1 or len(more)
                    part += more[:space]
                    at += space
        yield part.split()


def survey(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(slice, place, doc_id, n, terms, tfs) per document: its number of terms, and those of the vocabulary with their counts."""
    names = ["slice", "place", "doc_id", "n", "terms", "tfs"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        number = 0
        ids: list[pa.Array] = []
        sizes: list[int] = []
        terms: list[np.ndarray] = []
        tfs: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            """The slice held, in the order of its ids, so that places decide ties as ids do."""
            own = pa.concat_arrays(ids)
            order = pc.sort_indices(own, null_placement="at_end")
            lists = []
            for column in (terms, tfs):
                ordered = [column[k] for k in order.to_pylist()]
                starts = np.concatenate(([0], np.cumsum([len(x) for x in ordered])))
                lists.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(ordered), pa.int32())))
            n = len(own)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, task + number)), pa.array(np.arange(n), pa.int32()), own.take(order),
                                               pa.array(sizes, pa.int64()).take(order), *lists], names=names)

        held = 0
        for batch in batches:
            for k, text in enumerate(as_bytes(batch.column(1))):
                n, found = 0, Counter()
                for words in term_slices(text.as_py() or b""):
                    n += len(words)
                    found.update(map(vocabulary.get, words))
                found.pop(None, None)
                ids.append(batch.column(0).slice(k, 1))
                sizes.append(n)
                terms.append(np.fromiter(found.keys(), dtype=np.int32, count=len(found)))
                tfs.append(np.fromiter(found.values(), dtype=np.int32, count=len(found)))
                held += len(found)
                if len(sizes) == SLICE_DOCS or held > SLICE_POSTINGS:
                    yield closed()
                    ids, sizes, terms, tfs, held, number = [], [], [], [], 0, number + 1
        if sizes:
            yield closed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"slice long, place int, doc_id {kind}, n long, terms array<int>, tfs array<int>")


def postings(surveyed: DataFrame, owner_of: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Inverted slices, one table part per owner: (slice, places, terms, shares, owner).

    A share is what a document adds for a term of weight one: (10^9 tf) div (1000 tf + 20 m).
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("terms").value_lengths().to_numpy()
            terms = batch.column("terms").flatten().to_numpy()
            tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
            m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // n_terms
            share = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, counts))
            place = np.repeat(batch.column("place").to_numpy(), counts)
            part = np.repeat(batch.column("slice").to_numpy(), counts)
            owner = owner_of[terms] if len(terms) else terms
            used = owner >= 0
            order = np.lexsort((place, terms, part, owner))
            order = order[used[order]]
            if not len(order):
                continue
            first = np.flatnonzero(np.append(True, (np.diff(owner[order]) != 0) | (np.diff(part[order]) != 0)))
            ends = np.append(first[1:], len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[order][first]),
                 *[pa.array([column[order[a:b]].astype(np.int32).tobytes() for a, b in zip(first, ends)], pa.binary()) for column in (place, terms, share)],
                 pa.array(owner[order][first].astype(np.int32))], names=["slice", "places", "terms", "shares", "owner"])

    path = work_path(surveyed.sparkSession, "postings")
    made = surveyed.select("slice", "place", "n", "terms", "tfs").mapInArrow(run, "slice long, places binary, terms binary, shares binary, owner int")
    made.write.partitionBy("owner").parquet(path)
    return surveyed.sparkSession.read.schema("slice long, places binary, terms binary, shares binary, owner int").parquet(path)


BUNDLE = "slice long, query int, places binary, scores binary, last long"
_bundle = pa.schema([("slice", pa.int64()), ("query", pa.int32()), ("places", pa.binary()), ("scores", pa.binary()), ("last", pa.int64())])


def through_owner(bundles: DataFrame, owned: DataFrame, wanted: list[list[tuple[int, int]]], least: list[int], to_come: list[int]) -> DataFrame:
    """The bundles after one owner: ``wanted`` has its terms and their weights per query, ``least`` the
    score that the last place has at least, ``to_come`` the most that later owners can add."""
    final = not any(to_come)

    def add(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        def joined(name: str) -> np.ndarray:
            parts = [np.frombuffer(x, dtype=np.int32) for x in right.column(name).to_pylist()]
            return np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)

        places, terms, shares = joined("places"), joined("terms"), joined("shares").astype(np.int64)
        order = np.argsort(terms, kind="stable")
        places, terms, shares = places[order], terms[order], shares[order]
        known = {row["query"]: row for row in left.select(["query", "places", "scores"]).to_pylist()}
        size = 1 + max([int(places.max()) if len(places) else -1] + [int(np.frombuffer(r["places"], dtype=np.int32).max()) for r in known.values()], default=-1)
        held, first = np.unique(terms, return_index=True)
        at = dict(zip(held.tolist(), zip(first.tolist(), np.append(first[1:], len(terms)).tolist())))
        out: list[tuple] = []
        for query, own in enumerate(wanted):
            before = known.get(query)
            if before is None and not any(term in at for term, _ in own):
                continue
            scores = np.zeros(size, dtype=np.int64)
            if before is not None:
                scores[np.frombuffer(before["places"], dtype=np.int32)] = np.frombuffer(before["scores"], dtype=np.int64)
            for term, weight in own:
                if term in at:
                    start, end = at[term]
                    scores[places[start:end]] += weight * shares[start:end]
            found = np.flatnonzero(scores)
            last = int(np.partition(scores[found], -BEST)[-BEST]) if len(found) >= BEST else None
            found = found[scores[found] + to_come[query] >= max(least[query], last or 0)]
            if final and len(found) > BEST:
                found = found[np.argsort(-scores[found], kind="stable")[:BEST]]
            if len(found):
                out.append((key[0].as_py(), query, found.astype(np.int32).tobytes(), scores[found].tobytes(), last))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _bundle)] if out else [pa.array([], f.type) for f in _bundle], schema=_bundle)

    return bundles.groupBy("slice").cogroup(owned.groupBy("slice")).applyInArrow(add, BUNDLE)


def unpacked(bundles: DataFrame) -> DataFrame:
    """(slice, place, query, score) of all accumulators."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, query, places, scores in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                own = np.frombuffer(places, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part)), pa.array(own), pa.array(np.full(len(own), query, dtype=np.int32)),
                                                  pa.array(np.frombuffer(scores, dtype=np.int64))], names=["slice", "place", "query", "score"])

    return bundles.mapInArrow(run, "slice long, place int, query int, score long")


def owners_by_rarity(df: dict[int, int], weights: dict[int, int], size: int) -> np.ndarray:
    """The owner of every term, -1 for terms that add nothing: rare ones first, postings shared out evenly."""
    owner = np.full(size, -1, dtype=np.int32)
    ranked = sorted((t for t in df if weights[t] > 0), key=lambda t: (df[t], t))
    total, upto = sum(df[t] for t in ranked), 0
    for t in ranked:
        owner[t] = min(OWNERS - 1, OWNERS * upto // total)
        upto += df[t]
    return owner


def search_block(docs: DataFrame, queries: list[set[bytes]]) -> DataFrame | None:
    """(query, doc_id, score) of at least the best documents of a block of queries, given as sets of terms."""
    spark = docs.sparkSession
    vocabulary = {term: k for k, term in enumerate(sorted(set().union(*queries)))}
    surveyed = stage(survey(docs, vocabulary), "term-counts")
    n_docs, n_terms = surveyed.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not vocabulary:
        return None
    each = surveyed.select("n", F.inline(F.arrays_zip("terms", "tfs")))
    share = F.expr(f"(1000000000L * tfs) div (1000L * tfs + 20L * (50L + (50L * n * {n_docs}L) div {n_terms}L))")
    facts = each.groupBy("terms").agg(F.count(F.lit(1)).alias("df"), F.max(share).alias("most")).collect()   # at most one row per term of the block
    df, most = {r["terms"]: r["df"] for r in facts}, {r["terms"]: r["most"] for r in facts}
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    owner = owners_by_rarity(df, weights, len(vocabulary))
    if not (owner >= 0).any():
        return None
    terms = [sorted(t for t in (vocabulary[x] for x in q) if owner[t] >= 0) for q in queries]
    owned = postings(surveyed, owner, n_docs, n_terms)
    bundles, least = spark.createDataFrame([], BUNDLE), [0] * len(queries)
    for k in range(OWNERS):
        wanted = [[(t, weights[t]) for t in own if owner[t] == k] for own in terms]
        to_come = [sum(weights[t] * most[t] for t in own if owner[t] > k) for own in terms]
        if k and not any(wanted):
            continue
        bundles = stage(through_owner(bundles, owned.filter(F.col("owner") == k).drop("owner"), wanted, least, to_come), "bundles")
        for row in bundles.filter("last is not null").groupBy("query").agg(F.max("last").alias("last")).collect():
            least[row["query"]] = max(least[row["query"]], row["last"])
    bounds = spark.createDataFrame(list(enumerate(least)), "query int, least long")
    # Places of equal score are told apart by id only now; a slice has already left out what its own ids decide.
    first = Window.partitionBy("query").orderBy(F.desc("score"))
    found = unpacked(bundles).join(F.broadcast(bounds), "query").filter("score >= least").withColumn("_rank", F.rank().over(first))
    found = sized_stage(found.filter(F.col("_rank") <= BEST).select("slice", "place", "query", "score"), "found")
    return surveyed.select("slice", "place", "doc_id").join(found, ["slice", "place"]).select("query", "doc_id", "score")


def blocks_of(items: DataFrame) -> Iterator[DataFrame]:
    """The staged queries (_item, text) in blocks of a bounded size of text."""
    total = items.agg(F.sum(F.octet_length("text") + 200)).first()[0] or 0
    count = max(1, -(-total // QUERY_BYTES))
    for k in range(count):
        yield items.filter(F.pmod(F.xxhash64("_item"), F.lit(count)) == k)


def search_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best documents (doc_id, text) for each of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    own = stage(items.select("item_id", "text").withColumn("_item", F.monotonically_increasing_id()), "queries")
    found = []
    for block in blocks_of(own):
        rows = block.filter("text is not null").select("_item", "text").collect()
        queries = [{w for words in term_slices(r["text"].encode("utf-8", "surrogatepass")) for w in words} for r in rows]
        result = search_block(docs, queries) if any(queries) else None
        if result is not None:
            names = spark.createDataFrame([(k, r["_item"]) for k, r in enumerate(rows)], "query int, _item long")
            found.append(result.join(F.broadcast(names), "query").drop("query"))
    kinds = {"item": items.schema["item_id"].dataType.simpleString(), "doc": docs.schema["doc_id"].dataType.simpleString()}
    if not found:
        return spark.createDataFrame([], f"item_id {kinds['item']}, rank int, doc_id {kinds['doc']}, score long")
    best = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= BEST)
    ranked = stage(ranked, "ranked")
    return ranked.join(own.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")
