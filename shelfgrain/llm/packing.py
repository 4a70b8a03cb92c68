"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

As many sequences are opened as the pieces need at least.  A round range-sorts pieces and gaps together by size and sweeps every
slice in its own task, from small to large: a gap takes the largest piece that fits, then the largest that fits what is left, for
as long as the slice holds one; pieces of one length go by rank, so no two gaps want the same piece.  Gaps that found nothing in
their slice want pieces of the slices before.  Which slices those are follows from one row of counts and limits per slice, which
is all that the driver sees (``carried``): runs of pieces go to runs of gaps by rank, as many to each gap as surely fit, and
piece and gap meet by a shuffle on the gap.  Then gaps are updated, those smaller than every piece are closed, and the next round
follows.  A round that places nothing opens sequences for what is left.  With one slice a round is first-fit decreasing, and ends the packing but for sequences still to open; the last
``slice_rows`` pieces and gaps are one slice.  Rounds are written to the shared folder.

Defined cases: a null or empty text is one piece, the end token; a document that ends at
a multiple of the capacity has no empty piece; equal rows are placed one by one; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from ..session import ship_package, stage
from .common import as_bytes, remembered, tidy

CAPACITY = 2048
END = 0
TOKENIZER = "word_bpe_49k.json"
KNOWN_WORDS = 1_200_000  # words whose tokens a worker remembers: some 220 MB
TEXTS = 256              # texts tokenized at once
OPERATOR = "packing"     # tasks of others in the same worker drop that memory
MARK = b"\x01"           # put between words; no letter, digit or white space


class WordEncoder:
    """Token ids of whole texts, with a memory of words seen before.

    The tokenizer drops white space and never joins what it separates, so the ids of a text are
    those of its words, one after another.  New words are encoded together, a mark between them.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.mark = np.array(self.alone(MARK), dtype=self.type)
        self.known: dict[bytes, bytes] = {}

    def alone(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids

    def learn(self, words: list[bytes]) -> None:
        single = [w for w in words if MARK in w]
        for word in single:
            self.known[word] = np.array(self.alone(word), dtype=self.type).tobytes()
        if single:
            words = [w for w in words if MARK not in w]
        groups = [words[i:i + 2000] for i in range(0, len(words), 2000)]
        joined = [(b" " + MARK + b" ").join(g).decode("utf-8", "replace") for g in groups]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype=self.type)
            cuts = np.flatnonzero(ids == self.mark[0])
            begins, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
            raw, width = ids.tobytes(), self.type.itemsize
            for word, a, b in zip(group, (begins * width).tolist(), (ends * width).tolist()):
                self.known[word] = raw[a:b]

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        split = [(t or b"").split() for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = {w for words in split for w in words}
        if new:
            self.learn(list(new))
        for words in split:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=self.type).astype("<u4")


def encoder(path: str) -> WordEncoder:
    kept = remembered(OPERATOR)
    if path not in kept:
        made = WordEncoder(path)
        if len(made.mark) != 1:
            raise ValueError("the mark between words must be one token")
        kept[path] = made
    return kept[path]


def tokenize(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    ``tokenizer`` is a path, by default that of ``TOKENIZER`` in the folder of public tokenizers.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer or public_tokenizers.path(TOKENIZER))
        for batch in batches:
            names, texts = batch.column(0), as_bytes(batch.column(1))
            for at in range(0, len(texts), TEXTS):
                owner, piece, start, length, check, ids = [], [], [], [], [], []
                for k, own in enumerate(words.encode(texts.slice(at, TEXTS).to_pylist())):
                    own = np.append(own, np.array([END], dtype="<u4")).astype("<u4")
                    for n, first in enumerate(range(0, len(own), capacity)):
                        part = own[first:first + capacity]
                        owner.append(at + k)
                        piece.append(n)
                        start.append(first)
                        length.append(len(part))
                        check.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                columns = [names.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(check, pa.int64())]
                heads = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=heads + ["ids"] * with_ids)

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(tidy(OPERATOR, run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
                           + ", ids array<int>" * with_ids)


PIECE, GAP, PLACED, FILLED = range(4)    # rows of a round: left, untouched, placed here, gap after placements
SLICE_ROWS = 50_000                      # pieces and gaps that one task sweeps without a range sort
RANKS = 40                               # bits of a rank in a slice
SWEPT = "what int, slice int, rank long, id long, size long, sequence_id long, offset long"


def sweep(size: list[int], gap: list[bool], capacity: int) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """Best fit in one slice, whose rows come by size, pieces first: placements (row of the piece, of the gap, offset), and what is left of each gap."""
    held: dict[int, list[int]] = defaultdict(list)    # unplaced pieces of each length
    lengths: list[int] = []                           # those lengths, ascending
    placed, left = [], {}
    for row, (n, is_gap) in enumerate(zip(size, gap)):
        if not is_gap:
            if not held[n]:
                lengths.append(n)
            held[n].append(row)
            continue
        while lengths and lengths[0] <= n:
            k = bisect_right(lengths, n) - 1
            rows = held[lengths[k]]
            placed.append((rows.pop(), row, capacity - n))
            n -= lengths[k]
            if not rows:
                del lengths[k]
        left[row] = n
    return placed, left


def carried(slices: Iterable[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (slice, rank, n, each, slice of gaps, rank of gap) that send pieces on to gaps of later slices.

    ``slices`` has (slice, pieces, longest, gaps, least gap) in order.  The nearest pieces below come
    first; a run uses up pieces or gaps of a slice, so there are fewer than two runs per slice.
    """
    waiting: list[tuple[int, int, int, int]] = []     # (slice, rank, pieces, longest): a stack
    runs = []
    for number, pieces, longest, gaps, least in slices:
        first = 0
        while first < gaps and waiting:
            below, rank, n, most = waiting.pop()
            each = least // most
            taken = min(n, (gaps - first) * each)
            runs.append((below, rank, taken, each, number, first))
            first += -(-taken // each)
            if n > taken:
                waiting.append((below, rank + taken, n - taken, most))
        if pieces:
            waiting.append((number, 0, pieces, longest))
    return runs


def sweeper(capacity: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sweep as a task: rows (size, kind, id) of a sorted slice to rows of ``SWEPT``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not columns:
            return
        number = TaskContext.get().partitionId()
        size, kind, ident = (np.concatenate(c) for c in zip(*columns))
        placed, left = sweep(size.tolist(), (kind == GAP).tolist(), capacity)
        what = kind.astype(np.int32)
        sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        if placed:
            piece, gap, at = np.array(placed, dtype=np.int64).T
            what[piece], sequence[piece], offset[piece] = PLACED, ident[gap], at
            what[gap] = FILLED
        rows, rest = np.array(list(left), dtype=np.int64), np.array(list(left.values()), dtype=np.int64)
        size = size.copy()
        size[rows] = rest
        rank = np.zeros(len(size), dtype=np.int64)
        for of in (PIECE, GAP):                       # the longest piece and the smallest gap first
            own = np.flatnonzero(what == of)
            rank[own[::-1] if of == PIECE else own] = np.arange(len(own))
        yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(np.full(len(size), number, dtype=np.int32)), pa.array(rank), pa.array(ident),
                                          pa.array(size), pa.array(sequence), pa.array(offset)],
                                         names=["what", "slice", "rank", "id", "size", "sequence_id", "offset"])
    return run


def meeting(runs: list[tuple[int, int, int, int, int, int]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (what, slice, rank, id, size) with the gap, by slice and rank, at which they meet; null for rows of no run."""
    below, rank, n, each, above, first = (np.array(c, dtype=np.int64) for c in zip(*runs))
    code = (below << RANKS) + rank
    by_piece = np.argsort(code)
    gap_code = (above << RANKS) + first
    by_gap = np.argsort(gap_code)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            what, number, place = (batch.column(k).to_numpy().astype(np.int64) for k in range(3))
            own = (number << RANKS) + place
            at = by_piece[np.maximum(np.searchsorted(code[by_piece], own, "right") - 1, 0)]
            key = gap_code[at] + (own - code[at]) // each[at]
            met = (what == PIECE) & (own >= code[at]) & (own < code[at] + n[at])
            at = by_gap[np.maximum(np.searchsorted(gap_code[by_gap], own, "right") - 1, 0)]
            gaps = (what == GAP) & (own >= gap_code[at]) & (own < gap_code[at] + -(-n[at] // each[at]))
            key = np.where(gaps, own, key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, mask=~(met | gaps))], names=[*batch.schema.names, "key"])
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    ship_package(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row")
    held = stage(pieces.select(row, F.col("length").alias("size"), F.monotonically_increasing_id().alias("id")), "pieces")
    # A piece as long as a sequence is one; its number is below zero.
    full = held.filter(F.col("size") >= capacity).select("row", (-1 - F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    state = held.filter(F.col("size") < capacity).select("size", F.lit(PIECE).alias("kind"), "id")
    left = state.agg(F.sum("size")).first()[0] or 0   # tokens of unplaced pieces
    opened, moved, placed = 0, False, []
    while left:
        if not moved:
            more = -(-left // capacity)
            state = state.unionByName(spark.range(opened, opened + more).select(F.lit(capacity).cast("long").alias("size"), F.lit(GAP).alias("kind"), "id"))
            opened += more
        order = ["size", "kind", "id"]
        sliced = state.coalesce(1) if state.count() <= slice_rows else state.repartitionByRange(*order)
        swept = stage(sliced.sortWithinPartitions(*order).mapInArrow(sweeper(capacity), SWEPT), "swept")
        facts = {(r["slice"], r["what"]): r for r in swept.groupBy("slice", "what").agg(
            F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("total")).collect()}
        found = lambda number, what, name: facts[number, what][name] if (number, what) in facts else 0
        runs = carried((k, found(k, PIECE, "n"), found(k, PIECE, "most"), found(k, GAP, "n"), found(k, GAP, "least"))
                       for k in sorted({k for k, _ in facts}))
        # What a single slice leaves fits into none of its gaps.
        moved = len({k for k, _ in facts}) > 1 and (bool(runs) or any(what == PLACED for _, what in facts))
        placed.append(swept.filter(F.col("what") == PLACED).select("id", "sequence_id", "offset"))
        rest = swept.filter(F.col("what").isin(PIECE, GAP)).select("what", "slice", "rank", "id", "size")
        filled = swept.filter(F.col("what") == FILLED).select("size", F.lit(GAP).alias("kind"), "id")
        left = sum(r["total"] for (_, what), r in facts.items() if what == PIECE)
        least = min((r["least"] for (_, what), r in facts.items() if what == PIECE), default=0)
        if runs:
            met = rest.mapInArrow(meeting(runs), "what int, slice int, rank long, id long, size long, key long")
            own = Window.partitionBy("key")
            by_rank = own.orderBy(F.col("what").desc(), F.col("rank"))         # the gap, then its pieces: ``capacity`` rows at most
            length = F.when(F.col("what") == PIECE, F.col("size")).otherwise(0)
            sent = stage(met.filter("key is not null").select(
                "what", "id", "size", F.first("id").over(by_rank).alias("sequence_id"),
                (capacity - F.first("size").over(by_rank) + F.sum(length).over(by_rank) - length).alias("offset"),
                (F.first("size").over(by_rank) - F.sum(length).over(own)).alias("rest")), "sent")
            pieces_sent = sent.filter(F.col("what") == PIECE)
            placed.append(pieces_sent.select("id", "sequence_id", "offset"))
            left -= pieces_sent.agg(F.sum("size")).first()[0]
            filled = filled.unionByName(sent.filter(F.col("what") == GAP).select(F.col("rest").alias("size"), F.lit(GAP).alias("kind"), "id"))
            rest = met.filter("key is null")
        state = (rest.select("size", F.col("what").alias("kind"), "id").unionByName(filled)
                 .filter((F.col("kind") == PIECE) | (F.col("size") >= least)))  # smaller gaps can take nothing any more
    if placed:
        full = full.unionByName(held.filter(F.col("size") < capacity).join(functools.reduce(DataFrame.unionByName, placed), "id")
                                .select("row", "sequence_id", "offset"))
    return full.select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences: (sequence_id, ids), from pieces that carry ``ids``; at most a capacity of tokens each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.flatten(F.col("_parts.ids")).alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Digest of the packing of ``docs``: one row per piece."""
    return pack(tokenize(docs))
