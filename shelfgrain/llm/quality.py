"""Quality rules on repetition coverage.

For several lengths n, rolling hashes of all word n-grams show which were seen before in the
text; the characters of the words that they cover, and those of repeated lines, are measured
against all characters of words.  A text is too repetitive when any of these shares passes its
limit; longer n-grams have lower limits, as a longer passage comes back by chance less often.  The
limits are those published for the filters of MassiveText, far below what the base rules imply (half of the words).
A text is dropped when it is too repetitive, when symbols abound, or when it fails the base rules.

Defined cases: null and empty texts have no words and fail the base rules; texts of any length are
measured whole; every row is judged by itself, so ties, repeated rows and other columns do
not matter; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WHITE, annotate, fresh, mixed, rolling, word_spans

MOST_IN_NGRAMS = {5: 0.15, 7: 0.13, 10: 0.10}   # share of characters in n-grams seen before, by length
MOST_IN_LINES = 0.2      # share of characters in lines seen before
MOST_SYMBOLS = 0.1       # symbols per word
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50       # per cent of words in windows of three words that come twice

FIELDS = T.StructType([
    *[T.StructField(name, T.LongType()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("in_lines", T.DoubleType()), T.StructField("in_ngrams", T.DoubleType()),
    T.StructField("base_failed", T.BooleanType()), T.StructField("too_repetitive", T.BooleanType()), T.StructField("kept", T.BooleanType())])
_ARROW = pa.struct([*[(name, pa.int64()) for name in FIELDS.names[:5]], ("in_lines", pa.float64()), ("in_ngrams", pa.float64()),
                    ("base_failed", pa.bool_()), ("too_repetitive", pa.bool_()), ("kept", pa.bool_())])
_not_symbols = bytes(set(range(256)) - set(SYMBOLS))


def covered(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in windows of ``width`` words that begin at the marked places."""
    steps = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(first)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, at + width, 1)
    return np.cumsum(steps)[:n] > 0


def repeats(keys: np.ndarray, also_first: bool) -> np.ndarray:
    """Which keys equal an earlier one, or (``also_first``) any other one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    if also_first:
        out[order[:-1][same]] = True
    return out


def triples(ids: np.ndarray, distinct: int) -> np.ndarray:
    """A key of its own for every sequence of three ids."""
    if distinct < 1 << 21:
        return ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
    return pairs[:-1] * distinct + ids[2:]


def measure(text: bytes | None) -> tuple:
    text = text or b""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_spans(data)
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text.translate(None, _not_symbols)), 0, 0, 0.0, 0.0, True, False, False
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    begun = np.zeros(len(data) + 1, dtype=np.int64)      # code points begun before each byte
    np.cumsum((data & 0xC0) != 0x80, out=begun[1:])
    chars = begun[ends] - begun[starts]
    total = int(chars.sum())
    symbols = len(text.translate(None, _not_symbols))
    repeated = int(covered(repeats(triples(ids, len(known)), True), 3, n).sum()) if n > 2 else 0
    seen: set[bytes] = set()
    dup_lines = in_lines = at = 0
    upto = np.concatenate(([0], np.cumsum(chars)))
    for line in text.split(b"\n"):
        if line.strip(WHITE):
            if line in seen:
                dup_lines += 1
                first, last = np.searchsorted(starts, (at, at + len(line)))
                in_lines += int(upto[last] - upto[first])
            else:
                seen.add(line)
        at += len(line) + 1
    most, repetitive = 0.0, in_lines / total > MOST_IN_LINES
    hashes = mixed(ids.astype(np.uint64) + np.uint64(1))
    for width, limit in MOST_IN_NGRAMS.items():
        if n > width:
            share = float(chars[covered(repeats(rolling(hashes, width), False), width, n)].sum()) / total
            most, repetitive = max(most, share), repetitive or share > limit
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    kept = not (failed or repetitive or symbols > MOST_SYMBOLS * n)
    return n, total, symbols, dup_lines, repeated, in_lines / total, most, failed, repetitive, kept


def facts(texts: pa.Array) -> pa.Array:
    rows = [measure(text.as_py()) for text in texts]
    return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else
                                      [pa.array([], f.type) for f in _ARROW], fields=list(_ARROW))


def with_quality(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` of measures and verdict; no shuffle."""
    return annotate(docs, "text", name, FIELDS, facts)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are."""
    name = fresh(docs, "_quality")
    return with_quality(docs, name).filter(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def judge_documents(docs: DataFrame) -> DataFrame:
    """Digest of the rules: one row per document."""
    return with_quality(docs.select("doc_id", "text"), "_quality").select("doc_id", "_quality.*")
