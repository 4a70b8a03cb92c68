"""Language identification by rank-order profiles.

A profile holds the most frequent n-grams of a language's texts, in order.  The most frequent
n-grams of a document are compared to each profile: every n-gram adds the distance between its
two places, or the largest distance if the profile lacks it.  The least sum wins.

N-grams are runs of one to three letters, where a gap between words counts as one place; case is
ignored.  The n-grams of all learning texts are counted in Spark; only profiles, a few hundred
n-grams for each language label, come to the driver and go out to the tasks.

Defined cases: ``und`` with score 0 for a null text, one without a letter, or if nothing could be
learnt; ties go to the language first in code point order, ties between n-grams to
the smaller one; texts are read whole, in slices; repeated rows count as often as they come; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import ship_package
from .common import annotate, as_bytes, held_out

PROFILE = 400        # n-grams of a language profile
DOCUMENT = 400       # n-grams of a document that are compared
SLICE = 1 << 18      # characters counted at once
PENDING = 400_000    # counts kept by a learning task before it hands them on

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_tables: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    if not _tables:
        _tables.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _tables[0]


def ngrams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers (21 bits a letter, 0 a gap) and how often each comes."""
    decoded = (text or b"").decode("utf-8", "replace")
    found: dict[int, int] | None = None
    parts = []
    for at in range(0, len(decoded), SLICE):
        code = np.frombuffer(decoded[at:at + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        letter = is_letter()[code]
        if not letter.any():
            continue
        code = np.concatenate(([0], np.where(letter, code, 0), [0]))
        code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]  # one gap between words
        pairs = code[:-1] << 21 | code[1:]
        threes = pairs[:-1] << 21 | code[2:]
        threes = threes[code[1:-1] != 0]      # a gap in the middle joins two words
        every = np.concatenate((code[code != 0] | 1 << 62, pairs | 1 << 61, threes))
        parts.append(np.unique(every, return_counts=True))
    if not parts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if len(parts) == 1:
        return parts[0]
    grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def most_frequent(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent n-grams, in order; ties by number."""
    if len(grams) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        likely = counts >= least
        grams, counts = grams[likely], counts[likely]
    return grams[np.lexsort((grams, -counts))][:most]


def count_ngrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, count), added up inside the task."""
    sums: dict[str, list] = {}
    pending = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for lang, parts in sums.items():
            grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "count"])
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            grams, counts = ngrams(text.as_py())
            sums.setdefault(lang, []).append((grams, counts))
            pending += len(grams)
            if pending > PENDING:
                yield from hand_on()
                pending = 0
    yield from hand_on()


def learn_profiles(learning: DataFrame) -> dict[str, np.ndarray]:
    """The profile of every ``lang`` of ``learning`` (lang, text): its ``PROFILE`` most frequent n-grams."""
    ship_package(learning.sparkSession)
    counted = (learning.filter("lang is not null and text is not null").select("lang", "text")
               .mapInArrow(count_ngrams, "lang string, gram long, count long")
               .groupBy("lang", "gram").agg(F.sum("count").alias("count")))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "gram")
    best = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PROFILE)
    rows = sorted(best.select("lang", "place", "gram").collect())   # PROFILE rows per label
    profiles: dict[str, list[int]] = {}
    for lang, _, gram in rows:
        profiles.setdefault(lang, []).append(gram)
    return {lang: np.array(grams, dtype=np.int64) for lang, grams in profiles.items()}


def predictor(profiles: dict[str, np.ndarray]):
    """A function from texts to predictions."""
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.empty(0, dtype=np.int64)
    far = max(PROFILE, DOCUMENT)
    places = np.full((len(known) + 1, max(1, len(names))), far, dtype=np.int64)   # the last row: in no profile
    for k, name in enumerate(names):
        places[np.searchsorted(known, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(text: bytes | None) -> tuple[str, float]:
        grams, counts = ngrams(text)
        if not len(grams) or not names:
            return "und", 0.0
        top = most_frequent(grams, counts, DOCUMENT)
        at = np.searchsorted(known, top)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != top)] = len(known)
        found = places[at]
        distance = np.where(found < far, np.abs(found - np.arange(len(top))[:, None]), far).sum(axis=0)
        best = int(distance.argmin())
        return names[best], 1.0 - float(distance[best]) / (far * len(top))

    def facts(texts: pa.Array) -> pa.Array:
        rows = [predict(text.as_py()) for text in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                                          names=FIELDS.names)

    return facts


def with_language(docs: DataFrame, profiles: dict[str, np.ndarray], name: str) -> DataFrame:
    """``docs`` with a struct column ``name``: predicted language and a score from 0 to 1."""
    return annotate(docs, "text", name, FIELDS, predictor(profiles))


def predict_languages(docs: DataFrame) -> DataFrame:
    """Digest of the predictions: one row per document; profiles are learnt from rows not held out."""
    learning = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    profiles = learn_profiles(learning)
    return with_language(docs.select("doc_id", "text"), profiles, "_lang").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "_lang.*")
