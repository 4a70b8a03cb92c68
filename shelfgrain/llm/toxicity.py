"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers are trained from confirmed toxic texts and from unlabelled ones.  The risk of
calling the unlabelled texts clean is corrected by the class prior: the part of it that stems
from toxic texts among them is subtracted, and the rest is kept from going below zero.

Features are the words of a text, without regard to case and punctuation, and their first four, five
and six bytes, hashed.  A bounded sample is cut into parts; classifiers are trained
side by side, each in one task on all parts but one; their weights are averaged.  Spark counts in how many texts each feature
is; those that stand out among toxic texts are what a classifier has weights for, and the only ones that go to its task.  The
margin that counts as toxic is the one with the least prior-corrected risk on sampled texts that a classifier did not learn from.
Features with weights and the margins of sampled texts are all that comes to the driver.

Defined cases: null, empty and wordless texts get the score of a text without features; labels
without text, of no document or of a held-out document teach nothing; a document with several
labels is toxic if any says so; without any toxic label the score is 0 everywhere; texts are read whole;
repeated rows are scored alike, and the least text of an id is the one to learn from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import ship_package, stage
from .common import BASE, INVERSE, SLICE_BYTES, annotate, fresh, held_out, mixed, powers, short_batches, tidy, word_spans

BINS = 1 << 18            # hashed features
PREFIXES = (4, 5, 6)
BAGS = 4                  # parts of the sample; each classifier learns from all but one
POSITIVES = 1200          # toxic texts of a part, about, at most
UNLABELLED = 3000         # unlabelled texts of a part, about, at most
TEXTS = 256               # texts whose features are looked up at once
LEAST_TEXTS = 4           # toxic texts that must have a feature
LEAST_LIFT = 4.0          # times as frequent among toxic texts as among unlabelled ones, at least
LEAST_EXCESS = 5.0        # standard deviations above the number expected from unlabelled texts
ROUNDS, RATE, DECAY = 300, 0.05, 1e-4
AT_LEAST = 0.7            # score from which a text counts as toxic

FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
_plain = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_letters = mixed(np.arange(1, 257, dtype=np.uint64))


def features(text: bytes | None) -> np.ndarray:
    """Distinct feature numbers of a text."""
    text = (text or b"").translate(_plain)
    found = []
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= SLICE_BYTES else text.rfind(b" ", at, at + SLICE_BYTES) + 1
        end = end if end > at else text.find(b" ", at + SLICE_BYTES) + 1 or len(text)
        part = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
        starts, ends = word_spans(part)
        if len(starts):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_letters[part] * powers(BASE, len(part)), out=sums[1:])
            back = powers(INVERSE, len(part))[starts]
            found.append(mixed((sums[ends] - sums[starts]) * back))
            for n in PREFIXES:
                longer = ends - starts > n
                s = starts[longer]
                found.append(mixed((sums[s + n] - sums[s]) * back[longer] + np.uint64(n)))
        at = end
    return np.unique((np.concatenate(found) % np.uint64(BINS)).astype(np.int32)) if found else np.empty(0, dtype=np.int32)


def feature_lists(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.int32()))


def standing_out(made: DataFrame, prior: float) -> dict[int, np.ndarray]:
    """By classifier, the features that it has weights for, in order; without those that lack toxic or unlabelled texts.

    ``made`` (bag, toxic, features) is counted in Spark, to one row per feature; those that stand out come to the driver.
    """
    texts = {(r.bag, r.toxic): r.n for r in made.groupBy("bag", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = made.select("bag", "toxic", F.explode("features").alias("bin")).groupBy("bin").agg(
        *[F.count_if((F.col("bag") == k) & (F.col("toxic") == t)).alias(f"_{k}{t}") for k in range(BAGS) for t in (True, False)])
    least = {}
    for bag in range(BAGS):
        others = [k for k in range(BAGS) if k != bag]
        n_p, n_u = (sum(texts.get((k, t), 0) for k in others) for t in (True, False))
        if not n_p or not n_u:
            continue
        in_p, in_u = (sum((F.col(f"_{k}{t}") for k in others), F.lit(0)) for t in (True, False))
        # A word that only toxic texts have is 1 / prior times as frequent among them as among the unlabelled.
        expected = in_u * n_p / n_u
        least[bag] = ((in_p >= min(LEAST_TEXTS, n_p)) & (in_p >= min(LEAST_LIFT, 0.5 / prior) * expected)
                      & (in_p >= expected + LEAST_EXCESS * F.sqrt(expected + 0.25)))
    if not least:
        return {}
    bags = F.array_compact(F.array(*[F.when(stands, F.lit(bag)) for bag, stands in least.items()]))
    found = counts.select(F.explode(bags).alias("bag"), "bin").toPandas()
    return {bag: np.sort(found.loc[found["bag"] == bag, "bin"].to_numpy(dtype=np.int32)) for bag in least}


def turns(made: DataFrame, used: dict[int, np.ndarray]) -> DataFrame:
    """A row (bag, toxic, places) for each text that a classifier learns from: where its features are among those of the classifier."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {bag: np.full(BINS, -1, dtype=np.int32) for bag in used}
        for bag, bins in used.items():
            place[bag][bins] = np.arange(len(bins), dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                own, toxic, lists = batch.slice(at, TEXTS).columns
                own, lengths = own.to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
                values, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(own)), lengths)
                for bag, places in place.items():
                    other, found = own != bag, places[values]
                    kept = (found >= 0) & other[owner]
                    ends = np.cumsum(np.bincount(owner[kept], minlength=len(own))[other])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ends), bag, dtype=np.int32)), toxic.filter(pa.array(other)),
                         pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(found[kept]))],
                        names=["bag", "toxic", "places"])

    return made.select("bag", "toxic", "features").mapInArrow(tidy("toxicity", run), "bag int, toxic boolean, places array<int>")


def fit(n_used: int, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a classifier with little non-negative risk; texts are lists of places among ``n_used`` features."""
    def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*rows, np.empty(0, dtype=np.int32)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    sides = [(*packed(positive), len(positive)), (*packed(unlabelled), len(unlabelled))]
    weights, first, second = (np.zeros(n_used + 1) for _ in range(3))  # the last one is the bias

    def margins(side: int) -> np.ndarray:
        column, row, n = sides[side]
        return np.bincount(row, weights=weights[column], minlength=n) + weights[-1]

    def gradient(side: int, slope: np.ndarray) -> np.ndarray:
        column, row, n = sides[side]
        return np.append(np.bincount(column, weights=slope[row], minlength=n_used), slope.sum()) / max(1, n)

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, ROUNDS + 1):
        p, u = margins(0), margins(1)
        clean_risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        push = gradient(1, sigmoid(u)) - prior * gradient(0, sigmoid(p))
        slope = prior * gradient(0, sigmoid(p) - 1) + push if clean_risk >= 0 else -push
        slope = slope + DECAY * np.append(weights[:-1], 0)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        weights -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def sample(df: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most of distinct ids, the same ones in every run, chosen by a hash of the id."""
    n = df.count()
    return df if n <= most else df.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Average weights and bias, learnt from documents that are not held out; None without toxic labels."""
    ship_package(docs.sparkSession)
    short_batches(docs.sparkSession)
    may = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    texts = docs.filter(may & F.col("text").isNotNull()).select("doc_id", "text")
    ids = stage(texts.select("doc_id").distinct(), "ids")
    marks = stage(labels.filter(may & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
                  .join(ids, "doc_id", "left_semi"), "labels")
    n, toxic = marks.agg(F.count(F.lit(1)), F.sum("_toxic")).first()
    if not toxic:
        return None
    chosen = (sample(marks.filter("_toxic > 0").select("doc_id"), POSITIVES * BAGS).withColumn("toxic", F.lit(True))
              .unionByName(sample(ids, UNLABELLED * BAGS).withColumn("toxic", F.lit(False))))   # bounded, so it may be broadcast
    bag = F.pmod(F.xxhash64("doc_id", F.lit("bag")), F.lit(BAGS)).cast("int").alias("bag")
    # Rows of one id are one text to learn from.
    rows = (texts.join(F.broadcast(stage(chosen, "chosen")), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
            .select(bag, "toxic", "text"))
    made = stage(annotate_list(rows), "features")
    prior = float(toxic) / n

    used = standing_out(made, prior)

    def train(group: pd.DataFrame) -> pd.DataFrame:
        bag = int(group["bag"].iloc[0])
        lists = [[np.asarray(x, dtype=np.int32) for x in group.loc[group.toxic == t, "places"]] for t in (True, False)]
        weights, bias = fit(len(used[bag]), *lists, prior)
        return pd.DataFrame({"bag": bag, "bin": np.append(used[bag], -1), "weight": np.append(weights, bias)})

    learnt = turns(made, used).groupBy("bag").applyInPandas(train, "bag int, bin int, weight double").toPandas()
    found = {bag: np.bincount(np.where(part["bin"] < 0, BINS, part["bin"]), weights=part["weight"], minlength=BINS + 1)
             for bag, part in learnt.groupby("bag")}
    if not found:
        return None
    model = sum(found.values()) / len(found)
    cut = threshold(made, found, prior)
    return model[:-1], float(model[-1]) - cut + float(np.log(AT_LEAST / (1 - AT_LEAST)))


def threshold(made: DataFrame, found: dict[int, np.ndarray], prior: float) -> float:
    """The margin at which the prior-corrected risk of a decision is least, in the middle if there are several.

    Sampled texts are scored by the classifier that did not learn from them.
    """
    sparse = {bag: (np.flatnonzero(w[:-1]), w[:-1][np.flatnonzero(w[:-1])], w[-1]) for bag, w in found.items()}

    def margins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = {}
        for bag, (bins, values, bias) in sparse.items():
            dense[bag] = np.append(np.zeros(BINS), bias)
            dense[bag][bins] = values
        for frame in frames:
            frame = frame[frame["bag"].isin(dense)]
            yield pd.DataFrame({"toxic": frame["toxic"], "margin": [dense[b][np.asarray(f, dtype=np.int64)].sum() + dense[b][-1]
                                                                    for b, f in zip(frame["bag"], frame["features"])]})

    scored = made.mapInPandas(margins, "toxic boolean, margin double").toPandas()   # as many rows as are learnt from
    positive, rest = (np.sort(scored.loc[scored["toxic"] == t, "margin"].to_numpy(dtype=float)) for t in (True, False))
    cuts = np.unique(np.concatenate((positive, rest)))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1)
    caught = 1 - np.searchsorted(positive, cuts) / max(1, len(positive))
    called = 1 - np.searchsorted(rest, cuts) / max(1, len(rest))
    risk = prior * (1 - caught) + np.maximum(0, called - prior * caught)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(cuts[best[len(best) // 2]])


def annotate_list(rows: DataFrame) -> DataFrame:
    """``rows`` (bag, toxic, text) with feature lists in place of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), feature_lists(batch.column(2).cast(pa.binary()))],
                                             names=["bag", "toxic", "features"])

    return rows.mapInArrow(tidy("toxicity", run), "bag int, toxic boolean, features array<int>")


def with_toxicity(docs: DataFrame, model: tuple[np.ndarray, float] | None, name: str) -> DataFrame:
    """``docs`` with a struct column ``name``: score and whether it counts as toxic; no shuffle."""
    used = np.flatnonzero(model[0]) if model else np.empty(0, dtype=np.int64)
    values, bias = (model[0][used], model[1]) if model else (np.empty(0), 0.0)

    def facts(texts: pa.Array) -> pa.Array:
        weights = np.zeros(BINS)
        weights[used] = values
        margin = np.array([weights[features(t.as_py())].sum() + bias for t in texts] if model else [-np.inf] * len(texts), dtype=float)
        score = 1 / (1 + np.exp(-np.clip(margin, -700, 700))) if model else np.zeros(len(texts))
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array((score >= AT_LEAST).astype(np.int32), pa.int32())], names=FIELDS.names)

    return annotate(docs, "text", name, FIELDS, facts)


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that do not count as toxic, with their columns as they are."""
    name = fresh(docs, "_toxicity")
    scored = with_toxicity(docs, learn(docs, labels), name)
    return scored.filter(F.col(name)["predicted"] == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest of the scores: one row per document."""
    return with_toxicity(docs.select("doc_id", "text"), learn(docs, labels), "_toxicity").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "_toxicity.*")
