"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and texts without a label teach; no text is ever taken as a confirmed clean
one. With the class prior ``p``, positives P and unlabelled texts U, the risk that is minimised is

    p * R_P(+) + max(0, R_U(-) - p * R_P(-))

where the last two terms estimate the risk on clean texts; where they fall below zero the model has begun
to learn single texts by heart, and the step goes back on that part. Several linear numpy classifiers
over the presence of words and word beginnings learn on shards of the rows; a text's score is the logistic function of their
mean margin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.base import load, named, query, texts
from featloom.session import materialise

WORD = re.compile(r"\w+")
WORDS = r"[\p{L}\p{N}_]+"
# Bounds of the training sample: rows drawn by a hash of their id.
MAX_POSITIVE = 10_000
MAX_UNLABELLED = 30_000
SHARDS = 4
# Lengths of word beginnings that are features beside the words themselves.
BEGINNINGS = (3, 4, 5, 6)
# A feature is used from this share of the positive texts on, if it is clearly more frequent there than
# among unlabelled texts: so many times, or half as often as a feature of positive texts alone would be,
# which is one by the class prior; the most frequent ones first.
LEAST_SHARE = 0.005
LEAST_TEXTS = 4
LEAST_LIFT = 4.0
MAX_FEATURES = 5_000
ROUNDS = 300
RATE = 0.1
PENALTY = 3e-4
THRESHOLD = 0.3


@dataclass(frozen=True)
class Classifier:
    """Weights of features, and the margin of a text without any."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        margin = self.bias + sum(map(self.weights.__getitem__, features_of(text) & self.weights.keys()))
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -30.0, 30.0))))


def features_of(text: str) -> set[str]:
    """Distinct lower-case words and their beginnings."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({word[:length] for word in words} for length in BEGINNINGS))


def fold(doc_id: Column) -> Column:
    """Remainder of the checksum of the id as text; rows with remainder 2 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def class_prior(labels: DataFrame) -> float:
    """Share of toxic rows among the labelled rows that may teach."""
    row = labels.agg(F.avg("toxic").alias("share")).first()
    return min(0.9, max(1e-3, row["share"])) if row["share"] is not None else 0.0


def label_rows(labels: DataFrame) -> DataFrame:
    """(id, toxic) once per id that may teach; an id counts as toxic if any of its rows says so."""
    rows = labels.select(named("doc_id").cast("long").alias("id"), named("toxic").cast("int").alias("toxic"))
    usable = rows.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
    return usable.groupBy("id").agg(F.max("toxic").alias("toxic"))


def sampled(rows: DataFrame, at_most: int, total: int) -> DataFrame:
    """About ``at_most`` rows by a hash of their id, all if there are fewer."""
    if total <= at_most:
        return rows
    return rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(at_most / total * (1 << 30)))


def training_rows(rows: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> DataFrame:
    """(id, text, positive): confirmed toxic texts, and texts whose labels are not looked at."""
    usable = rows.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    toxic = label_rows(labels).where("toxic = 1").select("id")
    wanted = sampled(toxic, max_positive, toxic.count())
    unlabelled = sampled(usable.select("id"), max_unlabelled, usable.select("id").count())
    chosen = wanted.withColumn("positive", F.lit(1)).unionByName(unlabelled.withColumn("positive", F.lit(0)))
    return materialise(usable.join(chosen, "id").select("id", "text", "positive"), "toxicity-training")


def vocabulary(training: DataFrame, prior: float, least_share: float = LEAST_SHARE, most: int = MAX_FEATURES) -> list[str]:
    """Features of many positive texts that stand out against the unlabelled ones."""
    totals = {row["positive"]: row["count"] for row in training.groupBy("positive").count().collect()}
    n_positive, n_unlabelled = totals.get(1, 0), totals.get(0, 0)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)))
    beginnings = [F.transform("words", lambda word, n=n: F.substring(word, 1, n)) for n in BEGINNINGS]
    features = F.explode(F.array_distinct(F.concat("words", *beginnings))).alias("feature")
    counted = training.select("positive", words.alias("words")).select("positive", features).groupBy("feature")
    counts = counted.agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    # Two standard deviations below the count, so that chance does not make a rare feature stand out.
    sure = (F.col("p") - 2 * F.sqrt("p")) / max(1, n_positive) >= min(LEAST_LIFT, 0.5 / prior) * F.col("u") / max(1, n_unlabelled)
    frequent = F.col("p") >= max(LEAST_TEXTS, int(least_share * n_positive))
    return [row["feature"] for row in counts.where(frequent & sure).orderBy(F.desc("p"), "feature").limit(most).collect()]


def risk_step(margin: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Derivative of the corrected risk by each row's margin, for the logistic loss."""
    chance = 1.0 / (1.0 + np.exp(-margin))
    loss_negative = np.logaddexp(0.0, margin)
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    clean = loss_negative[~positive].sum() / n_u - prior * loss_negative[positive].sum() / n_p
    # The part of the risk on clean texts, by unlabelled rows less their positive share.
    back = np.where(positive, -prior * chance / n_p, chance / n_u)
    if clean < 0.0:
        return -back
    return back + np.where(positive, prior * (chance - 1.0) / n_p, 0.0)


def train(indices: np.ndarray, sizes: np.ndarray, positive: np.ndarray, features: int, prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows at once; ``indices`` lists the features of row after row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    weights = np.zeros(features + 1)
    weights[-1] = np.log(prior / (1.0 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        margin = np.bincount(row, weights[indices], len(sizes)) + weights[-1]
        slope = risk_step(np.clip(margin, -30.0, 30.0), positive, prior)
        gradient = np.append(np.bincount(indices, slope[row], features) + PENALTY * weights[:-1], slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, shards: int = SHARDS) -> Classifier:
    """Learn from (doc_id, text) rows and (doc_id, toxic) labels outside the held-out fold.

    Every shard is one task's: about ``(max_positive + max_unlabelled) / shards`` texts, whatever the size
    of the table. Without a toxic example the classifier knows no feature and its score is 0.
    """
    rows = texts(docs).withColumnRenamed("doc_id", "id")
    prior = class_prior(label_rows(labels))
    training = training_rows(rows, labels, max_positive, max_unlabelled) if prior else None
    features = vocabulary(training, prior) if prior else []
    if not features:
        return Classifier({}, -30.0)
    place = {feature: i for i, feature in enumerate(features)}

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "positive", "text"])
        found = [np.fromiter((place[f] for f in features_of(text) & place.keys()), np.int64) for text in frame["text"]]
        sizes = np.array([len(f) for f in found], np.int64)
        weights, bias = train(np.concatenate(found), sizes, frame["positive"].to_numpy() == 1, len(place), prior)
        return pd.DataFrame({"weights": [weights.astype("<f8").tobytes()], "bias": [bias]})

    dealt = training.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    models = dealt.groupBy("shard").applyInPandas(learn, "weights binary, bias double").collect()
    mean = np.mean([np.frombuffer(m["weights"], "<f8") for m in models], axis=0)
    return Classifier(dict(zip(features, mean.tolist())), float(np.mean([m["bias"] for m in models])))


def score(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row: the whole text's words count, nothing else does.

    A null or empty text has the score of a text without a known feature; repeated rows are scored one by
    one; a null id stays null; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            scores = pa.array([classifier.score(text.as_py()) for text in frame.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([frame.column(0), scores], schema=schema)

    return texts(docs, doc_id, text).mapInArrow(run, "doc_id long, score double")


@query("op2_pu_toxicity")
def op2_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, load(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
