"""Toxicity by weak supervision.

Voters are lexicon entries (words and word stems found in labelled toxic
documents and rare in others, and a fixed list) and patterns over them. A
generative label model with two classes estimates by expectation maximisation
how accurate each voter is, and from what the classes leave unexplained how
strongly voters repeat one another; a voter's say is divided by the number of
voters that it repeats. Its posterior labels train a linear classifier over
all entries, which scores every document.

Labels are used of rows alone whose crc32 of the id is not 1 modulo 3. The
sample that the models are fitted on is bounded (``SAMPLE``); the score reads
every word of every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from salesledger.llm.common import freeze, small_batches

THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
#: Labelled documents that the models see at most, toxic and others: those
#: with the least hash of the id.
SAMPLE = {1: 4000, 0: 8000}
#: Entries: least toxic documents with one, and least log-odds. All that pass
#: are the classifier's.
MIN_SUPPORT = 3
MIN_ODDS = 2.5
VOTERS = 128
#: A toxic document counts as covered once it has so many voters.
COVER = 3
STEMS = range(3, 9)
WORD = re.compile(r"[^\W\d_]+")
# fixed values: abusive English words that vote without labels too
LEXICON = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def entries_of(text: str | None) -> set[str]:
    """The text's words, and their stems (marked by a hyphen)."""
    words = set(WORD.findall((text or "").lower()))
    found = set(words)
    for n in STEMS:
        found |= {w[:n] + "-" for w in words if len(w) >= n}
    return found


@dataclass
class Model:
    """Weights of entries (hyphen: a stem) and patterns, and a constant."""

    constant: float = -3.0
    weight: dict[str, float] = field(default_factory=lambda: dict.fromkeys(LEXICON, 5.0))

    def hits(self, text: str | None) -> set[str]:
        words = set(WORD.findall((text or "").lower()))
        found = words & self.weight.keys()
        for n in STEMS:
            found |= {s for w in words if len(w) >= n and (s := w[:n] + "-") in self.weight}
        return found

    def score(self, text: str | None) -> float:
        total = self.constant + sum(self.weight[w] for w in sorted(self.hits(text)))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen[toxic].update(entries_of(text))
        found = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([seen[k][e] for e in found], pa.int64()) for k in (1, 0))], ["entry", "positive", "negative"])


def _odds(sample: DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """Log-odds of the entries with enough support and odds: both counts are
    joined and tested in Spark, so that what comes here is what the model uses."""
    counts = sample.mapInArrow(_count, "entry string, positive long, negative long").groupBy("entry").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    odds = F.log((F.col("positive") + 0.5) / (n_pos + 1)) - F.log((F.col("negative") + 0.5) / (n_neg + 1))
    table = counts.where(F.col("positive") >= min(MIN_SUPPORT, n_pos)).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS).select("entry", "odds").toArrow()
    return dict(zip(table.column("entry").to_pylist(), table.column("odds").to_pylist(), strict=True))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of the bounded sample, and how many labels there are."""
    known = labels.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = freeze(known)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k, most in SAMPLE.items()]
    ids = freeze(parts[0].unionByName(parts[1]))  # at most sum(SAMPLE) rows, so a broadcast is bounded
    return freeze(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic")), counts


class Rows:
    """A sparse 0/1 matrix: for each row its entries, sorted by row."""

    def __init__(self, sizes: np.ndarray, entry: np.ndarray, width: int):
        self.row, self.entry = np.repeat(np.arange(len(sizes)), sizes), entry
        self.shape = (len(sizes), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Sum of ``w`` over each row's entries."""
        return np.bincount(self.row, w[self.entry], self.shape[0])

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Sum of ``v`` over each entry's rows."""
        return np.bincount(self.entry, v[self.row], self.shape[1])

    def columns(self, chosen: list[int]) -> np.ndarray:
        """Some columns, dense."""
        place = np.full(self.shape[1], -1)
        place[chosen] = np.arange(len(chosen))
        out, own = np.zeros((self.shape[0], len(chosen)), bool), place[self.entry] >= 0
        out[self.row[own], place[self.entry[own]]] = True
        return out


def _voters(has: Rows, toxic: np.ndarray, odds: np.ndarray) -> list[int]:
    """Entries chosen one by one for the toxic documents they still cover."""
    left = np.where(toxic == 1, COVER, 0)
    free, chosen = np.ones(has.shape[1], bool), []
    while len(chosen) < VOTERS and free.any():
        support = has.sums((left > 0).astype(np.float64))
        best = int((support * odds * free).argmax())
        if support[best] < MIN_SUPPORT:
            break
        chosen.append(best)
        free[best] = False
        left[has.row[has.entry == best]] -= 1
    return chosen


def label_model(votes: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior labels of 0/1 votes (document by voter), each voter's rates
    given class 0 and 1, and the share of its say that correlations leave it."""
    n, j = votes.shape
    posterior = np.where(votes.any(axis=1), 0.9, 0.05)
    say = np.ones(j)
    for _ in range(rounds):
        w1, w0 = posterior * weight, (1 - posterior) * weight
        p1 = (votes.T @ w1 + 0.5) / (w1.sum() + 5)
        p0 = (votes.T @ w0 + 0.05) / (w0.sum() + 5)
        # what two voters share beyond the classes: their residual correlation
        rest = votes - (posterior[:, None] * p1 + (1 - posterior)[:, None] * p0)
        spread = np.sqrt((rest**2 * weight[:, None]).mean(axis=0)) + 1e-9
        tied = (rest * weight[:, None]).T @ rest / n / np.outer(spread, spread)
        np.fill_diagonal(tied, 0)
        say = 1 / (1 + np.clip(tied - 0.1, 0, 1).sum(axis=1))
        prior = np.clip(w1.sum() / weight.sum(), 1e-4, 1 - 1e-4)
        logit = np.log(prior / (1 - prior)) + votes @ (say * np.log(p1 / p0)) + (1 - votes) @ (say * np.log((1 - p1) / (1 - p0)))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, np.stack([p0, p1]), say


def linear(x: Rows, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic regression on sparse rows, by
    accelerated descent."""
    share = weight / weight.sum()
    direction = np.ones(x.shape[1])
    for _ in range(20):  # the steepest curve, by power iteration; the constant adds at most 1
        direction = x.sums(share * x.dot(direction))
        steepest = float(np.linalg.norm(direction)) or 1.0
        direction /= steepest
    rate = 4.0 / (steepest + 1.0)
    w, constant = np.zeros(x.shape[1]), -3.0
    ahead, ahead_constant = w.copy(), constant
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(ahead) + ahead_constant, -30, 30)))
        off = share * (p - y)
        new, new_constant = ahead - rate * (x.sums(off) + ridge / x.shape[0] * ahead), ahead_constant - rate * float(off.sum())
        push = step / (step + 3)
        ahead, ahead_constant = new + push * (new - w), new_constant + push * (new_constant - constant)
        w, constant = new, new_constant
    return w, constant


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier for ``docs`` (doc_id, text) and ``labels`` (doc_id,
    toxic). Without toxic labels in the sample the fixed list alone votes."""
    sample, counts = _sample(docs, labels)
    n_pos, n_neg = sample.where("toxic = 1").count(), sample.where("toxic = 0").count()
    if not n_pos:
        return Model()
    odds = _odds(sample, n_pos, n_neg)
    entries = sorted(odds.keys() | set(LEXICON))
    probe = Model(0.0, dict.fromkeys(entries, 1.0))
    at = {e: k for k, e in enumerate(entries)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(at[e] for e in probe.hits(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    rows = sample.mapInArrow(hits, "toxic int, found array<int>").toArrow()  # entries of at most sum(SAMPLE) documents
    found = rows.column("found").combine_chunks()
    has = Rows(np.diff(np.asarray(found.offsets)), found.flatten().to_numpy(), len(entries))
    toxic = rows.column("toxic").to_numpy()
    chosen = _voters(has, toxic, np.array([max(0.0, odds.get(e, 0.0)) for e in entries]))
    fixed = has.columns([at[w] for w in LEXICON]).any(axis=1)
    cast = has.columns(chosen)
    number = cast.sum(axis=1)
    votes = np.column_stack([cast, fixed, number >= 2, number >= 4]).astype(np.float64)
    # the sample's classes weigh as in all labelled rows
    weight = np.where(toxic == 1, counts.get(1, 0) / max(1, n_pos), counts.get(0, 0) / max(1, n_neg))
    posterior, _, _ = label_model(votes, weight / weight.mean())
    w, constant = linear(has, posterior, weight)
    return Model(constant, dict(zip(entries, w.tolist(), strict=True)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any others) with held_out, score and predicted;
    columns of these names are replaced.

    score: 0 to 1, higher if label 1 is likelier; null and empty texts get the
    constant's score. predicted: 1 if score >= 0.7. A null doc_id counts as an
    empty one. Labels that are null, neither 0 nor 1, or of unknown documents
    are ignored; of a document's several labels the highest counts.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("own"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(found, pa.float64())], ["own", "score"])

    schema = StructType([rows.schema["own"], StructField("score", DoubleType())])
    scored = rows.mapInArrow(run, schema).select(*(F.col(f"own.`{c}`") for c in keep), "score")
    return scored.withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
