"""Quality scores learned from preference pairs: Bradley-Terry ranking.

Of two labelled documents, one of quality 1 is preferred to one of quality 0.
The score of a document is linear in features of its text; the chance that one
is preferred is the logistic function of the difference of scores, so the weights
are those of a logistic loss on feature differences.  The threshold is a quantile
of the learned scores of all labelled documents that are not held out: the share of
label 0 among the labels.  Scores are reported
on 0 to 1 such that the threshold lies at ``CUT``.  Each text is read for its features
once: scores are written, and threshold and verdicts are taken from what is written.

Learning reads a bounded sample of labelled rows (``per_label`` of each label, by
hash of the id) and never a held-out one; scoring reads every whole text.

Defined results: null and empty texts get the score of an empty text; null ids
are scored and not held out; an id labelled both 0 and 1 counts as 0; without
both labels every score is 0.5 (nothing is rejected).  Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import Batches, as_bytes, fresh
from shelfwise.settings import cut_lineage

CUT = 0.3
PER_LABEL = 2000
PAIRS = 40_000
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
# Letters, also of other scripts: bytes from 128 on are parts of them.
LETTERS = bytes(range(97, 123)) + UPPER + bytes(range(128, 256))
SPACES = b" \t\n\r\x0b\x0c"
MARKS = b".,;:!?'\"()-"
NAMES = (
    "length words word_length upper digits symbols marks endings unique repeats pairs lines line_words line_ends"
).split()


def features(text: bytes) -> list[float]:
    """Shares and lengths of a whole text; none depends on its language or source."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    letters = len(text) - len(text.translate(None, LETTERS))
    upper = len(text) - len(text.translate(None, UPPER))
    digits = len(text) - len(text.translate(None, DIGITS))
    rest = text.translate(None, LETTERS + DIGITS + SPACES)
    marks = len(rest) - len(rest.translate(None, MARKS))
    lines = [x for x in text.split(b"\n") if x]
    tails = [w[-1] for w in words]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(size),
        np.log1p(len(words)),
        letters / n,
        upper / max(letters, 1),
        digits / size,
        (len(rest) - marks) / n,
        marks / n,
        (tails.count(46) + tails.count(33) + tails.count(63)) / n,
        len(set(words)) / n ** 0.9,
        repeats / n,
        len(set(zip(words, words[1:]))) / n,
        len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
        sum(x[-1] in b".!?" for x in lines) / max(len(lines), 1),
    ]


@dataclass
class Ranker:
    """score = sigmoid(scale * (weights . form(features) - threshold) + logit(CUT))."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def form(self, x: np.ndarray) -> np.ndarray:
        """Features about their median, and how far out they are on either side."""
        z = np.clip((x - self.middle) / self.spread, -6, 6)
        return np.hstack([z, np.abs(z), np.minimum(z * z, 9)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.form(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return 1 / (1 + np.exp(-np.clip(self.scale * (raw - self.threshold) + np.log(CUT / (1 - CUT)), -40, 40)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, share: float, seed: int = 7) -> Ranker:
    """Weights from ``PAIRS`` preference pairs; the threshold from the share of label 0."""
    if not len(good) or not len(bad):
        return Ranker(np.zeros(0), np.ones(0), np.zeros(0), 0.0, 1.0)
    middle = np.median(good, axis=0)
    spread = np.maximum(np.percentile(np.abs(good - middle), 80, axis=0), 1e-3)
    ranker = Ranker(middle, spread, np.zeros(3 * good.shape[1]), 0.0, 1.0)
    g, b = ranker.form(good), ranker.form(bad)
    rng = np.random.default_rng(seed)
    d = g[rng.integers(len(g), size=PAIRS)] - b[rng.integers(len(b), size=PAIRS)]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / len(d) + 1e-3 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    ranker.weights = w
    # Each label weighs as it does among all labels, not as in the sample.
    scores = np.concatenate([g @ w, b @ w])
    mass = np.concatenate([np.full(len(g), (1 - share) / len(g)), np.full(len(b), share / len(b))])
    order = np.argsort(scores, kind="stable")
    below = np.cumsum(mass[order])
    at = min(int(np.searchsorted(below, share)), len(order) - 1)
    up = min(at + 1, len(order) - 1)
    ranker.threshold = float((scores[order[at]] + scores[order[up]]) / 2)
    return ranker


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _raw(spark, ranker: Ranker):
    """Column function: the learned score of a text, before the threshold is known."""
    shared = spark.sparkContext.broadcast(ranker)

    @F.pandas_udf("double")
    def raw(texts: pd.Series) -> pd.Series:
        found = [features((t or "").encode()) for t in texts]
        return pd.Series(shared.value.raw(np.array(found)) if found else np.zeros(0))

    return raw


def _threshold(raws: DataFrame, column: str, marked: DataFrame, share: float) -> float:
    """Middle of the step at the quantile ``share`` of the raw scores of every id in ``marked``."""
    found = raws.select("doc_id", F.col(column).alias("raw")).join(marked.select("doc_id"), "doc_id")
    found = cut_lineage(found.groupBy("doc_id").agg(F.min("raw").alias("raw")))
    low = found.agg(F.percentile_approx("raw", share, 100_000)).first()[0]
    high = found.where(F.col("raw") > low).agg(F.min("raw")).first()[0]
    return (low + (low if high is None else high)) / 2


def _fit(docs: DataFrame, labels: DataFrame, per_label: int, seed: int = 7) -> tuple[Ranker, DataFrame, float]:
    """Ranker from at most ``per_label`` documents of each label, all labelled ids, and the share of label 0.

    None of the ids is held out.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = dict(marked.groupBy("quality").count().collect())
    share = counts.get(0, 0) / max(sum(counts.values()), 1)
    rows = []
    for q in (0, 1):
        rows += marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_label).collect()
    spark = docs.sparkSession
    picked = spark.createDataFrame([(r["doc_id"], int(r["quality"])) for r in rows], "doc_id long, quality int")
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def kernel(batches: Batches) -> Batches:
        for batch in batches:
            found = [features(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))],
                names=["doc_id", "quality", "x"],
            )

    # Rows that share an id count once, or they could outgrow the sample.
    sample = chosen.select("doc_id", "text", "quality").mapInArrow(kernel, "doc_id long, quality int, x array<double>")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()
    sides = [np.array([r["x"] for r in sorted(sample) if r["quality"] == q]) for q in (1, 0)]
    return fit_pairs(*sides, share, seed), marked, share


def _scored(docs: DataFrame, columns: list, name: str, labels: DataFrame, per_label: int) -> tuple[DataFrame, Ranker]:
    """``columns`` of ``docs`` and the raw score ``name``, written, and the ranker with the threshold over all labels."""
    ranker, marked, share = _fit(docs, labels, per_label)
    if not len(ranker.weights):
        return docs.select(*columns, F.lit(0.0).alias(name)), ranker
    raws = cut_lineage(docs.select(*columns, _raw(docs.sparkSession, ranker)("text").alias(name)))
    ranker.threshold = _threshold(raws, name, marked, share)
    return raws, ranker


def _score(ranker: Ranker, name: str) -> Column:
    """`Ranker.score` of a written raw score."""
    if not len(ranker.weights):
        return F.lit(0.5)
    x = F.lit(float(ranker.scale)) * (F.col(name) - F.lit(ranker.threshold)) + F.lit(float(np.log(CUT / (1 - CUT))))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(x, F.lit(-40.0)), F.lit(40.0))))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Ranker:
    """Fit on at most ``per_label`` documents of each label; the threshold is over all labelled ones."""
    return _scored(docs, ["doc_id"], "raw", labels, per_label)[1]


def quality_report(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    raws, ranker = _scored(docs, ["doc_id"], "raw", labels, per_label)
    scored = raws.select("doc_id", held_out().alias("held_out"), _score(ranker, "raw").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def drop_rejected(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """``docs`` without the rows whose score is under the threshold."""
    name = fresh(docs, "quality_score")
    raws, ranker = _scored(docs, ["*"], name, labels, per_label)
    return raws.where(_score(ranker, name) >= CUT).drop(name)
