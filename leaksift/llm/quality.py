"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are pairs of neighbouring character classes over the whole text
and a few marks of repetition. Their damped, idf-weighted counts are projected
on the leading singular directions of a bounded sample of labelled texts. The
sample's vectors are broadcast, every document is compared with all of them in
blocks by exact cosine, and its nearest neighbours vote by similarity, each
label weighing as much as it does among all labelled rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_LABEL = 2048
DIMENSIONS = 48
NEIGHBOURS = 15
BLOCK = 512
THRESHOLD = 0.7

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = 6 + len(PUNCTUATION)
MARKS = 40
FEATURES = CLASSES * CLASSES + MARKS


def _class_table() -> np.ndarray:
    """Class of every byte of UTF-8: white space, line end, capital, small letter, digit, other byte, punctuation."""
    kinds = np.full(256, 5, np.int64)
    kinds[[9, 11, 12, 13, 32]] = 0
    kinds[10] = 1
    kinds[65:91], kinds[97:123], kinds[48:58] = 2, 3, 4
    for i, c in enumerate(PUNCTUATION):
        kinds[ord(c)] = 6 + i
    return kinds


_KINDS = _class_table()


def term_counts(text: str | None) -> np.ndarray:
    """Counts of all terms of one text; a null or empty text has none."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    step = 1 << 20
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    for lo in range(0, len(raw), step):
        kinds = _KINDS[raw[max(0, lo - 1):lo + step]]
        pairs += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    out[:CLASSES * CLASSES] = pairs
    words = text.split()
    if words:
        n = len(words)
        again = sum(map(str.__eq__, words, words[1:])) / n
        distinct = len(set(words)) / n ** 0.8
        length = np.log2(len(text) / n + 1)
        marks = out[CLASSES * CLASSES:]
        # A mark counts with the text's length, as the pairs do.
        marks[min(9, int(again * 10))] = n
        marks[10 + min(9, int(distinct * 4))] = n
        marks[20 + min(9, int(length * 1.5))] = n
        marks[30 + min(9, int(np.log2(n + 1) * 0.7))] = n
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    damped = np.log1p(counts) * idf
    norm = np.linalg.norm(damped, axis=1, keepdims=True)
    return damped / np.where(norm > 0, norm, 1)


@dataclass(frozen=True)
class Voter:
    """A fitted classifier: plain arrays of bounded size."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        latent = _weighted(counts, self.idf) @ self.basis
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return (latent / np.where(norm > 0, norm, 1)).astype(np.float32)

    def scores(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors; the prior for a text without terms."""
        if len(self.labels) == 0:
            return np.full(len(counts), self.prior)
        close = self.embed(counts) @ self.vectors.T
        k = min(neighbours, close.shape[1])
        best = np.argpartition(-close, k - 1, axis=1)[:, :k]
        votes = np.clip(np.take_along_axis(close, best, 1), 0, None).astype(np.float64) ** 8 * self.weights[best]
        total = votes.sum(1)
        share = (votes * self.labels[best]).sum(1) / np.where(total > 0, total, 1)
        return np.where((total > 0) & (counts.sum(1) > 0), share, self.prior)


def fit_voter(counts: np.ndarray, labels: np.ndarray, totals: dict[int, int], dimensions: int = DIMENSIONS) -> Voter:
    """Latent directions and weighted labelled vectors; without rows of both labels the prior decides alone."""
    every = sum(totals.values())
    prior = totals.get(1, 0) / every if every else 0.5
    if len(labels) == 0:
        return Voter(np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros((0, 1), np.float32), labels, np.zeros(0), prior)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
    gram = np.zeros((counts.shape[1],) * 2)
    for lo in range(0, len(counts), BLOCK):  # a block at a time: the driver holds no second copy of the sample
        block = _weighted(counts[lo:lo + BLOCK], idf)
        gram += block.T @ block
    _, vectors = np.linalg.eigh(gram)
    basis = vectors[:, ::-1][:, :dimensions]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1)
    seen = {y: int((labels == y).sum()) for y in (0, 1)}
    weights = np.array([totals[int(y)] / seen[int(y)] for y in labels], np.float64)
    voter = Voter(idf, basis, np.zeros((0, 1), np.float32), labels, weights / weights.mean(), prior)
    latent = np.concatenate([voter.embed(counts[lo:lo + BLOCK]) for lo in range(0, len(counts), BLOCK)])
    return Voter(idf, basis, latent, labels.astype(np.float64), weights / weights.mean(), prior)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether ``crc32`` of the key's text falls in the fold that is never learned from (a null key does not)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, key: str, text: str,
                    per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_label`` texts of each label in seeded order, and how many labelled rows there are in all.

    A key labelled twice counts by its largest label. The keys are bounded, so they are broadcast.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
             .where(learn))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit("sample"), F.col(key))
    parts = [known.where(F.col("_label") == y).orderBy(order, key).limit(per_label) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    sample = (docs.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key)
              .where(F.col("_text").isNotNull()).dropDuplicates([key]))
    return sample, totals


def fitted(docs: DataFrame, labels: DataFrame, label: str, learn: Column, key: str, text: str, per_label: int) -> Voter:
    sample, totals = labelled_sample(docs, labels, label, learn, key, text, per_label)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_key": batch[key], "_label": batch["_label"],
                                "_counts": [np.asarray(term_counts(t), np.float32).tobytes() for t in batch["_text"]]})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_key")  # a fixed order, so reruns agree
        counts = np.frombuffer(b"".join(rows["_counts"]), np.float32).reshape(len(rows), FEATURES)
        return pd.DataFrame({"model": [pickle.dumps(fit_voter(counts, rows["_label"].to_numpy(), totals))]})

    kind = dict(docs.dtypes)[key]
    # The sample is bounded, so one task fits it; the driver gets the model alone.
    models = (sample.mapInPandas(count, f"_key {kind}, _label int, _counts binary").groupBy(F.lit(0).alias("_all"))
              .applyInPandas(fit, "model binary").collect())
    if not models:
        return fit_voter(np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), totals)
    return pickle.loads(models[0]["model"])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2, key: str = "doc_id",
                   text: str = "text", per_label: int = SAMPLE_PER_LABEL, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; every row and column kept, nothing shuffled.

    Learned from at most ``per_label`` texts of each label outside the held-out
    fold. A null or empty text gets the labels' overall share; a null key is
    not held out; with no labels every score is one half; rows with equal text
    get equal scores; an empty table gives an empty one. Columns of ``docs``
    called like a new one are replaced.
    """
    voter = fitted(docs, labels, label, ~held_out(F.col(key), folds, fold), key, text, per_label)
    shared = docs.sparkSession.sparkContext.broadcast(voter)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model, out = shared.value, []
        for lo in range(0, len(texts), BLOCK):
            counts = np.array([term_counts(t) for t in texts.iloc[lo:lo + BLOCK]], np.float32)
            out.append(model.scores(counts, neighbours))
        return pd.Series(np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0))

    score = score.asNondeterministic()  # keeps a later filter from computing it twice
    scored = docs.withColumn("held_out", held_out(F.col(key), folds, fold)).withColumn("score", score(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
