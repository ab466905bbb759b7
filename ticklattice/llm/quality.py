"""Operator 5, quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklattice.llm._util import held_out, map_text

#: Hashed features of a text: byte trigrams reduced to kinds of character, and byte bigrams.
SHAPES, PAIRS = 2048, 2048
#: Steps in which the shares of repeated words and lines are told apart.
STEPS = 8
SIZE = SHAPES + PAIRS + 2 * STEPS
_KIND = np.zeros(256, np.uint32)
_KIND[:] = np.arange(256)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4


def features(text: str) -> np.ndarray:
    """Features of the whole text: hashed counts, SHAPES then PAIRS, each as log(1 + count) of unit length (a text of fewer
    than three bytes has none), then the steps of the shares of words that repeat the one before and of repeated lines."""
    out = np.zeros(SIZE, np.float32)
    data = text.encode()
    words, lines = data.split(), data.split(b"\n")
    again = sum(map(eq, words, words[1:])) / max(len(words), 1)
    twice = 1 - len(set(lines)) / len(lines)
    for at, x in ((SHAPES + PAIRS, again), (SHAPES + PAIRS + STEPS, twice)):
        out[at + min(STEPS - 1, int(x * STEPS * 2))] = 0.5
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < 3:
        return out
    a = _KIND[raw]
    h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
    shapes = np.bincount(((h ^ (h >> 15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(21), minlength=SHAPES)
    b = raw.astype(np.uint32)
    pairs = np.bincount(((b[:-1] * np.uint32(256) + b[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=PAIRS)
    for at, x in ((0, shapes), (SHAPES, pairs)):
        v = np.log1p(x)
        out[at : at + len(x)] = v / np.sqrt((v * v).sum())
    return out


@dataclass
class QualityModel:
    """Inverse document weights, the latent basis (features x rank), the labelled vectors (rows of unit length), labels."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weights) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, texts: Sequence[str], block: int = 256) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each voting by its cosine to a high power, with one vote
        of the labels' mean; exact products with every labelled vector, a block of texts at a time."""
        out = np.full(len(texts), self.prior)
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(texts) if k else 0, block):
            x = np.stack([features(t) for t in texts[at : at + block]])
            sims = self.project(x) @ self.vectors.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** 8
            out[at : at + block] = ((w * self.labels[near]).sum(1) + 0.1 * self.prior) / (w.sum(1) + 0.1)
        return np.clip(out, 0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int) -> DataFrame:
    """doc_id, text and label of at most `limit` labelled documents whose id is not held out, chosen by a hash of the id; of
    rows that share an id the least text, of its labels the largest.

    The bound makes the ids fit a broadcast whatever the size of labels."""
    ids = (
        labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(~held_out("id") & F.col("id").isNotNull() & F.col("label").isNotNull())
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(limit)
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy(F.col("id").alias("doc_id")).agg(F.min("text").alias("text"), F.first("label").alias("label"))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = 4096, rank: int = 48, neighbours: int = 25) -> QualityModel:
    """Fits on a sample of at most `sample` labelled documents (see labelled_sample): the bound of what is broadcast.

    Copies of an id count once. The latent basis is the truncated singular basis of the weighted feature matrix. Without usable labels every
    score is 0.5.
    """
    rows = map_text(
        labelled_sample(docs, labels, label_col, sample), "text", ["doc_id", "label"], [("x", T.BinaryType())],
        lambda: lambda texts: [[features(t).astype(np.float16).tobytes() for t in texts]],
    ).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.stack([np.frombuffer(r.x, np.float16).astype(np.float32) for r in rows]) if rows else np.zeros((0, SIZE), np.float32)
    y = np.array([r.label for r in rows], np.float64)
    del rows
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    basis = np.zeros((x.shape[1], 1), np.float32)
    if len(x):
        rng = np.random.default_rng(7)
        x *= weights
        q = rng.standard_normal((x.shape[1], min(rank + 8, len(x)))).astype(np.float32)
        for _ in range(4):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        basis = (q @ v.T)[:, :rank].astype(np.float32)
    model = QualityModel(weights, basis, np.zeros((0, 1), np.float32), y, neighbours, float(y.mean()) if len(y) else 0.5)
    if len(x):
        z = x @ basis
        model.vectors = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return model


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """`keep` columns with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold), from whole
    texts alone. Null and empty texts are voted on by the labelled texts without repeated words or lines; repeated rows get
    the same score; an empty table none; without labels every score is 0.5. A kept column named like a result is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = shared.value

        def score(texts: list[str]):
            s = m.score(texts)
            return s.tolist(), (s >= threshold).astype(int).tolist()

        return score

    return map_text(docs, text_col, keep, [("score", T.DoubleType()), ("predicted", T.IntegerType())], factory)
