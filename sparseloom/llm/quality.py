"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Features are hashed byte trigrams of the whole text (damped counts, weighted by their rarity
among the labelled rows, scaled to unit length) and, as one more feature beside them, the share of words that
repeat the word before. A truncated SVD of the labelled rows gives the latent space. The
labelled rows' unit vectors, at most SAMPLE of them, are broadcast: their size is bounded by
SAMPLE x RANK numbers and FEATURES x RANK for the projection, whatever the corpus. Every
document's cosines with all of them are computed exactly, a block of documents at a time; the NEAREST vote,
each weighted by a power of its similarity.

The sample is the documented bound on what the classifier is fitted on: the SAMPLE labelled
training rows with the least hash of their id. All else covers all data.

Cases: null and empty texts have no features, and take the training rows' mean label as their score;
so do all texts when there are no labels (0.5 without any); a document that is labelled twice counts
once, with its larger label; null labels and null ids are not learned from; repeated rows are
scored each; of neighbours with equal cosines at the edge any may vote; a very long text is read whole, in chunks;
an empty table gives no rows; other columns are passed over or through, whatever their names.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, map_batches, texts, with_locator

SAMPLE, FEATURES, RANK, NEAREST, POWER, BLOCK = 4096, 4096, 32, 25, 4, 256
#: The length that a text of nothing but repeats gets beside the trigrams' unit length; and the scale of that feature.
REPEATS, SCALE = 1.5, 60000
THRESHOLD = 0.7
#: Odd multipliers that mix the three bytes of a trigram.
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
SHIFT = 32 - FEATURES.bit_length() + 1


def held_out(id_col: Column, of: int, rest: int) -> Column:
    """Whether crc32 of the id, as text, leaves ``rest`` modulo ``of`` (null ids: false)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % of == rest, F.lit(False))


def features(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams, of the padded text where it is shorter than one; last, SCALE times the share of repeats."""
    counts = np.zeros(FEATURES + 1, np.int64)
    if not text:
        return counts
    words = text.lower().split()
    if len(words) > 1:
        counts[FEATURES] = SCALE * sum(map(operator.eq, words, words[1:])) // (len(words) - 1)
    b = np.frombuffer(text.ljust(3, b"\0"), np.uint8)
    # Chunks overlap by two bytes, so that long texts need little memory and lose no trigram.
    for at in range(0, len(b) - 2, 1 << 16):
        c = b[at : at + (1 << 16) + 2].astype(np.uint32)
        h = (c[:-2] * MIX[0] ^ c[1:-1] * MIX[1] ^ c[2:] * MIX[2]) * MIX[3] >> np.uint32(SHIFT)
        counts[:FEATURES] += np.bincount(h, minlength=FEATURES)
    return counts


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Feature vectors of count vectors."""
    x = np.empty(counts.shape, np.float32)
    x[:, :FEATURES] = unit(np.log1p(counts[:, :FEATURES]).astype(np.float32) * weight)
    x[:, FEATURES] = REPEATS * np.sqrt(counts[:, FEATURES] / SCALE)
    return x


@dataclass
class Voters:
    weight: np.ndarray  # of each feature
    basis: np.ndarray  # FEATURES + 1 x rank
    vectors: np.ndarray  # labelled rows x rank, unit length
    labels: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.weight) @ self.basis)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        near = min(NEAREST, len(self.labels))
        if not near:
            return out
        for at in range(0, len(counts), BLOCK):
            latent = self.latent(counts[at : at + BLOCK])
            cosines = latent @ self.vectors.T
            # Of equal cosines at the edge, any may vote: they are as near.
            top = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
            votes = np.maximum(np.take_along_axis(cosines, top, 1), 0).astype(np.float64) ** POWER
            total = votes.sum(axis=1)
            score = np.divide((votes * self.labels[top]).sum(axis=1), total, out=np.full(len(total), self.prior), where=total > 0)
            out[at : at + BLOCK] = np.clip(score, 0, 1)
        return out


def latent_space(x: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 10, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank], np.float32)


def fit(counts: np.ndarray, labels: np.ndarray) -> Voters:
    n = len(labels)
    prior = float(labels.mean()) if n else 0.5
    weight = (np.log((1 + n) / (1 + (counts[:, :FEATURES] > 0).sum(axis=0))) + 1).astype(np.float32)
    basis = latent_space(weighted(counts, weight)) if n else np.zeros((FEATURES + 1, 1), np.float32)
    voters = Voters(weight, basis, np.zeros((0, basis.shape[1]), np.float32), labels, prior)
    voters.vectors = voters.latent(counts) if n else voters.vectors
    return voters


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of at most SAMPLE rows, on the driver."""
    ids = F.col(id_col)
    rows = labels.filter(ids.isNotNull() & F.col(label_col).isNotNull() & (F.lit(True) if train is None else train))
    picked = rows.groupBy(ids.alias("_sl_id")).agg(F.max(label_col).cast("double").alias("_sl_label")).orderBy(F.xxhash64("_sl_id"), "_sl_id").limit(SAMPLE)
    wanted = docs.select(ids.alias("_sl_i"), F.col(text_col).alias("_sl_text")).join(F.broadcast(picked), F.col("_sl_i") == F.col("_sl_id")).select("_sl_id", "_sl_label", "_sl_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Whole counts, most of them zero, so that a labelled text has the features that it is scored by.
            packed = [zlib.compress(features(t).astype("<i8").tobytes(), 1) for t in texts(b["_sl_text"])]
            yield pa.RecordBatch.from_arrays([b["_sl_id"], b["_sl_label"], pa.array(packed, pa.binary())], names=["id", "label", "counts"])

    kind = wanted.schema["_sl_id"].dataType.simpleString()
    # Ids may repeat among documents: one row each, so that SAMPLE bounds the rows as well.
    found = map_batches(wanted, work, f"id {kind}, label double, counts binary").groupBy("id").agg(F.max(F.struct("counts", "label")).alias("x")).select("id", "x.*").orderBy("id").collect()
    counts = np.zeros((len(found), FEATURES + 1), np.float32)
    for i, r in enumerate(found):
        counts[i] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return counts, np.array([r["label"] for r in found], np.float64)


def scored(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_sl_id, FILE, ROW, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    read = with_locator(docs, [F.col(id_col).alias("_sl_id"), F.col(text_col).alias("_sl_text")])
    schema = read.drop("_sl_text").withColumn("score", F.lit(0.0)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = texts(b["_sl_text"])
            score = np.concatenate([shared.value.score(np.array([features(t) for t in found[i : i + BLOCK]], np.float32)) for i in range(0, len(found), BLOCK)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b["_sl_id"], b[FILE], b[ROW], pa.array(score, pa.float64())], names=["_sl_id", FILE, ROW, "score"])

    return map_batches(read, work, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query's columns: learned from labels outside the fold, scored everywhere."""
    held = held_out(F.col("doc_id"), 4, 2)
    voters = fit(*labelled_features(docs, labels, "doc_id", "text", "quality", ~held))
    rows = scored(docs, voters).withColumnRenamed("_sl_id", "doc_id")
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that the classifier rejects, all columns kept; learned as quality_scores() does."""
    held = held_out(F.col(id_col), 4, 2)
    voters = fit(*labelled_features(docs, labels, id_col, text_col, "quality", ~held))
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    read = docs.select(*docs.columns)
    text_at = read.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = texts(b.column(text_at))
            for i in range(0, len(found), BLOCK):
                score = shared.value.score(np.array([features(t) for t in found[i : i + BLOCK]], np.float32))
                yield b.slice(i, len(score)).filter(pa.array(score >= threshold))

    return map_batches(read, work, read.schema)
