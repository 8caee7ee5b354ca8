"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of two kinds of terms: its hashed byte trigrams, and pairs of recency codes, which say of each of two
words in a row how long ago it was last seen (never, or the power of two of the distance). Counts are damped and weighted
by inverse document frequency, and each kind is normalised. A truncated singular value decomposition of a bounded labelled
sample turns them into DIMENSIONS latent-semantic coordinates. The sample's vectors and labels are broadcast (VOTERS x
DIMENSIONS numbers at most), every document gets exact cosines to all of them in blocks, and its NEIGHBOURS nearest vote
with their similarity as weight.

The sample takes about VOTERS / 2 labelled documents of each class at most, whole texts, by a hash of their ids; votes are
weighted back to the classes' shares.

Nulls: a null or empty text has no direction and scores the share of good documents. Unlabelled documents and null
labels are not learned from; with one class only, every score is that class. Repeated rows count repeatedly. Of
neighbours that tie for the last place any may vote. Very long texts are counted whole, in stretches. Empty tables give
no rows. score() keeps all columns and adds _score, with underscores after it where the documents have such a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fresh, held_out, sample_hash, with_labels

VOTERS = 4096
DIMENSIONS = 64
BUCKETS = 4096
NEIGHBOURS = 15
#: Recency codes of a word: 0 for a new one, else 1 + log2 of the distance, and the weight of their pairs beside trigrams.
CODES = 16
RECENCY_WEIGHT = 0.5
THRESHOLD = 0.7
_STEP = 1 << 20


def recency_codes(words: list[str]) -> np.ndarray:
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    code = np.zeros(len(ids), dtype=np.int64)
    code[order[1:][again]] = np.minimum(1 + np.log2(order[1:][again] - order[:-1][again]).astype(np.int64), CODES - 1)
    return code


def term_counts(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams of a whole text, then of pairs of its recency codes."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros(BUCKETS + CODES * CODES, dtype=np.float32)
    for at in range(0, max(0, len(data) - 2), _STEP):
        part = data[at : at + _STEP + 2].astype(np.uint32)
        key = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)
        out[:BUCKETS] += np.bincount(key >> np.uint32(20), minlength=BUCKETS).astype(np.float32)
    code = recency_codes((text or "").lower().split())
    out[BUCKETS:] = np.bincount(code[:-1] * CODES + code[1:], minlength=CODES * CODES)
    return out


def _pack(counts: np.ndarray) -> bytes:
    """The buckets that aren't empty, then their counts."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes()


def _unpack(data: bytes, into: np.ndarray) -> None:
    n = len(data) // 6
    into[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)


def _direction(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _principal(x: np.ndarray, k: int, spare: int = 16, rounds: int = 5) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a fixed random start."""
    q = np.linalg.qr(x.T @ np.random.default_rng(11).normal(size=(len(x), min(k + spare, *x.shape))).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt[: min(k, int((s > 1e-6).sum()))].T).astype(np.float32)


class Voters:
    def __init__(self, counts: np.ndarray, labels: np.ndarray, shares: np.ndarray):
        seen = (counts > 0).sum(0)
        self.idf = np.log((len(counts) + 1) / (seen + 1)).astype(np.float32) + 0.1
        x = self.weigh(counts)
        self.project = _principal(x, DIMENSIONS)
        self.vectors = _direction(x @ self.project)
        self.labels = labels.astype(np.float32)
        mean = max(1e-9, float(labels.mean())), max(1e-9, 1 - float(labels.mean()))
        self.weight = np.where(labels > 0, shares[1] / mean[0], shares[0] / mean[1]).astype(np.float32)
        self.share = float(shares[1])

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return np.hstack([_direction(x[:, :BUCKETS]), RECENCY_WEIGHT * _direction(x[:, BUCKETS:])])

    def vote(self, texts: list) -> np.ndarray:
        counts = np.stack([term_counts(t) for t in texts])
        x = _direction(self.weigh(counts) @ self.project)
        cosine = x @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        near = np.clip(np.take_along_axis(cosine, at, 1), 0, None) * self.weight[at]
        total = near.sum(1)
        score = (near * self.labels[at]).sum(1) / np.where(total > 0, total, 1)
        return np.where(total > 0, score, self.share)


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Voters | float:
    rows = with_labels(docs.select("doc_id", "text").where(~held_out()), labels.select("doc_id", column), column)
    rows = rows.where(F.length("text") > 0).withColumn("_label", (F.col("_label") > 0).cast("int"))
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0))
    spread = 1 << 30
    cut = F.when(F.col("_label") == 1, F.lit(min(spread, spread * VOTERS // 2 // counts[1]))).otherwise(F.lit(min(spread, spread * VOTERS // 2 // counts[0])))

    @arrow_udf("binary")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_pack(term_counts(t.as_py())) for t in batch], pa.binary())

    some = rows.where(F.pmod(sample_hash(), F.lit(spread)) < cut).select("_label", F.col("text").cast("string").alias("t")).limit(VOTERS + VOTERS // 4)
    found = some.select("_label", counted("t").alias("x")).toArrow()
    if not found.num_rows:
        return float(counts[1] / (counts[0] + counts[1]))
    x = np.zeros((found.num_rows, BUCKETS + CODES * CODES), dtype=np.float32)
    for row, data in zip(x, found["x"], strict=True):
        _unpack(data.as_py(), row)
    y = found["_label"].to_numpy()
    total = counts[0] + counts[1]
    return Voters(x, y, np.array([counts[0] / total, counts[1] / total]))


def score(docs: DataFrame, learned: Voters | float) -> DataFrame:
    """The documents with a column _score."""
    if isinstance(learned, float):
        return docs.select("*", F.lit(learned).alias(fresh(docs, "_score")))
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voters: Voters = sent.value
        for batch in batches:
            out = [voters.vote(batch.slice(at, 256).to_pylist()) for at in range(0, len(batch), 256)]
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.select("*", run.asNondeterministic()(F.col("text").cast("string")).alias(fresh(docs, "_score")))


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
