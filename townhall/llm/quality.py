"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import rest

BITS = 20
SAMPLE = 6000  # labelled documents at most
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.02, 0.1
_SHAPE = bytes(
    0x58 if 65 <= b <= 90 else 0x78 if 97 <= b <= 122 or b >= 128 else 0x39 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"x+|X{2,}|9+")


def _mix(a: np.ndarray, seed: int) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed * 0xC2B2AE3D27D4EB4F % 2**64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(64 - BITS)


def features(text: bytes | None) -> np.ndarray:
    """Buckets of all one- to three-word n-grams, and of the same over word shapes; repeats stay."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.int64)
    shapes = _RUN.sub(lambda m: m[0][:1], b" ".join(words).translate(_SHAPE)).split(b" ")
    crc, found = zlib.crc32, []
    for seed, tokens in ((1, words), (11, shapes)):
        one = np.fromiter(map(crc, tokens), np.uint64, len(tokens))
        two = one[:-1] * np.uint64(0x100000001B3) + one[1:]
        three = two[:-1] * np.uint64(0x100000001B3) + one[2:]
        found += [_mix(g, seed + k) for k, g in enumerate((one, two, three))]
    return np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    """Weights of the buckets and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, x: np.ndarray) -> float:
        """The probability of label 1: a sparse dot product, counts scaled by the root of their sum."""
        z = self.intercept + (float(self.weights[x].sum()) / np.sqrt(len(x)) if len(x) else 0.0)
        return float(1 / (1 + np.exp(-min(35.0, max(-35.0, z)))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """FTRL-proximal with a learning rate per bucket; rows are (buckets, scaled counts, label)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == size, 0.0, L1)  # the intercept is not shrunk
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for idx, val, label in rows:
            i, x = np.append(idx, size), np.append(val, 1.0)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    every = weight(np.arange(size + 1))
    return Model(every[:size].astype(np.float32), float(every[size]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model | None:
    """Learn from at most 6000 labelled documents, the first by a hash of their id. None when there are none.

    ``learn`` is a condition on doc_id. Features are made on the executors; the driver gets sparse rows.
    """
    c = F.col
    known = labels.filter(learn & c("quality").isNotNull() & c("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    first = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE).select(c("doc_id").alias("_pick"), "h", "y")
    # At most SAMPLE rows.
    chosen = docs.select("doc_id", "text").join(F.broadcast(first), c("doc_id") == c("_pick")).select("h", "y", c("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, y, text in zip(b["h"].to_pylist(), b["y"].to_pylist(), b["text"].to_pylist(), strict=True):
                x, count = np.unique(features(text), return_counts=True)
                out.append({"h": h, "y": int(y), "idx": x.astype(np.int32).tobytes(), "val": (count / np.sqrt(max(1, count.sum()))).astype(np.float32).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("h", pa.int64()), ("y", pa.int32()), ("idx", pa.binary()), ("val", pa.binary())]))

    rows = sorted(tuple(r) for r in chosen.mapInArrow(run, "h long, y int, idx binary, val binary").collect())
    if not rows:
        return None
    return train([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), int(y > 0)) for _, y, i, v in rows])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """A row per document: doc_id, score (probability of label 1), predicted.

    Whole texts are read; null and empty texts get the intercept's probability, everything 0.5 if
    nothing was learned. Repeated rows give repeated rows; no other column is an input.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2^20 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.array([m.score(features(t)) if m else 0.5 for t in b["text"].to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def learnable() -> Column:
    """Rows the registered query may learn from."""
    return rest(F.col("doc_id"), 3) != 1
