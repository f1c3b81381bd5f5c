"""Language ID with a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, the
maximum over a window is pooled and a softmax layer names the language. A document's
score is the mean of its windows' probabilities, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townhall.llm.common import free_name, rest

WINDOW = 256  # bytes; windows overlap by the widest filter less one
WIDTHS = (2, 3, 4)
FILTERS = 12  # per width
EMBED = 8
SAMPLE = 400  # labelled documents per language at most
PER_DOC = 8  # training windows of one document at most
EPOCHS = 4  # passes over the training windows at least
STEPS = 800  # batches at least
BATCH = 64
CHUNK = 128  # windows scored at a time
UNKNOWN = "und"


@dataclass
class Network:
    """Learned weights; ``names`` are the languages in code point order."""

    names: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset: what each byte adds to each filter."""
        return [[np.ascontiguousarray(self.embed @ w[j]) for j in range(len(w))] for w in self.filters]

    def pooled(self, x: np.ndarray, n: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Windows (rows of bytes, lengths) to pooled features and the places of the maxima."""
        feats, places = [], []
        for table, b in zip(tables, self.bias, strict=True):
            w, span = len(table), x.shape[1] - len(table) + 1
            act = table[0][x[:, :span]]
            for j in range(1, w):
                act += table[j][x[:, j : j + span]]
            short = n < x.shape[1]
            if short.any():
                act[short] = np.where((np.arange(span)[None, :] + w <= n[short, None])[:, :, None], act[short], -np.inf)
            at = act.argmax(axis=1)
            top = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0, :] + b
            feats.append(np.maximum(top, 0))
            places.append(at)
        return np.concatenate(feats, axis=1), np.concatenate(places, axis=1)

    def probabilities(self, x: np.ndarray, n: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        z = self.pooled(x, n, tables)[0] @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut_windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, zero-padded, and their lengths; together they hold every byte string of a filter's width."""
    raw, step = np.frombuffer(text, np.uint8), WINDOW - max(WIDTHS) + 1
    count = max(1, -(-(len(raw) - (WINDOW - step)) // step))
    padded = np.zeros((count - 1) * step + WINDOW, np.uint8)
    padded[: len(raw)] = raw
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]
    return windows, np.minimum(WINDOW, len(raw) - np.arange(count) * step)


def train(x: np.ndarray, n: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> Network:
    """Adam on the cross entropy; every other pass sees windows cut to random lengths, so short texts are learned too."""
    rng = np.random.default_rng(seed)
    net = Network(
        names, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    params = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(max(EPOCHS, -(-STEPS // -(-len(x) // BATCH)))):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            pick = order[k : k + BATCH]
            xb, yb, nb = x[pick], y[pick], n[pick]
            if epoch % 2:
                nb = np.minimum(nb, rng.integers(12, WINDOW + 1, len(nb)))
            grads = _gradients(net, xb, nb, yb)
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    feats, places = net.pooled(x, n, net.tables())
    z = feats @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    d_feats = (p @ net.out.T) * (feats > 0)
    d_embed, d_filters, d_bias = np.zeros_like(net.embed), [], []
    rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
    for i, w in enumerate(WIDTHS):
        d, at = d_feats[:, i * FILTERS : (i + 1) * FILTERS], places[:, i * FILTERS : (i + 1) * FILTERS]
        dw = np.zeros_like(net.filters[i])
        for j in range(w):
            # Only the byte under the maximum has a gradient.
            table = np.zeros((256, FILTERS), np.float32)
            np.add.at(table, (x[rows, at + j], np.broadcast_to(cols, at.shape)), d)
            dw[j] = net.embed.T @ table
            d_embed += table @ net.filters[i][j].T
        d_filters.append(dw)
        d_bias.append(d.sum(axis=0))
    return [d_embed, *d_filters, *d_bias, feats.T @ p, p.sum(axis=0)]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, learn: Column) -> Network | None:
    """Train on at most 400 documents per language, the first by a hash of their id, and 8 windows of each.

    Only rows where ``learn`` holds and lang is not null count. None when there are none.
    """
    c = F.col
    usable = docs.filter(learn & c("lang").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    first = usable.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).filter(c("rn") <= SAMPLE)
    # At most SAMPLE rows per language.
    chosen = docs.select("doc_id", "lang", "text").join(F.broadcast(first.select(c("doc_id").alias("_pick"), c("lang").alias("_pick_lang"))), c("doc_id").eqNullSafe(c("_pick")) & (c("lang") == c("_pick_lang")), "left_semi")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, lang, text in zip(b["h"].to_pylist(), b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                x, n = cut_windows(text)
                for k in np.unique(np.linspace(0, len(x) - 1, PER_DOC).astype(int)):
                    out.append((h, int(k), lang, x[k, : n[k]].tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("h", "k", "lang", "part"), r, strict=True)) for r in out], schema=pa.schema([("h", pa.int64()), ("k", pa.int32()), ("lang", pa.string()), ("part", pa.binary())]))

    sample = chosen.filter(has_letter(c("text"))).select(F.xxhash64("doc_id").alias("h"), "lang", c("text").cast("binary").alias("text"))
    rows = sorted(tuple(r) for r in sample.mapInArrow(windows, "h long, k int, lang string, part binary").collect())
    if not rows:
        return None
    names = sorted({r[2] for r in rows})
    x, n = np.zeros((len(rows), WINDOW), np.uint8), np.array([len(r[3]) for r in rows])
    for i, r in enumerate(rows):
        x[i, : n[i]] = np.frombuffer(r[3], np.uint8)
    return train(x, n, np.array([names.index(r[2]) for r in rows]), names)


def predict(texts: list[bytes | None], net: Network | None) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts; None stands for a text without letters."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if net is None:
        return names, scores
    tables = net.tables()
    total, weight = np.zeros((len(texts), len(net.names))), np.zeros(len(texts))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    count = 0

    def score() -> None:
        x, n = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        doc = np.repeat([h[0] for h in held], [len(h[2]) for h in held])
        for k in range(0, len(x), CHUNK):
            p = net.probabilities(x[k : k + CHUNK], n[k : k + CHUNK], tables)
            np.add.at(total, doc[k : k + CHUNK], p * n[k : k + CHUNK, None])
            np.add.at(weight, doc[k : k + CHUNK], n[k : k + CHUNK])

    for i, text in enumerate(texts):
        if text:
            held.append((i, *cut_windows(text)))
            count += len(held[-1][2])
            if count >= 8 * CHUNK:
                score()
                held, count = [], 0
    if held:
        score()
    best = total.argmax(axis=1)
    for i in np.flatnonzero(weight > 0):
        names[i], scores[i] = net.names[best[i]], min(1.0, total[i, best[i]] / weight[i])
    return names, scores


def classify(docs: DataFrame, net: Network | None) -> DataFrame:
    """A row per document: doc_id, lang_pred, score (mean probability of the language).

    A text that is null or has no letter gives ``und`` and 0; so does everything if nothing was learned.
    Ids, sources and given languages are not read; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = predict(b["text"].to_pylist(), net)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    text = F.when(has_letter(F.col("text")), F.col("text").cast("binary")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more, with all their columns."""
    # The bytes to look at come last, under a name no column has.
    flagged = docs.select("*", F.when(has_letter(F.col("text")), F.col("text").cast("binary")).alias(free_name(docs, "lang_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = predict(b.column(b.num_columns - 1).to_pylist(), net)
            ok = pa.array((scores >= least) & np.array([x != UNKNOWN for x in names], bool))
            yield pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1])).filter(ok)

    return flagged.mapInArrow(run, docs.schema)


def learnable() -> Column:
    """Documents the registered query may learn from."""
    return rest(F.col("doc_id"), 4) != 2
