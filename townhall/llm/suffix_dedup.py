"""Removal of long repeated byte strings by bucket-pointer refinement.

A suffix matters only by its first 400 bytes. Its initial bucket is a q-gram of 128 bytes: of
those inside the 400 the one with the smallest hash (the first of equals), so that equal strings share the
bucket and the place in it, and few q-grams stand for all suffixes. Buckets with one member are done.
The others are refined: members are told apart by hashes of all bytes that their suffixes cover before and
behind the q-gram, first for all suffixes of a member at once, then for blocks of 16, then one by one.
These content hashes of 128 bits stand in for bucket identifiers of later offsets. What a step decides
(all repeated, or none) is used and not looked at again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import row_key, settle

LENGTH = 400
GRAM = 128
BLOCK = 16
SEGMENT = 1 << 20  # suffixes of a text that are worked on at a time
KEYS = ("inter", "un1", "un2")
MEMBER = "doc_id long, row_key long, a long, lo long, hi long, inter long, un1 long, un2 long"
_U = np.uint64


def _spread(n: int, seed: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(31))


class _Hash:
    """Polynomial hashes of byte ranges, modulo 2^64: a sum of powers, made independent of the place."""

    def __init__(self, factor: int, seed: int, size: int):
        self.values = _spread(256, seed)
        self.power, self.inverse = (
            np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, f, _U)])) for f in (factor, pow(factor, -1, 1 << 64)))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, _U)
        np.cumsum(self.values[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (sums[hi] - sums[lo]) * self.inverse[lo]


_made: list[_Hash] = []


def _hashes() -> list[_Hash]:
    if not _made:
        _made.extend(_Hash(f, s, SEGMENT + LENGTH) for f, s in ((0x9E3779B97F4A7C15, 1), (0xD1342543DE82EF95, 2)))
    return _made


def _mixed(h: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    """A last stir, so that identifiers of different lengths do not mix."""
    h = (h + np.asarray(more).astype(_U) * _U(0xA24BAED4963EE407)) ^ _U(0x5851F42D4C957F2D)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def members(raw: np.ndarray, unions: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of suffixes with the same q-gram: (a, lo, hi, inter, un1, un2), segment by segment.

    ``a`` is the place of the q-gram, lo to hi are the suffixes; inter names the bytes all of them share
    (the q-gram), un1 and un2 all bytes they cover together.
    """
    first, second = _hashes()
    window = LENGTH - GRAM + 1
    for base in range(0, len(raw) - LENGTH + 1, SEGMENT):
        part = raw[base : base + SEGMENT + LENGTH - 1]
        sums = first.sums(part)
        gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * first.inverse[: len(part) - GRAM + 1], GRAM)
        low = _U((1 << 31) - 1)
        best = (gram & ~low) | np.arange(len(gram), dtype=_U)
        width = 1
        while 2 * width <= window:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        best = np.minimum(best[: len(best) - (window - width)], best[window - width :])
        at = (best & low).astype(np.int64)
        lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        hi = np.append(lo[1:], len(at)) - 1
        a = at[lo]
        if not unions:
            yield (gram[a],)
            continue
        un1 = _mixed(first.of(sums, lo, hi + LENGTH), hi - lo)
        un2 = _mixed(second.of(second.sums(part), lo, hi + LENGTH), hi - lo)
        yield a + base, lo + base, hi + base, gram[a], un1, un2


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x, pa.int64())


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(x) for x in columns.values()], list(columns))


def _ids(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b[name].to_numpy(zero_copy_only=False).astype(np.int64)


def _initial(rows: DataFrame) -> DataFrame:
    """The members of all texts whose q-gram occurs more than once."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x[0] for t in b["text"].to_pylist() if len(t) >= LENGTH for x in members(np.frombuffer(t, np.uint8), False)]
            keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, _U), np.zeros(0, np.int64))
            yield _batch({"inter": keys, "n": n.astype(np.int64)})

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, count, docs = [], [], []
            for k, t in enumerate(b["text"].to_pylist()):
                if len(t) >= LENGTH:
                    for x in members(np.frombuffer(t, np.uint8), True):
                        found.append(x)
                        count.append(len(x[0]))
                        docs.append(k)
            if not found:
                continue
            of = np.repeat(np.array(docs), count)
            cols = [np.concatenate(x) for x in zip(*found, strict=True)]
            ids = b["doc_id"].take(pa.array(of))
            yield pa.RecordBatch.from_arrays(
                [ids, _signed(_ids(b, "row_key")[of]), *map(_signed, cols)], ["doc_id", "row_key", "a", "lo", "hi", *KEYS])

    repeated = settle(rows.select("text").mapInArrow(grams, "inter long, n long").groupBy("inter").agg(F.sum("n").alias("n")).filter("n > 1").select("inter"))
    return settle(rows.mapInArrow(full, MEMBER).join(repeated, "inter", "left_semi").select("doc_id", "row_key", "a", "lo", "hi", *KEYS))


def _refine(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step: decided runs of suffixes (doc_id, row_key, lo, hi) and the members that are left.

    ``found`` has members with ``want`` (whether their answer is asked for) and ``weight``. Members with the same
    union are one class. A class of two or more is repeated as a whole. A single one is left if its
    bucket has others; one member stands for each repeated class of such a bucket, with weight 2.
    """
    c = F.col
    classes = settle(found.groupBy(*KEYS).agg(F.sum("weight").alias("w"), *[F.first(x).alias(x) for x in ("doc_id", "row_key", "a", "lo", "hi")]))
    open_ = classes.groupBy("inter").agg(F.sum("w").alias("n"), F.min("w").alias("least")).filter("n > 1 AND least = 1").select("inter")
    left = classes.join(settle(open_), "inter", "left_semi").select("doc_id", "row_key", "a", "lo", "hi", (c("w") == 1).alias("want"), F.least("w", F.lit(2)).alias("weight"))
    whole = settle(classes.filter("w > 1").select("un1", "un2"))
    decided = found.filter("want").join(whole, ["un1", "un2"], "left_semi").select("doc_id", "row_key", "lo", "hi")
    return settle(decided), settle(left)


def _contexts(rows: DataFrame, left: DataFrame) -> DataFrame:
    """The members that are left with the bytes their suffixes cover."""
    c = F.col
    per_text = left.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("a", "lo", "hi", "want", "weight")).alias("runs"))
    per_text = settle(per_text.select(c("doc_id").alias("_d"), c("row_key").alias("_k"), "runs"))
    # One row per text; copies of a row that is repeated in full give the same members.
    joined = rows.join(per_text, c("doc_id").eqNullSafe(c("_d")) & (c("row_key") == c("_k"))).select("doc_id", "row_key", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("a", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("want", pa.bool_()), ("weight", pa.int64()), ("bytes", pa.binary())])
        for b in batches:
            out = [(d, k, r["a"], r["lo"], r["hi"], r["want"], r["weight"], t[r["lo"] : r["hi"] + LENGTH]) for d, k, t, runs in zip(*(b[x].to_pylist() for x in ("doc_id", "row_key", "text", "runs")), strict=True) for r in runs]
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out[k : k + 20_000], strict=True), schema, strict=True)], schema=schema)

    made = joined.mapInArrow(run, "doc_id long, row_key long, a long, lo long, hi long, want boolean, weight long, bytes binary")
    return settle(made.dropDuplicates(["doc_id", "row_key", "a", "lo"]))


def _smaller(context: DataFrame, size: int) -> DataFrame:
    """Members of at most ``size`` suffixes each: those whose offset to the q-gram falls into one block.

    ``context`` has the runs to cut (lo, hi), the bytes and where these begin (start).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _hashes()
        for b in batches:
            texts = b["bytes"].to_pylist()
            lengths = np.array([len(t) for t in texts], np.int64)
            a, lo, hi, start = (_ids(b, x) for x in ("a", "lo", "hi", "start"))
            k = 0
            while k < len(texts):
                n = max(1, int(np.searchsorted(np.cumsum(lengths[k:]), SEGMENT, side="right")))
                part = slice(k, k + n)
                base = np.cumsum(lengths[part]) - lengths[part] - start[part]  # place of a text's byte 0 in what is joined
                top, low = (a[part] - lo[part]) // size, (a[part] - hi[part]) // size
                count = top - low + 1
                of = np.repeat(np.arange(n), count)
                block = low[of] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = a[part][of]
                p_lo, p_hi = np.maximum(lo[part][of], at - block * size - size + 1), np.minimum(hi[part][of], at - block * size)
                raw = np.frombuffer(b"".join(texts[k : k + n]), np.uint8)
                s1, s2 = first.sums(raw), second.sums(raw)
                shift = base[of]
                # What all suffixes of an unclipped block share lies inside each of them.
                inter = _mixed(first.of(s1, at - block * size + shift, at - block * size - size + 1 + LENGTH + shift), size)
                un1 = _mixed(first.of(s1, p_lo + shift, p_hi + LENGTH + shift), p_hi - p_lo)
                un2 = _mixed(second.of(s2, p_lo + shift, p_hi + LENGTH + shift), p_hi - p_lo)
                take = pa.array(of + k)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(take), b["row_key"].take(take), *map(_signed, (at, p_lo, p_hi, inter, un1, un2)), b["want"].take(take), b["weight"].take(take)],
                    ["doc_id", "row_key", "a", "lo", "hi", *KEYS, "want", "weight"])
                k += n

    return settle(context.select("doc_id", "row_key", "a", "lo", "hi", "start", "want", "weight", "bytes").mapInArrow(run, f"{MEMBER}, want boolean, weight long"))


def repeated_runs(rows: DataFrame) -> DataFrame:
    """doc_id, row_key, lo, hi: the suffixes lo to hi of a text whose first 400 bytes occur elsewhere.

    ``rows`` has doc_id, row_key and text (bytes, not null). Every suffix with that property is in a run. Runs may overlap.
    """
    c = F.col
    first = _initial(rows).withColumns({"want": F.lit(True), "weight": F.lit(1).cast("long")})
    done, left = _refine(first)
    context = _contexts(rows, left)
    done2, left = _refine(_smaller(context.withColumn("start", c("lo")), BLOCK))
    held = context.select(c("doc_id").alias("_d"), c("row_key").alias("_k"), c("a").alias("_a"), c("lo").alias("start"), c("hi").alias("_hi"), "bytes")
    same = c("doc_id").eqNullSafe(c("_d")) & (c("row_key") == c("_k")) & (c("a") == c("_a")) & c("lo").between(c("start"), c("_hi"))
    done3, _ = _refine(_smaller(left.join(held, same), 1))
    return done.unionByName(done2).unionByName(done3)


def remove(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Null and empty texts have no bytes and keep none; texts below 400 bytes stay whole. A text that
    occurs twice is removed in both. Repeated rows count as copies of each other. Spans are maximal runs of removed bytes.
    An empty table gives an empty result.
    """
    c = F.col
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), F.coalesce(c("text").cast("binary"), F.lit(b"")).alias("text"))
    per_text = repeated_runs(rows).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    per_text = settle(per_text.select(c("doc_id").alias("_d"), c("row_key").alias("_k"), "runs"))
    joined = rows.join(per_text, c("doc_id").eqNullSafe(c("_d")) & (c("row_key") == c("_k")), "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, *cut(t, runs)) for d, t, runs in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["runs"].to_pylist(), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def cut(text: bytes, runs: list[dict] | None) -> tuple[int, int, int, str, bytes]:
    """Counts, digest and bytes of a text without what its runs cover."""
    if not runs:
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), text
    lo, hi = np.array([r["lo"] for r in runs]), np.array([r["hi"] for r in runs]) + LENGTH
    edge = np.bincount(lo, minlength=len(text) + 1).astype(np.int64) - np.bincount(hi, minlength=len(text) + 1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept
