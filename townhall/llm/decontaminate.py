"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of three words of a test item is a seed, however common. The item is aligned with
the passage around its seeds, so edited and paraphrased copies are found as well. Passages whose longest
common subsequence with the item is below the threshold cannot reach it and are not aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import free_name

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.6  # of the score of a full match
SEGMENT = 400  # words of a long item that are aligned at a time
ITEMS_PER_PASS = 20_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them."""
    return (text or b"").translate(_TABLE).split()


@dataclass
class Seeds:
    """The test items of one pass: word numbers, seeds and where each seed occurs."""

    vocab: dict[bytes, int]
    items: list[tuple[int, np.ndarray]]  # item_id, word numbers of a segment
    codes: np.ndarray  # sorted distinct seeds
    places: list[list[tuple[int, int]]] = field(default_factory=list)  # per seed: (segment, offset)
    short: dict[int, list[int]] = field(default_factory=dict)  # segments below SEED_WORDS words, by first word
    masks: list[dict[int, int]] = field(default_factory=list)  # per segment: the offsets of each word as bits

    def encode(self, text: bytes | None) -> np.ndarray:
        w = words(text)
        get = self.vocab.get
        return np.fromiter((get(x, 0) for x in w), np.int64, len(w))

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and codes of the n-grams whose words all occur in test items."""
        n = len(ids) - SEED_WORDS + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        all_known = known[:n].copy()
        for k in range(1, SEED_WORDS):
            all_known &= known[k : n + k]
        at = np.flatnonzero(all_known)
        code = np.zeros(len(at), np.int64)
        for k in range(SEED_WORDS):
            code = code * (len(self.vocab) + 1) + ids[at + k]
        return at, code

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets in a document and the seeds found there."""
        at, code = self.grams(ids)
        if not len(at) or not len(self.codes):
            return at[:0], code[:0]
        k = np.searchsorted(self.codes, code)
        k[k == len(self.codes)] = 0
        ok = self.codes[k] == code
        return at[ok], k[ok]


def prepare(items: list[tuple[int, bytes]]) -> Seeds:
    vocab: dict[bytes, int] = {}
    segments = []
    for item_id, text in items:
        w = words(text)
        ids = np.array([vocab.setdefault(x, len(vocab) + 1) for x in w], np.int64)
        pieces = max(1, -(-len(w) // SEGMENT))
        segments += [(item_id, part) for part in np.array_split(ids, pieces) if len(part)]
    if (len(vocab) + 1) ** SEED_WORDS >= 2**63:
        raise ValueError("too many different words in one pass; lower ITEMS_PER_PASS")
    seeds = Seeds(vocab, segments, np.zeros(0, np.int64))
    where: dict[int, list[tuple[int, int]]] = {}
    for s, (_, ids) in enumerate(segments):
        mask: dict[int, int] = {}
        for at, w in enumerate(ids.tolist()):
            mask[w] = mask.get(w, 0) | 1 << at
        seeds.masks.append(mask)
        if len(ids) < SEED_WORDS:
            seeds.short.setdefault(int(ids[0]), []).append(s)
        for at, code in zip(*seeds.grams(ids), strict=True):
            where.setdefault(int(code), []).append((s, int(at)))
    seeds.codes = np.array(sorted(where), np.int64)
    seeds.places = [where[int(k)] for k in seeds.codes]
    return seeds


def _can_reach(masks: dict[int, int], m: int, words: list[int]) -> bool:
    """Whether the longest common subsequence lets a score reach the threshold: it has all matches of any alignment."""
    full = (1 << m) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count() >= THRESHOLD * m - 1e-9


def promising(masks: dict[int, int], m: int, passage: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of a passage outside of which no alignment reaches the threshold.

    Such an alignment has at most m matches and, at a point each, at most (2 - 1.2) m gaps and
    mismatches: it covers 1.8 m words, so it lies in one of the windows of twice that length.
    """
    words = passage.tolist()
    step = int((MATCH + 1 - MATCH * THRESHOLD) * m) + 2
    held = None
    for at in range(0, max(1, len(words) - step), step):
        if _can_reach(masks, m, words[at : at + 2 * step]):
            if held and at <= held[1]:
                held = held[0], min(len(words), at + 2 * step)
            else:
                if held:
                    yield held
                held = at, min(len(words), at + 2 * step)
    if held:
        yield held


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score of the best local alignment and the end of it in the passage, a row per item word."""
    n = len(passage)
    ramp = -GAP * np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP)
        # A gap in the item costs the same per word: a running maximum finds the best start of it.
        new = np.maximum.accumulate(np.maximum(new, 0) + ramp) - ramp
        row = new
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def find(seeds: Seeds, text: bytes | None) -> list[tuple[int, float, int, int]]:
    """Test items in a text: (item_id, score, first word, last word + 1), the best place of each."""
    ids = seeds.encode(text)
    at, which = seeds.hits(ids)
    spots: dict[int, list[int]] = {}
    for pos, k in zip(at.tolist(), which.tolist(), strict=True):
        for s, offset in seeds.places[k]:
            spots.setdefault(s, []).append(pos - offset)
    if seeds.short:
        for pos in np.flatnonzero(np.isin(ids, list(seeds.short))).tolist():
            for s in seeds.short[int(ids[pos])]:
                spots.setdefault(s, []).append(pos)
    best: dict[int, tuple[float, int, int]] = {}
    for s, starts in spots.items():
        item_id, item = seeds.items[s]
        m = len(item)
        slack = m // 2 + 2
        starts.sort()
        k = 0
        while k < len(starts):
            lo = hi = starts[k]
            while k < len(starts) and starts[k] <= hi + slack:
                hi = starts[k]
                k += 1
            left, right = max(0, lo - slack), min(len(ids), hi + m + slack)
            for lo, hi in promising(seeds.masks[s], m, ids[left:right]):
                passage = ids[left + lo : left + hi]
                score, end = align(item, passage)
                share = score / (MATCH * m)
                if share >= THRESHOLD and share > best.get(item_id, (0.0,))[0]:
                    back = align(item[::-1], passage[:end][::-1])[1]
                    best[item_id] = (share, left + lo + end - back, left + lo + end)
    return [(i, *v) for i, v in sorted(best.items())]


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The test items, block by block; the driver holds one block at a time."""
    c = F.col
    items = benchmark.filter(c("item_id").isNotNull() & c("text").isNotNull()).select(c("item_id").cast("long").alias("item_id"), c("text").cast("binary").alias("text")).distinct()
    blocks = max(1, -(-items.count() // ITEMS_PER_PASS))
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        yield sorted((r["item_id"], bytes(r["text"])) for r in block.collect())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of every document that holds a test item.

    Score is the alignment's share of a full match, 0.6 or more. Of several places of an item in a
    document the best is given (ties: the first). Items or texts that are null or have no word match nothing;
    items of one or two words are looked up by their first word. Repeated documents give repeated rows, repeated
    items one. The benchmark is read in blocks of 20000 items, each a pass over all documents; no document is shuffled.
    """
    c = F.col
    thin = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("binary").alias("text"))
    out = None
    for items in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(prepare(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) for hit in find(shared.value, t)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

        part = thin.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    for items in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(prepare(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = pa.array([not find(shared.value, t) for t in b.column(b.num_columns - 1).to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1])).filter(ok)

        docs = docs.select("*", F.col("text").cast("binary").alias(free_name(docs, "leak_text"))).mapInArrow(run, docs.schema)
    return docs
