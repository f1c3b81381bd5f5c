"""Spelling variants: words one edit apart, found in FM-indexes of the vocabulary, grouped under their frequent form.

A word with one error keeps one of its halves. The search scheme for one error is therefore: match the left half
exactly and go on to the right with one error, or match the right half exactly and go on to the left with one error. Words stand
between delimiters, so each search starts at a delimiter and goes one way; the vocabulary has an index for either direction
(of the words and of their mirror images), and a state is an interval of suffix ranks.

Words meet in blocks that share length and half, as one word can only reach words of these blocks. Blocks are hashed into shards; a shard
that is too large is cut into pieces of words times pieces of searches, so no task holds more than a bounded index.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import settle

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10  # a form is at least this much more frequent
SHARD = 40_000  # words and searches of a task
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def misspell(doc_id: str, word: str) -> str:
    """The word, or if 31 divides the hash of document and word, the word without the letter the hash points at."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 31:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    long_runs = re.compile(f"{RUN.pattern[:-1]}{{{MIN_LENGTH},}}")
    for b in batches:
        found: Counter[str] = Counter()
        for doc, text in zip(b["doc"].to_pylist(), b["text"].to_pylist(), strict=True):
            for w, n in Counter(long_runs.findall(text)).items():
                w = misspell(doc, w.translate(LOWER))
                if len(w) >= MIN_LENGTH:
                    found[w] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of at least MIN_LENGTH letters that occur ``min_count`` times. Counts are combined per task before the shuffle."""
    thin = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return thin.mapInArrow(_count_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Index:
    """An FM-index of words between delimiters, searched from the end of a word to its head.

    Suffixes are compared up to their delimiter, delimiters by the order of their words. The index keeps the positions of every letter of the
    last column in one sorted array, so a step of a search is a binary search: the number of entries below (letter, rank).
    """

    def __init__(self, words: list[str]):
        codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        lengths = np.fromiter(map(len, codes), np.int64, len(codes))
        raw = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        self.letters, inner = np.unique(raw, return_inverse=True)
        self.starts = np.cumsum(lengths + 1) - lengths - 1  # of the words in the text; the delimiter comes behind
        text = np.zeros(len(raw) + len(codes), np.int64)
        text[np.arange(len(raw)) + np.repeat(np.arange(len(codes)), lengths)] = inner + 1
        self.n, self.sigma = len(text), len(self.letters) + 1
        word = np.repeat(np.arange(len(codes)), lengths + 1)
        order = self._sorted(text, word, self.starts + lengths)
        self.suffix = order
        self.word = word
        last = text[order - 1]  # the first word follows the last delimiter
        self.column = np.sort(last * self.n + np.arange(self.n))
        self.last = last
        self.first = np.searchsorted(self.column, np.arange(self.sigma + 1) * self.n)

    @staticmethod
    def _sorted(text: np.ndarray, word: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Suffix order by doubling: ranks by the first letter, then by pairs of ranks 1, 2, 4, ... letters apart."""
        n = len(text)
        stop = ends[word] if n else word
        key = np.where(text == 0, word, text + len(ends))
        rank = np.unique(key, return_inverse=True)[1]
        step = 1
        while n and rank.max() < n - 1:
            at = np.arange(n) + step
            # Behind a delimiter nothing is compared: it has a rank of its own already.
            next_ = np.where(at <= stop, rank[np.minimum(at, n - 1)] + 1, 0)
            rank = np.unique(rank * (n + 1) + next_, return_inverse=True)[1]
            step *= 2
        return np.argsort(rank, kind="stable")

    def back(self, letter: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The rank of the first suffix that is ``letter`` and then a suffix of at least ``rank``."""
        return np.searchsorted(self.column, letter * self.n + rank)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (state, letter) that stand before a suffix of the states' intervals, delimiters left out."""
        wide = hi - lo > self.sigma
        few, many = np.flatnonzero(~wide), np.flatnonzero(wide)
        size = (hi - lo)[few]
        rows = np.repeat(lo[few] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pairs = np.concatenate([np.repeat(few, size) * self.sigma + self.last[rows], np.repeat(many * self.sigma, self.sigma) + np.tile(np.arange(self.sigma), len(many))])
        pairs = np.unique(pairs)
        state, letter = pairs // self.sigma, pairs % self.sigma
        return state[letter > 0], letter[letter > 0]


def one_error(index: Index, patterns: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (pattern, word of the index) one edit apart, with the last ``exact`` letters of the pattern in common; each pair once.

    All patterns go one letter to the left at a time. States without error have one interval per pattern, those with an error one per
    way it was made; a state ends where its interval is empty.
    """
    k = len(patterns)
    codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32)[::-1] for p in patterns]
    lengths = np.fromiter(map(len, codes), np.int64, k)
    raw = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    at = np.searchsorted(index.letters, raw)
    known = np.minimum(at, max(len(index.letters) - 1, 0))
    flat = np.where(index.letters[known] == raw, known + 1, 0) if len(index.letters) else np.zeros(len(raw), np.int64)
    head = np.cumsum(lengths) - lengths
    none = np.zeros(0, np.int64)
    # Letters of the pattern already read, and the interval, of states without and with an error.
    clean = (np.arange(k), np.full(k, index.first[0]), np.full(k, index.first[1])) if index.n else (none, none, none)
    wrong = (none, none, none)
    out = []
    for step in range(int(lengths.max()) + 1 if k else 0):
        q, lo, hi = clean
        live = (step <= lengths[q]) & (lo < hi)
        q, lo, hi = q[live], lo[live], hi[live]
        # A word that ends here with its error made.
        w, wlo, whi = wrong
        done = step == lengths[w]
        out.append(_whole(index, w[done], wlo[done], whi[done]))
        w, wlo, whi = w[~done], wlo[~done], whi[~done]
        late = step >= exact[q]
        s, c = index.branches(lo[late], hi[late])
        bq, blo, bhi = q[late][s], index.back(c, lo[late][s]), index.back(c, hi[late][s])
        # One letter more than the pattern has; the rest of the pattern is still to come.
        ended = lengths[bq] == step
        out.append(_whole(index, bq[ended], blo[ended], bhi[ended]))
        more = (bq[~ended], blo[~ended], bhi[~ended])
        # The pattern's letter is replaced, or missing.
        letter = np.where(step < lengths[bq], flat[np.minimum(head[bq] + step, max(len(flat) - 1, 0))], -1) if len(bq) else none
        other = (letter != c) & (step < lengths[bq])
        left = late & (step < lengths[q])
        w, wlo, whi = (np.concatenate(x) for x in zip((w, wlo, whi), more, strict=True))
        w, wlo, whi = _step(index, flat, head, w, wlo, whi, step)
        wrong = _distinct(index, *(np.concatenate(x) for x in zip((w, wlo, whi), (bq[other], blo[other], bhi[other]), (q[left], lo[left], hi[left]), strict=True)))
        on = step < lengths[q]
        clean = _step(index, flat, head, q[on], lo[on], hi[on], step)
    q, found = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none)
    pairs = np.unique(q * max(len(index.starts), 1) + found)
    return pairs // max(len(index.starts), 1), pairs % max(len(index.starts), 1)


def _step(index: Index, flat: np.ndarray, head: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States after the pattern's next letter; a letter the index lacks (0) ends them."""
    if not len(q):
        return q, lo, hi
    c = flat[head[q] + step]
    lo, hi = index.back(c, lo), index.back(c, hi)
    live = (c > 0) & (lo < hi)
    return q[live], lo[live], hi[live]


def _distinct(index: Index, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal states, made by the same letter at several places of a run, are one."""
    n = index.n + 1
    key = np.unique((q * n + lo) * n + hi)
    return key // n // n, key // n % n, key % n


def _whole(index: Index, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the intervals that begin here: a delimiter stands before them."""
    a, b = index.back(np.zeros_like(lo), lo), index.back(np.zeros_like(hi), hi)
    size = b - a
    rows = index.column[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())]
    return np.repeat(q, size), index.word[index.suffix[rows]]


_NEAR = "word string, n_near long, form string, form_n long"


def _search(rows: pa.Table) -> pa.Table:
    """One piece of a shard: its searches against the index of its words. Per search the number of near words and the best of them."""
    side = rows["side"][0].as_py()
    every = list(zip(*(rows[k].to_pylist() for k in ("word", "n", "asks")), strict=True))
    of = {w: n for w, n, asks in every if not asks}
    patterns, words = [w for w, _, asks in every if asks], sorted(of)
    # The right half lies at the end of a word, where searches start; for the left half all words are mirrored.
    turn = (lambda w: w) if side == 1 else (lambda w: w[::-1])
    half = np.array([len(w) // 2 if side == 0 else len(w) - len(w) // 2 for w in patterns], np.int64)
    best: dict[str, tuple[int, int, str]] = {}
    if words and patterns:
        q, t = one_error(Index([turn(w) for w in words]), [turn(w) for w in patterns], half)
        for a, b in zip(q.tolist(), t.tolist(), strict=True):
            a, b = patterns[a], words[b]
            if side == 1 and b.startswith(a[: len(a) // 2]):
                continue  # words that share the left half as well were found from there
            count, n, form = best.get(a, (0, 0, ""))
            better = not count or of[b] > n or (of[b] == n and b < form)
            best[a] = (count + 1, of[b], b) if better else (count + 1, n, form)
    found = list(best.values())
    return pa.table([pa.array(list(best), pa.string()), pa.array([v[0] for v in found], pa.int64()), pa.array([v[2] for v in found], pa.string()), pa.array([v[1] for v in found], pa.int64())], ["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n_near, form, form_n: for each word with a near word their number and the most frequent one (ties: the smallest)."""
    c = F.col
    length = F.length("word")

    # A search of length L looks for words of lengths L - 1 to L + 1 that begin with its left half, or end with its right half.
    def left(of: Column) -> Column:
        return c("word").substr(F.lit(1), F.floor(of / 2).cast("int"))

    def right(of: Column) -> Column:
        size = (of - F.floor(of / 2)).cast("int")
        return c("word").substr(length - size + 1, size)

    rows = None
    for side, part in ((0, left), (1, right)):
        asks = words.select("word", "n", F.lit(side).alias("side"), F.lit(True).alias("asks"), F.xxhash64(F.lit(side), length, part(length)).alias("block"))
        reach = F.explode(F.array(length - 1, length, length + 1))
        told = words.select("word", "n", reach.alias("of")).select(
            "word", "n", F.lit(side).alias("side"), F.lit(False).alias("asks"), F.xxhash64(F.lit(side), c("of"), part(c("of"))).alias("block"))
        both = asks.unionByName(told)
        rows = both if rows is None else rows.unionByName(both)
    rows = settle(rows)
    total = rows.filter(~c("asks")).count()
    shards = max(1, -(-total // shard))
    rows = rows.withColumn("shard", F.pmod(c("block"), F.lit(shards)))
    # Pieces of shards that are too large: every piece of words meets every piece of searches.
    size = rows.groupBy("side", "shard").agg(F.count_if(~c("asks")).alias("told"), F.count_if(c("asks")).alias("asked"))
    size = settle(size.select("side", "shard", F.ceil(c("told") / (2 * shard)).cast("int").alias("nt"), F.ceil(c("asked") / (2 * shard)).cast("int").alias("na")).filter("nt > 0 AND na > 0"))
    piece = rows.join(size, ["side", "shard"])
    all_of = lambda n: F.sequence(F.lit(0), c(n) - 1)
    own = lambda n: F.array(F.pmod(F.xxhash64("word", F.lit(7)), c(n)).cast("int"))
    piece = piece.withColumn("t", F.explode(F.when(c("asks"), all_of("nt")).otherwise(own("nt")))).withColumn("a", F.explode(F.when(c("asks"), own("na")).otherwise(all_of("na"))))
    piece = piece.select("word", "n", "side", "asks", "shard", "t", "a")
    found = piece.groupBy("side", "shard", "t", "a").applyInArrow(_search, _NEAR)
    best = F.min(F.struct((-c("form_n")).alias("n"), c("form").alias("w"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", c("best.w").alias("form"), (-c("best.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms. A form is more frequent than its word, so chains are short and have no cycles; each round halves them."""
    c = F.col
    now = settle(forms.select("word", c("form").alias("root")))
    while True:
        ahead = now.select(c("word").alias("root"), c("root").alias("next"))
        moved = settle(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), c("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary.

    ``form`` is the most frequent word one edit away, if it is ``ratio`` times as frequent; ``root`` ends the chain of forms. Null and empty
    texts have no words, a null doc_id counts as empty text, repeated rows count each, a table without words gives no rows. Extra columns are ignored.
    """
    c = F.col
    words = settle(vocabulary(docs, min_count))
    near = settle(near_words(words, shard))
    fits = c("form_n") >= c("n") * ratio
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, c("form")).alias("form"), F.when(fits, c("form_n")).alias("form_n"))
    known = settle(known)
    ends = roots(known.filter("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
