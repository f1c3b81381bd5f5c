"""Source divergence audit: which sources of a language use other words than the language, and than each other.

Terms are counted by sorting pointers. A slice of texts is one byte buffer; a pointer stands at the start of every word, so that
the bytes from it on are a suffix of the slice, compared up to the end of its first word. A multikey quicksort parts the pointers eight
bytes at a time, and a run of equal pointers is a term: its pointers, looked up in the row offsets, give
occurrences and documents per source. Only these counts leave the task; Spark adds them up.

Probabilities and divergences are whole numbers throughout, so every run and every order of rows gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townhall.llm.common import settle

SLICE = 8 << 20  # bytes of text whose pointers are sorted together; bears on memory only
SMALL = 2048  # pointers below which a slice is sorted at once
UNIT = 1_000_000_000
MIN_DOCS = 10
TOP = 10
TILE_SOURCES = 128  # sources and terms of a tile that one task compares
TILE_TERMS = 4096

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of lower-cased bytes; a word ends at the end of its row."""
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1 if len(data) else starts
    return starts, ends - starts


def _keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of every word from ``depth`` on as one number; bytes behind the end are zero, which no word holds."""
    key = np.zeros(len(starts), np.uint64)
    for k in range(8):
        at = depth + k
        here = np.where(lengths > at, data[np.minimum(starts + at, len(data) - 1)], 0)
        key = (key << np.uint64(8)) | here.astype(np.uint64)
    return key


def _sort_at_once(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a small slice and where its runs start; runs whose words go on are refined together, eight bytes a step."""
    order = np.argsort(key, kind="stable")
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    while True:
        depth += 8
        new = np.flatnonzero(first)
        open_ = (np.maximum.reduceat(lengths[order], new) > depth) & (np.diff(np.append(new, len(order))) > 1)
        if not open_.any():
            return order, first
        run = np.cumsum(first) - 1
        at = np.flatnonzero(open_[run])
        mine, run = order[at], run[at]
        key = _keys(data, starts[mine], lengths[mine], depth)
        by = np.lexsort((key, run))
        order[at] = mine[by]
        key = key[by]
        first[at[1:]] |= (key[1:] != key[:-1]) & (run[1:] == run[:-1])


def equal_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their words, and where a run of equal words starts.

    A multikey quicksort: a slice is parted at a pivot into smaller, equal and larger keys of eight bytes, and
    only the equal part goes on to the next eight. Small slices are sorted at once.
    """
    order = np.arange(len(starts))
    first = np.zeros(len(starts), bool)
    todo = [(0, len(starts), 0, None)] if len(starts) else []
    while todo:
        lo, hi, depth, key = todo.pop()
        first[lo] = True
        mine = order[lo:hi]
        if key is None:
            key = _keys(data, starts[mine], lengths[mine], depth)
        if hi - lo <= SMALL:
            by, runs = _sort_at_once(data, starts[mine], lengths[mine], key, depth)
            order[lo:hi] = mine[by]
            first[lo:hi] |= runs
            continue
        pivot = np.partition(key[:: len(key) // 31], 15)[15]
        less, same = key < pivot, key == pivot
        more = ~(less | same)
        order[lo:hi] = np.concatenate([mine[less], mine[same], mine[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        first[a] = True
        if a > lo:
            todo.append((lo, a, depth, key[less]))
        if b < hi:
            todo.append((b, hi, depth, key[more]))
        # A key is padded with zeros, which no word holds: words that end here have it in common and are equal.
        if lengths[order[a:b]].max() > depth + 8:
            todo.append((a, b, depth + 8, None))
    return order, np.flatnonzero(first)


def _tally(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Per (term, group of rows): the term, the group, occurrences and rows of the slice that hold it."""
    starts, lengths = word_pointers(data, offsets)
    order, runs = equal_runs(data, starts, lengths)
    n_rows = len(offsets) - 1
    row = np.searchsorted(offsets, starts[order], "right") - 1
    term = np.zeros(len(order), np.int64)
    term[runs[1:]] = 1
    term = np.cumsum(term)
    cell, times = np.unique(term * n_rows + row, return_counts=True)
    n_groups = int(group.max()) + 1 if len(group) else 1
    of, inverse = np.unique(cell // n_rows * n_groups + group[cell % n_rows], return_inverse=True)
    head = order[runs]
    raw = data.tobytes()
    terms = [raw[s : s + k] for s, k in zip(starts[head].tolist(), lengths[head].tolist(), strict=True)]
    return [terms[t] for t in (of // n_groups).tolist()], of % n_groups, np.bincount(inverse, times, len(of)).astype(np.int64), np.bincount(inverse, minlength=len(of))


def _long_text(data: np.ndarray) -> dict[bytes, int]:
    """Occurrences per term of one long text, piece by piece; pieces end behind a word."""
    found: dict[bytes, int] = {}
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and _LETTER[data[end]] and _LETTER[data[end - 1]]:
            stop = np.flatnonzero(~_LETTER[data[end : end + SLICE]])
            end = end + int(stop[0]) if len(stop) else min(end + SLICE, len(data))
        terms, _, times, _ = _tally(data[at:end], np.array([0, end - at]), np.zeros(1, np.int64))
        for t, n in zip(terms, times.tolist(), strict=True):
            found[t] = found.get(t, 0) + n
        at = end
    return found


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]

    def out(lang, source, term, n, docs):
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names)

    for b in batches:
        langs, sources = b["lang"].to_pylist(), b["source"].to_pylist()
        keys = {}
        group = np.array([keys.setdefault(k, len(keys)) for k in zip(langs, sources, strict=True)], np.int64)
        named = list(keys)
        rows = np.bincount(group, minlength=len(named))
        # The empty term counts the documents of a group, so that groups without terms are known, too.
        yield out([k[0] for k in named], [k[1] for k in named], [b""] * len(named), [0] * len(named), rows)
        texts = b["text"]
        width, kind = (np.int64, 8) if pa.types.is_large_binary(texts.type) else (np.int32, 4)
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], width, len(texts) + 1, texts.offset * kind).astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
            piece = _LOWER[data[offsets[i] : offsets[j]]]
            if j == i + 1 and len(piece) > SLICE:
                found = _long_text(piece)
                yield out([langs[i]] * len(found), [sources[i]] * len(found), list(found), list(found.values()), [1] * len(found))
            else:
                terms, g, times, docs = _tally(piece, offsets[i : j + 1] - offsets[i], group[i:j])
                yield out([named[k][0] for k in g.tolist()], [named[k][1] for k in g.tolist()], terms, times, docs)
            i = j


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); the empty term counts the documents of the group.

    One scan without an exchange of texts; counts are combined in the task before they are shuffled, so a hot source or word is one row per task.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    thin = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    found = thin.mapInArrow(_count_batches, "lang string, source string, term binary, n long, docs long")
    return found.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * vocabulary)), exact for counts up to 18 digits."""
    d = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", d(F.lit(UNIT)) * d(n + 2), d(total + vocabulary * 2)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


_TILE = "lang string, s string, t string, value long"


def _tile(rows: pa.Table) -> pa.Table:
    """Sums of a tile: for each pair of a source of one block and one of the other, what the terms that occur add to the pair."""
    get = lambda k: rows[k].to_numpy(zero_copy_only=False) if k in ("block", "p", "base") else np.array(rows[k].to_pylist(), object)
    lang, bi, bj = (rows[k][0].as_py() for k in ("lang", "bi", "bj"))
    term, source, block, p, base = (get(k) for k in ("h", "source", "block", "p", "base"))
    mark = np.array([t is None for t in term], bool)
    by = np.argsort(source[mark])
    names, none, block, size = (x[mark][by] for x in (source, p, block, base))
    at = {s: k for k, s in enumerate(names)}
    number: dict[str, int] = {}
    columns = np.array([number.setdefault(t, len(number)) for t in term[~mark]], np.int64)
    grid = np.repeat(none[:, None], len(number), 1)
    grid[np.array([at[s] for s in source[~mark]], np.int64), columns] = p[~mark]
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    s, t, v = [], [], []
    for i in left:
        others = right[right > i] if bi == bj else right
        price = lambda x, y: (x - y) ** 2 // (x + y)
        # Terms that none of the tile's sources has are alike; the tile with the first terms accounts for the whole vocabulary.
        value = price(grid[i], grid[others]).sum(1) + (int(size[0]) - len(number)) * price(none[i], none[others])
        s += [names[i]] * len(others)
        t += names[others].tolist()
        v += value.tolist()
    return pa.table([pa.array([lang] * (2 * len(s)), pa.string()), pa.array(s + t, pa.string()), pa.array(t + s, pa.string()), pa.array(v + v, pa.int64())], ["lang", "s", "t", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: per group of (lang, source) its distance to every other source, and its own words.

    A language keeps the terms that ``min_docs`` of its documents hold. Part ``pair`` has the divergence from each other source of the
    language, part ``term`` the ``top`` terms that the source uses more than the language does. Nulls count as
    empty text; repeated rows count each; a table without rows gives none. Extra columns are ignored. Sources and languages of equal text are one.

    Pairs are computed in tiles of sources and terms, bounded by their size whatever the number of sources; rows that leave a tile are
    pairs of sources, which are the result itself.
    """
    c = F.col
    counted = settle(term_counts(docs))
    groups = counted.filter("term = ''").select("lang", "source")
    by_lang = counted.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(c("docs") >= min_docs)
    kept = settle(by_lang.select("lang", "term", c("n").alias("n_lang")))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    cells = settle(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    about = groups.join(sources, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    about = settle(about.select("lang", "source", "n_sources", zero("v"), zero("total_lang"), zero("total")))
    priced = cells.join(about, ["lang", "source"]).select(
        "lang", "source", "term", "v", "n_sources", probability(c("n"), c("total"), c("v")).alias("p"), probability(c("n_lang"), c("total_lang"), c("v")).alias("q"))
    priced = settle(priced)

    w = W.partitionBy("lang", "source").orderBy(c("value").desc(), "item")
    own = priced.filter("p > q").select("lang", "source", c("term").alias("item"), divergence(c("p"), c("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= top)

    blocks = lambda: F.ceil(c("n_sources") / TILE_SOURCES).cast("int")
    term_blocks = lambda: F.greatest(F.ceil(c("v") / TILE_TERMS).cast("int"), F.lit(1))
    block = F.pmod(F.xxhash64("source"), blocks()).cast("int").alias("block")
    p0 = F.when(c("v") > 0, probability(F.lit(0), c("total"), c("v"))).otherwise(F.lit(1))
    # A mark per source and block of terms has the probability of a term that the source lacks; the first one stands for the whole vocabulary.
    marks = about.select("lang", "source", block, blocks().alias("nb"), "v", p0.alias("p"), F.explode(F.sequence(F.lit(0), term_blocks() - 1)).alias("tb"))
    marks = marks.select("lang", "source", "block", "nb", "tb", F.lit(None).cast("string").alias("h"), "p", F.when(c("tb") == 0, c("v")).otherwise(F.lit(0)).cast("long").alias("base"))
    rows = marks.unionByName(priced.select(
        "lang", "source", block, blocks().alias("nb"), F.pmod(F.xxhash64("term"), term_blocks()).cast("int").alias("tb"), c("term").alias("h"), "p", F.lit(0).cast("long").alias("base")))
    # A block of sources meets every block once, itself included.
    other = F.explode(F.sequence(F.lit(0), c("nb") - 1)).alias("o")
    dealt = rows.select("*", other).select(
        "lang", "source", "block", "tb", "h", "p", "base", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"))
    sums = dealt.groupBy("lang", "bi", "bj", "tb").applyInArrow(_tile, _TILE)
    pairs = sums.groupBy("lang", c("s").alias("source"), c("t").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", "item", "value", F.row_number().over(w).alias("rank"))
    order = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*order).unionByName(own.withColumn("part", F.lit("term")).select(*order))
