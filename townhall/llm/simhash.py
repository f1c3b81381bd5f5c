"""Near duplicates by SimHash: segment popcounts, a grid join under Manhattan distance, exact check.

A fingerprint of 64 bits is mapped to the counts of set bits in its 32 segments of two bits.
The Manhattan distance of two count vectors never exceeds the Hamming distance of the
fingerprints. If it is at most 3, then in one half of the segments it is at most 1: the
grid has a cell per half vector, each fingerprint is put into its own cells and
shown to the cells one step above, and only what meets in a cell is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import partitions, row_key, settle, whole_rows
from townhall.operators.graph import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCK = 2048  # owners of a cell that are compared at a time
LOW_BITS = 0x5555555555555555
FEW = 8


def fingerprint(text: bytes | None) -> int:
    """The unsigned SimHash of one text: XXH64 of three-word shingles, a bit is set if more than half have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[i:j], SEED) for i, j in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have; none of them: 0."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t) for t in b["text"].to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["row_key"], pa.array(prints.view(np.int64))], ["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, fp (signed) for every row; null and wordless texts have 0."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), F.col("text").cast("binary").alias("text"))
    return thin.mapInArrow(_fingerprints, "doc_id long, row_key long, fp long")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of fingerprints link: first the Manhattan distance of their embeddings, then the exact one."""

    def unary(v: np.ndarray) -> np.ndarray:
        # Two bits per segment, count 0, 1, 2 as 00, 01, 11: differing bits are the Manhattan distance.
        low, m = v >> np.uint64(1), np.uint64(LOW_BITS)
        return ((v | low) & m) | (((v & low) & m) << np.uint64(1))

    ok = np.bitwise_count(unary(a) ^ unary(b)) <= RADIUS
    return ok & (np.bitwise_count(a ^ b) <= RADIUS)


def link_block(own: np.ndarray, probe: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all that is near between ``own`` and ``probe``, as stars: no more than both are long together."""
    adj = np.vstack([near(own[None, :], probe[i : i + 256, None]) for i in range(0, len(probe), 256)])
    touched = adj.any(axis=1)
    adj, seen = adj[touched], probe[touched]
    label, far = np.arange(len(own)), len(own)
    while True:
        low = np.where(adj, label[None, :], far).min(axis=1, initial=far)
        new = np.minimum(label, np.where(adj, low[:, None], far).min(axis=0, initial=far))
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(own))
    return [(own[moved], own[label[moved]]), (seen, own[low])] if len(seen) else []


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (cell, b, c, probe, fp) to links; a cell's owners come before its probes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(cell: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(axis=1))))
        size = np.diff(np.append(start, len(cell)))
        owners = np.add.reduceat(1 - probe, start)
        found = []
        few = (owners > 0) & (owners <= FEW) & (size > 1)
        for k in range(FEW):
            # The k-th owner of each small cell against all that follows it there.
            has = few & (owners > k)
            n = size[has] - k - 1
            left = np.repeat(start[has] + k, n)
            right = np.repeat(start[has] + k + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
            ok = near(fp[left], fp[right])
            found.append((fp[left][ok], fp[right][ok]))
        for g in np.flatnonzero(owners > FEW):
            own, all_ = fp[start[g] : start[g] + owners[g]], fp[start[g] : start[g] + size[g]]
            found += link_block(own, all_)
        a = np.concatenate([x for x, _ in found]).view(np.int64)
        b = np.concatenate([x for _, x in found]).view(np.int64)
        hi, lo = np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
        return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], schema=schema)

    held = None
    for batch in batches:
        cell = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "b", "c")])
        now = (cell, batch["probe"].to_numpy(zero_copy_only=False).astype(np.int64), batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64))
        if held is not None:
            now = tuple(np.concatenate([x, y]) for x, y in zip(held, now, strict=True))
        if not len(now[0]):
            continue
        # The last cell may go on in the next batch.
        cut = len(now[0]) - int((now[0][::-1] == now[0][-1]).all(axis=1).argmin()) if (now[0] != now[0][-1]).any() else 0
        if cut:
            yield links(*(x[:cut] for x in now))
        held = tuple(x[cut:] for x in now)
    if held is not None and len(held[0]):
        yield links(*held)


def links(prints: DataFrame) -> DataFrame:
    """Links a > b between distinct fingerprints that connect whatever is within the radius.

    A cell with more than 2048 owners is cut into blocks, each pair of blocks being a task's
    work of bounded size; links of a large block are stars, so their number follows the rows.
    """
    c = F.col
    spark = prints.sparkSession
    own = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    low, part = F.lit(LOW_BITS & 0xFFFFFFFF), F.when(c("half") == 0, c("fp")).otherwise(F.shiftrightunsigned("fp", 32))
    vector = part.bitwiseAND(low) + F.shiftrightunsigned(part, 1).bitwiseAND(low)
    own = own.select("fp", "half", vector.alias("v"))
    up = F.filter(F.sequence(F.lit(0), F.lit(30), F.lit(2)), lambda i: F.expr("v").bitwiseAND(F.call_function("shiftleft", F.lit(2).cast("long"), i)) == 0)
    above = own.select("fp", "half", F.explode(F.transform(up, lambda i: F.expr("v") + F.call_function("shiftleft", F.lit(1).cast("long"), i))).alias("v"))
    cell = F.shiftleft(c("half").cast("long"), 40).bitwiseOR(c("v")).alias("cell")
    owners, shown = own.select(cell, "fp"), above.select(cell, "fp")
    large = settle(owners.groupBy("cell").count().filter(c("count") > BLOCK).select("cell", F.ceil(c("count") / BLOCK).cast("int").alias("n")))
    zero = F.lit(0)
    if large.isEmpty():
        rows = owners.select("cell", zero.alias("b"), zero.alias("c"), zero.alias("probe"), "fp").unionByName(shown.select("cell", zero.alias("b"), zero.alias("c"), F.lit(1).alias("probe"), "fp"))
    else:
        block = F.pmod(F.xxhash64("fp"), F.coalesce(c("n"), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(c("n"), F.lit(1)) - 1))
        o, s = owners.join(large, "cell", "left"), shown.join(large, "cell", "left")
        rows = o.select("cell", block.alias("b"), every.alias("c"), zero.alias("probe"), "fp")
        # In a cell of blocks the owners are shown to all other owners too.
        for p in (s, o.filter("n IS NOT NULL")):
            rows = rows.unionByName(p.select("cell", every.alias("b"), block.alias("c"), F.lit(1).alias("probe"), "fp"))
    dealt = rows.repartition(partitions(spark), "cell", "b", "c").sortWithinPartitions("cell", "b", "c", "probe")
    return dealt.mapInArrow(_cells, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, row_key, fp, component_id (smallest doc_id that links reach).

    Null, empty and wordless texts share fingerprint 0 and link like any other. Repeated rows
    give repeated rows; a null doc_id is never a component's smallest, a component of such rows alone has null.
    Empty table: empty result. Other columns enter only the row key.
    """
    c = F.col
    prints = settle(fingerprints(docs))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = settle(components(settle(links(distinct.select("fp")))))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = settle(named)
    ids = settle(named.groupBy("label").agg(F.min("least").alias("component_id")))
    of = settle(named.join(ids, "label").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", "row_key", "fp", "component_id")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The documents with one row of each group kept: the smallest doc_id, of its rows the one with the smallest key.

    ``found`` holds the groups, if they are not those of ``groups``, in its columns.
    """
    c = F.col
    found = groups(docs) if found is None else found
    # Groups without any id are told apart by their fingerprint.
    best = found.groupBy("component_id", F.when(c("component_id").isNull(), c("fp")).alias("_alone")).agg(
        F.min(F.struct(c("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("k"))
    keep = settle(best.select(c("k.doc_id").alias("keep_id"), c("k.row_key").alias("keep_key")).distinct())
    rows = whole_rows(docs)
    kept = rows.join(keep, c("doc_id").eqNullSafe(c("keep_id")) & (c("row_key") == c("keep_key")), "left_semi")
    again = settle(found.groupBy("doc_id", "row_key").count().filter(c("count") > 1).select(c("doc_id").alias("again_id"), c("row_key").alias("again_key")))
    if not again.isEmpty():
        # Rows repeated in full: one of them stays.
        same = c("doc_id").eqNullSafe(c("again_id")) & (c("row_key") == c("again_key"))
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "row_key"]))
    return kept.select("row.*")
