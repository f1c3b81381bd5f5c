"""Mixing sources to target weights with balanced sampling by the cube method.

Each source gets a target number of words. Every document is taken a whole number of times
plus a fractional part, and the fractions are rounded by the cube method: a random walk in
the null space of the constraints (words, documents) that keeps both totals of the source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import WORD, number_in_order, row_key, settle, whole_rows

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5  # of all sizes
LIMIT = 2.0  # times its source's size
BLOCK = 512  # documents that one step of the flight works on
MERGE = 128  # blocks whose leftovers (two documents each) meet in the next step
LANDING = 12  # documents of a source, spread over its sizes, that the flight leaves to the landing
EDGE = 1e-9


def _step(x: np.ndarray, size: np.ndarray, three: list[int], draw: float) -> None:
    """Move the fractions of three documents along the null space of (size, 1) until one is 0 or 1."""
    a, b, c = three
    u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], dtype=float)
    if not u.any():
        u = np.array([1.0, -1.0, 0.0])
    u /= np.abs(u).max()
    p = x[three]
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf))
        down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf))
    i, j = int(up.argmin()), int(down.argmin())
    if draw * (up[i] + down[j]) < down[j]:
        p = p + up[i] * u
        p[i] = 1.0 if u[i] > 0 else 0.0
    else:
        p = p - down[j] * u
        p[j] = 0.0 if u[j] > 0 else 1.0
    p[p < EDGE], p[p > 1 - EDGE] = 0.0, 1.0
    x[three] = p


def flight(size: np.ndarray, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The flight phase: at most two fractions are left. Sizes come largest first, so that small ones are left."""
    x = x.copy()
    live: list[int] = []
    for i in range(len(x)):
        if EDGE < x[i] < 1 - EDGE:
            live.append(i)
        if len(live) == 3:
            _step(x, size, live, draws[i])
            live = [k for k in live if 0 < x[k] < 1]
    return x


def land(size: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The landing phase: round the last fractions so that the words, then the documents, stay nearest."""
    left = np.flatnonzero((x > 0) & (x < 1))
    options = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
    words, documents = np.abs((options - x[left]) @ size[left]), np.abs((options - x[left]).sum(axis=1))
    x = x.copy()
    x[left] = options[np.lexsort((documents, words.round(6)))[0]]
    return x


def _fly(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's flight; a source that is one block lands, whatever the others still hold."""
    rows = rows.sort_values(["size", "h"], ascending=[False, True], kind="stable")
    size, x = rows["size"].to_numpy(float), rows["x"].to_numpy(float, copy=True)
    draws = (rows["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
    if rows["blocks"].max() <= 1:
        flying = np.ones(len(x), bool)
        flying[np.linspace(len(x) // 5, len(x) - 1, LANDING).astype(int)] = False
        x[flying] = flight(size[flying], x[flying], draws[flying])
        return rows.assign(x=land(size, x))
    return rows.assign(x=flight(size, x, draws))


def targets(thin: DataFrame) -> DataFrame:
    """source, source_rank, n_docs, source_size, target: weights 5, 2, 1 in turn by source, capped and reshared."""
    c = F.col
    sources = thin.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = number_in_order(sources.withColumn("_all", F.lit(0)), ["_all"], [c("source").asc_nulls_last()], "source_rank").drop("_all")
    ranked = settle(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (c("source_rank") % len(WEIGHTS) + 1).cast("int"))))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = SHARE * (total or 0)
    level = budget / weight if weight else 0.0
    while budget:
        # Sources above their limit keep it; the others share what is left. The level only rises.
        over = c("weight") * level > c("source_size") * LIMIT
        held, free = ranked.agg(F.sum(F.when(over, c("source_size") * LIMIT)), F.sum(F.when(~over, c("weight")))).first()
        rise = (budget - (held or 0.0)) / free if free else level
        if rise <= level * (1 + 1e-12):
            break
        level = rise
    target = F.least(c("weight") * level, c("source_size") * LIMIT)
    return ranked.select("source", "source_rank", "n_docs", "source_size", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, row_key, source, size, source_size, target, copies, taken.

    Size is the number of words. ``copies`` is how often the mix takes the document (0, 1 or 2).
    The flight runs in blocks of about 512 documents of a source, dealt by a hash; each block
    leaves at most two fractions, and these meet in ever larger blocks until one per source is left. There the
    flight spares twelve documents of all sizes, and the landing tries all roundings of these and of what is left (16384 at most).

    Null or empty text: size 0, taken 0. A null source is a source of its own, ranked last. Ties and
    repeated rows are separate documents; a rerun gives equal results. An empty table gives an empty one.
    """
    c = F.col
    thin = docs.select("doc_id", row_key(docs).alias("row_key"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    thin = settle(thin)
    goal = settle(targets(thin))
    ratio = F.when(c("source_size") > 0, F.least(F.lit(LIMIT), c("target") / c("source_size"))).otherwise(F.lit(0.0))
    known = thin.withColumnRenamed("source", "_source").join(goal, c("_source").eqNullSafe(c("source"))).drop("_source")
    known = known.withColumn("base", F.floor(ratio + EDGE)).withColumn("x", F.greatest(ratio - c("base"), F.lit(0.0)))
    known = known.withColumn("h", F.xxhash64("doc_id", "row_key", F.lit("cube")))
    state = known.withColumn("block", F.pmod("h", F.ceil(c("n_docs") / BLOCK)).cast("long")).withColumn("blocks", F.ceil(c("n_docs") / BLOCK))
    done = []
    while True:
        most = state.agg(F.max("blocks")).first()[0]
        last = most is None or most <= 1
        flown = settle(state.groupBy("source_rank", "block").applyInPandas(_fly, state.schema))
        if last:
            done.append(flown)
            break
        fraction = (c("x") > 0) & (c("x") < 1)
        done.append(flown.filter(~fraction))
        state = settle(flown.filter(fraction).withColumn("block", F.floor(c("block") / MERGE)).withColumn("blocks", F.ceil(c("blocks") / MERGE)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (c("base") + F.round("x")).cast("int")
    return out.select("doc_id", "row_key", "source", "size", c("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), (copies * c("size")).cast("long").alias("taken"))


def resample(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each row as often as the mix takes it, with its own columns.

    Repeated rows are one row that is taken as often as all of them together.
    """
    c = F.col
    plan = mix(docs).groupBy("doc_id", "row_key").agg(F.sum("copies").alias("n"), F.count("*").alias("same")).filter(c("n") > 0)
    plan = settle(plan.select(c("doc_id").alias("mix_id"), c("row_key").alias("mix_key"), c("n").cast("int").alias("n"), "same"))
    joined = whole_rows(docs).join(plan, c("doc_id").eqNullSafe(c("mix_id")) & (c("row_key") == c("mix_key")))
    taken = joined.filter(c("same") == 1)
    if not plan.filter(c("same") > 1).isEmpty():
        taken = taken.unionByName(joined.filter(c("same") > 1).dropDuplicates(["doc_id", "row_key"]))
    return taken.select("row", F.explode(F.sequence(F.lit(1), c("n"))).alias("copy")).select("row.*")
