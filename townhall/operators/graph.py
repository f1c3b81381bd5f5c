"""Connected components of a large link table."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.operators.skew import by_rows
from townhall.session import forget, outer, scratch, settle


def roots(pairs: DataFrame) -> DataFrame:
    """node -> root (some node of its connected component), written, for every node with a link. Nodes are numbers of 64 bits.

    Contraction (Bögeholz et al. 2020): every node is replaced by the first of itself and its neighbours, links inside a
    node go, and this is repeated with the links that are left, until there are none. The order of nodes changes from round to round.
    Every other round has that of the numbers, by which stars around their smallest node end at once; the others are random, so
    that no shape of links, such as a long chain, needs more rounds than in proportion to the logarithm of its nodes. Links get fewer
    with each round; the maps of the rounds, ever smaller, are joined from the last to the first.

    A round is a min per node (map-side combine), two joins of written tables, whose hot nodes run-time skew handling can
    split, and a distinct. The driver sees one answer per round. All tables but the result go at the end.
    """
    c = F.col
    spark = pairs.sparkSession
    keep, turn, maps = outer(spark), random.Random(0), []
    with scratch(spark):
        links = settle(pairs.select("a", "b").filter("a <> b"))
        while not links.isEmpty():
            mask = F.lit(turn.getrandbits(63) if len(maps) % 2 else 0).cast("long")
            ends = links.select(c("a").alias("u"), c("b").alias("v")).unionByName(links.select(c("b").alias("u"), c("a").alias("v")))
            low = ends.groupBy("u").agg(F.min(c("v").bitwiseXOR(mask)).alias("m"))
            maps.append(settle(low.select("u", F.least("m", c("u").bitwiseXOR(mask)).bitwiseXOR(mask).alias("m"))))
            to = by_rows(maps[-1])
            side = lambda x: to.select(c("u").alias(x), c("m").alias(f"to_{x}"))
            moved = links.join(side("a"), "a").join(side("b"), "b").filter("to_a <> to_b")
            left = settle(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())
            forget(links)
            links = left
        found = maps.pop() if maps else links.select(c("a").alias("u"), c("b").alias("m"))
        while maps:
            # A node without links in the later rounds stays what it is.
            end = by_rows(found).select(c("u").alias("m"), c("m").alias("end"))
            found = settle(maps.pop().join(end, "m", "left").select("u", F.coalesce("end", "m").alias("m")))
        return settle(found.select(c("u").alias("node"), c("m").alias("root")), root=keep)


def components(pairs: DataFrame) -> DataFrame:
    """node -> label (smallest node of its connected component), written, for nodes with a link but that smallest one.

    Nodes of other types than long numbers are numbered first. See ``roots``.
    """
    c = F.col
    spark = pairs.sparkSession
    keep = outer(spark)
    with scratch(spark):
        if {f.dataType.simpleString() for f in pairs.select("a", "b").schema} == {"bigint"}:
            found = roots(pairs)
        else:
            links = settle(pairs.select("a", "b").filter("a <> b").distinct())
            nodes = settle(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("n", F.monotonically_increasing_id()))
            number = lambda x: by_rows(nodes).select(c("node").alias(x), c("n").alias(f"n_{x}"))
            numbered = roots(links.join(number("a"), "a").join(number("b"), "b").select(c("n_a").alias("a"), c("n_b").alias("b")))
            found = nodes.join(by_rows(numbered).select(c("node").alias("n"), "root"), "n").select("node", "root")
            found = settle(found)
        low = settle(found.groupBy("root").agg(F.min("node").alias("label")))
        return settle(found.join(by_rows(low), "root").filter("node > label").select("node", "label"), root=keep)
