"""Sharding by a K-d tree: weighted medians along the widest metadata dimension.

Every node that still holds several shards is cut at the weighted quantile of its widest
dimension, all nodes of a level at once, until each leaf is one shard of about the target bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townhall.llm.common import number_in_order, partitions, settle

DIMENSIONS = ("length", "source", "lang", "doc_id")
TOGETHER = 1 / 16  # of a shard's bytes, up to which equal texts stay in one shard


def _coded(df: DataFrame, name: str, out: str) -> DataFrame:
    """The texts of a column replaced by their number in order; null is -1."""
    found = number_in_order(df.select(name).dropna().distinct(), [], [F.col(name)], out)
    return df.join(settle(found), name, "left").drop(name).withColumn(out, F.coalesce(F.col(out).cast("double"), F.lit(-1.0)))


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _cuts(units: DataFrame, nodes: dict[int, tuple[int, int, float]]) -> list[tuple]:
    """One cut per node: (node, dimension, value, hash, piece, inclusive).

    ``nodes`` is node -> (dimension, left weight wanted). The units are dealt by range along
    the node's own dimension; the partition that holds the quantile is found from sums per
    partition, and only its rows are summed up one by one.
    """
    spark = units.sparkSession
    plan = F.broadcast(spark.createDataFrame([(k, d) for k, (d, _) in nodes.items()], "node int, dim int"))
    along = F.element_at(F.array(*[F.col(f"d{i}") for i in range(len(DIMENSIONS))]), F.col("dim") + 1)
    line = units.join(plan, "node").select("node", along.alias("v"), "h", "part", "w")
    line = settle(line.repartitionByRange(partitions(spark), "node", "v", "h", "part").withColumn("pid", F.spark_partition_id()))
    spots, before = [], {}
    sums = sorted(line.groupBy("node", "pid").agg(F.sum("w").alias("w")).collect(), key=lambda r: (r["node"], r["pid"]))
    found = set()
    for r in sums:
        k = r["node"]
        done = before.get(k, 0)
        if k not in found and done + r["w"] >= nodes[k][1]:
            found.add(k)
            spots.append((k, r["pid"], float(done), float(nodes[k][1])))
        before[k] = done + r["w"]
    if not spots:
        return []
    here = F.broadcast(spark.createDataFrame(spots, "node int, pid int, done double, want double"))
    running = F.sum("w").over(W.partitionBy("node").orderBy("v", "h", "part").rangeBetween(W.unboundedPreceding, 0))
    peers = F.sum("w").over(W.partitionBy("node", "v", "h", "part"))
    reached = line.join(here, ["node", "pid"]).withColumn("cum", running + F.col("done")).withColumn("peers", peers)
    first = (
        reached.filter("cum >= want").groupBy("node")
        .agg(F.min(F.struct("v", "h", "part", "cum", "peers", "want")).alias("c")).select("node", "c.*").collect()
    )
    # The end of the cut that is nearer to the wanted weight.
    return [(r["node"], nodes[r["node"]][0], r["v"], r["h"], r["part"], bool(r["cum"] - r["want"] <= r["want"] - (r["cum"] - r["peers"]))) for r in first]


def _in_pieces(thin: DataFrame, cap: float) -> DataFrame:
    """Rows with ``piece``: groups of equal texts above ``cap`` bytes are cut by position into pieces of at most about that size."""
    c = F.col
    big = thin.groupBy("h", "size").agg((F.count("*") * c("size")).alias("gw")).filter(c("gw") > cap).select("h", "size", (c("gw") / cap).alias("parts"), "gw")
    big = settle(big)
    rows = number_in_order(thin.join(big, ["h", "size"]), ["h", "size"], [c("doc_id"), c("row")], "at")
    cut = rows.withColumn("piece", F.floor(c("at") * c("size") * F.ceil("parts") / c("gw")).cast("int"))
    rest = thin.join(big, ["h", "size"], "left_anti").withColumn("piece", F.lit(0))
    return settle(rest.unionByName(cut.drop("parts", "gw", "at")).drop("row"))


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, together: float = TOGETHER) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, shard, slot.

    ``shards`` leaves, or as many as ``target_bytes`` asks for. Size is the UTF-8 bytes of the text
    plus 8. Documents of equal text stay in one shard unless they hold more than ``together`` (a sixteenth) of
    its bytes; then they are cut into pieces of about that size, whatever their ids, so a huge group does not unbalance the shards.

    Null or empty text: size 8, checksum 0; they are two groups. Null metadata sorts before all else.
    Repeated rows are placed one by one, an empty table gives an empty result, other columns
    are not read. The driver holds a few numbers per shard and shuffle partition.
    """
    c = F.col
    thin = docs.select(
        c("doc_id"), _size(c("text")).alias("size"), F.coalesce(F.crc32(c("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.xxhash64(c("text"), c("text").isNull()), F.lit(0)).alias("h"),
        c("source").alias("source"), c("lang").alias("lang"), F.monotonically_increasing_id().alias("row"))
    thin = settle(thin)
    total = thin.agg(F.sum("size")).first()[0] or 0
    leaves = shards if shards is not None else max(1, math.ceil(total / target_bytes))
    thin = _in_pieces(_coded(_coded(thin, "source", "src"), "lang", "lng"), max(1.0, total / leaves * together))
    units = thin.groupBy("h", "size", c("piece").alias("part")).agg(
        (F.count("*") * c("size")).alias("w"), F.log2(c("size").cast("double")).alias("d0"), F.min("src").alias("d1"), F.min("lng").alias("d2"),
        F.coalesce(F.min("doc_id").cast("double"), F.lit(-1.0)).alias("d3"))
    group = W.partitionBy("h", "size")  # as many rows as the group has pieces
    units = settle(units.select("h", "size", "part", "w", "d0", *[F.min(f"d{i}").over(group).alias(f"d{i}") for i in (1, 2, 3)], F.lit(0).alias("node")))
    width: list[float] | None = None
    count, first_leaf = {0: leaves}, {0: 0}
    while any(k > 1 for k in count.values()):
        rows = units.groupBy("node").agg(F.sum("w").alias("w"), *[f(f"d{i}").alias(f"{n}{i}") for i in range(len(DIMENSIONS)) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        spans = {r["node"]: [r[f"hi{i}"] - r[f"lo{i}"] for i in range(len(DIMENSIONS))] for r in rows}
        if width is None:
            width = [x or 1.0 for x in spans.get(0, [1.0] * len(DIMENSIONS))]
        nodes = {}
        for r in rows:
            k, n = r["node"], count[r["node"]]
            if n > 1:
                widest = max(range(len(DIMENSIONS)), key=lambda i: (spans[k][i] / width[i], -i))
                nodes[k] = (widest, r["w"] * (n // 2) / n)
        cuts = _cuts(units, nodes) if nodes else []
        if cuts:
            units = _descend(units, cuts)
        left, start = {}, {}
        for k, n in count.items():
            if n > 1:
                left[2 * k + 1], start[2 * k + 1] = n // 2, first_leaf[k]
                left[2 * k + 2], start[2 * k + 2] = n - n // 2, first_leaf[k] + n // 2
            else:
                left[k], start[k] = n, first_leaf[k]
        count, first_leaf = left, start
    shard_of = docs.sparkSession.createDataFrame(sorted(first_leaf.items()), "node int, shard int")
    placed = units.join(F.broadcast(shard_of), "node").select("h", "size", c("part").alias("piece"), "shard")
    out = thin.join(settle(placed), ["h", "size", "piece"]).select("doc_id", "size", "text_crc32", "shard")
    return number_in_order(out, ["shard"], [c("doc_id"), c("text_crc32"), c("size")], "slot")


def _descend(units: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Move the units of every cut node to its left (2k + 1) or right (2k + 2) child."""
    c = F.col
    table = units.sparkSession.createDataFrame(cuts, "node int, dim int, cv double, ch long, cpart int, inclusive boolean")
    along = F.element_at(F.array(*[c(f"d{i}") for i in range(len(DIMENSIONS))]), c("dim") + 1)
    key, cut = F.struct(along, c("h"), c("part")), F.struct("cv", "ch", "cpart")
    left = (key < cut) | ((key == cut) & c("inclusive"))
    moved = F.when(c("dim").isNull(), c("node")).when(left, 2 * c("node") + 1).otherwise(2 * c("node") + 2)
    # A cut per shard at most, so its size is that of the shard list.
    out = units.join(F.broadcast(table), "node", "left").withColumn("node", moved.cast("int")).drop("dim", "cv", "ch", "cpart", "inclusive")
    return settle(out)
