"""Ranking, numbering, joins and components give the plain answer also when keys are hot."""

import random
from pathlib import Path

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townhall.operators import dedupe, relevance, rerank
from townhall.operators.graph import components
from townhall.operators.merge import upsert
from townhall.operators.ranking import number_rows, rank_in_buckets
from townhall.operators.skew import lookup_join
from townhall.session import scratch, settle


def skewed(spark, n=3000):
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.pmod(F.hash("id"), F.lit(500)).alias("v"))


def test_rank_in_buckets(spark):
    df = skewed(spark)
    got = rank_in_buckets(df, ["k"], F.floor(F.col("v") / 100), [F.col("v"), F.col("id")], "rank")
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy("v", "id")))
    assert sorted(map(tuple, got.select("id", "rank").collect())) == sorted(map(tuple, want.select("id", "rank").collect()))


def test_number_rows_is_dense_and_repeatable(spark):
    df = skewed(spark).select("id")
    one = sorted(map(tuple, number_rows(df, F.col("id").cast("string"), "n", 10).collect()))
    two = sorted(map(tuple, number_rows(df.repartition(7), F.col("id").cast("string"), "n", 10).collect()))
    assert one == two and sorted(n for _, n in one) == list(range(11, 3011))


def test_salted_join_equals_plain_join(spark):
    left = skewed(spark)
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        plain = lookup_join(left, right, ["k"], how).select("id", "w")
        salted = lookup_join(left, right, ["k"], how, spread="id", salts=8).select("id", "w")
        key = lambda r: (r[0], r[1] or -1)
        assert sorted(map(tuple, plain.collect()), key=key) == sorted(map(tuple, salted.collect()), key=key)


def test_components_equal_union_find(spark):
    rnd = random.Random(7)
    # A long chain, a star and random links.
    links = [(f"{i + 1:05d}", f"{i:05d}") for i in range(60)] + [(f"{1000 + i:05d}", "01000") for i in range(1, 80)]
    links += [tuple(sorted((f"{rnd.randrange(2000, 2300):05d}", f"{rnd.randrange(2000, 2300):05d}"), reverse=True)) for _ in range(150)]
    links = [(a, b) for a, b in links if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = {r["node"]: r["label"] for r in dedupe.components(spark.createDataFrame(links, "a string, b string")).collect()}
    nodes = {x for pair in links for x in pair}
    assert {x: got.get(x, x) for x in nodes} == {x: find(x) for x in nodes}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (None, "x", 3), (None, "y", 4)], "id int, v string, pos int")
    once = upsert(old, batch, ["id"], "pos")
    twice = upsert(once, batch, ["id"], "pos")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(once) == rows(twice) == sorted([(1, "a"), (2, "d"), (None, "y")], key=str)


def test_due_plan_has_no_driver_collect_and_prunes_columns(spark):
    from townhall.plans import load_all
    from townhall.plans.registry import QUERIES

    load_all()
    plan = QUERIES["claim_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan and "l_tax" not in plan


def test_components_leave_one_table_behind(spark):
    links = spark.createDataFrame([(f"{i + 1:05d}", f"{i:05d}") for i in range(60)], "a string, b string")
    with scratch(spark) as folder:
        found = components(links)
        assert {r["label"] for r in found.collect()} == {"00000"} and found.count() == 60
        assert len(list(Path(folder).iterdir())) == 1


def test_words_are_counted_before_they_meet_the_vocabulary(spark):
    texts = spark.createDataFrame([(1, 1, "road road road works", "", None)], "article_id long, city_id long, title string, summary string, cleaned_text string")
    asked = spark.createDataFrame([(7, 1, "road")], "query_id long, city_id long, question string")
    moved = []

    def watch(df, *a, **b):
        moved.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df, *a, **b)

    for module, run in ((rerank, lambda: rerank.text_candidates(asked, texts)), (relevance, lambda: relevance.asked_postings(asked, texts))):
        moved.clear()
        module.settle = watch
        try:
            rows = run().collect()
        finally:
            module.settle = settle
        assert rows[0]["tf" if module is rerank else "token"] == (3 if module is rerank else "road")
        plan = next(p for p in moved if "Join" in p and "Generate" in p)
        assert plan.index("Join") < plan.index("Aggregate") < plan.index("Generate")


def test_items_are_grouped_by_numbers_also_where_positions_repeat_or_are_null(spark):
    schema = "pos string, city_id long, canonical_url string, source_url string, source_uid string, content_hash string"
    rows = [("d", 1, "x", "s1", None, None), ("b", 1, "y", "s1", None, None), ("c", 1, "y", "s2", None, "h"), ("a", 1, "z", "s3", None, "h"), ("e", 1, "q", "s4", None, None),
            ("f", 2, "x", "s1", None, None), ("g", 1, "g1", "g2", None, None), ("g", 1, "w", "g3", None, None), ("i", 1, "w", "g4", None, None), (None, 1, "q", "s1", None, None),
            ("k", 1, "q", "k1", "0", ""), ("l", 1, "l0", "l1", "0", "")]
    items = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, dedupe.label_batch(items).collect()), key=str)
    want = {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f", "g": "g", "i": "g", "k": "e", "l": "l"}
    assert got == sorted([*((p, want[p]) for p, *_ in rows if p), (None, None)], key=str)
    # Texts do not go through the rounds.
    assert {t for _, t in dedupe.batch_pairs(items.withColumn("id", F.monotonically_increasing_id())).dtypes} == {"bigint"}
