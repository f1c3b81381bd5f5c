"""Plans and hot keys: what must not be shuffled, grouped or gathered."""

from collections import Counter

from pyspark.sql import functions as F

from townhall.operators import dedupe, listings, merge, skew
from townhall.plans.registry import dealt
from townhall.session import settle


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_neither_groups_nor_sorts_nor_shuffles_old_rows(spark):
    old = settle(spark.range(1000).select("id", F.concat(F.lit("text "), "id").alias("text"), F.lit(1).alias("kept")))
    batch = spark.range(10).select((F.col("id") + 995).alias("id"), F.lit("new").alias("text"), F.col("id").alias("pos"))
    out = merge.upsert(old, batch.union(batch.withColumn("text", F.lit("last")).withColumn("pos", F.lit(99).cast("long"))), ["id"], "pos", keep=["kept"])
    plan = plan_of(out)
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    rows = {r["id"]: (r["text"], r["kept"]) for r in out.collect()}
    assert len(rows) == 1005 and rows[0] == ("text 0", 1) and rows[999] == ("last", 1) and rows[1004] == ("last", None)


def test_replaced_groups_neither_group_nor_shuffle_old_rows(spark):
    old = settle(spark.range(1000).select((F.col("id") % 100).alias("g"), F.col("id").alias("v"), F.when(F.col("id") % 2 == 0, "open").alias("state")))
    batch = spark.createDataFrame([(3, -1, "open"), (None, -2, "open")], "g long, v long, state string")
    out = merge.replace_groups(old, batch, ["g"], replaceable=F.col("state") == "open")
    plan = plan_of(out)
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert out.count() == 1002  # group 3 has odd rows only, which may not go
    assert merge.replace_groups(old, batch, ["g"]).filter("g = 3").count() == 1
    assert merge.replace_groups(out, batch.limit(0), ["g"], touched=spark.createDataFrame([(None,), (4,)], "g long")).count() == 1002 - 10 - 1


def test_a_late_page_reads_its_range_only(spark):
    rows = spark.range(10_000).select(F.col("id"), (F.col("id") * 7919 % 10_007).alias("k"))
    pages = listings.paged(rows, [F.col("k"), F.col("id")], 25)
    want = [r["id"] for r in rows.orderBy("k", "id").offset(390 * 25).limit(25).collect()]
    late = pages.page(391)
    assert [r["id"] for r in late.orderBy("position").collect()] == want and "TakeOrdered" not in plan_of(late) and "GlobalLimit" not in plan_of(late)
    assert "PartitionFilters: [" in plan_of(late) and "_range" in plan_of(late).split("PartitionFilters")[1][:60]
    assert pages.page(401).count() == 0 and pages.page(400).count() == 25 and pages.bounds().count() == 400


def test_the_dashboard_is_one_grouping(spark):
    runs = spark.createDataFrame([(1, "success", 5), (1, "failed", 0), (9, None, None)], "scraper_id long, status string, items_written long")
    out = listings.dashboard_rollup(settle(runs), settle(spark.createDataFrame([(1, 4)], "id long, city_id long")))
    assert plan_of(out).count("hashpartitioning") == 1
    rows = {(r["city_id"], r["scraper_id"], r["status"], r["level"]): (r["runs"], r["items_written"]) for r in out.collect()}
    assert rows[None, None, None, 7] == (3, 5) and rows[4, 1, None, 1] == (2, 5) and rows[None, 9, None, 0] == (1, None) and len(rows) == 8


def test_merge_takes_null_keys_as_equal(spark):
    schema = "a long, b string, v string"
    old = spark.createDataFrame([(1, None, "old"), (None, None, "old"), (2, "x", "old")], schema)
    batch = spark.createDataFrame([(1, None, "new", 1), (None, None, "new", 1), (2, "y", "new", 1)], schema + ", pos long")
    assert Counter(map(tuple, merge.upsert(old, batch, ["a", "b"], "pos").collect())) == Counter([(1, None, "new"), (None, None, "new"), (2, "x", "old"), (2, "y", "new")])


def test_a_hot_item_key_is_split_when_it_is_looked_up(spark):
    """A key that holds nine tenths of the items: the join of the lookup is a skew join in the final plan."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = F.col("id")
        url = F.when(n % 10 == 0, F.concat(F.lit("https://x/"), n.cast("string"))).otherwise("https://hot/")
        items = settle(spark.range(60_000).repartition(8).select(
            n.alias("pos"), F.lit(1).cast("long").alias("city_id"), url.alias("canonical_url"), url.alias("source_url"), F.lit(None).cast("string").alias("source_uid"),
            F.sha2(n.cast("string"), 256).alias("content_hash")))
        articles = spark.createDataFrame([(7, 1, "https://hot/", "h")], "id long, city_id long, canonical_url string, content_hash string")
        sources = spark.createDataFrame([], "article_id long, city_id long, source_url string, source_uid string")
        keys = dedupe._item_keys(items, {1: F.col("canonical_url"), 4: F.col("content_hash")})
        known = settle(keys.groupBy("tier", "city_id", "key").agg(F.min("pos").alias("first")))
        df = keys.join(known, ["tier", "city_id", "key"])
        df.collect()
        assert "skew=true" in plan_of(df)
        found = dedupe.match_existing(items, articles, sources)
        assert found.count() == 54_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_item_keys_are_dealt_out_as_numbers(spark):
    items = spark.createDataFrame([(p, 1, "https://x/" + p, "https://y/", None, "") for p in "abc"] + [("d", None, "https://x/a", "https://y/", None, None)],
                                  "pos string, city_id long, canonical_url string, source_url string, source_uid string, content_hash string")
    articles = spark.createDataFrame([(7, 1, "https://x/b", "h"), (6, None, "https://x/a", None), (None, 1, "https://x/b", None)], "id long, city_id long, canonical_url string, content_hash string")
    sources = spark.createDataFrame([(9, 1, "https://y/", None), (7, 1, "https://y/", None)], "article_id long, city_id long, source_url string, source_uid string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = dedupe.match_existing(items, articles, sources)
        assert "hashpartitioning(_id0" in plan_of(found) and "hashpartitioning(tier" not in plan_of(found)
        assert sorted(map(tuple, found.collect())) == [("a", 2, 7), ("b", 1, 7), ("c", 2, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_keys_of_text_are_dealt_out_as_numbers(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW_ROWS", 0)
    schema = "a long, b string, v string"
    old = spark.createDataFrame([(1, None, "old"), (1, "", "old"), (None, None, "old"), (2, "x", "old"), (2, "x", "again")], schema)
    batch = spark.createDataFrame([(1, None, "new", 1), (None, None, "new", 1), (2, "y", "new", 1)], schema + ", pos long")
    out = merge.upsert(old, batch, ["a", "b"], "pos")
    assert "_id0" in plan_of(out)
    new = [(1, None, "new"), (None, None, "new"), (2, "y", "new")]
    assert Counter(map(tuple, out.collect())) == Counter([(1, "", "old"), (2, "x", "old"), (2, "x", "again"), *new])
    by_id = merge.upsert(old, batch, ["a"], "pos")
    assert "_id0" not in plan_of(by_id) and by_id.count() == 3


def test_the_first_merge_writes_no_table_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(merge, "settle", None)
    schema = "a long, v string, kept int"
    batch = spark.createDataFrame([(1, "new", 1), (1, "last", 2), (None, "x", 1)], "a long, v string, pos long")
    out = merge.upsert(spark.createDataFrame([], schema), batch, ["a"], "pos", keep=["kept"], first=True)
    assert Counter(map(tuple, out.collect())) == Counter([(1, "last", None), (None, "x", None)]) and out.dtypes == [("a", "bigint"), ("v", "string"), ("kept", "int")]


def test_rows_in_many_splits_are_not_dealt_again(spark):
    cores = spark.sparkContext.defaultParallelism
    assert dealt(spark.range(0, 1000, 1, cores * 3)).rdd.getNumPartitions() == cores * 3
    if cores > 1:
        assert "RoundRobin" in plan_of(dealt(spark.range(0, 1000, 1, 1)))
