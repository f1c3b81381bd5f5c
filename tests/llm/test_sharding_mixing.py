import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_rows import ROWS
from pyspark.sql import functions as F

from townhall.llm import cube, kd_shards


def test_shards_hold_near_equal_bytes(small, texts):
    rows = kd_shards.assign(small, shards=6).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    per, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        per[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(per) == set(range(6))
    assert max(per.values()) - min(per.values()) <= max(r["size"] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_target_bytes_gives_the_number_of_shards(small):
    rows = kd_shards.assign(small, target_bytes=100_000).select("shard", "size").collect()
    total = sum(r["size"] for r in rows)
    assert len({r["shard"] for r in rows}) == -(-total // 100_000)


def test_a_hot_group_is_cut_and_a_small_one_is_not(spark):
    rows = [(i, "hot " * 50, "en", "s", 1) for i in range(600)] + [(1000 + i, f"pair {i // 2} " + "w " * 40, "en", "s", 1) for i in range(600)]
    out = kd_shards.assign(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), shards=8).collect()
    per, pairs = Counter(), defaultdict(set)
    for r in out:
        per[r["shard"]] += r["size"]
        if r["doc_id"] >= 1000:
            pairs[(r["doc_id"] - 1000) // 2].add(r["shard"])
    assert max(per.values()) < 1.25 * min(per.values())
    assert all(len(s) == 1 for s in pairs.values())


def test_shards_of_odd_rows(odd, empty):
    rows = kd_shards.assign(odd, shards=3).collect()
    assert len(rows) == len(ROWS)
    assert {r["size"] for r in rows if r["doc_id"] in (6, 7)} == {8}
    assert kd_shards.assign(empty, shards=3).count() == 0
    assert kd_shards.assign(empty, target_bytes=10).count() == 0


def words(text):
    return len((text or "").encode().split())


def levels(sizes):
    """Targets by plain resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mix_meets_targets(small, texts):
    rows = cube.mix(small).collect()
    assert len(rows) == len(texts)
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == words(texts[r["doc_id"]])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2)
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = levels(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert sum(abs(taken[s] - want[s]) for s in want) < 0.05 * sum(want.values())
    assert Counter(map(tuple, rows)) == Counter(map(tuple, cube.mix(small).collect()))


def test_flight_keeps_both_totals_and_leaves_two():
    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(1, 1000, 400))[::-1].astype(float)
    x = cube.flight(size, np.full(400, 0.3), rng.random(400))
    assert ((x > 0) & (x < 1)).sum() <= 2
    assert x.sum() == pytest.approx(120, abs=1e-6) and (x * size).sum() == pytest.approx(0.3 * size.sum(), rel=1e-9)
    tied = cube.flight(np.full(50, 7.0), np.full(50, 0.5), rng.random(50))
    assert tied.sum() == pytest.approx(25, abs=1e-6)


def test_blocks_of_a_large_source_meet_until_one_is_left(spark):
    rows = [(i, "w " * (1 + i % 97), "en", "hot" if i % 3 else "cold", 1) for i in range(6000)]
    out = cube.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    for s in ("hot", "cold"):
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 100


def test_mix_and_resample_of_odd_rows(odd, empty):
    rows = cube.mix(odd).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] == 0 for r in rows if r["doc_id"] in (6, 7, 8))
    again = cube.resample(odd)
    assert again.columns == odd.columns and again.count() == sum(r["copies"] for r in rows)
    assert cube.mix(empty).count() == 0 and cube.resample(empty).count() == 0


def test_a_small_source_lands_finely_beside_a_large_one(spark):
    rows = [(i, "w " * (500 + 37 * i % 997), "en", "small", 1) for i in range(300)] + [(1000 + i, "w " * (1 + i % 97), "en", "vast", 1) for i in range(700)]
    out = cube.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    own = [r for r in out if r["source"] == "small"]
    assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 20


def test_a_hot_text_fills_all_of_its_many_shards(spark):
    """A third of all rows share one text and have no id; sources differ behind a long common start only."""
    rows = [(i, f"text number {i} of these", f"https://example.org/{i % 3}", "en") for i in range(2000)] + [(None, "one text of many rows", "https://example.org/0", None)] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    shards = kd_shards.assign(docs, shards=240).groupBy("shard").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    target = sum(r["w"] for r in shards) / 240
    assert {r["shard"] for r in shards} == set(range(240)) and all(r["n"] == r["last"] + 1 for r in shards) and sum(r["n"] for r in shards) == 3000
    assert all(abs(r["w"] - target) <= target / 8 for r in shards)
