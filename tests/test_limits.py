"""Driver memory, calls of Python functions and scans of texts do not grow with the rows."""

import datetime as dt
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from townhall import config as C
from townhall.functions.dates import parse_date_part
from townhall.functions.html import first_attribute, first_text
from townhall.functions.text import find_phrases, found_hits, phrase_hits
from townhall.operators import actions, merge, proximity, skew
from townhall.operators import evidence as E
from townhall.operators import heuristics as H
from townhall.operators.ranking import rank_in_buckets
from townhall.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_with_a_row_per_article_are_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, 2, 3)], "k int, v int, id int")
    assert "BroadcastHashJoin" not in plan(rank_in_buckets(df, ["k"], F.col("v"), [F.col("id")], "rank"))
    rows = spark.createDataFrame([(1, "q", "c")], "article_id int, evidence_quote string, claim_quote string")
    assert "Broadcast" not in plan(actions.opportunities_or_claims(rows.drop("claim_quote"), rows, rows))
    batch = spark.createDataFrame([(1, "a", 1)], "id int, v string, pos int")
    old = batch.drop("pos")
    assert "BroadcastHashJoin" in plan(merge.upsert(old, batch, ["id"], "pos"))
    monkeypatch.setattr(skew, "FEW_ROWS", 0)
    assert "BroadcastHashJoin" not in plan(merge.upsert(old, batch, ["id"], "pos"))
    assert "BroadcastHashJoin" not in plan(merge.replace_groups(old, batch, ["id"]))


class State:
    """State of one bucket of runs, in memory."""

    hasTimedOut, at, now, rows = False, None, 0, None
    exists = property(lambda self: self.rows is not None)
    get = property(lambda self: self.rows)

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, rows):
        self.rows = rows

    def setTimeoutTimestamp(self, at):
        self.at = at

    def remove(self):
        self.rows = None


def test_the_runs_of_a_bucket_are_read_in_one_call():
    day, state = dt.datetime(2026, 1, 1), State()
    beats = pd.DataFrame([(k // 2, k % 2, 0, day + dt.timedelta(minutes=m), "success" if m == k % 7 else "running") for k in range(100) for m in range(3)],
                         columns=["source_id", "run_id", "absent", "ts", "status"])
    ended = pd.concat(jobs._lifecycle((0,), iter([beats[:150], beats[150:]]), state))
    assert {(r.source_id, r.run_id, r.beats) for r in ended.itertuples()} == {(k // 2, k % 2, 3) for k in range(100) if k % 7 < 3} and set(ended["status"]) == {"success"}
    state.now, state.hasTimedOut = state.at + 1, True
    stuck = pd.concat(jobs._lifecycle((0,), iter([]), state))
    assert {(r.source_id, r.run_id) for r in stuck.itertuples()} == {(k // 2, k % 2) for k in range(100) if k % 7 >= 3} and set(stuck["status"]) == {"stuck"}
    assert state.rows is None


def test_items_of_one_title_make_links_in_proportion(spark, monkeypatch):
    """300 items of two similar titles within the window have 44850 pairs; less than three links an item are written."""
    day, written = dt.datetime(2024, 5, 5), []
    items = spark.createDataFrame([(k, 1, f"zoning hearing room {k % 2} today", day + dt.timedelta(seconds=k)) for k in range(300)], "id long, city_id long, title string, at timestamp_ntz")
    plain = proximity.components
    monkeypatch.setattr(proximity, "components", lambda links: (written.append(links.count()), plain(links))[1])
    found = proximity.time_duplicates(items, 3600).collect()
    assert {(r.first_id, r.n_links) for r in found} == {(0, 299)} and written[0] < 600


def test_titles_that_differ_in_a_number_of_their_own_are_compared_as_one(spark, monkeypatch):
    """240 titles, each with its own number, and 20 of another kind: neighbours are counted as by pairs, a bucket holds a few titles."""
    day, rng, sides = dt.datetime(2024, 5, 5), random.Random(11), []
    title = lambda k: f"garden workshop number {k}" if k < 240 else f"garden workshop number {k} and much more to see {k % 2}"
    rows = [(k, 1, title(k), day + dt.timedelta(seconds=rng.randrange(20_000))) for k in range(260)]
    plain = proximity.similar_pairs
    monkeypatch.setattr(proximity, "similar_pairs", lambda left, *a, **b: (sides.append(left.groupBy("bucket").count().agg(F.max("count")).first()[0]), plain(left, *a, **b))[1])
    found = {r.id: r.n_links for r in proximity.time_duplicates(spark.createDataFrame(rows, "id long, city_id long, title string, at timestamp_ntz"), 3600).collect()}
    words = {k: set(t.split()) for k, _, t, _ in rows}
    near = lambda a, b: abs((a[3] - b[3]).total_seconds()) <= 3600 and len(words[a[0]] & words[b[0]]) * 10 >= len(words[a[0]] | words[b[0]]) * 6
    assert found == {a[0]: sum(near(a, b) for b in rows if b is not a) for a in rows}
    assert sides[0] <= 4


def test_one_scan_finds_the_phrases_of_all_lists(spark):
    rng = random.Random(3)
    words = sorted({w for phrases in H.PHRASES for p in phrases for w in [p, *p.split()]}) + ["hearings", "x_board", "the", "-", "."]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)] + ["", "board", "public hearing", "zoning-board"]
    count = lambda t, phrases: sum(len(re.findall(rf"(?<![A-Za-z0-9_])(?={re.escape(p)}(?![A-Za-z0-9_]))", t)) for p in phrases)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = find_phrases(F.col("t"), *H.PHRASES)
    rows = df.select("t", *[found_hits(found, p, *H.PHRASES).alias(f"n{k}") for k, p in enumerate(H.PHRASES)], phrase_hits(F.col("t"), C.CIVIC_PHRASES).alias("civic")).collect()
    for r in rows:
        assert [r[f"n{k}"] for k in range(len(H.PHRASES))] == [count(r.t, p) for p in H.PHRASES] and r.civic == count(r.t, C.CIVIC_PHRASES)
    scans = plan(df.withColumn("title", F.col("t")).withColumn("summary", F.col("t")).withColumnRenamed("t", "cleaned_text").transform(lambda x: H.text_signals(x, F.lit("1998-10-01").cast("timestamp_ntz"))))
    assert scans.count("(?=(a(?:") == 1


def test_patterns_find_what_the_plain_ones_find(spark):
    plain = {
        E.EMAIL: r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}", E.WEEKDAY: rf"(?i)\b{C.WEEKDAY}\b",
        E.PHONE: r"\b\+?1?[\s.\-]?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b", E.W_LABEL: r"\b[A-Za-z][A-Za-z\s]{0,20}:\s+"}
    rng = random.Random(5)
    parts = ["a@bb.com", "1@cc.org", "@", ".", " ", "x.y-z", "monday", "Fri", "316-555-0101", "+1 (316) 555.0101", "1", "(", "Date: ", "some words", ": ", "555", "-", "a_b"]
    texts = ["".join(rng.choice(parts) for _ in range(14)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for fast, slow in plain.items():
        for r in df.select("t", E.match_offsets(F.col("t"), fast).alias("m")).collect():
            assert [(m.start, m.len) for m in r.m] == [(m.start(), m.end() - m.start()) for m in re.finditer(slow, r.t, re.ASCII)], (r.t, fast)


def test_syllables_equal_a_loop_over_the_words(spark):
    def one(w):
        w = re.sub("[^a-z]", "", w)
        if len(w) <= 3:
            return 1 if w else 0
        groups = len(re.findall("[aeiouy]+", w))
        return max(1, groups - (w.endswith("e") and not w.endswith("le") and w[-2] not in "aeiouy" and groups > 1))

    rng = random.Random(9)
    texts = ["".join(rng.choice("aeiylesmtr  \n.'") for _ in range(60)).strip() for _ in range(200)] + ["the little place made a tree\n \tsssst", "a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.syllable_count(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.n == sum(one(w) for w in r.t.lower().split()), r.t


def test_days_and_first_elements(spark):
    texts = ["1998-10-02", " 1998-1-2T10:00", "1998-02-30", "1998-10-02x", "Fri, Oct 2, 1998", "10/2/98", "2-10-1998", "Oct 2", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_date_part(F.col("t"), F.lit(1999)).cast("string")).collect()
    assert [r[0] for r in rows] == ["1998-10-02", "1998-01-02", None, None, "1998-10-02", "1998-10-02", "1998-10-02", "1999-10-02", None, None]
    page = "<p class='n'>One <b>1</b></p><p class='n'>Two</p><a href='/x'>y</a>"
    row = spark.createDataFrame([(page,)], "t string").select(first_text(F.col("t"), "p.n"), first_text(F.col("t"), "h1"), first_attribute(F.col("t"), "a", "href"), first_text(F.lit(None).cast("string"), "p")).first()
    assert list(row) == ["One 1", "", "/x", ""]
