"""Jobs over several micro-batches on small tables: the run guard and the change feed."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from townhall.plans.q_streams import state_store
from townhall.streaming import changes, guard, jobs

T0 = dt.datetime(2024, 1, 1)


def minutes(k):
    return T0 + dt.timedelta(minutes=k)


def arriving(spark, folder, parts, schema):
    """A stream of one micro-batch per part."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


BEATS = [
    (1, 10, minutes(0), "queued"), (1, 10, minutes(1), "running"), (1, 11, minutes(2), "running"), (1, 11, minutes(3), "success"), (1, 10, minutes(5), "success"),
    (1, 12, minutes(6), "running"), (1, 10, minutes(7), "running"), (2, 20, minutes(8), "running"), (1, 12, minutes(60), "running"), (2, 21, minutes(90), "failed"),
    (1, 10, minutes(130), "failed"), (3, 30, minutes(140), "running"), (2, 22, minutes(300), "running"), (9, 90, minutes(311.5), None), (9, 91, minutes(320), "success"),
]
ENDED = {
    (1, 11, "refused", 2, 1), (1, 10, "success", 0, 3), (2, 20, "stuck", 8, 1), (2, 21, "failed", 90, 1), (1, 12, "stuck", 6, 2), (1, 10, "failed", 130, 1), (3, 30, "stuck", 140, 1),
}


def guarded(spark, folder, parts):
    schema = "source_id long, run_id long, ts timestamp, status string"
    found = []
    with state_store(spark):
        stream = guard.guarded_runs(arriving(spark, f"{folder}/in", parts, schema))
        jobs.run_available(stream, f"{folder}/checkpoint", lambda b, epoch: found.extend(b.collect()))
    return sorted((r["source_id"], r["run_id"], r["status"], int((r["started_at"] - T0).total_seconds() // 60), r["beats"]) for r in found)


def test_never_two_active_runs_however_the_beats_arrive(spark, tmp_path):
    one = guarded(spark, f"{tmp_path}/one", [BEATS])
    assert set(one) == ENDED and len(one) == len(ENDED)
    five = guarded(spark, f"{tmp_path}/five", [BEATS[k : k + 3] for k in range(0, 15, 3)])
    mixed = guarded(spark, f"{tmp_path}/mixed", [BEATS[1::-1], BEATS[2:5], BEATS[5:13][::-1], BEATS[13:]])
    assert five == mixed == one


def test_changes_both_ways(spark):
    schema = "id long, a string, b int"
    old = spark.createDataFrame([(1, "x", 1), (2, None, 2), (3, "z", None), (4, "gone", 4), (None, "n", 1)], schema)
    new = spark.createDataFrame([(1, "x", 1), (2, "", 2), (3, "z", None), (5, None, None), (None, "m", 1)], schema)
    found = {(r["id"], r["kind"]) for r in changes.changes(old, new, ["id"]).collect()}
    assert found == {(2, "changed"), (4, "removed"), (5, "added"), (None, "changed")}
    assert changes.changes(old, old, ["id"]).count() == 0


def test_feed_drives_the_second_job(spark, tmp_path):
    bodies = jobs.Snapshots(f"{tmp_path}/bodies")
    versions = [{1: "one two", 2: "three"}, {1: "one two", 2: "three four", 3: "five"}, {1: "one", 2: "three four"}]

    def each(batch, epoch):
        rows = [(k, v, "en") for k, v in versions[epoch].items()]
        bodies.write(spark.createDataFrame(rows, jobs.BODIES), "bodies", epoch)

    feed, measured = f"{tmp_path}/feed", jobs.Snapshots(f"{tmp_path}/measured")
    run = changes.with_feed(each, bodies, "bodies", jobs.BODIES, ["article_id"], feed)
    last = -1
    for epoch in range(3):
        run(spark.range(0), epoch)
        stream = spark.readStream.schema(changes.FEED).option("recursiveFileLookup", "true").parquet(feed)
        done = jobs.run_available(stream, f"{tmp_path}/checkpoint", changes.measure_changed(measured, lambda: bodies.read(spark, "bodies", epoch, jobs.BODIES)))
        last = max(last, done)
    rows = {r["article_id"]: (r["n_passes"], r["n_chars"], r["n_words"]) for r in measured.read(spark, "measures", last, changes.MEASURES).collect()}
    assert rows == {1: (2, 3, 1), 2: (2, 10, 2)}


def test_resends_within_the_delay_are_dropped(spark, tmp_path):
    rows = [[("a", minutes(0)), ("b", minutes(1)), ("a", minutes(3))], [("a", minutes(6)), ("c", minutes(60))], [("d", minutes(61))], [("a", minutes(62))]]
    found = []
    stream = jobs.drop_resends(arriving(spark, f"{tmp_path}/in", rows, "k string, at timestamp"), "at", "10 minutes", ["k"])
    jobs.run_available(stream, f"{tmp_path}/checkpoint", lambda b, epoch: found.extend(b.select(F.col("k")).collect()))
    assert sorted(r["k"] for r in found) == ["a", "a", "b", "c", "d"]


class Kept:
    """State of one source, in memory, and the timers that were asked for."""

    def __init__(self):
        self.timers, self.rows = [], []

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return Nothing()

    def getMapState(self, *_):
        return Nothing()

    def registerTimer(self, at):
        self.timers.append(at)

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows)

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []


class Nothing:
    def exists(self):
        return False

    def update(self, *_):
        pass

    def updateValue(self, *_):
        pass


def test_a_source_is_woken_once_however_many_minutes_its_beats_lie_in():
    kept, processor = Kept(), guard.RunGuard()
    processor.init(kept)
    beats = pd.DataFrame({"ts": [minutes(k) for k in range(500)], "run_id": 1, "status": "running"})
    list(processor.handleInputRows((1,), iter([beats]), None))
    at = lambda k: int(minutes(k).replace(tzinfo=dt.UTC).timestamp() * 1000)
    assert kept.timers == [at(1)]
    # Up to the watermark everything is read at once; the first beat behind it has the next timer.
    processor._advance(at(200) * 1000)
    assert len(kept.rows) == 300 and at(201) in kept.timers and len(kept.timers) <= 3
