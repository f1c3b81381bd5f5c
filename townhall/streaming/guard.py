"""Run lifecycle per source with the guard against two active runs, inside the stream.

State per source: a list of beats that the watermark has not passed, the active run, and the runs that ended lately. Beats are read in
the order of their time once a whole minute below the watermark holds them, so the result does not depend on how the input was cut
into micro-batches. Timers stand at the minute after the earliest waiting beat and after the silence of the active run, so a source is
read a few times per micro-batch, however many minutes its beats lie in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("success", "failed")
MINUTE = 60_000_000
QUIET = 60 * MINUTE
TRANSITIONS = "source_id bigint, run_id bigint, status string, started_at timestamp, last_seen timestamp, beats bigint"


class RunGuard(StatefulProcessor):
    """One active run per source.

    A beat of another run while one is active ends that other run as ``refused``. The active run ends with its first final status, or as
    ``stuck`` once a beat of the source or the watermark is over an hour past its last one. Beats of an ended run within an hour of its end are ignored;
    later ones open it again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ts bigint, run_id bigint, status string")
        self.active = handle.getValueState("active", "run_id bigint, started bigint, last bigint, beats bigint")
        self.ended = handle.getMapState("ended", "run_id bigint", "ts bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            ts = pdf["ts"].astype("datetime64[us]").astype("int64").tolist()
            beats = list(zip(ts, pdf["run_id"].tolist(), pdf["status"].tolist(), strict=True))
            if beats:
                self.pending.appendList(beats)
                self._wake(min(ts))
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000 // MINUTE * MINUTE
        yield self._rows(key, self._advance(limit))

    def close(self) -> None:
        pass

    def _wake(self, ts: int) -> None:
        """A timer at the minute after a beat. Whatever waits behind it is given one when it fires."""
        self.handle.registerTimer((ts // MINUTE + 1) * MINUTE // 1000)

    def _advance(self, limit: int) -> list[tuple]:
        """Everything that happened before ``limit``, and the state after it. Called again for the same limit it finds nothing new."""
        beats = sorted(tuple(b) for b in self.pending.get()) if self.pending.exists() else []
        ready, later = [b for b in beats if b[0] < limit], [b for b in beats if b[0] >= limit]
        active = tuple(self.active.get()) if self.active.exists() else None
        ended = {int(k[0]): int(v[0]) for k, v in self.ended.iterator()} if self.ended.exists() else {}
        before, out = (active, dict(ended)), []
        for ts, run, status in ready:
            if active and ts > active[2] + QUIET:
                out.append((active[0], "stuck", *active[1:]))
                ended[active[0]] = active[2]
                active = None
            if run in ended and ts <= ended[run] + QUIET:
                continue
            if active and active[0] != run:
                out.append((run, "refused", ts, ts, 1))
                ended[run] = ts
                continue
            active = (run, active[1] if active else ts, ts, (active[3] if active else 0) + 1)
            if status in TERMINAL:
                out.append((run, status, *active[1:]))
                ended[run] = ts
                active = None
        if active and limit > active[2] + QUIET:
            out.append((active[0], "stuck", *active[1:]))
            ended[active[0]] = active[2]
            active = None
        if ready:
            self.pending.put(later) if later else self.pending.clear()
            if later:
                self._wake(later[0][0])
        if active != before[0]:
            if active:
                self.active.update(active)
                self.handle.registerTimer(((active[2] + QUIET) // MINUTE + 1) * MINUTE // 1000)
            else:
                self.active.clear()
        for run in set(ended) | set(before[1]):
            if run in ended and ended[run] + QUIET < limit:
                if run in before[1]:
                    self.ended.removeKey((run,))
            elif before[1].get(run) != ended[run]:
                self.ended.updateValue((run,), (ended[run],))
        return out

    @staticmethod
    def _rows(key, found: list[tuple]) -> pd.DataFrame:
        at = lambda k: pd.to_datetime(pd.Series([f[k] for f in found], dtype="int64"), unit="us")
        return pd.DataFrame({"source_id": [key[0]] * len(found), "run_id": [f[0] for f in found], "status": pd.Series([f[1] for f in found], dtype=object), "started_at": at(2), "last_seen": at(3), "beats": [f[4] for f in found]})


def guarded_runs(beats: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Heartbeats (source_id, run_id, ts, status) to ended and refused runs. Needs the RocksDB state store.

    State holds what lies within the watermark delay and the last hour of a source; null keys, times and runs are left out.
    """
    known = beats.filter("source_id IS NOT NULL AND run_id IS NOT NULL AND ts IS NOT NULL").withColumn("status", F.coalesce("status", F.lit("")))
    return known.withWatermark("ts", delay).groupBy("source_id").transformWithStateInPandas(RunGuard(), TRANSITIONS, "append", "eventTime")
