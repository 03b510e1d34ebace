"""Live activity and debounced edits: stateful streams with timers of event time.

A hub (one viewer's header) keeps the latest report of each source, shows the one of the highest rank, forgets a transient ready report after
``READY_SECONDS`` and keeps a log of the last ``LOG_ENTRIES`` entries. Timers fire when the watermark passes them, so a report that nothing follows
expires too. Within a micro-batch a hub's reports are taken by time and number, and what is due before a report expires before it: what is
shown doesn't depend on how the stream is cut into batches, as long as none is late. State is a row a source and a bounded log.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridloom.streaming.activity import CAMERA, CAMERA_BUSY, CONTEXT, LOG_ENTRIES, RANKS, READY_SECONDS, VIEW

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHOWN = "hub string, at_ms long, source string, state string, message string, rank long, log string"
COMMITS = "source string, first_ms long, last_ms long, edits long, y0 long, x0 long, y1 long, x1 long"
#: Milliseconds without another edit after which edits are committed. A fixed value.
COMMIT_MS = 400


def rank_of(report: dict) -> int:
    """The rank of activity_rank() for one report."""
    source, failed = report["source"], report["state"] == "error"
    if source == "view" and not failed:
        base = VIEW
    elif source == "context":
        base = CONTEXT
    elif source == "camera" and not failed:
        base = CAMERA_BUSY if report["state"] == "busy" else CAMERA
    else:
        base = RANKS.get(report["state"], 0)
    return base + report["priority"]


class HubState:
    """A hub's reports and log, as a small document."""

    def __init__(self, held: str | None):
        self.seq, self.reports, self.log, self.shown = json.loads(held) if held else (0, {}, [], None)

    def dumps(self) -> str:
        return json.dumps([self.seq, self.reports, self.log, self.shown])

    def current(self) -> dict:
        best = max(self.reports.values(), key=lambda r: (rank_of(r), r["seq"]), default=None)
        return best or {"source": "view", "state": "idle", "message": "Ready", "priority": 0, "seq": 0}

    def change(self, at: int) -> list[tuple]:
        """What is shown from now on, if it is another report than before."""
        now = self.current()
        if self.shown == [now["source"], now["seq"]]:
            return []
        self.shown = [now["source"], now["seq"]]
        log = json.dumps(self.log[-1]) if self.log else None
        return [(at, now["source"], now["state"], now["message"], rank_of(now) if now["seq"] else None, log)]

    def expire(self, until: int) -> list[tuple]:
        """Reports whose time is over leave, one moment after the other."""
        out = []
        while due := min((r["expires"] for r in self.reports.values() if r["expires"] is not None and r["expires"] <= until), default=None):
            self.reports = {s: r for s, r in self.reports.items() if r["expires"] is None or r["expires"] > due}
            out += self.change(due)
        return out

    def report(self, at: int, source: str, state: str, message: str, details: str, priority: int, transient: bool, log: bool) -> list[tuple]:
        """Take a report in; one that repeats its source's last one changes and renews nothing."""
        new, old = {"source": source, "state": state, "message": message, "details": details, "priority": priority}, self.reports.get(source, {})
        if all(old.get(k) == v for k, v in new.items()):
            return []
        self.seq += 1
        self.reports[source] = new | {"seq": self.seq, "expires": at + 1000 * READY_SECONDS if transient and state == "ready" else None}
        entry = [source, state, details]
        if log and source not in ("view", "camera", "context") and (not self.log or self.log[-1] != entry):
            self.log = [*self.log, entry][-LOG_ENTRIES:]
        return self.change(at)


class ActivityHub(StatefulProcessor):
    """Reports (hub, at, seq, source, state, message, details, priority, transient, log) to changes of what is shown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("hub", "held string")

    def _kept(self) -> HubState:
        return HubState(self.state.get()[0] if self.state.exists() else None)

    def _end(self, key, hub: HubState, out: list[tuple]) -> Iterator[pd.DataFrame]:
        self.state.update((hub.dumps(),))
        for at in {*self.handle.listTimers()}:
            self.handle.deleteTimer(at)
        for at in {r["expires"] for r in hub.reports.values()} - {None}:
            self.handle.registerTimer(at)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[f.split()[0] for f in SHOWN.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hub, out = self._kept(), []
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        for r in batch.itertuples():
            at = r.at.value // 1_000_000
            out += hub.expire(at)
            out += hub.report(at, r.source, r.state, r.message, r.details, int(r.priority), bool(r.transient), bool(r.log))
        yield from self._end(key, hub, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hub = self._kept()
        yield from self._end(key, hub, hub.expire(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


class Debounce(StatefulProcessor):
    """Edits (source, at, box) to one commit, with the box around them, when none has followed for COMMIT_MS."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("edits", "first long, last long, edits long, y0 long, x0 long, y1 long, x1 long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = list(self.state.get()) if self.state.exists() else None, []
        for r in pd.concat(list(rows)).sort_values("at").itertuples():
            at = r.at.value // 1_000_000
            if held and at - held[1] >= COMMIT_MS:
                out.append((key[0], *held))
                held = None
            held = [at, at, 0, r.y0, r.x0, r.y1, r.x1] if held is None else held
            held = [held[0], max(held[1], at), held[2] + 1, min(held[3], r.y0), min(held[4], r.x0), max(held[5], r.y1), max(held[6], r.x1)]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.state.update(tuple(int(v) for v in held))
        self.handle.registerTimer(int(held[1]) + COMMIT_MS)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in COMMITS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[1] + COMMIT_MS <= expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([(key[0], *self.state.get())], columns=[f.split()[0] for f in COMMITS.split(", ")])
            self.state.clear()

    def close(self) -> None:
        pass


def use_timers(spark: SparkSession) -> None:
    """Sessions that run these streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def stream_activity(reports: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(hub, at_ms, source, state, message, rank, log) whenever another report is shown; log: the newest entry."""
    use_timers(reports.sparkSession)
    return reports.withWatermark("at", late).groupBy("hub").transformWithStateInPandas(ActivityHub(), SHOWN, "append", "EventTime")


def stream_commits(edits: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(source, first_ms, last_ms, edits, box) of edits that were followed by none for COMMIT_MS."""
    use_timers(edits.sparkSession)
    return edits.withWatermark("at", late).groupBy("source").transformWithStateInPandas(Debounce(), COMMITS, "append", "EventTime")
