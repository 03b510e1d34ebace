import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.streaming import live

START = datetime.datetime(2024, 1, 1)
REPORTS = "hub string, at timestamp, seq long, source string, state string, message string, details string, priority int, transient boolean, log boolean"


def at(ms):
    return START + datetime.timedelta(milliseconds=ms)


def plain_loop(reports, end):
    """What a header shows, report by report, its clock moved to each; expired reports leave at their time."""
    base = int((START - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    held, log, shown, seq, out = {}, [], None, 0, []

    def show(ms):
        nonlocal shown
        def rank(r):
            special = {"view": -100, "context": 25, "camera": 50 if r["state"] == "busy" else -50}
            special = special if r["state"] != "error" else {"context": 25}
            return special.get(r["source"], {"error": 400, "busy": 200, "warning": 120, "ready": 100}.get(r["state"], 0)) + r["priority"]
        best = max(held.values(), key=lambda r: (rank(r), r["seq"])) if held else {"source": "view", "seq": 0, "state": "idle"}
        if shown != (best["source"], best["seq"]):
            shown = (best["source"], best["seq"])
            out.append((base + ms, best["source"], best["state"], rank(best) if held else None))

    def pass_time(ms):
        while due := [r["until"] for r in held.values() if r["until"] is not None and r["until"] <= ms]:
            for s in [s for s, r in held.items() if r["until"] == min(due)]:
                del held[s]
            show(min(due))

    for ms, source, state, message, priority, transient, logged in reports:
        pass_time(ms)
        old = held.get(source)
        if old and (old["state"], old["message"], old["priority"]) == (state, message, priority):
            continue
        seq += 1
        held[source] = {"source": source, "state": state, "message": message, "priority": priority, "seq": seq, "until": ms + 4000 if transient and state == "ready" else None}
        if logged and source not in ("view", "camera", "context") and (not log or log[-1] != [source, state, message]):
            log = [*log, [source, state, message]][-100:]
        show(ms)
    pass_time(end)
    return out, log


def run(spark, tmp_path, make, stream, batches):
    """Rows of a stream over files, one a batch."""
    source = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        part = make(rows).coalesce(1)
        part.write.mode("append").parquet(source)
    schema = make([]).schema
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream(read).writeStream.format("memory").queryName(f"t{random.randrange(1 << 30)}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(120)
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.table(query.name).collect()


@pytest.mark.parametrize("cut", [1, 3])
def test_activity_like_a_plain_loop(spark, tmp_path, cut):
    rng, ms, reports = random.Random(5), 0, []
    for _ in range(60):
        ms += rng.choice([0, 50, 900, 2500])
        reports.append((ms, rng.choice(["view", "camera", "context", "train", "library"]), rng.choice(["ready", "busy", "error", "warning"]), rng.choice("ab"), rng.choice([50, 50, 10]), rng.random() < 0.8, rng.random() < 0.9))
    end = ms + 60_000
    want, log = plain_loop(reports, end)
    rows = [("h", at(r[0]), k, r[1], r[2], r[3], r[3], r[4], r[5], r[6]) for k, r in enumerate(reports)]
    step = -(-len(rows) // cut)
    batches = [rows[k : k + step] for k in range(0, len(rows), step)] + [[("else", at(end), 999, "view", "busy", "x", "x", 0, False, False)]]
    found = run(spark, tmp_path, lambda rows: spark.createDataFrame(rows, REPORTS), live.stream_activity, batches)
    mine = [r for r in found if r.hub == "h"]
    assert sorted((r.at_ms, r.source, r.state, r["rank"]) for r in mine) == sorted(want, key=lambda r: r[:3])
    logged = [json.loads(r.log) for r in mine if r.log]
    assert logged and all(entry in [[s, t, m] for _, s, t, m, *_ in reports] for entry in logged)


def test_log_is_a_ring_without_direct_repeats():
    hub = live.HubState(None)
    for k in range(51):
        hub.report(k, "task", "busy", str(k), str(k), 50, True, True)
    for k in range(6000):
        hub.report(100 + k, "task", "busy", "50", f"{50 if k % 2 else 50}", 50 + k % 2, True, True)
    assert len(hub.log) == 51 and live.HubState(hub.dumps()).log == hub.log
    for k in range(300):
        hub.report(10_000 + k, "task", "busy", "x", f"d{k}", 50, True, True)
    assert len(hub.log) == 100 and hub.log[0] == ["task", "busy", "d200"]


def test_edits_are_committed_once_they_pause(spark, tmp_path):
    edits = [("a", 0), ("a", 399), ("b", 100), ("a", 700), ("a", 1100), ("a", 1101), ("b", 900)]
    rows = [(s, at(ms), k, k, k + 2, k + 3) for k, (s, ms) in enumerate(edits)]
    schema = "source string, at timestamp, y0 long, x0 long, y1 long, x1 long"
    found = run(spark, tmp_path, lambda rows: spark.createDataFrame(rows, schema), live.stream_commits, [rows[:3], rows[3:5], rows[5:], [("z", at(60_000), 0, 0, 1, 1)], [("z", at(61_000), 0, 0, 1, 1)]])
    base = int((START - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    got = sorted((r.source, r.first_ms - base, r.last_ms - base, r.edits, r.y0, r.x1) for r in found if r.source != "z")
    assert got == [("a", 0, 700, 3, 0, 6), ("a", 1100, 1101, 2, 4, 8), ("b", 100, 100, 1, 2, 5), ("b", 900, 900, 1, 6, 9)]
