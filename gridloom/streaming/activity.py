"""Event-sourced batches, current activity and edit sessions: batch forms and their streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.numbering import number_rows

#: Ranks of activity states, and of the sources view, context and camera, before the priority is added. Fixed values.
RANKS = {"error": 400, "busy": 200, "warning": 120, "ready": 100}
VIEW, CONTEXT, CAMERA_BUSY, CAMERA = -100, 25, 50, -50
#: Seconds after which a transient ready record is no longer shown; entries of the log that are kept.
READY_SECONDS, LOG_ENTRIES = 4, 100


def batch_states(events: DataFrame) -> DataFrame:
    """State of each batch from events(batch_id, seq, action, region): how many regions are members, whether it is finished, rejected events.

    add and remove change membership; approve and revoke don't; finish and reopen switch; a finished batch rejects add and approve.
    """
    order = W.partitionBy("batch_id").orderBy("seq")
    switch = F.when(F.col("action") == "finish", True).when(F.col("action") == "reopen", False)
    before = F.coalesce(F.last(switch, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    marked = events.withColumn("_refused", before & F.col("action").isin("add", "approve"))
    totals = marked.groupBy("batch_id").agg(F.max_by(switch, F.when(switch.isNotNull(), F.col("seq"))).alias("_last"), F.count_if("_refused").alias("rejected"), F.count("*").alias("events"))
    change = marked.where("action IN ('add', 'remove') AND NOT _refused").groupBy("batch_id", "region").agg(F.max_by("action", "seq").alias("last"))
    members = change.groupBy("batch_id").agg(F.count_if(F.col("last") == "add").alias("regions"))
    return totals.join(members, "batch_id", "left").select("batch_id", F.coalesce("regions", F.lit(0)).cast("long").alias("regions"), F.coalesce("_last", F.lit(False)).alias("finished"), "rejected", "events")


def activity_rank() -> Column:
    """Rank of a report (source, state, priority): errors first; view, camera and context stand back unless they fail or, the camera, work."""
    states = F.coalesce(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col("state")], F.lit(0))
    error = F.col("state") == "error"
    base = F.when((F.col("source") == "view") & ~error, VIEW).when(F.col("source") == "context", CONTEXT)
    base = base.when((F.col("source") == "camera") & ~error, F.when(F.col("state") == "busy", CAMERA_BUSY).otherwise(CAMERA)).otherwise(states)
    return (base + F.col("priority")).cast("long")


def changes_only(reports: DataFrame) -> DataFrame:
    """Reports without those that repeat the last one of their source in everything but seq and time: these renew nothing."""
    said = F.struct(*[c for c in reports.columns if c not in ("source", "seq", "at")])
    w = W.partitionBy("source").orderBy("seq")
    return reports.withColumn("_said", said).withColumn("_before", F.lag("_said").over(w)).where("_before IS NULL OR NOT (_said <=> _before)").drop("_said", "_before")


def source_activity(reports: DataFrame, now: float | None = None) -> DataFrame:
    """The latest report (source, state, at, priority, transient, seq) of each source, with its rank; at ``now`` a transient ready one that is too old is gone."""
    latest = reports.groupBy("source").agg(F.max_by(F.struct("state", "at", "priority", "transient", "seq"), "seq").alias("r")).select("source", "r.*")
    if now is not None:
        latest = latest.where(~((F.col("state") == "ready") & F.col("transient") & (F.col("at") + READY_SECONDS <= now)))
    return latest.withColumn("rank", activity_rank())


def current_activity(reports: DataFrame, now: float | None = None) -> DataFrame:
    """The one report that is shown: of the sources' latest ones that of the highest rank, the later one at a tie; none is idle."""
    best = source_activity(reports, now).agg(F.max_by(F.struct("source", "state", "seq", "rank"), F.struct("rank", "seq")).alias("b"))
    return best.select(F.coalesce("b.source", F.lit("view")).alias("source"), F.coalesce("b.state", F.lit("idle")).alias("state"), "b.seq", "b.rank")


def activity_log(reports: DataFrame) -> DataFrame:
    """The last LOG_ENTRIES reports (source, state, details, seq), without view, camera and context and without direct repeats."""
    entries = reports.where(~F.col("source").isin("view", "camera", "context")).select("source", "state", "details", "seq")
    numbered = number_rows(entries, ["seq"], "_n")  # one order over all sources, however many repeats stand in it
    before = numbered.select((F.col("_n") + 1).alias("_n"), F.struct("source", "state", "details").alias("_before"))
    fresh = numbered.join(before, "_n", "left").where(~F.struct("source", "state", "details").eqNullSafe(F.col("_before")))
    return fresh.select("source", "state", "details", "seq").orderBy(F.desc("seq")).limit(LOG_ENTRIES)


def edit_sessions(edits: DataFrame, gap_seconds: int) -> DataFrame:
    """Edits of a source that follow each other within a gap, as one commit: (source, first, last, edits)."""
    w = W.partitionBy("source").orderBy("at", "seq")
    new = F.coalesce(F.col("at") - F.lag("at").over(w) >= gap_seconds, F.lit(True))
    numbered = edits.withColumn("_new", new.cast("int")).withColumn("_session", F.sum("_new").over(w))
    return numbered.groupBy("source", "_session").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("edits")).drop("_session")


def stream_sessions(edits: DataFrame, gap: str = "400 milliseconds", late: str = "1 second") -> DataFrame:
    """The same over a stream of (source, ts): a session closes when the watermark passes its gap."""
    return edits.withWatermark("ts", late).groupBy("source", F.session_window("ts", gap)).agg(F.count("*").alias("edits"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def dirty_bounds(edits: DataFrame) -> DataFrame:
    """Bounding box so far after each edit of a layer (layer, seq, y0, x0, y1, x1)."""
    w = W.partitionBy("layer").orderBy("seq")
    return edits.select("layer", "seq", *[(F.min if c.endswith("0") else F.max)(c).over(w).alias(c) for c in ("y0", "x0", "y1", "x1")])


def stream_dirty(edits: DataFrame, apply, checkpoint: str):
    """Run apply(bounds, batch_id) on the bounds of each micro-batch of edits: the trigger of incremental refreshes."""
    def batch(df: DataFrame, batch_id: int) -> None:
        apply(df.groupBy("layer").agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1")), batch_id)

    return edits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
