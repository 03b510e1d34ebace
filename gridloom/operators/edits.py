"""Bounded reads, differences of masks, and write-back with a check for conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(y0: int, x0: int, y1: int, x1: int) -> Column:
    return (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)


def window_read(mask: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    return mask.where(within(y0, x0, y1, x1))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(y, x, old, new) of pixels that differ; null stands for background."""
    both = old.select("y", "x", F.col("v").alias("old")).join(new.select("y", "x", F.col("v").alias("new")), ["y", "x"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def changed_box(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row with the half-open box of all differences, nulls without any."""
    return differences(old, new).agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))


def edit_states(base: DataFrame, current: DataFrame, edited: DataFrame) -> DataFrame:
    """(y, x, state) of edited pixels: apply, done (the store has it already) or conflict (another writer changed it)."""
    edit = differences(base, edited)
    both = edit.join(current.select("y", "x", F.col("v").alias("now")), ["y", "x"], "left")
    state = F.when(F.col("now").eqNullSafe(F.col("new")), "done").when(F.col("now").eqNullSafe(F.col("old")), "apply").otherwise("conflict")
    return both.select("y", "x", "old", "new", "now", state.alias("state"))


def checked_value(low: int, high: int) -> Column:
    """The new value of an edited pixel; a conflict, or a value out of the mask's range, fails the query."""
    out_of_range = (F.col("new") < low) | (F.col("new") > high)
    return F.when(F.col("state") == "conflict", F.raise_error(F.lit("another writer changed an edited pixel"))).when(out_of_range, F.raise_error(F.lit("a value is out of the mask's range"))).otherwise(F.col("new"))


def write_back(base: DataFrame, current: DataFrame, edited: DataFrame, low: int = 0, high: int = (1 << 32) - 1) -> DataFrame:
    """The mask after an edit; a conflict, or a value the mask can't hold, fails the query."""
    states = edit_states(base, current, edited)
    new = checked_value(low, high)
    merged = current.select("y", "x", "v").join(states.select("y", "x", new.alias("_new"), F.lit(True).alias("_hit")), ["y", "x"], "full")
    return merged.select("y", "x", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("v")).alias("v")).where("v IS NOT NULL AND v <> 0")


def commit_within(base: DataFrame, current: DataFrame, edited: DataFrame, dirty: DataFrame, bucket: int = 512) -> DataFrame:
    """write_back() of the edits inside the dirty rectangles; pixels outside stay as they are."""
    from gridloom.operators.rects import overlap_join

    changed = differences(base, edited)
    points = changed.select(F.col("y").alias("y0"), F.col("x").alias("x0"), (F.col("y") + 1).alias("y1"), (F.col("x") + 1).alias("x1"))
    inside = overlap_join(points, dirty.select("y0", "x0", "y1", "x1"), bucket).select(F.col("l_y0").alias("y"), F.col("l_x0").alias("x")).distinct()
    old = base.select("y", "x", F.col("v").alias("old")).join(changed.join(inside, ["y", "x"], "left_anti").select("y", "x", F.lit(True).alias("_out")), ["y", "x"], "full")
    kept = edited.select("y", "x", F.col("v").alias("new")).join(old, ["y", "x"], "full")
    return write_back(base, current, kept.select("y", "x", F.when(F.col("_out"), F.col("old")).otherwise(F.col("new")).alias("v")).where("v IS NOT NULL"))


def journal(base: DataFrame, current: DataFrame, edited: DataFrame, low: int = 0, high: int = (1 << 32) - 1) -> DataFrame:
    """(y, x, old, new) of the pixels that a write will change, to be stored before it; a conflict, or a value the mask can't hold, fails the query."""
    states = edit_states(base, current, edited)
    new = checked_value(low, high)
    return states.select("y", "x", F.col("now").alias("old"), new.alias("new"))


def replay(current: DataFrame, entries: DataFrame) -> DataFrame:
    """The mask after a journal: pixels that still hold the old value, or hold the new one already, get the new one; any other fails the query.

    Replaying twice, or after a write that stopped half-way, gives the same mask.
    """
    both = current.select("y", "x", "v", F.lit(True).alias("_now")).join(entries.select("y", "x", "old", "new", F.lit(True).alias("_entry")), ["y", "x"], "full")
    fits = F.col("v").eqNullSafe(F.col("old")) | F.col("v").eqNullSafe(F.col("new"))
    value = F.when(F.col("_entry").isNull(), F.col("v")).when(fits, F.col("new")).otherwise(F.raise_error(F.lit("a journal's pixel was changed by another writer")))
    return both.select("y", "x", value.alias("v")).where("v IS NOT NULL AND v <> 0")


def unwritten(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose new value the store doesn't hold: empty after a write that is verified."""
    now = stored.select("y", "x", F.col("v").alias("_now"))
    return entries.join(now, ["y", "x"], "left").where(~F.col("_now").eqNullSafe(F.col("new"))).drop("_now")


def safe_write(base: DataFrame, edited: DataFrame, path: str, low: int = 0, high: int = (1 << 32) - 1) -> None:
    """Write edits to a stored mask so that a crash at any point can be made good by recover().

    A journal that an earlier write has left is replayed first. Then the own journal is stored, then the mask is published; it is read
    back, and the journal goes when all is there. This rewrites the mask; a ``TileStore`` writes the edit alone.
    """
    from gridloom.sources import workspace

    spark, log = base.sparkSession, f"{path}.journal"
    recover(spark, path)
    now = workspace.read_mask(spark, path)
    staged = f"{log}.staged"
    journal(base, now, edited, low, high).write.mode("overwrite").parquet(staged)
    workspace.publish(spark, staged, log)
    recover(spark, path)


def recover(spark, path: str) -> bool:
    """Replay a journal that a write has left; whether there was one. A conflict keeps the journal and fails."""
    from gridloom.sources import workspace

    files, make = workspace.file_system(spark, path)
    log = make(f"{path}.journal")
    workspace.settle(spark, path)
    workspace.settle(spark, f"{path}.journal")
    if not files.exists(log):
        return False
    entries = spark.read.parquet(f"{path}.journal")
    workspace.write_mask(replay(workspace.read_mask(spark, path), entries), path)
    if not unwritten(workspace.read_mask(spark, path), entries).isEmpty():
        raise OSError(f"the mask doesn't hold what was written; the journal is kept beside {path}")
    files.delete(log, True)
    return True


def undo_review(now: DataFrame, before: DataFrame, revision: int) -> DataFrame:
    """The review rows before a step, if no edit came after it: ``now`` and ``before`` hold edit_revision; another one than expected is an error."""
    last = now.agg(F.max("edit_revision").alias("_last"))  # one row
    checked = F.when(F.col("_last") != revision, F.raise_error(F.lit("annotations changed after this review"))).otherwise(F.col("edit_revision"))
    return before.join(F.broadcast(last)).withColumn("edit_revision", checked).drop("_last")
