"""Annotation batches as folds of an event log: which batch is active, what is a member, what was refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.rects import BOX, subtract_all
from gridloom.operators.review import RECTS

#: Colours of the first batches. Fixed values.
PALETTE = ["#56b4e9", "#bb86fc", "#2ec4b6", "#f781bf", "#ff8c42", "#a6cee3", "#b3de69", "#fb8072"]
#: Step of the hue of later ones, the hues that are left to selections, and how far these are moved. Fixed values.
HUE_STEP, YELLOW, YELLOW_SHIFT, SATURATION, VALUE = 0.61803398875, (0.11, 0.19), 0.12, 0.55, 0.95
REGION_ACTIONS, VIEWS = ["approve", "add", "revoke", "remove"], ["active", "all", "hide"]


def batch_color(number: Column) -> Column:
    """Colour of a batch by its number, as #rrggbb: the palette, then hues a golden ratio apart."""
    n = F.greatest(number, F.lit(1))
    hue = F.pmod(n * F.lit(HUE_STEP), F.lit(1.0))
    hue = F.when((hue > YELLOW[0]) & (hue < YELLOW[1]), hue + YELLOW_SHIFT).otherwise(hue)
    sector = F.floor(hue * 6).cast("int")
    part = hue * 6 - sector
    low, down, up, high = F.lit(VALUE * (1 - SATURATION)), VALUE * (1 - SATURATION * part), VALUE * (1 - SATURATION * (1 - part)), F.lit(VALUE)
    parts = [(high, up, low), (down, high, low), (low, high, up), (low, down, high), (up, low, high), (high, low, down)]
    hexa = lambda k: F.format_string("%02x", F.rint(255 * F.when(sector % 6 == 0, parts[0][k]).when(sector % 6 == 1, parts[1][k]).when(sector % 6 == 2, parts[2][k]).when(sector % 6 == 3, parts[3][k]).when(sector % 6 == 4, parts[4][k]).otherwise(parts[5][k])).cast("int"))
    return F.when(n <= len(PALETTE), F.element_at(F.array(*[F.lit(c) for c in PALETTE]), n.cast("int"))).otherwise(F.concat(F.lit("#"), hexa(0), hexa(1), hexa(2)))


def resolved_events(events: DataFrame) -> DataFrame:
    """events(pair, seq, action, number, name, box) with the batch each one acts on (batch), how many there are (batches), whether it is refused.

    new starts a batch, or uses the first one while that is untouched and all batches are in scope; select makes one
    active. Choosing a batch that isn't there, an unknown view, a blank name, and approving in a finished batch are refused.
    """
    order = W.partitionBy("pair").orderBy("seq")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    action = F.col("action")
    switch = F.when(action == "finish", True).when(action == "reopen", False)
    scope = F.when(action.isin("new", "training", "active"), "active").when(action == "all", "all")
    no = F.lit(False)
    # while there is one batch, every event acts on it
    e = events.withColumn("_done", F.coalesce(F.last(switch, ignorenulls=True).over(before), no)).withColumn("_all", F.coalesce(F.last(scope, ignorenulls=True).over(before), F.lit("all")) == "all")
    touched = action.isin(*REGION_ACTIONS) & ~(action.isin("approve", "add") & F.col("_done"))
    e = e.withColumn("_touched", F.coalesce(F.bool_or(touched).over(before), no))
    blocked = (action == "new") & (F.col("_touched") | F.col("_done") | ~F.col("_all"))
    e = e.withColumn("_many", F.bool_or(blocked).over(upto))
    e = e.withColumn("batches", F.lit(1) + F.count_if((action == "new") & F.col("_many")).over(upto))
    known = (F.col("number") >= 1) & (F.col("number") <= F.col("batches"))
    chosen = F.when(action == "new", F.col("batches")).when((action == "select") & known, F.col("number"))
    e = e.withColumn("batch", F.coalesce(F.last(chosen, ignorenulls=True).over(upto), F.lit(1)).cast("long"))
    own = W.partitionBy("pair", "batch").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("_done", F.coalesce(F.last(switch, ignorenulls=True).over(own), no))
    refused = (action.isin("approve", "add") & F.col("_done")) | (action.isin("select", "training") & ~F.coalesce(known, no))
    refused |= ((action == "view") & ~F.coalesce(F.col("name").isin(*VIEWS), no)) | ((action == "rename") & (F.trim(F.coalesce("name", F.lit(""))) == ""))
    return e.withColumn("refused", refused).drop("_done", "_all", "_touched", "_many")


def pair_states(resolved: DataFrame) -> DataFrame:
    """(pair, batches, active, training, scope, view_mode, refused) after all events."""
    fine, action = ~F.col("refused"), F.col("action")
    last = lambda value, when: F.max_by(value, F.when(fine & when, F.col("seq")))
    shown = F.max(F.when(fine & action.isin("new", "select"), F.col("seq")))
    view, view_at = last(F.col("name"), action == "view"), F.max(F.when(fine & (action == "view"), F.col("seq")))
    trained = F.when(action == "training", F.col("number")).otherwise(F.col("batch"))
    scope = F.when(action == "all", "all").otherwise("active")
    return resolved.groupBy("pair").agg(
        F.max("batches").cast("long").alias("batches"), F.max_by("batch", "seq").alias("active"),
        F.coalesce(last(trained, action.isin("new", "training", "active")), F.lit(1)).cast("long").alias("training"),
        F.coalesce(last(scope, action.isin("new", "training", "active", "all")), F.lit("all")).alias("scope"),
        F.coalesce(F.when((view == "hide") & (shown > view_at), "active").otherwise(view), F.lit("active")).alias("view_mode"),
        F.count_if("refused").alias("refused"),
    )


def _member(regions: Column, event: Column) -> Column:
    rect = F.struct(*[event[c].alias(c) for c in BOX])
    kept = F.when(F.array_contains(regions, rect), regions).otherwise(F.array_append(regions, rect))
    return F.when(event["action"].isin("approve", "add"), kept).when(event["action"] == "remove", subtract_all(regions, F.array(rect))).otherwise(regions)


def batch_records(resolved: DataFrame) -> DataFrame:
    """(pair, batch, name, color, finished, revision, regions) of each batch with an event.

    approve and add make a rectangle a member, remove subtracts it, revoke is only noted; each of them is a
    revision. A batch's events are metadata: one row holds them.
    """
    action, box = F.col("action"), [F.col(c).cast("long").alias(c) for c in BOX]
    fine = resolved.where("NOT refused")
    name = F.max_by(F.trim("name"), F.when(action == "rename", F.col("seq")))
    done = F.max_by(action == "finish", F.when(action.isin("finish", "reopen"), F.col("seq")))
    events = F.array_sort(F.collect_list(F.when(action.isin(*REGION_ACTIONS), F.struct("seq", "action", *box))))
    out = fine.groupBy("pair", "batch").agg(F.coalesce(name, F.concat(F.lit("Batch "), F.first("batch").cast("string"))).alias("name"), F.coalesce(done, F.lit(False)).alias("finished"), F.count_if(action.isin(*REGION_ACTIONS)).alias("revision"), events.alias("_e"))
    return out.select("pair", "batch", "name", batch_color(F.col("batch")).alias("color"), "finished", "revision", F.aggregate("_e", F.array().cast(RECTS), _member).alias("regions"))


def first_batch(reviews: DataFrame) -> DataFrame:
    """(pair, batch, name, regions) that existing reviews (pair, review_cells, areas) start with."""
    return reviews.select("pair", F.lit(1).cast("long").alias("batch"), F.lit("Batch 1").alias("name"), F.coalesce("review_cells", "areas", F.array().cast(RECTS)).alias("regions"))


def selection(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(pair, scope, batch, name, revision, regions, signature) of what training reads: all, or the training batch."""
    own = records.select("pair", F.col("batch").alias("training"), "name", "revision", "regions")
    both = pairs.join(own, ["pair", "training"], "left")
    active = F.col("scope") == "active"
    columns = [F.when(active, F.col(c)).alias(n) for c, n in (("training", "batch"), ("name", "name"), ("revision", "revision"), ("regions", "regions"))]
    sign = F.when(active, F.concat_ws(":", F.lit("active"), F.col("training").cast("string"), F.coalesce("revision", F.lit(0)).cast("string"))).otherwise("all")
    return both.select("pair", "scope", *columns, sign.alias("signature"))


def preparation_problems(selected: DataFrame) -> DataFrame:
    """(pair, problem): pairs whose training batch is empty."""
    return selected.where((F.col("scope") == "active") & (F.coalesce(F.size("regions"), F.lit(0)) <= 0)).select("pair", F.concat(F.coalesce("name", F.lit("The batch")), F.lit(" is empty")).alias("problem"))


def restore_membership(records: DataFrame, before: DataFrame) -> DataFrame:
    """Records with the regions they had before; each that differs is a revision further. Batches that weren't there before stay."""
    old = before.select("pair", "batch", F.col("regions").alias("_old"))
    changed = F.col("_old").isNotNull() & (F.array_sort("_old") != F.array_sort("regions"))
    both = records.join(old, ["pair", "batch"], "left")
    return both.withColumns({"regions": F.when(changed, F.col("_old")).otherwise(F.col("regions")), "revision": F.col("revision") + F.when(changed, 1).otherwise(0)}).drop("_old")


def guarded(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs (pair, truth_id, height, width, registration array<double>) whose source still is what they were made for; any other fails the query."""
    now = sources.select("pair", *[F.col(c).alias(f"_{c}") for c in ("truth_id", "height", "width", "registration")])
    moved = F.exists(F.zip_with("registration", "_registration", lambda a, b: F.abs(a - b) > 1e-8), lambda x: F.coalesce(x, F.lit(True)))
    both = pairs.join(now, "pair")
    wrong = F.when(F.col("truth_id") != F.col("_truth_id"), F.raise_error(F.lit("these batches belong to another mask"))).when((F.col("height") != F.col("_height")) | (F.col("width") != F.col("_width")) | moved, F.raise_error(F.lit("the source's size or registration changed"))).otherwise(F.col("truth_id"))
    return both.withColumn("truth_id", wrong).select(*pairs.columns)


def stream_batches(events: DataFrame, apply, checkpoint: str):
    """Run apply(changed pairs, batch_id) on each micro-batch of events: the log is appended, then the pairs it names are folded anew."""
    def batch(df: DataFrame, batch_id: int) -> None:
        apply(df.select("pair").distinct(), batch_id)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
