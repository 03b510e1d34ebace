"""Runs and learning curves of models whose records are kept as JSON documents, read as VARIANT columns.

A model's record has its own fields and a list of runs, each with its history (configuration, source, validation, checkpoints). What a
run lacks comes from its history, and from the model only for the model's latest revision: scores of another run are never shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.catalog import comparison_key, file_status
from gridloom.plans.shared import materialize

#: Scores of a run, and words for what a configuration switches on. Fixed values.
METRICS = ("dice", "iou", "precision", "recall", "loss")
AUGMENTATION = {"augment_rotations": "rotation", "augment_flips": "flip", "augment_intensity": "intensity"}
#: Fields that a text is searched in. Fixed values.
SEARCHED = (
    "model_name", "run", "date", "task", "dataset", "provider", "architecture", "encoder", "width", "initialization", "parameters", *METRICS, "validation", "epochs", "learning_rate", "batch_size", "crop_pixels",
    "input_pixels", "image", "annotations", "coverage", "training_patches", "validation_patches", "steps", "augmentation", "seconds", "device", "mode", "favorite", "tags", "notes", "status", "model_id", "run_id",
    "revision", "dataset_id", "checkpoint", "file_status",
)
NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def part(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def words(v: Column, path: str) -> Column:
    return part(v, path, "string")


def number(v: Column, path: str) -> Column:
    """A number of a document as a double; null for truth values, texts and what isn't there."""
    found = part(v, path)
    return F.when(F.schema_of_variant(found).rlike(NUMBER), part(v, path, "double"))


def whole(v: Column, path: str) -> Column:
    return number(v, path).cast("long")


def filled(v: Column) -> Column:
    """A part that is there and isn't empty."""
    return F.when(~F.to_json(v).isin("{}", "[]", "null", '""'), v)


def first_of(*values: Column) -> Column:
    return F.coalesce(*values)


def run_rows(models: DataFrame, tasks: DataFrame, datasets: DataFrame, files: DataFrame | None = None, folder: str | None = None, loaded: DataFrame | None = None) -> DataFrame:
    """One row for each run of models (record VARIANT), or one for a model without runs.

    tasks: (task_id, task); datasets: (dataset_id, dataset); files: (path) of checkpoints that are there, those under ``folder`` are managed;
    loaded: (model_id, revision) of networks in memory.
    """
    m = F.col("record")
    every = models.select("record", F.posexplode_outer(part(m, "runs", "array<variant>")).alias("_pos", "_run"))
    last = F.try_element_at(part(m, "history", "array<variant>"), F.lit(-1))
    r, none = F.col("_run"), F.col("_run").isNull()
    own = every.select(
        "record", "_run", (F.coalesce("_pos", F.lit(0)) + 1).cast("long").alias("run"), words(m, "id").alias("model_id"), F.when(none, words(m, "id")).otherwise(words(r, "id")).alias("run_id"),
        F.when(none, words(m, "revision")).otherwise(words(r, "revision")).alias("revision"), F.when(none, last).otherwise(part(r, "history")).alias("h"),
    )
    own = own.withColumn("latest", F.col("revision").eqNullSafe(words(m, "revision")))
    h, latest = F.col("h"), F.col("latest")
    own = own.withColumn("c", first_of(part(r, "config"), part(h, "config")))
    c = F.col("c")
    own = own.withColumn("spec", first_of(filled(part(r, "spec")), filled(part(c, "model_spec")), F.when(latest, part(m, "spec"))))
    own = own.withColumn("scores", first_of(part(r, "metrics"), part(h, "retained_validation"), F.when(latest, part(m, "metrics")))).withColumn("summary", first_of(part(h, "dataset_summary"), part(h, "crop_summary")))
    spec, channels = F.col("spec"), whole(c, "base_channels")
    plain = ~latest & spec.isNull() & (channels > 0)  # networks from before there were specifications
    told = lambda name, old: first_of(words(spec, name), F.when(plain, F.lit(old)), F.lit(""))
    checkpoint = first_of(F.when(words(r, "checkpoint") != "", words(r, "checkpoint")), F.when(latest, words(m, "checkpoint")), F.lit(""))
    saved = F.when(part(r, "saved_revision").isNotNull(), words(r, "saved_revision")).when(latest, words(m, "saved_revision"))
    method = first_of(words(h, "validation.method"), F.when(filled(part(h, "crop_summary")).isNotNull(), "sampled holdout"), F.lit("unknown"))
    trial = words(h, "validation.evaluation.mode") == "trial"
    seen = F.concat(F.lit(" · Trial validation ("), words(h, "validation.evaluation.selected_patches"), F.lit("/"), words(h, "validation.evaluation.available_patches"), F.lit(")"))
    total = number(h, "total_pixels")
    rows = own.select(
        "model_id", words(m, "name").alias("model_name"), "run_id", "revision", "run", first_of(words(h, "started_at_utc"), F.lit("")).alias("date"), words(m, "task_id").alias("task_id"),
        first_of(words(h, "dataset_snapshot_id"), F.lit("")).alias("dataset_id"), words(h, "source.image_layer").alias("_image"), told("provider", "custom").alias("provider"), told("architecture", "unet").alias("architecture"),
        F.when(words(spec, "provider") == "smp", first_of(words(spec, "encoder"), F.lit(""))).otherwise("").alias("encoder"), first_of(whole(spec, "width"), F.when(plain, channels)).alias("width"), told("initialization", "random").alias("initialization"),
        first_of(whole(r, "parameters"), F.when(latest, whole(m, "parameters"))).alias("parameters"), F.concat(method, F.when(trial, seen).otherwise("")).alias("validation"),
        whole(h, "epochs").alias("epochs"), whole(h, "steps").alias("steps"), number(h, "learning_rate").alias("learning_rate"), whole(c, "batch_size").alias("batch_size"),
        first_of(whole(c, "crop_pixels"), whole(h, "crop_pixels")).alias("crop_pixels"), whole(c, "input_pixels").alias("input_pixels"), number(h, "duration_seconds").alias("seconds"),
        first_of(words(h, "device"), F.lit("")).alias("device"), first_of(words(h, "mode"), F.lit("unknown")).alias("mode"), first_of(part(m, "favorite", "boolean"), F.lit(False)).alias("favorite"),
        F.array_join(first_of(part(m, "tags", "array<string>"), F.array().cast("array<string>")), ", ").alias("tags"), first_of(words(r, "notes"), F.lit("")).alias("notes"), checkpoint.alias("checkpoint"),
        (~saved.eqNullSafe(F.col("revision"))).alias("_dirty"), first_of(words(h, "source.image_layer"), F.lit("")).alias("image"), first_of(words(h, "source.ground_truth_layer"), F.lit("")).alias("annotations"),
        F.when(total > 0, first_of(number(h, "reviewed_pixels"), F.lit(0.0)) / total).alias("coverage"), whole(F.col("summary"), "training.total").alias("training_patches"), whole(F.col("summary"), "validation.total").alias("validation_patches"),
        F.concat_ws(", ", *[F.when(part(c, k, "boolean"), w) for k, w in AUGMENTATION.items()]).alias("augmentation"), *[number(F.col("scores"), k).alias(k) for k in METRICS], F.to_json(part(h, "validation")).alias("split"),
    )
    none_of = lambda schema: models.sparkSession.createDataFrame([], schema)
    there = (files if files is not None else none_of("path string")).select(F.col("path").alias("checkpoint"), F.lit(True).alias("_there")).distinct()
    held = (loaded if loaded is not None else none_of("model_id string, revision string")).select("model_id", "revision", F.lit(True).alias("_loaded")).distinct()
    rows = rows.join(tasks, "task_id", "left").join(datasets, "dataset_id", "left").join(there, "checkpoint", "left").join(held, ["model_id", "revision"], "left")
    known = F.col("checkpoint") != ""
    kept = F.when(known & F.col("_there"), "Saved").when(known, "Missing checkpoint").when(F.col("_loaded"), "In memory").otherwise("Not saved")
    managed = F.col("checkpoint").startswith(f"{folder.rstrip('/')}/") if folder else F.lit(False)
    named = {
        "task": F.coalesce("task", F.lit("Unassigned")), "dataset": first_of(F.col("dataset"), F.col("_image"), F.lit("Not recorded")),
        "status": F.concat(kept, F.when(F.col("_dirty"), " · unsaved weights").otherwise("")),
        "file_status": file_status(F.when(~F.col("_dirty") & known, F.col("checkpoint")), F.coalesce("_there", F.lit(False)), managed),
    }
    return rows.withColumns(named).drop("_image", "_dirty", "_there", "_loaded")


def run_keys(rows: DataFrame) -> DataFrame:
    """run_rows() with what two runs must share to be compared: task, dataset, sizes and split; null where that isn't known."""
    held = rows.withColumn("_dataset", F.when(F.col("dataset_id") != "", F.col("dataset_id")))
    return comparison_key(held, "_dataset", "validation", ["task_id", "crop_pixels", "input_pixels", "split"]).drop("_dataset")


def filter_runs(rows: DataFrame, task_id: str | None = None, dataset_id: str | None = None, status: str | None = None, favorites: bool = False, max_parameters: float = 0, comparable_with: str | None = None, text: str = "") -> DataFrame:
    """Rows of run_keys() that pass every filter that is set: task, dataset, state of the file, favourites, millions of parameters, comparable runs, a text in any field in any case."""
    for column, value in (("task_id", task_id), ("dataset_id", dataset_id), ("file_status", status), ("comparison_key", comparable_with)):
        if value:
            rows = rows.where(F.col(column) == value)
    if favorites:
        rows = rows.where("favorite")
    if max_parameters:
        rows = rows.where(F.col("parameters") <= max_parameters * 1_000_000)
    if text.strip():
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCHED])), F.lit(text.strip().lower())))
    return rows


def history_points(histories: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, round, series, epoch, axis, scope, patches, step, training_loss, scores) of histories (keys, round, h VARIANT).

    Points are the validated checkpoints of each round, as trial or full validation, and full evaluations made later. Only if none of a key's rounds
    has any, the folds of its last round's cross-validation report give them. The histories are made once and kept as a table, however often
    they are read.
    """
    h = F.col("h")
    base = materialize(histories.select(*keys, "round", "h"), "histories").select(*keys, "round", "h", (words(h, "validation.evaluation.mode") == "trial").alias("_t")).withColumn("_trial", F.coalesce("_t", F.lit(False)))
    p = F.col("p")
    scores = lambda v: [number(v, k).alias(k) for k in METRICS]
    name = F.concat(F.lit("Round "), F.col("round").cast("string"))
    step, loss = words(p, "step"), first_of(number(p, "training_loss_last_batch"), number(p, "loss"))
    checkpoints = base.select("*", F.explode(part(h, "checkpoints", "array<variant>")).alias("p")).where(filled(part(p, "validation")).isNotNull()).select(
        *keys, "round", F.concat(name, F.when(F.col("_trial"), " · Trial validation").otherwise("")).alias("series"), first_of(number(p, "epoch"), number(p, "step"), F.lit(0.0)).alias("epoch"),
        F.when(part(p, "epoch").isNotNull(), "epoch").otherwise("step").alias("axis"), F.when(F.col("_trial"), "trial").when(words(h, "workflow") == "coverage", "full").otherwise("recorded").alias("scope"),
        first_of(whole(h, "validation.evaluation.selected_patches"), whole(h, "dataset_summary.validation.total")).alias("patches"), step.alias("step"), loss.alias("training_loss"), *scores(part(p, "validation")),
    )
    later = base.select("*", F.explode(part(h, "evaluations", "array<variant>")).alias("p")).select(
        *keys, "round", F.concat(name, F.lit(" · Full validation")).alias("series"), first_of(number(h, "retained_epoch"), F.lit(0.0)).alias("epoch"), F.lit("epoch").alias("axis"), F.lit("full").alias("scope"),
        whole(p, "patches").alias("patches"), words(p, "training_steps").alias("step"), F.lit(None).cast("double").alias("training_loss"), *scores(part(p, "metrics")),
    )
    found = materialize(checkpoints.unionByName(later), "history-points")
    newest = base.groupBy(*keys).agg(F.max("round").alias("round"))
    bare = base.where(part(h, "cross_validation_report").isNotNull()).join(newest, [*keys, "round"], "left_semi").join(found.select(*keys).distinct(), keys, "left_anti")
    folds = bare.select(*keys, "round", F.explode(part(h, "cross_validation_report.fold_results", "array<variant>")).alias("f"))
    rounds = folds.select(*keys, "round", words(F.col("f"), "fold").alias("fold"), F.explode(part(F.col("f"), "history", "array<variant>")).alias("r"))
    points = rounds.select("*", F.explode(part(F.col("r"), "checkpoints", "array<variant>")).alias("p")).where(filled(part(p, "validation")).isNotNull())
    return found.unionByName(points.select(
        *keys, "round", F.concat(F.lit("Fold "), F.col("fold")).alias("series"), first_of(number(p, "epoch"), F.lit(0.0)).alias("epoch"), F.lit("epoch").alias("axis"), F.lit("recorded").alias("scope"),
        F.lit(None).cast("long").alias("patches"), step.alias("step"), loss.alias("training_loss"), *scores(part(p, "validation")),
    ))


def run_points(rows: DataFrame, histories: DataFrame) -> DataFrame:
    """history_points() of each run's own last record: histories (run_id, round, h) are cumulative. Series are named by model and run, and by what they were judged on where that differs."""
    newest = histories.groupBy("run_id").agg(F.max_by("h", "round").alias("h"))
    h = F.col("h")
    judged = part(h, "evaluations").isNotNull() | (words(h, "validation.evaluation.mode") == "trial")
    points = history_points(newest.withColumn("round", F.lit(1)), ["run_id"]).join(newest.select("run_id", F.coalesce(judged, F.lit(False)).alias("_judged")), "run_id").drop("round")
    named = points.join(rows.select("run_id", "model_id", "model_name", "run"), "run_id")
    scope = F.when(F.col("_judged") & (F.col("scope") == "trial"), " · Trial validation").when(F.col("_judged") & (F.col("scope") == "full"), " · Full validation").otherwise("")
    series = F.concat(F.col("model_name"), F.lit(" / run "), F.col("run").cast("string"), F.lit(" ["), F.substring("model_id", 1, 6), F.lit("]"), scope)
    return named.withColumn("series", series).drop("_judged", "model_id", "model_name", "run")
