"""Queries of models' stored documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import model_history
from gridloom.plans.queries import query
from gridloom.sources.rasters import table


def order_run(k: Column) -> Column:
    """The document of an order as a run; what a condition leaves null isn't in it."""
    price = F.col("o_totalprice")
    when = lambda condition, value: F.when(condition, value)
    evaluation = when(k % 6 == 0, F.struct(F.lit("trial").alias("mode"), (k % 9).alias("selected_patches"), F.lit(9).alias("available_patches")))
    points = F.array(*[F.struct((k % 5 + j).alias("epoch"), F.struct((price / 1e6 + j).alias("dice")).alias("validation"), (price * j).alias("loss")) for j in (1, 2)])
    folds = F.struct(F.array(F.struct((k % 4).alias("fold"), F.array(F.struct(points.alias("checkpoints"))).alias("history"))).alias("fold_results"))
    return F.struct(
        F.concat(F.lit("r"), k).alias("id"), k.cast("string").alias("revision"), when(k % 7 > 0, k.cast("string")).alias("saved_revision"), when(k % 2 == 0, F.concat(F.lit("/m/"), k, F.lit(".pt"))).alias("checkpoint"),
        when(k % 4 == 0, F.struct(F.lit("smp").alias("provider"), F.lit("fpn").alias("architecture"), F.lit("r18").alias("encoder"))).alias("spec"), when(k % 5 == 0, F.lit("none")).alias("notes"),
        F.struct((price / 1e6).alias("dice"), when(k % 5 > 0, price).alias("loss"), F.lit(True).alias("iou")).alias("metrics"),
        F.struct((k % 3 * 64).alias("base_channels"), (k % 50 + 64).alias("input_pixels"), (k % 2 == 0).alias("augment_flips"), (k % 3 == 0).alias("augment_rotations")).alias("config"),
        F.struct(
            F.col("o_orderstatus").alias("dataset_snapshot_id"), F.col("o_orderpriority").alias("mode"), (k % 90).alias("epochs"), (k % 100).alias("reviewed_pixels"), when(k % 3 > 0, F.lit(200)).alias("total_pixels"),
            F.struct(when(k % 11 > 0, F.lit("holdout")).alias("method"), evaluation.alias("evaluation")).alias("validation"), when(k % 13 == 0, F.struct(F.lit(1).alias("a"))).alias("crop_summary"),
            when(k % 8 < 3, points).alias("checkpoints"), when(k % 8 == 2, F.array(F.struct((k % 30).alias("patches"), F.struct((price / 1e5).alias("dice")).alias("metrics")))).alias("evaluations"), when(k % 8 == 7, folds).alias("cross_validation_report"), (k % 6).alias("retained_epoch"),
        ).alias("history"),
    )


def customer_models(spark, sf_dir) -> DataFrame:
    """(record VARIANT): customers as models, their orders as runs."""
    o, c = table(spark, sf_dir, "orders"), F.col("c_custkey")
    runs = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", order_run(F.col("o_orderkey")).alias("run")))), lambda r: r["run"]).alias("runs"), F.max("o_orderkey").alias("last"))
    both = table(spark, sf_dir, "customer").join(runs, F.col("o_custkey") == c, "left")
    record = F.struct(
        c.cast("string").alias("id"), F.col("c_name").alias("name"), F.coalesce(F.col("last").cast("string"), F.lit("none")).alias("revision"), (F.col("c_nationkey") % 20).cast("string").alias("task_id"), (c % 3 == 0).alias("favorite"),
        F.array(F.lit("a"), F.col("c_mktsegment")).alias("tags"), F.struct(F.lit("custom").alias("provider"), F.lit("unet").alias("architecture"), F.lit(32).alias("width"), F.lit("random").alias("initialization")).alias("spec"), F.lit("none").alias("saved_revision"),
        F.when(c % 2 == 0, F.concat(F.lit("/else/"), c)).alias("checkpoint"), (c * 100_000).alias("parameters"), F.struct(F.lit(0.25).alias("dice")).alias("metrics"), "runs",
    )
    return both.select(F.parse_json(F.to_json(record)).alias("record"))


def model_rows(spark, sf_dir) -> DataFrame:
    tasks = table(spark, sf_dir, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").cast("string").alias("task_id"), F.col("n_name").alias("task"))
    datasets = spark.createDataFrame([("F", "first"), ("O", "other")], "dataset_id string, dataset string")
    files = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.concat(F.lit("/m/"), "o_orderkey", F.lit(".pt")).alias("path"))
    return model_history.run_keys(model_history.run_rows(customer_models(spark, sf_dir), tasks, datasets, files, "/m"))


ROWS_SQL = """o AS (SELECT *, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS latest FROM orders),
j AS (SELECT c.*, o.*, k IS NULL AS bare, coalesce(latest, true) AS late, coalesce(CASE WHEN k % 2 = 0 THEN '/m/' || k || '.pt' END, CASE WHEN coalesce(latest, true) AND c_custkey % 2 = 0 THEN '/else/' || c_custkey END, '') AS cp FROM customer c LEFT JOIN o ON o_custkey = c_custkey),
rows AS (SELECT c_custkey::VARCHAR AS model_id, c_name AS model_name, coalesce('r' || k, c_custkey::VARCHAR) AS run_id, coalesce(k::VARCHAR, 'none') AS revision, coalesce(run, 1) AS run, '' AS date, (c_nationkey % 20)::VARCHAR AS task_id, coalesce(n_name, 'Unassigned') AS task, coalesce(o_orderstatus, '') AS dataset_id,
CASE o_orderstatus WHEN 'F' THEN 'first' WHEN 'O' THEN 'other' ELSE 'Not recorded' END AS dataset, CASE WHEN k % 4 = 0 THEN 'smp' WHEN late OR k % 3 > 0 THEN 'custom' ELSE '' END AS provider, CASE WHEN k % 4 = 0 THEN 'fpn' WHEN late OR k % 3 > 0 THEN 'unet' ELSE '' END AS architecture,
CASE WHEN k % 4 = 0 THEN 'r18' ELSE '' END AS encoder, CASE WHEN k % 4 = 0 THEN NULL WHEN late THEN 32 WHEN k % 3 > 0 THEN k % 3 * 64 END AS width, CASE WHEN k % 4 = 0 THEN '' WHEN late OR k % 3 > 0 THEN 'random' ELSE '' END AS initialization, CASE WHEN late THEN c_custkey * 100000 END AS parameters,
CASE WHEN bare THEN 'unknown' ELSE CASE WHEN k % 11 > 0 THEN 'holdout' WHEN k % 13 = 0 THEN 'sampled holdout' ELSE 'unknown' END || CASE WHEN k % 6 = 0 THEN ' · Trial validation (' || k % 9 || '/9)' ELSE '' END END AS validation, k % 90 AS epochs, k % 50 + 64 AS input_pixels,
coalesce(o_orderpriority, 'unknown') AS mode, c_custkey % 3 = 0 AS favorite, 'a, ' || c_mktsegment AS tags, CASE WHEN k % 5 = 0 THEN 'none' ELSE '' END AS notes, cp AS checkpoint,
CASE WHEN k % 3 > 0 THEN k % 100 / 200.0::DOUBLE END AS coverage, concat_ws(', ', CASE WHEN k % 3 = 0 THEN 'rotation' END, CASE WHEN k % 2 = 0 THEN 'flip' END) AS augmentation, CASE WHEN bare THEN 0.25 ELSE o_totalprice / 1e6 END AS dice, CASE WHEN k % 5 > 0 THEN o_totalprice END AS loss, NULL::DOUBLE AS iou,
CASE WHEN cp = '' THEN 'Not saved' WHEN cp LIKE '/m/%' AND k % 3 > 0 THEN 'Saved' ELSE 'Missing checkpoint' END || CASE WHEN NOT bare AND (k % 7 = 0 OR k IS NULL) THEN ' · unsaved weights' ELSE '' END AS status,
CASE WHEN cp = '' OR k % 7 = 0 THEN 'Unsaved' WHEN cp LIKE '/m/%' AND k % 3 > 0 THEN 'Managed' ELSE 'Missing' END AS file_status FROM j LEFT JOIN nation ON n_nationkey = c_nationkey % 20 AND n_nationkey < 15)"""
ROW_FIELDS = ["model_id", "model_name", "run_id", "revision", "run", "date", "task_id", "task", "dataset_id", "dataset", "provider", "architecture", "encoder", "width", "initialization", "parameters", "validation", "epochs", "input_pixels", "mode", "favorite", "tags", "notes", "checkpoint", "coverage", "augmentation", "dice", "loss", "iou", "status", "file_status"]


@query(f"WITH {ROWS_SQL} SELECT {', '.join(ROW_FIELDS)} FROM rows")
def model_run_rows(spark, sf_dir):
    """Runs of stored documents with all that falls back on histories and models."""
    return model_rows(spark, sf_dir).select(*ROW_FIELDS)


@query(f"WITH {ROWS_SQL} SELECT run_id, file_status, parameters FROM rows WHERE dataset_id = 'O' AND file_status = 'Managed' AND favorite AND parameters <= 90000000 AND contains(lower(model_name || ' ' || validation || ' ' || status), 'trial')")
def model_run_filters(spark, sf_dir):
    """Five filters at once."""
    found = model_history.filter_runs(model_rows(spark, sf_dir), dataset_id="O", status="Managed", favorites=True, max_parameters=90, text=" TRIAL ")
    return found.select("run_id", "file_status", "parameters")


POINTS_SQL = """j AS (SELECT unnest([1, 2]) AS j), p AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest FROM orders),
flat AS (SELECT c, n, 'Round ' || n || CASE WHEN k % 6 = 0 THEN ' · Trial validation' ELSE '' END AS series, k % 5 + j AS epoch, CASE WHEN k % 6 = 0 THEN 'trial' ELSE 'recorded' END AS scope, CASE WHEN k % 6 = 0 THEN k % 9 END AS patches, price * j AS training_loss, price / 1e6 + j AS dice FROM p, j WHERE k % 8 < 3
UNION ALL SELECT c, n, 'Round ' || n || ' · Full validation', k % 6, 'full', k % 30, NULL, price / 1e5 FROM p WHERE k % 8 = 2),
pts AS (SELECT * FROM flat UNION ALL SELECT c, n, 'Fold ' || k % 4, k % 5 + j, 'recorded', NULL, price * j, price / 1e6 + j FROM p, j WHERE newest AND k % 8 = 7 AND c NOT IN (SELECT c FROM flat))"""


def customer_histories(spark, sf_dir) -> DataFrame:
    models = customer_models(spark, sf_dir)
    m = F.col("record")
    return models.select(model_history.words(m, "id").alias("model_id"), F.posexplode(model_history.part(m, "runs", "array<variant>")).alias("_n", "_r")).select("model_id", (F.col("_n") + 1).cast("long").alias("round"), model_history.part(F.col("_r"), "history").alias("h"), model_history.words(F.col("_r"), "id").alias("run_id"))


@query(f"WITH {POINTS_SQL} SELECT c::VARCHAR AS model_id, n AS round, series, epoch::DOUBLE AS epoch, scope, patches, training_loss, dice FROM pts")
def model_history_points(spark, sf_dir):
    """Learning curves of whole histories: trials, later evaluations, folds where there is nothing else."""
    points = model_history.history_points(customer_histories(spark, sf_dir).drop("run_id"), ["model_id"])
    return points.select("model_id", "round", "series", "epoch", "scope", "patches", "training_loss", "dice")


@query("""WITH j AS (SELECT unnest([1, 2]) AS j), p AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
q AS (SELECT k, c, n, k % 5 + j AS epoch, CASE WHEN k % 6 = 0 THEN 'trial' ELSE 'recorded' END AS scope, price / 1e6 + j AS dice FROM p, j WHERE k % 8 < 3 OR k % 8 = 7 UNION ALL SELECT k, c, n, k % 6, 'full', price / 1e5 FROM p WHERE k % 8 = 2)
SELECT 'r' || k AS run_id, c_name || ' / run ' || n || ' [' || left(c::VARCHAR, 6) || ']' || CASE WHEN k % 8 = 7 THEN '' WHEN (k % 8 = 2 OR k % 6 = 0) AND scope = 'trial' THEN ' · Trial validation' WHEN scope = 'full' THEN ' · Full validation' ELSE '' END AS series, epoch::DOUBLE AS epoch, dice FROM q JOIN customer ON c_custkey = c""")
def model_run_points(spark, sf_dir):
    """The curve of each run alone, named by model, run and what it was judged on."""
    histories = customer_histories(spark, sf_dir).select("run_id", "round", "h")
    return model_history.run_points(model_rows(spark, sf_dir), histories).select("run_id", "series", "epoch", "dice")
