import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import algebra, catalog, metrics, patches, stitch
from gridloom.streaming import activity


def test_hand_counted_scores(spark):
    rows = [(2, 1, 1), (0, 0, 0), (0, 3, 2), (7, 0, 0)]
    got = [(round(r.precision, 6), round(r.recall, 6), round(r.dice, 6), round(r.iou, 6)) for r in metrics.scores(spark.createDataFrame(rows, "tp long, fp long, fn long")).collect()]
    assert got == [(0.666667, 0.666667, 0.666667, 0.5), (0, 0, 0, 0), (0, 0, 0, 0), (1, 1, 1, 1)]
    assert metrics.macro(spark.createDataFrame(rows, "tp long, fp long, fn long")).first().iou == pytest.approx(0.5)


def test_confusion_within_valid_pixels(spark):
    m = lambda *v: spark.createDataFrame([(0, i, x) for i, x in enumerate(v) if x], "y long, x long, v long")
    valid = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "y long, x long")
    got = {r["class"]: (r.tp, r.fp, r.fn) for r in metrics.confusion(m(1, 1, 0, 1), m(1, 2, 2, 1), valid, ["y", "x"]).collect()}
    assert got == {1: (1, 1, 0), 2: (0, 0, 2)}


def test_plateau_reduces_once_then_stops():
    assert metrics.plateau([1, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9], 2, 3) == ["continue", "continue", "continue", "reduce", "continue", "continue", "stop"]
    assert metrics.plateau([1, 0.99995, 0.9999], 1, 1) == ["continue", "reduce", "stop"]  # too small to count
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            metrics.plateau([1, bad])
    with pytest.raises(ValueError):
        metrics.plateau([1], 0)


def brute_folds(blocks, count):
    """Blocks one after the other, each to the fold with the fewest patches of all kinds."""
    loads, out = [0] * count, {}
    for kind in (True, False):
        rows = [b for b in blocks if b[1] is kind]
        rows.sort(key=lambda b: (-b[2], hashlib.md5(f"42:{b[0]}".encode()).hexdigest()))
        for name, _, size in rows:
            fold = loads.index(min(loads))
            out[name] = fold
            loads[fold] += size
    return out, loads


@pytest.mark.parametrize("count", [2, 3, 5, 10])
def test_folds_keep_one_load_over_both_kinds(count):
    rng = random.Random(count)
    blocks = [(f"{i}:0", i % 3 == 0, rng.randint(1, 9)) for i in range(47)]
    want, loads = brute_folds(blocks, count)
    assert dict(patches.spatial_folds(blocks, count)) == want
    assert max(loads) - min(loads) <= 9


def test_folds_that_cant_be_made(spark):
    blocks = [("a", True, 1), ("b", True, 1), ("c", False, 3)]
    for count in (1, 3, 11):
        with pytest.raises(ValueError):
            patches.spatial_folds(blocks, count)
    rows = [("a", True, 4, 1), ("b", True, 4, 4), ("c", False, 4, 0)]
    table = spark.createDataFrame(rows, "block string, contains_foreground boolean, reviewed_pixels long, foreground_pixels long")
    folds = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0)], "block string, fold long")
    assert {(r.fold, r.split, r.problem) for r in patches.fold_problems(table, folds).collect()} == {(1, "validation", "no reviewed background"), (0, "train", "no reviewed background")}
    split = table.withColumn("split", F.when(F.col("block") == "b", "validation").otherwise("train"))
    assert [(r.split, r.problem) for r in patches.split_problems(split).collect()] == [("validation", "no reviewed background")]


def test_subset_sizes():
    assert patches.subset_size(1225, percentage=10) == 123
    assert patches.subset_size(10, count=50) == 10 and patches.subset_size(10, percentage=0.1) == 1
    for bad in ({"percentage": 0}, {"percentage": 101}, {"count": 0}, {}):
        with pytest.raises(ValueError):
            patches.subset_size(10, **bad)
    assert patches.stratum_sizes(100, 25, 10) == (3, 7) and patches.stratum_sizes(100, 99, 10) == (9, 1) and patches.stratum_sizes(100, 1, 10) == (1, 9)
    assert patches.stratum_sizes(10, 10, 4) == (4, 0) and patches.stratum_sizes(10, 4, 1) == (1, 0) and patches.stratum_sizes(10, 4, 10) == (4, 6) and patches.stratum_sizes(10, 9, 5) == (4, 1)


def test_subset_of_one_patch_holds_both(spark):
    train = spark.createDataFrame([(1, True, 4, 4), (2, True, 4, 2), (3, False, 4, 0)], "k long, contains_foreground boolean, reviewed_pixels long, foreground_pixels long")
    assert [r.k for r in patches.subset_stratified(train, "1", ("k",), count=1).collect()] == [2]
    assert patches.subset_stratified(train, "1", ("k",), count=9).count() == 3
    with pytest.raises(ValueError):
        patches.subset_stratified(train.where("k = 3"), "1", ("k",), count=1)


def test_split_holds_out_both_kinds(spark):
    blocks = spark.createDataFrame([(str(i), i % 2 == 0, i in (0, 1, 2)) for i in range(20)], "block string, positive boolean, forbidden boolean")
    out = {r.block: r.split for r in patches.holdout(blocks, 0.25, "1").collect()}
    held = [int(b) for b, s in out.items() if s == "validation"]
    # a quarter of all ten with targets, of the nine free ones without
    assert out["0"] == out["1"] == out["2"] == "train" and sum(b % 2 == 0 for b in held) == 2 and sum(b % 2 for b in held) == 2
    seen = blocks.withColumn("forbidden", F.col("positive"))
    assert sum(r.split == "validation" and int(r.block) % 2 == 0 for r in patches.holdout(seen, 0.25, "1").collect()) == 2
    with pytest.raises(Exception, match="two blocks"):
        patches.holdout(blocks.where("NOT positive OR block = '4'"), 0.25, "1").collect()
    with pytest.raises(ValueError):
        patches.holdout(blocks, 0.6, "1")


def test_short_axes_have_blocks_of_one():
    assert patches.block_spans(64, 48, 16) == (2, 1) and patches.block_spans(49, 64, 16) == (2, 2)


def test_preview_takes_both_ends(spark):
    rows = [(i, "train", True) for i in range(11)] + [(i, "validation", False) for i in range(2)]
    found = patches.preview(spark.createDataFrame(rows, "k long, split string, contains_foreground boolean"), 16, ("k",)).collect()
    assert sorted(r.k for r in found if r.split == "train") == [0, 3, 6, 10] and sorted(r.k for r in found if r.split == "validation") == [0, 1]


def test_pooled_images_stay_in_their_group(spark):
    rows = spark.createDataFrame([(1, "0:0"), (2, "0:0"), (3, "1:0")], "image_id long, block string")
    pairs = spark.createDataFrame([(1, " s "), (2, "s"), (3, None)], "image_id long, group string")
    assert {(r.image_id, r.block, r.source_block) for r in patches.pool_pairs(rows, pairs).collect()} == {(1, "s", "0:0"), (2, "s", "0:0"), (3, "3", "1:0")}
    with pytest.raises(Exception, match="stands twice"):
        patches.pool_pairs(rows, pairs.unionByName(pairs.where("image_id = 1"))).collect()
    with pytest.raises(Exception, match="two groups"):
        patches.pool_pairs(rows, pairs.where("image_id < 3")).collect()


def test_merged_blocks_take_the_smallest_key(spark):
    pixels = spark.createDataFrame([(0, 0, 1), (0, 5, 1), (0, 9, 1), (20, 0, 2)], "y long, x long, component long")
    assert {r.block: r.merged for r in patches.merge_blocks(pixels, 2).collect()} == {"0:0": "0:0", "0:1": "0:0", "0:2": "0:0", "5:0": "5:0"}


def test_nearest_resize(spark):
    labels = spark.createDataFrame([(y, x, 10 * y + x) for y in range(4) for x in range(4)], "y long, x long, v long")
    assert {(r.y, r.x): r.v for r in patches.resize_nearest(labels, (4, 4), (2, 2)).collect()} == {(0, 0): 11, (0, 1): 13, (1, 0): 31, (1, 1): 33}


def test_epoch_repeats_positives_only(spark):
    train = spark.createDataFrame([(i, i < 3) for i in range(10)], "k long, contains_foreground boolean")
    rows = patches.epoch_order(train, 0.5, "1", ("k",)).collect()
    assert len(rows) == 15 and all(r.k < 3 for r in rows if r.draw)


def test_names_and_tags(spark):
    assert catalog.name_part("Élan vital / №1") == "Elan-vital-No1" and catalog.name_part("ab cd", 3) == "ab" and catalog.name_part(None) == ""
    assert catalog.checkpoint_name("Çelik", "unet-w16", 3, "0123456789", "Plate 4", input_pixels=256, started="2024-05-06T23:30:00-02:00") == "Celik_Plate-4_unet-w16_in256_run03_20240507_01234567.pt"
    assert catalog.checkpoint_name("", "", 1, "r", started="soon") == "model_network_run01_undated_r.pt"
    assert catalog.unique_name("mask", {"mask", "mask 2"}) == "mask 3"
    assert spark.range(1).select(catalog.ordered_tags(F.lit(" b, a ,,b")).alias("t")).first().t == ["b", "a"]
    assert catalog.unet_parameters(1, 1, [2]) == 18 + 2 + 36 + 2 + 2 + 1


def test_tasks_and_outputs(spark):
    tasks = catalog.add_task(spark.createDataFrame([], "task_id string, name string, definition string, class_names array<string>"), "1", " cells ", "all of them", ("a", "b"))
    assert tuple(tasks.first()) == ("1", "cells", "all of them", ["a", "b"])
    for bad in (("2", " ", "x", ()), ("2", "x", "", ()), ("2", "x", "y", ("a", "A"))):
        with pytest.raises(ValueError):
            catalog.add_task(tasks, *bad)
    assert algebra.output_layer(["m", "n"], "union", True) == ("m", True) and algebra.output_layer(["m", "m votes"], "votes", True) == ("m votes 2", False)


def test_snapshot_ignores_row_order(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("k"))
    one = catalog.snapshot_id(df, ["id", "k"]).first().snapshot
    assert one == catalog.snapshot_id(df.orderBy(F.desc("id")).repartition(3), ["id", "k"]).first().snapshot
    assert one != catalog.snapshot_id(df.where("id > 0"), ["id", "k"]).first().snapshot


def test_tiles_cover_every_pixel():
    for size, tile in ((10, 16), (100, 16), (64, 16), (17, 16)):
        starts = stitch.tile_starts(size, tile)
        assert {p for s in starts for p in range(s, min(s + tile, size))} == set(range(size)) and max(starts) + min(tile, size) == size
    assert stitch.tile_starts(100, 16, 50, 60) == [50] and stitch.tile_starts(100, 16, 95, 100) == [84]


def brute_prediction(image, tile, scorer):
    """Tiles one after the other, weighted by NumPy's Hann window with a floor."""
    n = min(tile, *image.shape)
    ramp = np.maximum(np.hanning(n), 0.05)
    total, weight = np.zeros(image.shape), np.zeros(image.shape)
    for y in stitch.tile_starts(image.shape[0], n):
        for x in stitch.tile_starts(image.shape[1], n):
            p = np.clip(scorer(stitch.normalized(image[y : y + n, x : x + n])), 0, 1)
            total[y : y + n, x : x + n] += p * np.outer(ramp, ramp)
            weight[y : y + n, x : x + n] += np.outer(ramp, ramp)
    return total / weight


def test_prediction_like_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    image = rng.normal(size=(30, 23))
    scorer = lambda a: a * np.linspace(0, 1.2, len(a))[:, None]
    stitch.SCORERS["loop"] = scorer
    pixels = spark.createDataFrame([(y, x, float(image[y, x])) for y in range(30) for x in range(23)], "y long, x long, value double")
    found = np.zeros((30, 23))
    for r in stitch.predict(pixels, 30, 23, 12, "loop").collect():
        found[r.y, r.x] = r.p
    assert np.allclose(found, brute_prediction(image, 12, scorer), atol=1e-9)
    part = stitch.predict(pixels, 30, 23, 12, "loop", bounds=(-3, 20, 9, 99)).collect()
    assert {(r.y, r.x) for r in part} == {(y, x) for y in range(9) for x in range(20, 23)}
    assert stitch.predict(pixels, 30, 23, 12, "loop", input_pixels=6).count() == 690
    with pytest.raises(ValueError):
        stitch.predict(pixels, 30, 23, 12, "loop", bounds=(40, 0, 50, 5))


def test_batch_membership(spark):
    rows = [(1, 1, "add", 5), (1, 2, "add", 6), (1, 3, "remove", 5), (1, 4, "finish", 0), (1, 5, "add", 7), (1, 6, "approve", 6), (1, 7, "reopen", 0), (1, 8, "revoke", 6), (1, 9, "add", 8), (2, 1, "approve", 1)]
    events = spark.createDataFrame(rows, "batch_id long, seq long, action string, region long")
    columns = ["batch_id", "regions", "finished", "rejected", "events"]
    assert {tuple(r) for r in activity.batch_states(events).select(columns).collect()} == {(1, 2, False, 2, 9), (2, 0, False, 0, 1)}


def test_ready_reports_expire_and_errors_come_first(spark):
    rows = [("a", "busy", 1, 0, True, 1), ("a", "ready", 2, 0, True, 2), ("b", "warning", 1, 5, True, 3), ("c", "ready", 0, 0, False, 4), ("view", "busy", 9, 90, True, 5), ("camera", "busy", 9, 0, True, 6)]
    reports = spark.createDataFrame(rows, "source string, state string, at long, priority int, transient boolean, seq long")
    ranks = lambda now: {r.source: r["rank"] for r in activity.source_activity(reports, now).collect()}
    assert ranks(5) == {"a": 100, "b": 125, "c": 100, "view": -10, "camera": 50} and set(ranks(6)) == {"b", "c", "view", "camera"}
    assert activity.current_activity(reports, 5).first().source == "b"
    worse = reports.unionByName(spark.createDataFrame([("view", "error", 9, 0, True, 7)], reports.schema))
    assert activity.current_activity(worse, 5).first().source == "view"
    none = activity.current_activity(reports.where("source = 'a'"), 100).first()
    assert (none.source, none.state) == ("view", "idle")
    twice = reports.unionByName(reports.where("source = 'b'").withColumn("seq", F.lit(9).cast("long")).withColumn("at", F.lit(8).cast("long")))
    assert activity.changes_only(twice).count() == reports.count()
    log = reports.withColumn("details", F.col("state"))
    assert [r.source for r in activity.activity_log(log).collect()] == ["c", "b", "a", "a"]


def test_streams_of_edits(spark, tmp_path):
    source, out = tmp_path / "in", []
    spark.sql("SELECT 'm' AS layer, 'a' AS source, timestamp_seconds(t) AS ts, t AS y0, t AS x0, t + 1 AS y1, t + 1 AS x1 FROM VALUES (1.0), (1.2), (9.0), (60.0) v(t)").write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    activity.stream_dirty(stream, lambda df, i: out.extend(df.collect()), str(tmp_path / "c1")).awaitTermination()
    assert [(float(r.y0), float(r.y1)) for r in out] == [(1.0, 61.0)]
    run = activity.stream_sessions(stream, "400 milliseconds").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.edits for r in spark.table("sessions").collect()) == [1, 2]


def test_losses_without_known_pixels(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, 1, 0), (1, 1, 0.5, 0, 0), (2, 0, 0.5, 1, 1), (2, 1, 0.2, 0, 0)], "g int, channel int, p double, t int, valid int")
    found = {r.g: (r.loss, r.channels) for r in metrics.multilabel_loss(rows, ["g"]).collect()}
    assert found[1] == (0.0, 0) and found[2][1] == 1 and found[2][0] > 0
    classes = spark.createDataFrame([(1, 0, 0, 0.7, 0, 0), (1, 0, 1, 0.3, 0, 0), (2, 0, 0, 0.7, 0, 1), (2, 0, 1, 0.3, 0, 1)], "g int, pixel int, class int, p double, t int, valid int")
    found = {r.g: r.loss for r in metrics.class_loss(classes, ["g"], ["pixel"]).collect()}
    assert found[1] == 0.0 and found[2] > 0


def test_names_of_networks():
    assert catalog.network_name({}) == "unet" and catalog.network_name({"provider": "smp", "architecture": "fpn", "encoder": "resnet18"}) == "smp-fpn-resnet18"
    assert catalog.network_name({"provider": "custom", "architecture": "unet"}, 16) == "unet-w16" and catalog.network_name({"provider": "monai", "architecture": "net", "width": 8}) == "monai-net-w8"
    name = catalog.checkpoint_name("Cells", {"provider": "smp"}, 3, "abc", ["a", "b"], "day 1", 256, "2024-02-03T04:05:06Z")
    assert name == "Cells_multiple-images_day-1_smp-unet-encoder_in256_run03_20240203_abc.pt"


def test_label_values_must_differ(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 4)], "layer int, y long, x long, v long")
    for values, background in (([5], 0), ([5, 5], 0), ([5, 0], 0), ([5, 6], 6)):
        with pytest.raises(ValueError, match="different"):
            algebra.compose_last_wins(rows, values, background, (2, 2))
    with pytest.raises(ValueError, match="shape"):
        algebra.merge_same(rows, 5, 9)
    assert sorted(tuple(r) for r in algebra.compose_last_wins(rows, [8, 6], 2, (1, 2)).select("y", "x", "v").collect()) == [(0, 0, 6), (0, 1, 2)]


def test_folds_of_any_number_of_blocks(spark):
    rng = random.Random(11)
    for count, n in ((2, 9), (5, 300), (10, 1500)):
        blocks = [(str(i), rng.random() < 0.3 or i < count, rng.choice([1, 1, 1, 2, 4, 7])) for i in range(n)]
        found = patches.assign_folds(spark.createDataFrame(blocks, "block string, positive boolean, size long"), count).collect()
        assert {r.block: r.fold for r in found} == dict(patches.spatial_folds(blocks, count))
    few = spark.createDataFrame([("a", True, 1), ("b", False, 1)], "block string, positive boolean, size long")
    with pytest.raises(ValueError, match="targets"):
        patches.assign_folds(few, 2)
    with pytest.raises(ValueError, match="2 to 10"):
        patches.assign_folds(few, 11)


def test_split_of_any_number_of_blocks(spark):
    rng = random.Random(5)
    rows = [(f"{i}:{i % 7}", rng.random() < 0.4, rng.random() < 0.3) for i in range(900)]
    blocks = spark.createDataFrame(rows, "block string, positive boolean, forbidden boolean")
    found = patches.holdout(blocks, 0.2, "7")
    held = set()
    for kind, most in ((True, max(1, int(sum(p for _, p, _ in rows) * 0.2))), (False, int(sum(not p and not f for _, p, f in rows) * 0.2))):
        free = [b for b, p, f in rows if p == kind and not f]
        held |= set(sorted(free, key=lambda b: hashlib.md5(f"7:{b}".encode()).hexdigest())[:most])
    assert {r.block for r in found.collect() if r.split == "validation"} == held and found.count() == 900
    assert "windowspecdefinition(positive" not in found._jdf.queryExecution().toString()  # no task holds all blocks of a kind


def test_tiles_of_a_long_axis(spark):
    """A pixel's tiles come from its place, not from a list of all starts."""
    rng = random.Random(2)
    for height, tile, bounds in ((3, 5, None), (48, 48, None), (100, 48, None), (145, 48, (7, 0, 131, 1)), (1000, 1, None), (997, 30, (13, 0, 600, 1))):
        low, high = (0, height) if bounds is None else (bounds[0], bounds[2])
        pixels = spark.createDataFrame([(y, 0, 1.0) for y in range(height)], "y long, x long, value double")
        side = min(tile, height)
        got = sorted((r.y, r.ty) for r in stitch.tiles_of(pixels, height, side, side, None if bounds is None else (*bounds[:3], side)).collect())
        assert got == sorted((y, s) for s in stitch.tile_starts(height, side, low, high) for y in range(s, s + side))
    plan = stitch.tiles_of(spark.range(1).selectExpr("id AS y", "id AS x", "1.0D AS value"), 10**7, 48, 48)._jdf.queryExecution().toString()
    assert len(plan) < 20_000


def test_patch_digests_deal_rows_by_their_number(spark, monkeypatch):
    """Twice the rows take twice the tasks, none with more than its share of patches; the digests stay the same."""
    from gridloom.plans import shared

    i = F.col("id")
    mask = spark.range(4000).select(F.floor(i / 100).alias("y"), (i % 100).alias("x"), (i % 3).alias("v"))
    reviewed = mask.where("(y + x) % 2 = 0").select("y", "x")
    want = {(r.py, r.px): (r.annotation_digest, r.label_digest) for r in patches.patch_digests(mask, reviewed, 4).collect()}
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    found = patches.patch_digests(mask, reviewed, 4)
    parts = found.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert {(r.py, r.px): (r.annotation_digest, r.label_digest) for r in found.collect()} == want and len(want) == 250
    assert len(parts) > 30 and max(r["count"] for r in parts) < 25


def test_relabelled_patches_are_the_stale_ones_of_two_indexes(spark):
    """Labels that changed, vanished or came, in one pass over pixels, against digests made apart and joined; values against hashlib."""
    rng = random.Random(8)
    held = [(y, x, rng.randint(0, 3), rng.randint(0, 1), rng.choice([None, 0, 1, 5])) for y in range(24) for x in range(20) if rng.random() < 0.4]
    held = [(y, x, v, ok, v if n is None or (y // 4) % 3 == 0 else n if (y // 4) % 3 == 1 else v and 7) for y, x, v, ok, n in held]
    held += [(100, 100, 0, 0, 2), (104, 100, 2, 0, 0)]  # no patch before, none after
    rows = spark.createDataFrame(held, "y long, x long, v long, valid int, n long")
    reviewed = rows.where("valid = 1").select("y", "x")
    then = patches.patch_digests(rows.select("y", "x", "v"), reviewed, 4)
    now = patches.patch_digests(rows.select("y", "x", F.col("n").alias("v")), reviewed, 4)
    reasons = {(r.py, r.px): r.reason for r in patches.stale_patches(then, now).collect()}
    want = {(r.py, r.px): (r.annotation_digest, r.label_digest, reasons.get((r.py, r.px))) for r in then.collect()}
    pixels = rows.select(patches.tile("y", 4).alias("py"), patches.tile("x", 4).alias("px"), "*")
    got = {(r.py, r.px): (r.annotation_digest, r.label_digest, r.reason) for r in patches.relabelled_patches(pixels, F.col("n")).collect()}
    assert got == want and {r for _, _, r in got.values()} == {None, "labels", "annotations"} and (25, 25) not in got and got[26, 25][2] == "annotations"
    part = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)
    for (py, px), (annotation, label, _) in got.items():
        own = [r for r in held if (r[0] // 4, r[1] // 4) == (py, px)]
        assert annotation == hashlib.md5(str(sum(part(y, x, int(v != 0), ok) for y, x, v, ok, _ in own if v or ok)).encode()).hexdigest()
        assert label == hashlib.md5(str(sum(part(y, x, v) for y, x, v, _, _ in own if v)).encode()).hexdigest()
