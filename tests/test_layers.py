import hashlib
import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import catalog, components, dataset, edits, library, pyramid, rects, review
from gridloom.sources import checkpoints, layers
from gridloom.streaming import batches, tasks


def test_planes_and_levels(spark):
    levels = spark.createDataFrame([(0, 1, 1, 5), (1, 0, 0, 5)], "level long, y long, x long, v long")
    assert [tuple(r) for r in layers.full_resolution(levels).collect()] == [(1, 1, 5)]
    assert layers.plane_axes((1, 40, 1, 50)) == (1, 3) and layers.plane_axes((1, 9)) == (0, 1)
    voxels = spark.createDataFrame([(0, 3, 4, 7)], "i0 long, i1 long, i2 long, v long")
    assert tuple(layers.squeezed(voxels, (1, 9, 9)).first()) == (3, 4, 7)
    for shape in ((2, 9, 9), (1, 1, 9)):
        with pytest.raises(ValueError):
            layers.plane_axes(shape)
    with pytest.raises(ValueError):
        layers.label_kind("float32")


def test_records_of_each_type(tmp_path):
    base = str(tmp_path)
    labels = layers.layer_record({"type": "Labels", "name": "m", "scale": np.array([1, 2]), "path": f"{base}/m", "gamma": 2}, base)
    assert labels == {"type": "Labels", "name": "m", "scale": [1, 2], "storage": {"kind": "parquet", "path": "m", "mode": "r+"}}
    points = layers.layer_record({"type": "Points", "data": [np.float64(1.5)], "size": 3}, base)
    assert points["data"] == [1.5] and points["storage"] == {"kind": "inline"} and json.dumps(points)
    assert layers.layer_record({"type": "Image", "name": "i", "file": f"{base}/i.png", "gamma": 1.0}, base)["storage"] == {"kind": "file", "path": "i.png"}
    for bad in ({"type": "Surface"}, {"type": "Labels", "name": "memory"}):
        with pytest.raises(ValueError):
            layers.layer_record(bad, base)
    assert layers.restored(labels | {"odd": 1}) == {"name": "m", "scale": [1, 2]}
    with pytest.raises(ValueError, match="finite"):
        layers.restored(labels | {"affine": [[float("nan")]]})
    with pytest.raises(ValueError, match="another layer"):
        layers.restored(labels | {"id": "a", "shape": [2, 2]}, {"shape": [2, 2], "source_id": "b"})
    assert layers.plain({1: (np.int64(2), {3})}) == {"1": [2, [3]]} and layers.identified({"id": "x"}) == {"id": "x"} and layers.identified({})["id"]


def test_manifests_of_other_formats():
    old = {"version": 2, "layers": [{"layer_type": "Labels", "asset_path": "a", "asset_dataset": "/s0/"}, {"layer_type": "Image", "source": {"path": "/i"}}, {"inline_kind": "Points"}, {"layer_type": "Mesh"}]}
    found = [x["storage"] for x in layers.upgraded(old, "/w/p.json")["layers"]]
    assert found == [{"kind": "store", "path": "p_assets/a", "array": "s0", "mode": "r+"}, {"kind": "file", "path": "/i"}, {"kind": "inline"}, {"kind": "unsupported"}]
    with pytest.raises(ValueError):
        layers.upgraded({"format": "else", "version": 2, "layers": []}, "p")
    assert layers.keep_foreign({"layers": [1]}, {"layers": [], "viewer": 2}) == {"viewer": 2, "layers": [1]}


def test_modes_guards_and_keys(tmp_path):
    assert layers.loading_mode("full") == "grid" and layers.loading_mode("full", "full") == "full" and layers.loading_mode(None) == "grid" and layers.loading_mode("auto") == "auto"
    with pytest.raises(ValueError):
        layers.loading_mode("else")
    assert layers.opens_tiled((9, 9), "grid", 4, 1 << 40) and not layers.opens_tiled((9, 9), "auto", 4, 1 << 40) and not layers.opens_tiled((20_000, 20_000), "full", 4, 1)
    assert layers.writable({"storage": {"mode": "r+"}}) and not layers.writable({"storage": {"mode": "r"}}) and not layers.writable({"storage": {"mode": "r+"}, "read_only": True})
    with layers.exclusive(str(tmp_path), "training"):
        with pytest.raises(RuntimeError, match="training"), layers.exclusive(str(tmp_path), "scan"):
            pass
    with layers.exclusive(str(tmp_path), "scan"):
        pass
    saved = []
    with pytest.raises(ZeroDivisionError):
        layers.save_with_edits([lambda: 1 / 0], lambda: saved.append(1))
    assert saved == []
    assert layers.journal_key({"type": "Labels", "storage": {"kind": "parquet", "path": "m"}}, "/w") == ("Labels", "parquet", "/w/m/")
    assert layers.screening_context((2, 3), np.eye(3)) == layers.screening_context((2, 3), np.eye(3) + 1e-12) != layers.screening_context((3, 2), np.eye(3))
    record = {"id": 1, "name": "m", "shape": [2, 2], "affine": np.eye(3)}
    assert layers.destination_key(record) == layers.destination_key(dict(record)) != layers.destination_key(record | {"role": "x"})


def test_tiles_of_a_mask(spark):
    mask = spark.createDataFrame([(0, 0, 1), (5, 7, 2), (9, 9, 3)], "y long, x long, v long")
    box, pixels = layers.crop(mask, 1, 1, 5, (10, 9))
    assert box == (5, 5, 10, 9) and [tuple(r) for r in pixels.collect()] == [(0, 2, 2)]
    assert layers.crop(mask, 2, 0, 5, (10, 9))[0] is None and layers.crop(mask, 2, 0, 5, (10, 9))[1].count() == 0
    assert [tuple(r) for r in layers.promoted(pixels, box).collect()] == [(5, 7, 2)]
    affine = [[2, 0, 10], [0, 2, 0], [0, 0, 1]]
    assert layers.tile_at(affine, (23, 15), 5, (10, 9)) == (1, 1)
    with pytest.raises(ValueError):
        layers.tile_at(affine, (9, 15), 5, (10, 9))
    records = [{"name": "a", "shape": (100, 100)}, {"name": "b", "shape": (10, 10)}]
    assert layers.planned_reads(records, (50, 60), 30) == [("a", (50, 60, 80, 90)), ("b", None)]
    with pytest.raises(ValueError):
        layers.planned_reads(records, (0, 0), 100, limit=100)
    assert layers.follow_signature(records) != layers.follow_signature(records[:1])
    requests = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "layer string, request long")
    assert {(r.layer, r.request) for r in layers.latest_loads(requests, requests.where("layer = 'b' OR request = 1")).collect()} == {("b", 1)}


def test_checkpoints(spark, tmp_path):
    weights = spark.createDataFrame([("w", 0, 0.5), ("w", 1, -1.0)], "tensor string, pos long, value double")
    history = [{"rounds": [{"epoch": 1, "dice": 0.5, "loss": 1.0}]}]
    folder, config = str(tmp_path / "one"), {"input_pixels": 64}
    checkpoints.save_checkpoint(weights, folder, config, history, {"model_id": "m"}, {"dice": 0.5})
    read, model = checkpoints.load_checkpoint(spark, folder)
    assert read.count() == 2 and model["history"] == history and (tmp_path / "one" / "metrics.csv").read_text().startswith("epoch,dice,loss\n1,0.5")
    with pytest.raises(ValueError):
        checkpoints.load_checkpoint(spark, str(tmp_path))
    first = checkpoints.copy_bundle(folder, str(tmp_path / "models"), "m.pt")
    second = checkpoints.copy_bundle(folder, str(tmp_path / "models"), "m.pt")
    assert first.endswith("m.pt") and second.endswith("m-2.pt") and checkpoints.copy_bundle(first, str(tmp_path / "models"), "x") == first
    assert json.loads((tmp_path / "models" / "m-2.pt" / "history.json").read_text())["model_file"] == "m-2.pt"
    for bad in ("../x", ""):
        with pytest.raises(ValueError):
            checkpoints.copy_bundle(folder, str(tmp_path / "models"), bad)
    run = {"model_id": "m", "history": history[-1], "dice": 0.5}
    checkpoints.verify_relocated(first, run, config)
    for changed, settings in ((run | {"model_id": "n"}, config), (run, {}), (run | {"history": {"rounds": []}}, config), (run | {"dice": 0.6}, config)):
        with pytest.raises(ValueError):
            checkpoints.verify_relocated(first, changed, settings)
    patches = spark.createDataFrame([(0, 0, "train"), (0, 1, "validation")], "py long, px long, split string")
    tensors = spark.createDataFrame([(0, 0, [0.5], [1.0], [1.0]), (0, 1, [0.1], [0.0], [1.0])], "py long, px long, x array<float>, y array<float>, valid array<float>")
    checkpoints.freeze_dataset(patches, tensors, str(tmp_path / "frozen"), {"size": 1})
    rows, about = checkpoints.thaw_dataset(spark, str(tmp_path / "frozen"), "train")
    assert about == {"size": 1} and [r.x for r in rows.collect()] == [[0.5]]
    checkpoints.check_config({"input_pixels": 64, "class_names": ["a", "b"]})
    for bad in ({"epochs": 0}, {"class_names": ["a", "A "]}, {"class_names": [" "]}, {"folds": 11}):
        with pytest.raises(ValueError):
            checkpoints.check_config(bad)
    assert checkpoints.provider_versions(["pyspark", "no-such-library"])["no-such-library"] is None


def test_tiles_stop_and_go_on(spark):
    done, tiles = [], [(0, k) for k in range(5)]
    with tasks.Task(spark, "first") as task:
        with pytest.raises(tasks.Cancelled):
            for p in tasks.run_tiles(task, tiles, lambda t: None, done):
                if p.completed == 2:
                    task.cancel()
    assert done == tiles[:2]
    with tasks.Task(spark, "second") as task:
        assert [p.completed for p in tasks.run_tiles(task, tiles, lambda t: None, done)] == [3, 4, 5] and done == tiles
        with pytest.raises(RuntimeError, match="2 tiles"):
            list(tasks.run_tiles(task, tiles[:2], lambda t: None, [], unchanged=lambda: False))
    with tasks.Task(spark, "third") as task:
        threading.Timer(1.0, task.cancel).start()
        slow = F.udf(lambda x: __import__("time").sleep(30) or x, "long")
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(4).select(slow("id")).collect()
    assert spark.range(3).count() == 3


def plain_batches(events):
    """The batches of one pair by a loop over its events, in sets of pixels."""
    def pixels(e):
        return {(y, x) for y in range(e["y0"], e["y1"]) for x in range(e["x0"], e["x1"])}

    books = [{"regions": set(), "log": 0, "done": False}]
    active, training, scope, view, refused = 0, 0, "all", "active", 0
    for e in events:
        a, n = e["action"], e["number"] - 1
        book = books[active]
        if a == "new":
            first = books[0]
            if not (len(books) == 1 and not first["log"] and not first["regions"] and not first["done"] and scope == "all"):
                books.append({"regions": set(), "log": 0, "done": False})
            active = training = len(books) - 1
            scope = "active"
            view = "active" if view == "hide" else view
        elif a == "select" and n < len(books):
            active, view = n, "active" if view == "hide" else view
        elif a == "training" and n < len(books):
            training, scope = n, "active"
        elif a == "view" and e["name"] in ("active", "all", "hide"):
            view = e["name"]
        elif a == "all":
            scope = "all"
        elif a == "active":
            scope, training = "active", active
        elif a in ("finish", "reopen"):
            book["done"] = a == "finish"
        elif a in ("approve", "add") and not book["done"]:
            book["regions"] |= pixels(e)
            book["log"] += 1
        elif a in ("revoke", "remove"):
            book["regions"] -= pixels(e) if a == "remove" else set()
            book["log"] += 1
        elif not (a == "rename" and e["name"].strip()):
            refused += 1
    return (len(books), active + 1, training + 1, scope, view, refused), [(len(b["regions"]), b["log"], b["done"]) for b in books]


def test_batches_like_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    actions = ["new", "select", "training", "view", "all", "active", "rename", "finish", "reopen", "approve", "add", "revoke", "remove"]
    rows = []
    for pair in range(60):
        for seq in range(int(rng.integers(1, 25))):
            y, x = rng.integers(0, 6, 2)
            rows.append((pair, seq, str(rng.choice(actions)), int(rng.integers(1, 5)), str(rng.choice(["active", "all", "hide", " ", "x"])), int(y), int(x), int(y + rng.integers(1, 4)), int(x + rng.integers(1, 4))))
    schema = "pair long, seq long, action string, number long, name string, y0 long, x0 long, y1 long, x1 long"
    resolved = batches.resolved_events(spark.createDataFrame(rows, schema)).cache()
    states = {r.pair: (r.batches, r.active, r.training, r.scope, r.view_mode, r.refused) for r in batches.pair_states(resolved).collect()}
    records = {(r.pair, r.batch): (len({(y, x) for g in r.regions for y in range(g.y0, g.y1) for x in range(g.x0, g.x1)}), r.revision, r.finished) for r in batches.batch_records(resolved).collect()}
    names = [f.split()[0] for f in schema.split(", ")]
    for pair in range(60):
        state, books = plain_batches([dict(zip(names, r)) for r in rows if r[0] == pair])
        assert states[pair] == state
        for k, book in enumerate(books, 1):
            assert records.get((pair, k), (0, 0, False)) == book


def test_batch_selection_and_undo(spark):
    box = "array<struct<y0:bigint,x0:bigint,y1:bigint,x1:bigint>>"
    records = spark.createDataFrame([(1, 1, "Batch 1", 2, [(0, 0, 2, 2)]), (2, 1, "Batch 1", 0, [])], f"pair long, batch long, name string, revision long, regions {box}")
    pairs = spark.createDataFrame([(1, "active", 1), (2, "active", 1), (3, "all", 1)], "pair long, scope string, training long")
    chosen = batches.selection(pairs, records)
    assert {r.pair: r.signature for r in chosen.collect()} == {1: "active:1:2", 2: "active:1:0", 3: "all"}
    assert [(r.pair, r.problem) for r in batches.preparation_problems(chosen).collect()] == [(2, "Batch 1 is empty")]
    back = {r.pair: (r.revision, len(r.regions)) for r in batches.restore_membership(records, records.withColumn("regions", F.expr(f"cast(array() as {box})"))).collect()}
    assert back == {1: (3, 0), 2: (0, 0)}
    held = spark.createDataFrame([(1, None, [(0, 0, 1, 1)]), (2, None, None)], f"pair long, review_cells {box}, areas {box}")
    assert {r.pair: len(r.regions) for r in batches.first_batch(held).collect()} == {1: 1, 2: 0}
    source = spark.createDataFrame([(1, "t", 5, 5, [1.0])], "pair long, truth_id string, height long, width long, registration array<double>")
    assert batches.guarded(source, source).count() == 1
    for changed in (source.withColumn("truth_id", F.lit("u")), source.withColumn("height", F.lit(6).cast("long")), source.withColumn("registration", F.array(F.lit(1.1)))):
        with pytest.raises(Exception, match="(?i)batches belong|changed"):
            batches.guarded(source, changed).collect()


def test_review_of_a_rectangle(spark):
    rows = [(1, 1, "approve", 0, 0, 4, 4), (1, 2, "approve", 0, 4, 4, 8), (1, 3, "edit", 1, 1, 2, 2), (1, 4, "edit", 1, 1, 2, 2), (1, 5, "revoke", 0, 4, 2, 8)]
    schema = "mask long, seq long, action string, y0 long, x0 long, y1 long, x1 long"
    got = review.review_states(spark.createDataFrame(rows, schema)).first()
    assert [tuple(a) for a in got.areas] == [(2, 4, 4, 8)] and [tuple(a) for a in got.invalid] == [(0, 0, 4, 4)] and [tuple(a) for a in got.cells] == [(0, 0, 4, 4), (2, 4, 4, 8)]
    again = review.review_states(spark.createDataFrame([*rows, (1, 6, "approve", 0, 0, 2, 4)], schema)).first()
    assert [tuple(a) for a in again.invalid] == [(2, 0, 4, 4)]


def test_patches_as_a_model_sees_them():
    image = np.arange(12.0).reshape(3, 4)
    labels, valid = np.zeros((3, 4), int), np.ones((3, 4), bool)
    labels[0, 0], valid[2, 3] = 7, False
    x, y, known = dataset.model_patch(image, labels, valid, 4, 4)
    assert x.shape == (4, 4) and (x[3] == x[2]).all() and y.sum() == 1 and known.sum() == 11 and not known[3].any()
    x, y, known = dataset.model_patch(image, labels, valid, 4, 2)
    assert y.tolist() == [[1, 0], [0, 0]] and known.tolist() == [[1, 1], [0, 0]]
    two = np.where(labels, 2, 0)
    with pytest.raises(ValueError, match="vanish"):
        dataset.model_patch(image, two, valid, 4, 2, classes=2)
    with pytest.raises(ValueError, match="0 to 1"):
        dataset.model_patch(image, two, valid, 4, 4, classes=1)
    with pytest.raises(ValueError, match="finite"):
        dataset.model_patch(np.where(labels, np.nan, image), labels, valid, 4, 4)


def test_changed_annotations_stop_a_read(spark):
    pixels = spark.createDataFrame([(0, x, float(x)) for x in range(4)], "y long, x long, value double")
    mask, known = spark.createDataFrame([(0, 1, 1)], "y long, x long, v long"), pixels.select("y", "x")
    index = spark.createDataFrame([(0, 0, 0, 0, 1, 2, 2, 1), (0, 1, 0, 2, 1, 4, 2, 0)], "py long, px long, y0 long, x0 long, y1 long, x1 long, reviewed_pixels long, foreground_pixels long")
    read = dataset.read_patches(pixels, mask, known, index, 2, 2)
    assert {r.px: r.y for r in read.collect()} == {0: [0.0, 1.0, 0.0, 0.0], 1: [0.0] * 4}
    with pytest.raises(Exception, match="annotations changed"):
        dataset.read_patches(pixels, mask.withColumn("x", F.col("x") + 2), known, index, 2, 2).collect()
    both = dataset.read_channels([read, read.where("px = 0")], 2).collect()
    assert {r.px: [sum(v) for v in r.valid] for r in both} == {0: [2.0, 2.0], 1: [2.0, 0.0]}


def test_trial_validation_needs_both_kinds(spark):
    rows = [(k, "validation", k < 2, 4, 2 if k < 2 else 0, str(k % 2), "s") for k in range(10)] + [(20, "train", True, 4, 1, "0", "s")]
    table = spark.createDataFrame(rows, "k long, split string, contains_foreground boolean, reviewed_pixels long, foreground_pixels long, block string, source string")
    some = dataset.trial_validation(table, 35, "1", ("k",)).collect()
    assert sum(r.split == "validation" for r in some) == 4 and sum(r.contains_foreground and r.split == "validation" for r in some) == 1 and any(r.k == 20 for r in some)
    one = dataset.trial_validation(table, 1, "1", ("k",)).where("split = 'validation'").collect()
    assert len(one) == 1 and one[0].contains_foreground
    assert dataset.trial_validation(table, 100, "1", ("k",)).count() == 11
    assert dataset.validation_problems(table).count() == 0
    assert dataset.validation_problems(table.where("contains_foreground = false")).first().problem == "no confirmed targets or background"
    assert dataset.validation_problems(table.where("split = 'train'")).first().problem == "no reserved patches"


def test_references_change_on_the_expected_revision(spark):
    records = spark.createDataFrame([("a", "x", 3), ("b", "y", 1)], "id string, reference string, revision long")
    assert {tuple(r) for r in catalog.update_reference(records, "a", "z", 3).collect()} == {("a", "z", 4), ("b", "y", 1)}
    with pytest.raises(Exception, match="changed meanwhile"):
        catalog.update_reference(records, "a", "z", 2).collect()
    assert library.tile_size((256, 256)) == 256 and library.tile_size((256, 128)) == 512 and library.tile_size((64, 64)) == 512


def test_small_pieces(spark, tmp_path):
    source = library.VersionedTable(spark, str(tmp_path / "a"))
    source.commit(spark.range(4), 0)
    layers.copy_library(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert library.VersionedTable(spark, str(tmp_path / "b")).read().count() == 4
    record = {"storage": {"path": "a"}}
    assert layers.storage_reference(record, str(tmp_path)) == str(tmp_path / "a") and layers.storage_reference({"path": "gone"}, str(tmp_path)) is None
    assert layers.chunk_shape(100, 5000, 3) == (100, 1024, 3)
    m = lambda *rows: spark.createDataFrame(list(rows), "y long, x long, v long")
    base, edited = m((0, 0, 1), (9, 9, 2)), m((0, 0, 5), (9, 9, 6), (3, 3, 7))
    dirty = spark.createDataFrame([(0, 0, 4, 4)], "y0 long, x0 long, y1 long, x1 long")
    assert {(r.y, r.x, r.v) for r in edits.commit_within(base, base, edited, dirty).collect()} == {(0, 0, 5), (3, 3, 7), (9, 9, 2)}
    review_rows = spark.createDataFrame([("a", 3)], "area string, edit_revision long")
    assert edits.undo_review(review_rows, review_rows.withColumn("area", F.lit("b")), 3).first().area == "b"
    with pytest.raises(Exception, match="after this review"):
        edits.undo_review(review_rows, review_rows, 2).collect()
    pixels = components.label_pixels(m((0, 0, 1), (0, 1, 1), (5, 5, 2)))
    assert {(r.y, r.x, r.component_id) for r in components.final_ids(pixels, components.component_table(pixels)).collect()} == {(0, 0, 1), (0, 1, 1), (5, 5, 2)}
    shapes = pyramid.level_shapes(10_000, 3000)
    assert pyramid.plan_overview(shapes) == 2 and pyramid.shown_scale(shapes, 2) == (4.0, 4.0)


def test_components_over_tile_seams(spark):
    """Components over many tiles, with corners on seams, are those of one tile."""
    rng = np.random.default_rng(6)
    array = rng.integers(0, 3, (40, 37)) * (rng.random((40, 37)) < 0.8)
    array[10:30, 5:33] = 2
    array[15:25, 15:20] = 0
    rows = [(int(y), int(x), int(array[y, x])) for y, x in zip(*np.nonzero(array))]
    mask = spark.createDataFrame(rows, "y long, x long, v long")
    one = components.label_pixels(mask)
    euler = {tuple(r) for r in components.euler(one).collect()}
    assert min(e for _, e in euler) < 1
    for tile in (8, 5):
        many = components.label_pixels(mask, tile)
        assert {tuple(r) for r in many.collect()} == {tuple(r) for r in one.collect()}
        assert {tuple(r) for r in components.euler(many, tile).collect()} == euler


def test_cells_of_any_grid_like_pixels(spark):
    rng = np.random.default_rng(7)
    boxes = [(int(y), int(x), int(y + h), int(x + w)) for y, x, h, w in zip(rng.integers(-5, 60, 40), rng.integers(-5, 250, 40), rng.integers(1, 30, 40), rng.integers(1, 60, 40))]
    table = spark.createDataFrame(boxes, "y0 long, x0 long, y1 long, x1 long")
    held = np.zeros((62, 301), bool)
    for y0, x0, y1, x1 in boxes:
        held[max(y0, 0) : max(y1, 0), max(x0, 0) : max(x1, 0)] = True
    got = {(r.row, r.col): (r.covered, r.touched) for r in rects.cell_coverage(table, 62, 301, 7, 3).collect()}
    assert len(got) == 9 * 101
    for (row, col), flags in got.items():
        cell = held[row * 7 : row * 7 + 7, col * 3 : col * 3 + 3]
        assert flags == (cell.all(), cell.any())


def test_spread_holds_no_source_in_one_task(spark):
    rows = [(k, f"s{k % 2}" if k % 9 else None, str(k % 23)) for k in range(300)]
    table = spark.createDataFrame(rows, "k long, source string, block string")
    found = dataset.spread(table, "3", ("k",))
    md5 = lambda *parts: hashlib.md5(":".join(map(str, (p for p in parts if p is not None))).encode()).hexdigest()
    turns, by_block = [], {}
    for k, s, b in sorted(rows, key=lambda r: md5(3, r[0])):
        by_block.setdefault((s, b), []).append(k)
    for source in {s for _, s, _ in rows}:
        own = sorted((i, md5(3, source, b), k) for (s, b), ks in by_block.items() if s == source for i, k in enumerate(ks))
        turns += [(n, md5(3, source), k) for n, (_, _, k) in enumerate(own)]
    assert [r.k for r in found.orderBy("turn").collect()] == [k for *_, k in sorted(turns)]
    assert "windowspecdefinition(source#" not in found._jdf.queryExecution().toString()
    assert [r.turn for r in found.orderBy("turn").collect()] == list(range(1, 301))


def test_regions_drawn_over_each_other_as_pixels(spark, monkeypatch):
    monkeypatch.setattr(rects, "LAYERS", 20)  # several tasks a cell
    rng = random.Random(3)
    boxes = lambda n, most: [(y, x, y + rng.randrange(most), x + rng.randrange(1, most)) for y, x in ((rng.randrange(-9, 60), rng.randrange(-9, 60)) for _ in range(n))]
    given = [(k, rng.randrange(60), *b) for k, b in enumerate(boxes(150, 25))]
    held = boxes(30, 22)
    drawn = review.display_regions(spark.createDataFrame(given, "region_id long, rank int, y0 int, x0 int, y1 int, x1 int"), spark.createDataFrame(held, "y0 int, x0 int, y1 int, x1 int"), 16)
    assert "collect_set" not in drawn._jdf.queryExecution().toString()  # no row holds all that lie above a region
    pixels = lambda b: {(y, x) for y in range(b[0], b[2]) for x in range(b[1], b[3])}
    covered = set().union(*map(pixels, held))
    wanted, got = {}, {}
    for k, rank, *b in given:
        left = pixels(b) - set().union(*(pixels(o) for _, r, *o in given if r < rank))
        if left:
            wanted[k] = left, pixels(b) <= covered
    for r in drawn.collect():
        seen, ready = got.setdefault(r.region_id, (set(), r.ready))
        new = pixels((r.y0, r.x0, r.y1, r.x1))
        assert new and not seen & new and ready == r.ready
        seen |= new
    assert got == wanted and {r for _, r in wanted.values()} == {False, True}


def test_read_patches_makes_and_shuffles_no_whole_image(spark, tmp_path):
    """Two patches at far ends of an image of 10 ** 12 pixels."""
    from gridloom.plans.more_queries import q

    lines = [(p, s, "A" if p % 2 else "N", "F") for p, s in ((3, 1), (25, 2), (20_000_001, 1_000_000), (20_000_030, 999_999))]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.py, r.px): (r.y, r.valid) for r in q.QUERIES["read_patches"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (2.0, 2.0), (250_000, 250_000): (1.0, 1.0), (250_000, 249_999): (0.0, 1.0)}


def test_patches_of_one_shape_are_read_at_once(spark, tmp_path, monkeypatch):
    """Patches read in calls and batches of any size are those of model_patch one by one; pixels beyond the boxes don't count."""
    rng = np.random.default_rng(4)
    h, w = 11, 14
    image, labels, valid = rng.random((h, w)), rng.integers(0, 4, (h, w)), rng.random((h, w)) < 0.8
    cells = [(y, x, float(image[y, x]), int(labels[y, x]), bool(valid[y, x])) for y in range(h) for x in range(w)]
    table = spark.createDataFrame(cells + [(11, 3, 5.0, 1, True), (2, 14, 5.0, 1, True)], "y long, x long, value double, v long, valid boolean")
    mask, known = table.select("y", "x", "v"), table.where("valid").select("y", "x")
    boxes = [(y // 4, x // 4, y, x, min(y + 4, h), min(x + 4, w)) for y in range(0, h, 4) for x in range(0, w, 4)]
    parts = {b[:2]: np.s_[b[2] : b[4], b[3] : b[5]] for b in boxes}
    index = spark.createDataFrame([(*b, int(valid[parts[b[:2]]].sum()), int((valid & (labels != 0))[parts[b[:2]]].sum())) for b in boxes], "py long, px long, y0 long, x0 long, y1 long, x1 long, reviewed_pixels long, foreground_pixels long")
    for task_side, side, classes in ((512, 4, None), (8, 4, 3), (8, 8, None), (1, 8, 3)):
        monkeypatch.setattr(dataset, "TASK_SIDE", task_side)
        got = {(r.py, r.px): (r.x, r.y, r.valid) for r in dataset.read_patches(table, mask, known, index, 4, side, classes).collect()}
        want = {k: dataset.model_patch(image[p], labels[p], valid[p], 4, side, classes) for k, p in parts.items()}
        assert got.keys() == want.keys() and all(np.array_equal(np.concatenate(got[k]), np.concatenate([a.ravel() for a in want[k]])) for k in want)
    # the query deals its lines once; they aren't read again for labels and reviewed places
    from gridloom.plans.more_queries import q

    spark.createDataFrame([(p, s, "A", "F") for p, s in ((3, 1), (25, 2))], "l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    read = q.QUERIES["read_patches"](spark, str(tmp_path))
    assert not any("lineitem" in f for f in read.inputFiles()) and read.count() == 1


def test_one_bad_patch_among_many_is_an_error():
    image, labels, valid = np.arange(48.0).reshape(3, 4, 4), np.zeros((3, 4, 4), int), np.ones((3, 4, 4), bool)
    labels[0, 0, 0] = labels[1, 1, 1] = 2
    assert dataset.model_patches(image, labels, valid, 4, 2)[1].sum((1, 2)).tolist() == [1, 1, 0]
    with pytest.raises(ValueError, match="vanish"):
        dataset.model_patches(image, labels, valid, 4, 2, classes=2)  # the first one's only target; the second's is kept
    dataset.model_patches(image[1:], labels[1:], valid[1:], 4, 2, classes=2)
    with pytest.raises(ValueError, match="vanish"):
        dataset.model_patches(image, labels, valid & (np.arange(3) != 2)[:, None, None], 4, 4)


def test_covered_pixels_without_making_pixels(spark):
    """Overlapping, touching, empty and repeated rectangles against a set of pixels, and areas of 10^12 pixels."""
    rng = random.Random(5)
    sets = [[(y, x, y + rng.randint(0, 5), x + rng.randint(-1, 5)) for y, x in ((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n))] for n in (0, 1, 2, 5, 12, 12)]
    want = {k: len({(y, x) for a, b, c, d in boxes for y in range(a, c) for x in range(b, d)}) for k, boxes in enumerate(sets)}
    sets.append([(0, 0, 1_000_000, 1_000_000), (500_000, 500_000, 1_500_000, 1_500_000), (0, 0, 1, 1)])
    rows = spark.createDataFrame([(k, boxes) for k, boxes in enumerate(sets)], "mask long, areas array<struct<y0:bigint,x0:bigint,y1:bigint,x1:bigint>>")
    got = {r.mask: r.pixels for r in review.covered_pixels(rows, "areas", "mask").collect()}
    assert got == {k: n for k, n in want.items() if n} | {6: 1_750_000_000_000}


def test_histories_are_made_once(spark):
    """Points of checkpoints, evaluations and folds come from one pass over what makes the histories."""
    from gridloom.operators import model_history

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    point = {"epoch": 1, "validation": {"dice": 0.5}}
    texts = [("a", 1, {"checkpoints": [point]}), ("b", 1, {"checkpoints": []}), ("b", 2, {"cross_validation_report": {"fold_results": [{"fold": 3, "history": [{"checkpoints": [point]}]}]}}), ("c", 1, {"evaluations": [{"metrics": {"dice": 0.25}}]})]
    rows = spark.createDataFrame([(k, n, json.dumps(d)) for k, n, d in texts], "id string, round long, d string")
    histories = rows.mapInArrow(seen, rows.schema).select("id", "round", F.parse_json("d").alias("h"))
    found = {(r.id, r.series, r.dice) for r in model_history.history_points(histories, ["id"]).collect()}
    assert found == {("a", "Round 1", 0.5), ("b", "Fold 3", 0.5), ("c", "Round 1 · Full validation", 0.25)}
    assert made.value == len(texts)
