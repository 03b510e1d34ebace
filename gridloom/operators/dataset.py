"""Datasets of patches: pairs of images and labels, reading patches as a model sees them, trial subsets, channels, crops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.numbering import number_rows
from gridloom.operators.patches import keyed_order, stratum_sizes, subset_size, tile

#: Names that scored masks begin with, and how they name their image. Fixed values.
PREDICTIONS = ("Model Training prediction", "Model Training preview")
#: Side in pixels of the patches that are read together.
TASK_SIDE = 512
#: Pixels of the head and the gap of a crop in an atlas.
HEADER, GUTTER = 36, 8


# ---- layers and pairs

def layer_roles(layers: DataFrame) -> DataFrame:
    """layers (kind, rgb, role, internal) with ``use``: image, labels or coverage; internal, coloured and derived ones have none."""
    labels = F.when(F.col("role") == "reviewed_regions", "coverage").when(F.coalesce(F.col("role") != "reviewed_annotations", F.lit(True)), "labels")
    use = F.when(F.coalesce("internal", F.lit(False)), None).when((F.col("kind") == "image") & ~F.coalesce("rgb", F.lit(False)), "image").when(F.col("kind") == "labels", labels)
    return layers.withColumn("use", use)


def is_prediction(flag: Column, name: Column) -> Column:
    """Whether a mask was scored by a model: by its flag, or by its name."""
    named = F.lit(False)
    for p in PREDICTIONS:
        named = named | F.startswith(name, F.lit(p))
    return F.coalesce(flag, F.lit(False)) | F.coalesce(named, F.lit(False))


def _only(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out, n): how many values a key has, and the value if it is one."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(out))


def suggest_pairs(layers: DataFrame) -> DataFrame:
    """(image_id, truth_id, reviewed_id, coverage) for each image of layers (layer_id, pos, use, name, image_id, truth_id, source_id).

    truth: the labels that a coverage mask or the image names; else those scored from the image or named after it; else
    those that follow it before the next image. Two candidates of the first kind that has any leave it open.
    """
    images = layers.where("use = 'image'").select(F.col("layer_id").alias("image"), F.col("name").alias("image_name"), "pos", F.col("truth_id").alias("own_truth"))
    labels, masks = layers.where("use = 'labels'"), layers.where("use = 'coverage'")
    named = masks.select(F.col("image_id").alias("image"), F.col("truth_id").alias("layer_id")).unionByName(images.select("image", F.col("own_truth").alias("layer_id"))).where("layer_id IS NOT NULL")
    named = named.join(labels.select("layer_id"), "layer_id", "left_semi")
    forms = F.array(*[F.concat(F.lit(f"{p} — "), "image_name") for p in PREDICTIONS], F.concat("image_name", F.lit(" labels")))
    by_name = images.select("image", F.explode(forms).alias("name")).join(labels.select("layer_id", "name"), "name").select("image", "layer_id")
    scored = labels.select(F.col("source_id").alias("image"), "layer_id").where("image IS NOT NULL").join(images.select("image"), "image", "left_semi").unionByName(by_name)
    between = layers.where("use IN ('image', 'labels')").withColumn("image", F.last(F.when(F.col("use") == "image", F.col("layer_id")), ignorenulls=True).over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))  # one order of a workspace's layers: metadata
    following = between.where("use = 'labels' AND image IS NOT NULL").select("image", "layer_id")
    out = images.select("image")
    for k, found in enumerate((named, scored, following)):
        out = out.join(_only(found, "image", "layer_id", f"_t{k}").withColumnRenamed("_n", f"_n{k}"), "image", "left")
    truth = F.when(F.col("_n0") > 0, F.when(F.col("_n0") == 1, F.col("_t0"))).when(F.col("_n1") > 0, F.when(F.col("_n1") == 1, F.col("_t1"))).when(F.col("_n2") == 1, F.col("_t2"))
    made = masks.groupBy("image_id", "truth_id").agg(F.min("layer_id").alias("reviewed_id"))
    out = out.select(F.col("image").alias("image_id"), truth.alias("truth_id")).join(made, ["image_id", "truth_id"], "left")
    return out.select("image_id", "truth_id", "reviewed_id", F.when(F.col("reviewed_id").isNotNull(), "partial").otherwise("complete").alias("coverage"))


def pair_problems(pairs: DataFrame, layers: DataFrame, channel: str | None = None) -> DataFrame:
    """(image_id[, channel], problem) of pairs (image_id, truth_id, reviewed_id, coverage, confirmed) that can't be used.

    layers: (layer_id, use, height, width, affine, flag, name, image_id, truth_id). With a channel column, pairs are channels of images:
    coverage unknown is fine, and a mask serves one channel of an image only.
    """
    keys = ["image_id"] + ([channel] if channel else [])
    names = ("use", "height", "width", "affine", "flag", "name", "image_id", "truth_id")
    side = lambda p, key: layers.select(F.col("layer_id").alias(key), *[F.col(c).alias(p + c) for c in names])
    both = pairs.join(side("i_", "image_id"), "image_id", "left").join(side("t_", "truth_id"), "truth_id", "left").join(side("m_", "reviewed_id"), "reviewed_id", "left")
    partial = F.col("coverage") == "partial"
    differs = lambda p: ~F.struct(*[F.col(p + c) for c in ("height", "width", "affine")]).eqNullSafe(F.struct(*[F.col("i_" + c) for c in ("height", "width", "affine")]))
    twice = F.count("*").over(W.partitionBy(*keys)) > 1
    reused = (F.count("truth_id").over(W.partitionBy("image_id", "truth_id")) > 1) & F.col("truth_id").isNotNull() if channel else F.lit(False)
    rules = [
        (~F.col("i_use").eqNullSafe(F.lit("image")), "image is missing"), (twice, "stands twice"), (F.lit(channel is not None) & (F.col("coverage") == "unknown"), ""),
        (~F.coalesce(F.col("coverage").isin("partial", "complete"), F.lit(False)), "coverage isn't chosen"),
        (~F.col("t_use").eqNullSafe(F.lit("labels")), "labels are missing"), (reused, "a mask serves two channels"),
        (is_prediction(F.col("t_flag"), F.col("t_name")) & ~F.coalesce("confirmed", F.lit(False)), "a prediction isn't confirmed"),
        (partial & ~F.col("m_use").eqNullSafe(F.lit("coverage")), "reviewed mask is missing"), (differs("t_") | (partial & differs("m_")), "shapes or transforms differ"),
        (partial & ~(F.col("m_image_id").eqNullSafe(F.col("image_id")) & F.col("m_truth_id").eqNullSafe(F.col("truth_id"))), "reviewed mask belongs to another pair"),
    ]
    problem = None
    for test, text in rules:
        problem = F.when(test, text) if problem is None else problem.when(test, text)
    return both.select(*keys, problem.alias("problem")).where("problem <> ''")


def suggest_channels(images: DataFrame, labels: DataFrame, channels: list[str]) -> DataFrame:
    """(image_id, channel, truth_id): the one mask that was made from an image for a channel, or is named after both, or, with
    a single image, after the channel. images: (image_id, name); labels: (layer_id, name, source_id, channel_name)."""
    spark = images.sparkSession
    wanted = images.join(F.broadcast(spark.createDataFrame([(c,) for c in channels], "channel string")))  # as many rows as names
    low = lambda c: F.lower(c)
    made = wanted.join(labels.select("layer_id", "source_id", "channel_name"), (F.col("image_id") == F.col("source_id")) & (F.col("channel") == F.col("channel_name"))).select("image_id", "channel", "layer_id")
    single = images.agg((F.count("*") == 1).alias("_one"))  # one row
    forms = F.array_compact(F.array(low(F.concat("name", F.lit(" — "), "channel")), low(F.concat("name", F.lit(" "), "channel")), F.when(F.col("_one"), low("channel"))))
    named = wanted.join(F.broadcast(single)).select("image_id", "channel", F.explode(forms).alias("_form")).join(labels.select("layer_id", low("name").alias("_form")), "_form").select("image_id", "channel", "layer_id")
    found = made.unionByName(named).groupBy("image_id", "channel").agg(F.countDistinct("layer_id").alias("_n"), F.min("layer_id").alias("_t"))
    return wanted.select("image_id", "channel").join(found, ["image_id", "channel"], "left").select("image_id", "channel", F.when(F.col("_n") == 1, F.col("_t")).alias("truth_id"))


# ---- subsets

def validation_problems(patches: DataFrame) -> DataFrame:
    """One row with what makes scores of the reserved patches meaningless; none if they hold confirmed targets and background."""
    held = patches.where("split = 'validation'").agg(F.count("*").alias("n"), F.coalesce(F.sum("foreground_pixels"), F.lit(0)).alias("f"), F.coalesce(F.sum("reviewed_pixels"), F.lit(0)).alias("r"))
    problem = F.when(F.col("n") == 0, "no reserved patches").when((F.col("f") <= 0) | (F.col("r") <= F.col("f")), "no confirmed targets or background")
    return held.select(problem.alias("problem")).where("problem IS NOT NULL")


def spread(patches: DataFrame, seed: str, keys: tuple[str, ...], source: str = "source") -> DataFrame:
    """Patches with ``turn`` from 1: sources take turns, in each its blocks do, and in each block its patches, all in keyed orders."""
    rank = lambda part, *order: F.row_number().over(W.partitionBy(*part).orderBy(*order))
    in_block = patches.withColumn("_b", rank([source, "block"], keyed_order(seed, *keys)))
    numbered = number_rows(in_block.withColumn("_k", keyed_order(seed, source, "block")), [source, "_b", "_k"], "_n")  # a source may hold most patches
    first = numbered.groupBy(F.col(source).alias("_of")).agg(F.min("_n").alias("_first"))
    in_source = numbered.join(first, F.col(source).eqNullSafe(F.col("_of"))).withColumn("_s", F.col("_n") - F.col("_first"))
    return number_rows(in_source.drop("_of", "_first", "_n").withColumn("_o", keyed_order(seed, source)), ["_s", "_o"], "turn").drop("_b", "_k", "_s", "_o")


def trial_validation(patches: DataFrame, percentage: float, seed: str, keys: tuple[str, ...]) -> DataFrame:
    """The patches with a part of the reserved ones: ceil(n * p / 100), targets rounded half up in proportion, one at
    least, spread over sources and blocks; training patches all stay. A single patch must hold targets and background."""
    held = patches.where("split = 'validation'")
    n, p = held.agg(F.count("*"), F.count_if("contains_foreground")).first()
    if not n or (want := subset_size(n, percentage)) >= n:
        return patches
    targets, background = stratum_sizes(n, p, want)
    mixed = F.col("reviewed_pixels") > F.col("foreground_pixels") if want == 1 else F.lit(True)
    one = spread(held.where(F.col("contains_foreground") & mixed), seed, keys).where(F.col("turn") <= targets)
    two = spread(held.where(~F.col("contains_foreground")), seed, keys).where(F.col("turn") <= background)
    return patches.where("split <> 'validation'").unionByName(one.drop("turn")).unionByName(two.drop("turn"))


# ---- patches as a model sees them

def target_problems(mask: DataFrame, valid: DataFrame, classes: int | None = None, binary: bool = True) -> DataFrame:
    """(v, pixels) of labels that supervised pixels must not hold: other than 0 to ``classes``, or than 0 and 1 of a binary channel.

    classes None, binary False: any label is foreground, and none is a problem. Pixels outside ``valid`` don't count.
    """
    held = mask.join(valid.select("y", "x").distinct(), ["y", "x"], "left_semi")
    most = classes if classes is not None else 1 if binary else None
    bad = F.lit(False) if most is None else (F.col("v") < 0) | (F.col("v") > most) | (F.col("v") != F.floor("v"))
    return held.where(bad).groupBy("v").agg(F.count("*").alias("pixels"))


def _bins(n: int, out: int) -> np.ndarray:
    return np.linspace(0, n, out + 1).astype(int)


def area_resize(a: np.ndarray, side: int, f: np.ufunc) -> np.ndarray:
    """Fewer pixels by a ufunc over each bin of the last two axes."""
    for axis in (-2, -1):
        a = f.reduceat(a, _bins(a.shape[axis], side)[:-1], axis=axis)
    return a


def nearest_resize(a: np.ndarray, side: int) -> np.ndarray:
    """The pixel at the centre of each new one, along the last two axes."""
    y, x = (np.minimum(((np.arange(side) + 0.5) * n / side).astype(int), n - 1) for n in a.shape[-2:])
    return a[..., y[:, None], x]


def model_patches(image: np.ndarray, labels: np.ndarray, valid: np.ndarray, size: int, side: int, classes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, valid) of side x side pixels of each of some patches of one shape, that may end before ``size``.

    The image is normalised, its edge repeated, and averaged; unknown pixels and padding aren't valid, and a model pixel is
    valid if all of its pixels are. Binary targets keep their largest value, classes their centre's. Targets or supervision
    that vanish at the model's size are an error.
    """
    if not np.isfinite(image).all():
        raise ValueError("the image holds pixels that aren't finite")
    low, high = (a[:, None, None] for a in np.percentile(image.reshape(len(image), -1), (1, 99), axis=1))
    pad = [(0, 0), *((0, size - n) for n in image.shape[1:])]
    x = np.pad(np.clip((image - low) / np.maximum(high - low, 1e-6), 0, 1), pad, mode="edge")
    truth = np.where(valid, labels, 0)
    if classes is not None and ((truth < 0) | (truth > classes)).any():
        raise ValueError(f"labels must be 0 to {classes}")
    truth = np.pad(truth if classes is not None else truth != 0, pad).astype(np.int64)
    known = np.pad(valid, pad)
    if side < size:
        count = np.diff(_bins(size, side))
        x = area_resize(x, side, np.add) / (count[:, None] * count)
        known = area_resize(known, side, np.logical_and)
        small = nearest_resize(truth, side) if classes is not None else area_resize(truth, side, np.maximum)
    elif side > size:
        x, known, small = (nearest_resize(a, side) for a in (x, known, truth))
    else:
        small = truth
    y = np.where(known, small, 0)
    values = 2 if classes is None else classes + 1
    held = lambda a: np.unique((np.arange(len(a))[:, None, None] * values + a)[a != 0])  # noqa: E731  a patch's own values
    if not np.isin(held(truth), held(y)).all() or not known.any(axis=(1, 2)).all():
        raise ValueError("targets or reviewed pixels vanish at the model's size")
    return x.astype(np.float32), y.astype(np.float32), known.astype(np.float32)


def model_patch(image: np.ndarray, labels: np.ndarray, valid: np.ndarray, size: int, side: int, classes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of model_patches."""
    x, y, known = model_patches(image[None], labels[None], valid[None], size, side, classes)
    return x[0], y[0], known[0]


def read_patches(pixels: DataFrame, mask: DataFrame, reviewed: DataFrame, indexed: DataFrame, size: int, side: int, classes: int | None = None) -> DataFrame:
    """(py, px, x, y, valid) as rows of float arrays of the indexed patches (py, px, box, reviewed_pixels, foreground_pixels).

    A call holds TASK_SIDE x TASK_SIDE pixels of patches, one patch at least, and works on those of one shape at once; pixels, labels and reviewed places meet there in one shuffle. A patch whose counts of reviewed pixels and foreground aren't those of the index any more fails the query.
    """
    columns = ["py", "px", "y0", "x0", "y1", "x1", "reviewed_pixels", "foreground_pixels"]
    wanted = indexed.select(*columns)
    at = [F.col(c).cast("long").alias(c) for c in "yx"]
    rows_of = lambda df, kind, value=F.lit(0.0), v=F.lit(0): df.select(*at, value.cast("double").alias("value"), v.cast("long").alias("v"), F.lit(kind).alias("kind"))
    given = rows_of(pixels, 0, value=F.col("value")).unionByName(rows_of(mask.where("v <> 0"), 1, v=F.col("v"))).unionByName(rows_of(reviewed, 2))
    schema = pa.schema([("py", pa.int64()), ("px", pa.int64()), *((c, pa.list_(pa.float32())) for c in ("x", "y", "valid"))])
    most = max(1, TASK_SIDE * TASK_SIDE // max(size, side) ** 2)  # patches that are worked on at once

    def read(heads: pa.Table, table: pa.Table) -> pa.Table:
        head = {c: heads.column(c).to_numpy() for c in columns}
        order = np.lexsort((head["px"], head["py"]))
        head = {c: a[order] for c, a in head.items()}
        held = {c: table.column(c).to_numpy() for c in ("y", "x", "value", "v", "kind")}
        py, px = held["y"] // size, held["x"] // size
        # the patch of each row, by its place among the group's
        first = (py.min(initial=0), px.min(initial=0), px.max(initial=0) + 1)
        if len(order):
            first = (min(first[0], head["py"].min()), min(first[1], head["px"].min()), max(first[2], head["px"].max() + 1))
        number = lambda a, b: (a - first[0]) * (first[2] - first[1]) + b - first[1]
        keys, own = number(head["py"], head["px"]), number(py, px)
        row = np.searchsorted(keys, own)
        there = np.flatnonzero(np.append(keys, -1)[row] == own)
        row, held = row[there], {c: a[there] for c, a in held.items()}
        height, width = head["y1"] - head["y0"], head["x1"] - head["x0"]
        y, x = held["y"] - head["y0"][row], held["x"] - head["x0"][row]
        inside = (y >= 0) & (x >= 0) & (y < height[row]) & (x < width[row])
        imaged = np.zeros(len(keys), bool)
        imaged[row[inside & (held["kind"] == 0)]] = True
        # patches with pixels in the order of their shapes, and the rows of each kind in that of their patches
        chosen = np.flatnonzero(imaged)
        chosen = chosen[np.lexsort((width[chosen], height[chosen]))]
        rank = np.full(len(keys), -1)
        rank[chosen] = np.arange(len(chosen))
        of_kind = []
        for kind in range(3):
            rows = np.flatnonzero(inside & imaged[row] & (held["kind"] == kind))
            rows = rows[np.argsort(rank[row[rows]], kind="stable")]
            of_kind.append((rows, rank[row[rows]]))
        one = {c: a[chosen] for c, a in head.items()} | {"h": height[chosen], "w": width[chosen]}
        starts = np.flatnonzero(np.append(True, (np.diff(one["h"]) != 0) | (np.diff(one["w"]) != 0)))
        found = []
        for begin, end in zip(starts, [*starts[1:], len(chosen)]):
            for a, b in ((k, min(k + most, end)) for k in range(begin, end, most)):
                shape = int(b - a), int(one["h"][a]), int(one["w"][a])
                image, labels, valid, seen = np.full(shape, np.nan), np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape, bool)
                (pixel, to_pixel), (label, to_label), (known, to_known) = ((k := rows[slice(*np.searchsorted(of, (a, b)))], (rank[row[k]] - a, y[k], x[k])) for rows, of in of_kind)
                image[to_pixel], seen[to_pixel] = held["value"][pixel], True
                labels[to_label], valid[to_known] = held["v"][label], True
                labels[~seen], valid[~seen] = 0, False
                if (valid.sum((1, 2)) != one["reviewed_pixels"][a:b]).any() or ((valid & (labels != 0)).sum((1, 2)) != one["foreground_pixels"][a:b]).any():
                    raise ValueError("annotations changed after indexing; prepare the dataset again")
                ends = pa.array(np.arange(b - a + 1) * side * side, pa.int32())
                arrays = [pa.ListArray.from_arrays(ends, pa.array(t.ravel())) for t in model_patches(image, labels, valid, size, side, classes)]
                found.append(pa.table([pa.array(one["py"][a:b], pa.int64()), pa.array(one["px"][a:b], pa.int64()), *arrays], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    together = max(1, TASK_SIDE // size)  # small patches share a task's call
    group = lambda c, n: F.floor(F.floor(F.col(c) / n) / together).cast("long")
    left = wanted.groupBy(group("py", 1).alias("gy"), group("px", 1).alias("gx"))
    right = given.groupBy(group("y", size).alias("gy"), group("x", size).alias("gx"))
    return left.cogroup(right).applyInArrow(read, "py long, px long, x array<float>, y array<float>, valid array<float>")


def read_channels(parts: list[DataFrame], side: int) -> DataFrame:
    """(py, px, x, y, valid) of channels read one by one: y and valid stacked; a channel unknown in a patch is nowhere valid there."""
    none = F.array_repeat(F.lit(0.0).cast("float"), side * side)
    out = None
    for k, part in enumerate(parts):
        own = part.select("py", "px", *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "valid")])
        out = own if out is None else out.join(own, ["py", "px"], "full")
    stacked = [F.array(*[F.coalesce(f"{c}{k}", none) for k in range(len(parts))]).alias(c) for c in ("y", "valid")]
    return out.select("py", "px", F.coalesce(*[f"x{k}" for k in range(len(parts))]).alias("x"), *stacked)


# ---- crops

def crop_summary(crops: DataFrame) -> DataFrame:
    """(split, total, positive, background, nearby_background) of crops (split, contains_foreground, kind)."""
    return crops.groupBy("split").agg(F.count("*").alias("total"), F.count_if("contains_foreground").alias("positive"), F.count_if(~F.col("contains_foreground")).alias("background"), F.count_if(F.col("kind") == "nearby background").alias("nearby_background"))


def crop_atlas(crops: DataFrame, order: list[str], size: int) -> DataFrame:
    """Crops with tile (from 1) and their corner (atlas_y0, atlas_x0) in a nearly square grid of tiles below their heads."""
    numbered = number_rows(crops, order, "tile")
    total = crops.agg(F.ceil(F.sqrt(F.count("*"))).alias("_c"))  # one row
    i = F.col("tile") - 1
    at = {"atlas_y0": F.floor(i / F.col("_c")) * (size + HEADER + GUTTER) + HEADER, "atlas_x0": (i % F.col("_c")) * (size + GUTTER)}
    return numbered.join(F.broadcast(total)).withColumns({k: v.cast("long") for k, v in at.items()}).drop("_c")


def sampled_crops(anchors: DataFrame, background: DataFrame, size: int, height: int, width: int, near: int) -> DataFrame:
    """(kind, y0, x0) of crops: around foreground anchors (y, x), of background points within ``near`` pixels of one, and of the others.

    Points are matched by buckets of ``near`` pixels, so no pair of all points is formed.
    """
    origin = lambda c, n: F.greatest(F.lit(0), F.least(F.col(c) - size // 2, F.lit(max(n - size, 0)))).cast("long")
    cell = lambda c, d=0: (F.floor(F.col(c) / near) + d).cast("long")
    around = anchors.select("y", "x", F.explode(F.array(*[F.struct(cell("y", dy).alias("by"), cell("x", dx).alias("bx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])).alias("b")).select(F.col("b.by").alias("by"), F.col("b.bx").alias("bx"), F.col("y").alias("ay"), F.col("x").alias("ax"))
    met = background.select("y", "x", cell("y").alias("by"), cell("x").alias("bx")).join(around, ["by", "bx"]).where((F.abs(F.col("y") - F.col("ay")) <= near) & (F.abs(F.col("x") - F.col("ax")) <= near))
    close = met.select("y", "x").distinct().withColumn("_near", F.lit(True))
    rest = background.select("y", "x").distinct().join(close, ["y", "x"], "left").select(F.when(F.col("_near"), "nearby background").otherwise("background").alias("kind"), "y", "x")
    every = anchors.select(F.lit("positive").alias("kind"), "y", "x").unionByName(rest)
    return every.select("kind", origin("y", height).alias("y0"), origin("x", width).alias("x0"))
