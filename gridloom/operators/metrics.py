"""Scores of segmentations. Empty against empty scores 0; means skip classes that never occur."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    return num / F.greatest(den, F.lit(1))


def scores(df: DataFrame) -> DataFrame:
    """precision, recall, dice and iou of columns tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "dice": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn)})


def confusion(pred: DataFrame, truth: DataFrame, valid: DataFrame | None, keys: list[str]) -> DataFrame:
    """(class, tp, fp, fn) of masks (keys, v), within the valid pixels if they are given."""
    both = pred.select(*keys, F.col("v").alias("p")).join(truth.select(*keys, F.col("v").alias("t")), keys, "full")
    if valid is not None:
        both = both.join(valid.select(*keys).distinct(), keys, "left_semi")
    classes = both.select(F.explode(F.array_compact(F.array_distinct(F.array("p", "t")))).alias("class"), "p", "t").where("class <> 0")
    hit = F.col("p").eqNullSafe(F.col("t"))
    return classes.groupBy("class").agg(F.count_if(hit).alias("tp"), F.count_if(~hit & F.col("p").eqNullSafe(F.col("class"))).alias("fp"), F.count_if(~hit & F.col("t").eqNullSafe(F.col("class"))).alias("fn"))


def macro(per_class: DataFrame) -> DataFrame:
    """Means over the classes that occur."""
    present = scores(per_class).where("tp + fp + fn > 0")
    return present.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "dice", "iou")])


def fold_spread(runs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean and sample deviation over folds."""
    return runs.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("folds"))


def best_checkpoint(points: DataFrame, keys: list[str]) -> DataFrame:
    """The last epoch with the largest dice."""
    return points.groupBy(*keys).agg(F.max_by("epoch", F.struct("dice", "epoch")).alias("best_epoch"), F.max("dice").alias("best_dice"))


def plateau(losses: list[float], reduce_patience: int = 10, stop_patience: int = 10, min_delta: float = 1e-4) -> list[str]:
    """What to do after each loss: continue, reduce (once, after ``reduce_patience`` losses without improvement), stop (after ``stop_patience`` more)."""
    if min(reduce_patience, stop_patience) < 1 or min_delta < 0:
        raise ValueError("patience must be 1 or more, the improvement 0 or more")
    best, waited, phases, out = math.inf, 0, [("reduce", reduce_patience), ("stop", stop_patience)], []
    for loss in losses:
        if not math.isfinite(loss):
            raise ValueError("a loss isn't finite")
        improved = loss < best - min_delta
        best, waited = (loss, 0) if improved else (best, waited + 1)
        action, patience = phases[0]
        if waited >= patience:
            out.append(action)
            if len(phases) > 1:
                phases, waited = phases[1:], 0
        else:
            out.append("continue")
    return out


def threshold_labels(probabilities: DataFrame, threshold: float = 0.5) -> DataFrame:
    return probabilities.withColumn("v", F.when(F.col("p") >= threshold, 1).otherwise(0).cast("long"))


def argmax_labels(probabilities: DataFrame, keys: list[str]) -> DataFrame:
    """Class of the largest probability, the lowest one at a tie."""
    return probabilities.groupBy(*keys).agg(F.max_by("class", F.struct("p", -F.col("class"))).alias("v"))


def weight_statistics(weights: DataFrame, most: int = 65_536) -> DataFrame:
    """Mean, population deviation and range per tensor of (tensor, pos, value), strided to at most so many, finite ones only; how many were taken and not finite."""
    sizes = weights.groupBy("tensor").agg(F.greatest(F.ceil(F.count("*") / most), F.lit(1)).alias("_s"))
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    sampled = weights.join(sizes, "tensor").where(F.col("pos") % F.col("_s") == 0)
    taken = [F.count("*").alias("sampled"), (F.count("*") - F.count(finite)).alias("nonfinite")]
    return sampled.groupBy("tensor").agg(F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"), F.min(finite).alias("low"), F.max(finite).alias("high"), *taken)


def loss_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of a binary loss over known pixels (keys, p, t, valid): cross entropy, overlap, areas and pixels."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    known = F.col("valid") > 0
    entropy = -(F.col("t") * F.log(p) + (1 - F.col("t")) * F.log(1 - p))
    only = lambda c: F.sum(F.when(known, c).otherwise(0.0))
    return df.groupBy(*keys).agg(only(entropy).alias("entropy"), only(F.col("p") * F.col("t")).alias("both"), only(F.col("p")).alias("p_area"), only(F.col("t").cast("double")).alias("t_area"), F.count_if(known).alias("pixels"))


def binary_loss(df: DataFrame, keys: list[str], smooth: float = 1.0) -> DataFrame:
    """Mean cross entropy plus one less the soft Dice score, over known pixels alone; of each group of keys."""
    dice = (2 * F.col("both") + smooth) / (F.col("p_area") + F.col("t_area") + smooth)
    return loss_sums(df, keys).select(*keys, (F.col("entropy") / F.greatest("pixels", F.lit(1)) + 1 - dice).alias("loss"), "pixels")


def multilabel_loss(df: DataFrame, keys: list[str], channel: str = "channel") -> DataFrame:
    """Mean of binary_loss() over the channels that are known somewhere in a group; channels nowhere known don't count, and a group without any has the loss 0."""
    known = F.when(F.col("pixels") > 0, F.col("loss"))
    return binary_loss(df, [*keys, channel]).groupBy(*keys).agg(F.coalesce(F.avg(known), F.lit(0.0)).alias("loss"), F.count(known).alias("channels"))


def class_loss(df: DataFrame, keys: list[str], pixel: list[str], smooth: float = 1.0) -> DataFrame:
    """Cross entropy plus mean soft Dice over classes of (keys, pixel, class, p, t, valid): t is the true class, class 0 the background; with how many pixels are known. A group without any has the loss 0."""
    hit = (F.col("class") == F.col("t")).cast("int")
    per = loss_sums(df.withColumn("t", hit), [*keys, "class"])
    dice = (2 * F.col("both") + smooth) / (F.col("p_area") + F.col("t_area") + smooth)
    known = df.where((F.col("valid") > 0) & (F.col("class") == F.col("t")))
    entropy = known.groupBy(*keys).agg(F.avg(-F.log(F.least(F.greatest("p", F.lit(1e-7)), F.lit(1.0)))).alias("_ce"), F.count("*").alias("_known"))
    return per.where("class > 0").groupBy(*keys).agg(F.avg(dice).alias("_dice")).join(entropy, keys, "left").select(*keys, (F.coalesce("_ce", F.lit(0.0)) + 1 - F.col("_dice")).alias("loss"), F.coalesce("_known", F.lit(0)).alias("pixels"))


def full_validation(pred: DataFrame, truth: DataFrame, patches: DataFrame, valid: DataFrame, size: int) -> DataFrame:
    """(class, tp, fp, fn, scores) over the whole reserved pool: known pixels of all validation patches (py, px, split)."""
    held = patches.where("split = 'validation'").select("py", "px").distinct()
    inside = valid.withColumn("py", F.floor(F.col("y") / size).cast("long")).withColumn("px", F.floor(F.col("x") / size).cast("long")).join(held, ["py", "px"], "left_semi").select("y", "x")
    return scores(confusion(pred, truth, inside, ["y", "x"]))
