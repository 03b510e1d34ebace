"""Checkpoints of models as folders: weights as a table, what they were trained as, and companions for people."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.workspace import chart_svg, csv_text, publish, write_json

VERSION = 1
#: Files that belong to a checkpoint, beside its weights. Fixed names.
COMPANIONS = ("model.json", "history.json", "learning.svg", "metrics.csv")
SCORES = ("dice", "iou", "precision", "recall", "loss")


def save_checkpoint(weights: DataFrame, folder: str, config: dict, history: list[dict], identity: dict, metrics: dict) -> None:
    """Store a checkpoint (tensor, pos, value) whole or not at all, with its history, curve and table of metrics."""
    spark, staged = weights.sparkSession, f"{folder}.staged-{uuid.uuid4().hex[:8]}"
    weights.select("tensor", "pos", "value").write.parquet(f"{staged}/weights")
    points = [(p["epoch"], p.get("dice"), p.get("loss")) for h in history for p in h.get("rounds", [])]
    write_json(f"{staged}/model.json", {"version": VERSION, "config": config, "identity": identity, "metrics": metrics}, spark)
    write_json(f"{staged}/history.json", {"version": VERSION, "model_file": os.path.basename(folder), "history": history}, spark)
    Path(staged, "learning.svg").write_text(chart_svg({"dice": [(e, d) for e, d, _ in points if d is not None]}))
    Path(staged, "metrics.csv").write_text(csv_text([{"epoch": e, "dice": d, "loss": x} for e, d, x in points], ["epoch", "dice", "loss"]))
    publish(spark, staged, folder)


def load_checkpoint(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """(weights, description with its history); what isn't a checkpoint of a known version is an error."""
    try:
        model = json.loads(Path(folder, "model.json").read_text())
    except FileNotFoundError:
        raise ValueError(f"{folder} is no checkpoint") from None
    if model.get("version") != VERSION:
        raise ValueError(f"{folder} has an unknown version")
    history = Path(folder, "history.json")
    return spark.read.parquet(f"{folder}/weights"), model | {"history": json.loads(history.read_text())["history"] if history.exists() else []}


def _state(folder: str) -> dict[str, tuple[int, int]]:
    return {str(p.relative_to(folder)): (p.stat().st_size, p.stat().st_mtime_ns) for p in sorted(Path(folder).rglob("*")) if p.is_file()}


def copy_bundle(source: str, models: str, name: str) -> str:
    """Copy a checkpoint into the models' folder under a free name; a source that changes meanwhile is an error and leaves nothing.

    A checkpoint that lies there already stays where it is. None is ever replaced.
    """
    if not os.path.exists(os.path.join(source, "model.json")):
        raise ValueError("the checkpoint is missing")
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name):
        raise ValueError(f"{name!r} is no name of a checkpoint")
    if Path(source).resolve().is_relative_to(Path(models).resolve()):
        return source
    os.makedirs(models, exist_ok=True)
    staged, before = os.path.join(models, f".copy-{uuid.uuid4().hex[:8]}"), _state(source)
    try:
        shutil.copytree(source, staged)
        if _state(source) != before:
            raise ValueError("the checkpoint changed while it was copied")
        stem, ext = os.path.splitext(name)
        target, k = os.path.join(models, name), 2
        history = Path(staged, "history.json")
        while True:  # a folder that isn't empty can't be replaced by a rename: another writer's stays
            if not os.path.exists(target):
                if history.exists():
                    history.write_text(json.dumps(json.loads(history.read_text()) | {"model_file": os.path.basename(target)}))
                os.rename(staged, target)
                return target
            target, k = os.path.join(models, f"{stem}-{k}{ext}"), k + 1
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def verify_relocated(folder: str, run: dict, config: dict) -> None:
    """Whether a checkpoint found elsewhere is the one that a run recorded: model, task, configuration, last history and scores."""
    try:
        model = json.loads(Path(folder, "model.json").read_text())
        history = json.loads(Path(folder, "history.json").read_text())["history"]
    except FileNotFoundError:
        raise ValueError("choose an available checkpoint") from None
    identity = model.get("identity", {})
    checks = [
        (identity.get("model_id") in (None, run["model_id"]), "it belongs to another model"),
        (not (identity.get("task_id") and run.get("task_id")) or identity["task_id"] == run["task_id"], "it belongs to another task"),
        (bool(config) and model.get("config") == config, "its configuration is another one"),
        (not run.get("history") or (history and history[-1] == run["history"]), "its history is another one"),
        (bool(run.get("history")) or identity.get("model_id") is not None, "nothing tells which model it is"),
        (all(run.get(s) is None or model.get("metrics", {}).get(s) == run[s] for s in SCORES), "its scores are others"),
        (os.path.isdir(os.path.join(folder, "weights")), "it holds no weights"),
    ]
    for ok, problem in checks:
        if not ok:
            raise ValueError(f"the checkpoint can't be relinked: {problem}")


def freeze_dataset(patches: DataFrame, read: DataFrame, folder: str, description: dict) -> None:
    """Store patches (py, px, split, ...) with their tensors (py, px, x, y, valid) as a model reads them, published whole."""
    spark, staged = patches.sparkSession, f"{folder}.staged-{uuid.uuid4().hex[:8]}"
    patches.join(read, ["py", "px"]).write.partitionBy("split").parquet(f"{staged}/patches")
    write_json(f"{staged}/dataset.json", description, spark)
    publish(spark, staged, folder)


def thaw_dataset(spark: SparkSession, folder: str, split: str | None = None) -> tuple[DataFrame, dict]:
    """(patches with tensors, of one split if it is named; description)."""
    rows = spark.read.parquet(f"{folder}/patches")
    return rows if split is None else rows.where(F.col("split") == split), json.loads(Path(folder, "dataset.json").read_text())


def provider_versions(names: list[str]) -> dict[str, str | None]:
    """Installed versions of libraries that a model may need; None for those that aren't there."""
    from importlib import metadata

    out: dict[str, str | None] = {}
    for n in names:
        try:
            out[n] = metadata.version(n)
        except metadata.PackageNotFoundError:
            out[n] = None
    return out


def check_config(config: dict) -> None:
    """Refuse training settings that no run can use: sizes, rates, counts, class names."""
    def within(name: str, low: float, high: float) -> None:
        value = config.get(name)
        if value is not None and not low <= value <= high:
            raise ValueError(f"{name} must be {low:g} to {high:g}")

    for name, low, high in (("input_pixels", 32, 1024), ("crop_pixels", 32, 8192), ("epochs", 1, 100_000), ("batch_size", 1, 4096), ("learning_rate", 1e-8, 1), ("holdout_fraction", 0.05, 0.5), ("folds", 2, 10)):
        within(name, low, high)
    names = config.get("class_names") or []
    if len({n.strip().lower() for n in names}) != len(names) or not all(n.strip() for n in names):
        raise ValueError("class names must be given, each once")
    if config.get("multilabel") and len(names) < 1:
        raise ValueError("channels need names")
