"""Layers of a workspace: which plane of a source is read, identity, records in a manifest, and guards."""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import workspace

#: Attributes that a record keeps of each type; the first group of all types. Fixed names of the manifest.
COMMON = ("name", "visible", "opacity", "blending", "scale", "translate", "rotate", "shear", "affine")
OWN = {
    "Labels": (), "Image": ("contrast_limits", "gamma", "colormap", "rgb"),
    "Shapes": ("data", "shape_type", "features", "edge_width", "edge_color", "face_color"),
    "Points": ("data", "features", "size", "symbol", "face_color", "border_color"),
}


# ---- planes

def full_resolution(levels: DataFrame) -> DataFrame:
    """Level 0 of stored levels, without reading the others."""
    return levels.where("level = 0").drop("level") if "level" in levels.columns else levels


def plane_axes(shape: tuple[int, ...]) -> tuple[int, int]:
    """The two axes of a source that is a plane: both, or the only ones that aren't single."""
    axes = tuple(range(2)) if len(shape) == 2 else tuple(k for k, n in enumerate(shape) if n != 1)
    if len(axes) != 2:
        raise ValueError(f"a source of shape {shape} is no plane")
    return axes


def squeezed(voxels: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """(y, x, v) of a table (i0, i1, ..., v) whose other axes are single."""
    y, x = plane_axes(shape)
    return voxels.select(F.col(f"i{y}").alias("y"), F.col(f"i{x}").alias("x"), "v")


def label_kind(dtype: str) -> None:
    """Masks hold booleans or integers."""
    if np.dtype(dtype).kind not in "bui":
        raise ValueError(f"{dtype} isn't a type of labels")


# ---- identity

def identified(record: dict) -> dict:
    """The record with an id, which it gets once and keeps."""
    return record if record.get("id") else record | {"id": str(uuid.uuid4())}


def screening_context(shape: tuple[int, int], affine) -> str:
    """What a saved selection was made on: equal for equal shapes and transforms."""
    return hashlib.sha256(json.dumps([list(shape), np.round(np.asarray(affine, float), 9).tolist()]).encode()).hexdigest()


def journal_key(record: dict, base: str) -> tuple[str, str, str]:
    """Identity of a progress record: type, kind of storage, resolved path."""
    storage = record["storage"]
    return record["type"], storage["kind"], os.path.join(workspace.resolve(storage["path"], base), storage.get("array", ""))


def destination_key(record: dict) -> tuple:
    """What a confirmation of a copy's destination holds for: asked again when any of it changes."""
    return record.get("id"), record.get("name"), tuple(record.get("shape", ())), json.dumps(plain(record.get("affine"))), record.get("role")


# ---- records

def plain(value: object) -> object:
    """A value as JSON can hold it: arrays as lists, numbers of NumPy as numbers, paths and anything else as text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in value]
    if isinstance(value, (np.ndarray, np.generic)):
        return plain(value.tolist())
    return value if value is None or isinstance(value, (str, bool, int, float)) else str(value)


def layer_record(layer: dict, base: str) -> dict:
    """The manifest's record of a layer (a dict with type, attributes, and path or data).

    Labels must be stored; images are stored or linked to a file; shapes and points are held in the record. Any
    other type has no record.
    """
    kind = layer.get("type")
    if kind not in OWN:
        raise ValueError(f"{kind} layers aren't kept")
    record = {"type": kind} | {k: plain(layer[k]) for k in COMMON + OWN[kind] if k in layer}
    if kind in ("Shapes", "Points"):
        return record | {"storage": {"kind": "inline"}}
    if layer.get("path"):
        return record | {"storage": {"kind": "parquet", "path": workspace.relative(layer["path"], base), "mode": "r+" if kind == "Labels" else "r"}}
    if kind == "Image" and layer.get("file"):
        return record | {"storage": {"kind": "file", "path": workspace.relative(layer["file"], base)}}
    raise ValueError(f"{kind} layer {layer.get('name')} is neither stored nor a file")


def restored(record: dict, library: dict | None = None) -> dict:
    """Attributes of a layer from its record; a transform that isn't finite, or a library of another shape or source, is an error."""
    for name in ("scale", "translate", "rotate", "shear", "affine"):
        if record.get(name) is not None and not np.isfinite(np.asarray(record[name], float)).all():
            raise ValueError(f"{record.get('name')}: {name} isn't finite")
    if library is not None and (list(library["shape"]) != list(record["shape"]) or library["source_id"] != record["id"]):
        raise ValueError(f"{record.get('name')}: the component library belongs to another layer")
    return {k: record[k] for k in COMMON + OWN.get(record["type"], ()) if k in record}


def _asset(old: dict, folder: str) -> dict | None:
    return old.get("asset_path") and {"kind": "store", "path": f"{folder}/{old['asset_path'].strip()}", "array": (old.get("asset_dataset") or "").strip().strip("/"), "mode": "r+" if kind_of(old) == "Labels" else "r"}


def _file(old: dict, folder: str) -> dict | None:
    source = old.get("source") or {}
    return source.get("path") and {"kind": "file", "path": source["path"].strip()} | {k: source[k] for k in ("reader_plugin",) if source.get(k)}


def kind_of(old: dict) -> str:
    return old.get("layer_type") or old.get("inline_kind") or old.get("type") or ""


#: How records of shared manifests tell where a layer's data lie; the first that does counts.
SHARED_STORAGE = (
    lambda old, folder: old.get("storage"), _asset, _file,
    lambda old, folder: {"kind": "inline"} if {kind_of(old), old.get("inline_kind")} & {"Shapes", "Points"} else None,
    lambda old, folder: {"kind": "unsupported"},
)
#: What a shared manifest holds besides its layers, and what stands for it where it is missing.
SHARED_REST = {"viewer": {}, "skipped_layers": []}


def shared_layers(document: dict, manifest: str) -> dict:
    folder = f"{os.path.splitext(os.path.basename(manifest))[0]}_assets"
    tell = lambda old: next(s for rule in SHARED_STORAGE if (s := rule(old, folder)))
    layers = [old | {"type": kind_of(old), "storage": tell(old)} for old in document["layers"] if isinstance(old, dict)]
    return {"imported": "shared-2", "layers": layers, "models": {}} | {k: document.get(k) or v for k, v in SHARED_REST.items()}


def upgraded(document: dict, manifest: str) -> dict:
    """A manifest of any format that was ever written, in the newest form.

    Own ones go by upgrade(). One without a format and of version 2 is a shared manifest: assets lie in <manifest>_assets, or a layer names a
    source file, or is held inline. Other workspaces (a format ending in ``sam3-workspace`` of version 1, any other workspace of version 1
    or 2 with records of layers) are read as they are; ``imported`` says what they were.
    """
    name, version, newest = document.get("format") or "", document.get("version"), {"format": workspace.FORMAT, "version": workspace.VERSION}
    if name == workspace.FORMAT:
        return workspace.upgrade(document)
    if not isinstance(document.get("layers"), list):
        raise ValueError("not a workspace of a known format")
    if not name and version == 2:
        return newest | shared_layers(document, manifest)
    if not name.endswith("-workspace") or version not in ((1,) if name.endswith("sam3-workspace") else (1, 2)):
        raise ValueError("not a workspace of a known format and version")
    return document | newest | {"imported": f"{name}-{version}"}


def storage_reference(record: dict, base: str) -> str | None:
    """The store or file of a record, if it is there."""
    path = (record.get("storage") or {}).get("path") or record.get("path")
    full = workspace.resolve(path, base) if path else None
    return full if full and os.path.exists(full) else None


def keep_foreign(new: dict, old: dict, known: tuple[str, ...] = ("format", "version", "layers", "models")) -> dict:
    """A manifest with the entries of the former one that this engine doesn't know."""
    return {k: v for k, v in old.items() if k not in known} | new


def chunk_shape(height: int, width: int, channels: int | None = None, side: int = 1024) -> tuple[int, ...]:
    """Chunks of an image: squares cut to the image, all channels together."""
    return (min(side, height), min(side, width)) + ((channels,) if channels else ())


def copy_library(spark: SparkSession, source: str, target: str) -> str:
    """Copy the current version of a component library's table to a new place."""
    from gridloom.operators.library import VersionedTable

    table = VersionedTable(spark, target)
    table.commit(VersionedTable(spark, source).read(spark), table.version())
    return target


# ---- modes and guards

def loading_mode(saved: str | None, chosen: str | None = None) -> str:
    """How masks are opened: as chosen in this session, else as saved; full layers are opened by the grid unless chosen anew."""
    mode = chosen or {"full": "grid"}.get(saved or "grid", saved or "grid")
    if mode not in ("auto", "grid", "full"):
        raise ValueError(f"{mode} is no way to open masks")
    return mode


def opens_tiled(shape: tuple[int, ...], mode: str, bytes_per_pixel: int, free_bytes: int) -> bool:
    from gridloom.functions.geometry import uses_tiles

    return len(shape) == 2 and mode != "full" and (mode == "grid" or uses_tiles(*shape, bytes_per_pixel, free_bytes))


def writable(record: dict) -> bool:
    return (record.get("storage") or {}).get("mode", "r") != "r" and not record.get("read_only", False)


@contextmanager
def exclusive(folder: str, task: str):
    """Hold a workspace for one task (training, scan, save): another one fails while it runs. The mark goes with the task."""
    path = Path(folder) / ".task"
    try:
        path.touch(exist_ok=False)
    except FileExistsError:
        raise RuntimeError(f"finish {path.read_text() or 'the other task'} first") from None
    try:
        path.write_text(task)
        yield
    finally:
        path.unlink(missing_ok=True)


def save_with_edits(pending: list[Callable[[], None]], save: Callable[[], None]) -> None:
    """Write all pending edits, then save; an edit that fails stops the save."""
    for write in pending:
        write()
    save()


# ---- tiles that are edited

def crop(mask: DataFrame, row: int, col: int, size: int, shape: tuple[int, int]) -> tuple[tuple[int, int, int, int] | None, DataFrame]:
    """(box, pixels counted from its corner) of a tile; outside the source there is no box and nothing in it."""
    y0, x0 = row * size, col * size
    if not (0 <= y0 < shape[0] and 0 <= x0 < shape[1]):
        return None, mask.where(F.lit(False)).select("y", "x", "v")
    y1, x1 = min(shape[0], y0 + size), min(shape[1], x0 + size)
    inside = (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    return (y0, x0, y1, x1), mask.where(inside).select((F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "v")


def tile_at(affine, world: tuple[float, float], size: int, shape: tuple[int, int]) -> tuple[int, int]:
    """(row, col) of the tile under a world point; outside the source is an error."""
    matrix = np.asarray(affine, float)
    y, x = np.linalg.solve(matrix[:2, :2], np.asarray(world, float) - matrix[:2, 2])
    row, col = math.floor(y / size), math.floor(x / size)
    if not (0 <= row < -(-shape[0] // size) and 0 <= col < -(-shape[1] // size)):
        raise ValueError("the point lies outside the source")
    return row, col


def promoted(crop_pixels: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """A crop's pixels in the full source, where all else is empty."""
    return crop_pixels.where("v <> 0").select((F.col("y") + box[0]).alias("y"), (F.col("x") + box[1]).alias("x"), "v")


def latest_loads(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(layer, request, ...) of loaded tiles (layer, request, ...) that are still asked for: each layer's last request alone."""
    return results.join(requests.groupBy("layer").agg(F.max("request").alias("request")), ["layer", "request"])


def planned_reads(records: list[dict], origin: tuple[int, int], size: int, limit: int = 128 << 20) -> list[tuple[str, tuple[int, int, int, int] | None]]:
    """(layer, box) to read of each layer for a window; more bytes than the limit are an error."""
    out, total = [], 0
    for r in records:
        (h, w), (y, x) = r["shape"], origin
        box = (y, x, min(h, y + size), min(w, x + size)) if y < h and x < w else None
        total += (box[2] - box[0]) * (box[3] - box[1]) * r.get("bytes", 4) if box else 0
        out.append((r["name"], box))
    if total > limit:
        raise ValueError(f"the window needs {total} bytes, {limit} may be read")
    return out


def follow_signature(records: list[dict]) -> str:
    """Layers, shapes and transforms that a read was planned for; it is applied only if they are still the same."""
    return hashlib.sha256(json.dumps(plain([[r["name"], r["shape"], r.get("affine"), r.get("path")] for r in records])).encode()).hexdigest()
