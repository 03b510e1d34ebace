"""Masks in stored tiles: copy-on-write segments behind a log of versions, so that an edit costs what it touches.

A segment is a folder of Parquet files, sorted by tile, many tiles in a file; row groups and pages that a window doesn't touch are
skipped by the tile's columns. It holds whole tiles, which take the place of those tiles in older segments, or single pixels, of
which the newest counts (0: removed). A version names its segments in a small document; it counts once its mark is made, which
one writer alone can do, so that readers see whole versions only and a crash at any point leaves the former one.
Small segments are merged when there are many (each at least half as large as all newer ones together), so a tile is rewritten
a few times, however many edits there are.

Each segment also stores how it changes the digest of its tiles, of the 8 x 8 tiles around, and so on to the root: an exclusive or of
the pixels' hashes, which adds up over segments and over levels. Two stores are compared from the root down, and
only subtrees that differ are read.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.shared import materialize
from gridloom.sources.workspace import file_system

#: Levels above the tiles in the tree of digests, and bits of a tile's number that a level takes.
LEVELS, BITS = 4, 3
#: Tiles that are named one by one in a scan's filter; more are given as their bounds, and joined.
NAMED_TILES = 200
#: Segments of a version before small ones are merged.
SEGMENTS = 8
#: Times that an edit is checked anew when another writer's version came first.
ATTEMPTS = 4


class StaleVersion(RuntimeError):
    """Another writer made a version since the expected one."""


class VersionLog:
    """Numbered states (small documents) in a folder of any file system that Spark reads.

    A state is written beside, then a mark with the next number is created that names it, which fails if there is one. A mark that
    a crash left empty doesn't count; ``recover`` removes it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.files, self.path = file_system(spark, folder)

    def _write(self, path: str, text: str, overwrite: bool) -> None:
        out = self.files.create(self.path(path), overwrite)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def _read(self, path: str) -> str:
        stream = self.files.open(self.path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _marks(self) -> dict[int, int]:
        """Number of each mark: time of its making in milliseconds."""
        root = self.path(f"{self.folder}/versions")
        found = self.files.listStatus(root) if self.files.exists(root) else []
        return {int(s.getPath().getName()): s.getModificationTime() for s in found if s.getPath().getName().isdigit()}

    def _state_of(self, version: int) -> str | None:
        text = self._read(f"{self.folder}/versions/{version}")
        return text.strip() if text.endswith("\n") else None

    def versions(self) -> list[int]:
        return sorted(v for v in self._marks() if self._state_of(v))

    def latest(self) -> tuple[int, dict]:
        """(version, state) of the newest one; (0, {}) without any."""
        for version in sorted(self._marks(), reverse=True):
            if name := self._state_of(version):
                return version, json.loads(self._read(f"{self.folder}/states/{name}"))
        return 0, {}

    def at(self, version: int) -> dict:
        name = self._state_of(version)
        if name is None:
            raise ValueError(f"there is no version {version}")
        return json.loads(self._read(f"{self.folder}/states/{name}"))

    def commit(self, state: dict, expected: int) -> int:
        """Make the next version, if the newest is still the expected one."""
        now = self.latest()[0]
        if now != expected:
            raise StaleVersion(f"version {now} is not the expected {expected}")
        name = f"{expected + 1}-{uuid.uuid4().hex[:12]}.json"
        self._write(f"{self.folder}/states/{name}", json.dumps(state, sort_keys=True), True)
        try:
            self._write(f"{self.folder}/versions/{expected + 1}", f"{name}\n", False)
        except Py4JJavaError as error:
            raise StaleVersion(f"version {expected + 1} is not the expected one: another writer made it") from error
        return expected + 1

    def recover(self, older_than: float = 60) -> list[int]:
        """Remove marks that a crash left without a state, if they are that many seconds old; their numbers."""
        limit = (time.time() - older_than) * 1000
        void = [v for v, made in self._marks().items() if made <= limit and not self._state_of(v)]
        for version in void:
            self.files.delete(self.path(f"{self.folder}/versions/{version}"), False)
        return void


@dataclass
class Region:
    """Tiles that a scan is limited to: bounds that reach the files' statistics, and the tiles themselves where bounds aren't enough."""

    box: tuple[int, int, int, int]
    named: list[tuple[int, int]] | None = None
    frame: DataFrame | None = None

    @classmethod
    def window(cls, y0: int, x0: int, y1: int, x1: int, size: int) -> Region:
        return cls((y0 // size, x0 // size, (y1 - 1) // size, (x1 - 1) // size))

    @classmethod
    def of(cls, tiles: DataFrame) -> Region | None:
        """The region of a table (ty, tx) that is read several times; None if it is empty."""
        some = tiles.limit(NAMED_TILES + 1).collect()
        if not some:
            return None
        if len(some) <= NAMED_TILES:
            named = sorted((r.ty, r.tx) for r in some)
            ys, xs = zip(*named)
            return cls((min(ys), min(xs), max(ys), max(xs)), named)
        return cls(tuple(tiles.agg(F.min("ty"), F.min("tx"), F.max("ty"), F.max("tx")).first()), None, tiles)

    def limit(self, df: DataFrame) -> DataFrame:
        """Rows (ty, tx, ..) of these tiles."""
        y0, x0, y1, x1 = self.box
        df = df.where(F.col("ty").between(y0, y1) & F.col("tx").between(x0, x1))
        if self.named is not None:
            return df.where(reduce(Column.__or__, [(F.col("ty") == y) & (F.col("tx") == x) for y, x in self.named]))
        return df if self.frame is None else df.join(self.frame.select("ty", "tx"), ["ty", "tx"], "left_semi")

    def meets(self, box: list[int]) -> bool:
        return bool(box) and box[0] <= self.box[2] and box[2] >= self.box[0] and box[1] <= self.box[3] and box[3] >= self.box[1]


def tile_columns(size: int) -> dict[str, Column]:
    return {"ty": F.floor(F.col("y") / size).cast("int"), "tx": F.floor(F.col("x") / size).cast("int")}


def pixel_hashes(v: str) -> list[Column]:
    """Two hashes of a pixel (y, x, value); 0 for background."""
    there = F.col(v).isNotNull() & (F.col(v) != 0)
    value = F.col(v).cast("long")
    return [F.when(there, h).otherwise(F.lit(0).cast("long")) for h in (F.xxhash64("y", "x", value), F.xxhash64(F.lit("gridloom"), value, "x", "y"))]


def combined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, n, h1, h2, whole) summed by the keys."""
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.max("whole").alias("whole"))


class TileLog:
    """Reads and writes the segments of versions; y, x and the value columns given (v first) are what a pixel has."""

    NODES = "ty int, tx int, n long, h1 long, h2 long, whole boolean, level int"

    def __init__(self, spark: SparkSession, folder: str, size: int, columns: tuple[str, ...] = ("v",)):
        self.spark, self.folder, self.size, self.columns = spark, folder, size, columns
        self.schema = ", ".join(["ty int", "tx int", "y long", "x long", *(f"{c} long" for c in columns)])

    def _pixels(self, segment: dict, region: Region | None) -> DataFrame | None:
        if not segment["rows"] or (region is not None and not region.meets(segment["box"])):
            return None
        rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{segment['name']}/pixels")
        return rows if region is None else region.limit(rows)

    def nodes(self, segments: list[dict], level: int = 0, region: Region | None = None) -> DataFrame:
        """(ty, tx, n, h1, h2, whole) of the tree's nodes at a level, as the segments together have them."""
        parts = [self.spark.read.schema(self.NODES).parquet(f"{self.folder}/{s['name']}/nodes").where(F.col("level") == level).drop("level") for s in segments]
        if not parts:
            return self.spark.createDataFrame([], self.NODES).drop("level")
        return combined(reduce(DataFrame.unionByName, parts if region is None else [region.limit(p) for p in parts]), ["ty", "tx"])

    def _whole_tiles(self, segment: dict, region: Region | None) -> DataFrame:
        rows = self.spark.read.schema(self.NODES).parquet(f"{self.folder}/{segment['name']}/nodes").where("level = 0 AND whole").select("ty", "tx")
        return rows if region is None else region.limit(rows)

    def read(self, segments: list[dict], region: Region | None = None) -> DataFrame:
        """(y, x, value columns) of all pixels, or of a region's tiles."""
        none = self.spark.createDataFrame([], self.schema)
        tiles, pixels, newer = [], [], None
        for seq, segment in reversed([*enumerate(segments)]):
            rows = self._pixels(segment, region)
            if rows is not None:
                rows = rows if newer is None else rows.join(newer, ["ty", "tx"], "left_anti")
                (tiles if segment["kind"] == "tiles" else pixels).append(rows.withColumn("_seq", F.lit(seq)))
            if segment["kind"] == "tiles":
                own = self._whole_tiles(segment, region)
                newer = own if newer is None else newer.unionByName(own)
        values = ["y", "x", *self.columns]
        base = reduce(DataFrame.unionByName, [t.select(*values) for t in tiles], none.select(*values))
        if not pixels:
            return base
        last = reduce(DataFrame.unionByName, pixels).groupBy("y", "x").agg(*[F.max_by(c, "_seq").alias(c) for c in self.columns])
        return base.join(last.select("y", "x"), ["y", "x"], "left_anti").unionByName(last.where(F.col(self.columns[0]) != 0).select(*values))

    def _store(self, kind: str, rows: DataFrame, leaves: DataFrame) -> dict:
        """A segment of pixels, with the changes (ty, tx, n, h1, h2, whole) that it makes to the tree's leaves."""
        name = f"{kind}-{uuid.uuid4().hex[:12]}"
        rows.withColumns(tile_columns(self.size)).select("ty", "tx", "y", "x", *self.columns).repartitionByRange("ty", "tx").sortWithinPartitions("ty", "tx", "y", "x").write.parquet(f"{self.folder}/{name}/pixels")
        leaves = materialize(leaves.select("ty", "tx", "n", "h1", "h2", "whole"), "tile-leaves")
        above = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *[F.shiftright(c, BITS * k).alias(c) for c in ("ty", "tx")]) for k in range(LEVELS + 1)])).alias("at")
        nodes = combined(leaves.select(above, "n", "h1", "h2", "whole").select("at.level", "at.ty", "at.tx", "n", "h1", "h2", "whole"), ["level", "ty", "tx"])
        nodes.sortWithinPartitions("ty", "tx").write.partitionBy("level").parquet(f"{self.folder}/{name}/nodes")
        held = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}/pixels").count()  # from the files' footers
        box = leaves.agg(F.min("ty"), F.min("tx"), F.max("ty"), F.max("tx")).first()
        return {"name": name, "kind": kind, "rows": held, "box": list(box) if box[0] is not None else []}

    def leaves_of(self, pixels: DataFrame) -> DataFrame:
        """(ty, tx, n, h1, h2) of pixels (y, x, v)."""
        h1, h2 = pixel_hashes("v")
        return pixels.withColumns(tile_columns(self.size)).groupBy("ty", "tx").agg(F.count("*").alias("n"), F.bit_xor(h1).alias("h1"), F.bit_xor(h2).alias("h2"))

    def put(self, rows: DataFrame, tiles: DataFrame, segments: list[dict], region: Region | None = None) -> dict:
        """A segment of whole tiles (ty, tx), with all of their pixels; those without pixels become empty."""
        zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "h1", "h2")]
        new = tiles.select("ty", "tx").distinct().join(self.leaves_of(rows), ["ty", "tx"], "left").select("ty", "tx", *zero, F.lit(True).alias("whole"))
        old = self.nodes(segments, 0, region).join(tiles.select("ty", "tx"), ["ty", "tx"], "left_semi").select("ty", "tx", (-F.col("n")).alias("n"), "h1", "h2", F.lit(True).alias("whole"))
        return self._store("tiles", rows, combined(new.unionByName(old), ["ty", "tx"]))

    def patch(self, changes: DataFrame) -> dict:
        """A segment of single pixels (y, x, old, new); null or 0 stands for background."""
        (a1, a2), (b1, b2) = pixel_hashes("old"), pixel_hashes("new")
        there = lambda c: (F.col(c).isNotNull() & (F.col(c) != 0)).cast("long")
        rows = changes.withColumns(tile_columns(self.size)).select("ty", "tx", (there("new") - there("old")).alias("n"), a1.bitwiseXOR(b1).alias("h1"), a2.bitwiseXOR(b2).alias("h2"), F.lit(False).alias("whole"))
        return self._store("pixels", changes.select("y", "x", F.coalesce("new", F.lit(0)).cast("long").alias("v")), combined(rows, ["ty", "tx"]))

    def merged(self, segments: list[dict], most: int = SEGMENTS) -> list[dict]:
        """The segments, small ones at the end merged if there are more than ``most``."""
        if len(segments) <= most:
            return segments
        first, total = len(segments) - 1, segments[-1]["rows"]
        while first > 0 and (segments[first - 1]["rows"] <= 2 * total or first >= most):
            first -= 1
            total += segments[first]["rows"]
        some = segments[first:]
        if len(some) == 1:
            return segments
        leaves = materialize(self.nodes(some), "tile-merge")
        whole = leaves.select("ty", "tx") if first == 0 else leaves.where("whole").select("ty", "tx")
        rows = self.read(some).withColumns(tile_columns(self.size)).join(whole, ["ty", "tx"], "left_semi")
        if first == 0:
            return [self._store("tiles", rows, leaves.withColumn("whole", F.lit(True)))]
        out = [*segments[:first], self._store("tiles", rows, leaves)]
        singles = [(seq, self._pixels(s, None)) for seq, s in enumerate(some) if s["kind"] == "pixels"]
        singles = [p.join(whole, ["ty", "tx"], "left_anti").withColumn("_seq", F.lit(seq)) for seq, p in singles if p is not None]
        if singles:
            last = reduce(DataFrame.unionByName, singles).groupBy("y", "x").agg(*[F.max_by(c, "_seq").alias(c) for c in self.columns])
            kept = self._store("pixels", last, self.spark.createDataFrame([], self.NODES))
            if kept["rows"]:
                box = leaves.agg(F.min("ty"), F.min("tx"), F.max("ty"), F.max("tx")).first()
                out.append(kept | {"box": list(box)})
        return out


class TileStore:
    """A mask (y, x, v) of given size and range of values, in versions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder, VersionLog(spark, folder)
        version, state = self.log.latest()
        if not version:
            raise FileNotFoundError(f"no mask is stored in {folder}")
        self.size = state["size"]
        self.tiles = TileLog(spark, folder, self.size)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, height: int, width: int, size: int = 1024, low: int = 0, high: int = (1 << 32) - 1) -> TileStore:
        VersionLog(spark, folder).commit({"height": height, "width": width, "size": size, "low": low, "high": high, "segments": []}, 0)
        return cls(spark, folder)

    def state(self, version: int | None = None) -> dict:
        return self.log.latest()[1] if version is None else self.log.at(version)

    def read(self, window: tuple[int, int, int, int] | None = None, version: int | None = None) -> DataFrame:
        """(y, x, v) of the mask or of a window (y0, x0, y1, x1), now or at a version."""
        segments = self.state(version)["segments"]
        if window is None:
            return self.tiles.read(segments)
        y0, x0, y1, x1 = window
        inside = (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
        return self.tiles.read(segments, Region.window(y0, x0, y1, x1, self.size)).where(inside)

    def read_tiles(self, region: Region | None, version: int | None = None) -> DataFrame:
        return self.tiles.read(self.state(version)["segments"], region)

    def leaves(self, version: int | None = None) -> DataFrame:
        """(ty, tx, n, h1, h2) of the tiles."""
        return self.tiles.nodes(self.state(version)["segments"]).drop("whole")

    def _checked(self, value: str, state: dict) -> Column:
        """Why a pixel (y, x, value) can't be stored; null if it can."""
        outside = (F.col("y") < 0) | (F.col("x") < 0) | (F.col("y") >= state["height"]) | (F.col("x") >= state["width"])
        return F.when(outside, "a pixel is outside the mask").when((F.col(value) < state["low"]) | (F.col(value) > state["high"]), "a value is out of the mask's range")

    def write(self, mask: DataFrame) -> int:
        """A version with this mask and nothing of the former ones."""
        version, state = self.log.latest()
        rows = materialize(mask.where("v <> 0").select(*[F.col(c).cast("long").alias(c) for c in ("y", "x", "v")]), "tile-write")
        if wrong := rows.select(self._checked("v", state).alias("why")).where("why IS NOT NULL").first():
            raise ValueError(wrong.why)
        leaves = self.tiles.leaves_of(rows).withColumn("whole", F.lit(True))
        return self.log.commit(state | {"segments": [self.tiles._store("tiles", rows, leaves)]}, version)

    def edit(self, changes: DataFrame) -> int:
        """A version with changed pixels (y, x, old, new), null or 0 for background; only their tiles are read and only they are written.

        A pixel that holds neither its old nor its new value was changed by another writer; that, a value out of the mask's range or a
        pixel outside it is an error, and nothing is written. If another writer's version comes first, the edit is
        checked against it and made on top. Nothing to change makes no version.
        """
        empty = lambda c: F.when(F.col(c) != 0, F.col(c).cast("long")).alias(c)
        wanted = materialize(changes.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), empty("old"), empty("new")), "tile-edit")
        touched = materialize(wanted.select(*[c.alias(k) for k, c in tile_columns(self.size).items()]).distinct(), "tile-touched")
        region = Region.of(touched)
        for _ in range(ATTEMPTS):
            version, state = self.log.latest()
            if region is None:
                return version
            now = self.tiles.read(state["segments"], region).select("y", "x", F.col("v").alias("now"))
            both = wanted.join(now, ["y", "x"], "left")
            done, fits = F.col("now").eqNullSafe(F.col("new")), F.col("now").eqNullSafe(F.col("old"))
            why = F.coalesce(self._checked("new", state), F.when(~done & ~fits, "another writer changed an edited pixel"))
            both = materialize(both.select("y", "x", F.col("now").alias("old"), "new", why.alias("why"), done.alias("done")), "tile-checked")
            if wrong := both.where("why IS NOT NULL").first():
                raise ValueError(wrong.why)
            apply = both.where("NOT done")
            if apply.isEmpty():
                return version
            segments = [*state["segments"], self.tiles.patch(apply)]
            try:
                return self.log.commit(state | {"segments": self.tiles.merged(segments)}, version)
            except StaleVersion:
                continue
        raise StaleVersion("other writers' versions came first too often")

    def compact(self) -> int:
        """A version of one segment."""
        version, state = self.log.latest()
        if len(state["segments"]) < 2:
            return version
        return self.log.commit(state | {"segments": self.tiles.merged(state["segments"], 1)}, version)

    def changed_since(self, version: int) -> DataFrame:
        """(ty, tx) of tiles that a version and the newest one hold differently; segments that both have aren't read."""
        old, new = self.log.at(version)["segments"], self.state()["segments"]
        names = [{s["name"] for s in part} for part in (old, new)]
        other = [s for s in old if s["name"] not in names[1]] + [s for s in new if s["name"] not in names[0]]
        return self.tiles.nodes(other).where("h1 <> 0 OR h2 <> 0").select("ty", "tx")

    def vacuum(self, keep: int = 1, older_than: float = 3600) -> list[str]:
        """Delete segments and states that none of the last ``keep`` versions names, if they are that many seconds old; their names."""
        limit, versions = (time.time() - older_than) * 1000, self.log.versions()
        states = [self.log.at(v) for v in versions[-keep:]]
        named = {s["name"] for state in states for s in state["segments"]}
        for version in versions[:-keep]:
            self.log.files.delete(self.log.path(f"{self.folder}/versions/{version}"), False)
        gone = []
        for status in self.log.files.listStatus(self.log.path(self.folder)):
            name = status.getPath().getName()
            if name.startswith(("tiles-", "pixels-")) and name not in named and status.getModificationTime() <= limit:
                self.log.files.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)


def changed_tiles(a: TileStore, b: TileStore) -> DataFrame:
    """(ty, tx) of tiles that two stores of one tile size hold differently: level by level from the root, below nodes that differ."""
    if a.size != b.size:
        raise ValueError("the stores' tiles differ in size")
    frontier = None
    for level in range(LEVELS, -1, -1):
        sides = []
        for store, p in ((a, "a"), (b, "b")):
            nodes = store.tiles.nodes(store.state()["segments"], level, Region.of(frontier) if frontier is not None else None)
            sides.append(nodes.select("ty", "tx", F.col("h1").alias(f"{p}1"), F.col("h2").alias(f"{p}2")))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        both = sides[0].join(sides[1], ["ty", "tx"], "full").where((zero("a1") != zero("b1")) | (zero("a2") != zero("b2")))
        found = materialize(both.select("ty", "tx"), "tree-level")
        if level == 0 or found.isEmpty():
            return found
        below = F.explode(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)))
        spread = found.withColumn("_y", below).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit((1 << BITS) - 1))))
        frontier = materialize(spread.select((F.col("ty") * (1 << BITS) + F.col("_y")).cast("int").alias("ty"), (F.col("tx") * (1 << BITS) + F.col("_x")).cast("int").alias("tx")), "tree-frontier")
    return found
