"""Queries of stored tiles and of the library that is kept on them, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.operators import library
from gridloom.plans.queries import labelled_sql, query
from gridloom.plans.shared import shared_root
from gridloom.sources import rasters, tilestore
from gridloom.sources.rasters import EVENT_MASK_SQL, PART_MASK_SQL


def fresh_folder(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(spark, mask, size: int, edge: int = 1 << 20) -> tilestore.TileStore:
    store = tilestore.TileStore.create(spark, fresh_folder(spark, "mask"), edge, edge, size)
    store.write(mask)
    return store


EVENTS_EDITED_SQL = f"{EVENT_MASK_SQL}, one AS (SELECT y, x, CASE WHEN (y + x) % 11 = 0 THEN 1 + v % 5 ELSE v END AS v FROM mask), two AS (SELECT y, x, v FROM one WHERE (y * 3 + x) % 13 <> 0 UNION ALL SELECT y, x + 1000, v FROM mask WHERE v = 3)"


def edited_store(spark, sf_dir) -> tilestore.TileStore:
    """The mask of events, in which one edit changes values and the next one takes pixels away and adds others."""
    mask = rasters.event_mask(spark, sf_dir)
    store = stored(spark, mask, 32)
    here = (F.col("y") + F.col("x")) % 11 == 0
    store.edit(mask.where(here).select("y", "x", F.col("v").alias("old"), (1 + F.col("v") % 5).alias("new")))
    gone = store.read().where((F.col("y") * 3 + F.col("x")) % 13 == 0).select("y", "x", F.col("v").alias("old"), F.lit(None).cast("long").alias("new"))
    added = mask.where("v = 3").select("y", (F.col("x") + 1000).alias("x"), F.lit(None).cast("long").alias("old"), F.col("v").alias("new"))
    store.edit(gone.unionByName(added))
    return store


@query(f"WITH {EVENTS_EDITED_SQL} SELECT y, x, v FROM two")
def tile_store_edits(spark, sf_dir):
    return edited_store(spark, sf_dir).read()


@query(f"WITH {EVENTS_EDITED_SQL} SELECT y, x, v FROM one WHERE y >= 30 AND y < 90 AND x >= 10 AND x < 75")
def tile_store_former_window(spark, sf_dir):
    """A window as it was after the first edit."""
    return edited_store(spark, sf_dir).read((30, 10, 90, 75), version=3)


@query(f"WITH {EVENTS_EDITED_SQL} SELECT DISTINCT coalesce(m.y, t.y) // 32 AS ty, coalesce(m.x, t.x) // 32 AS tx FROM mask m FULL JOIN two t USING (y, x) WHERE m.v IS DISTINCT FROM t.v")
def tile_tree_changes(spark, sf_dir):
    """Two stores compared from the roots of their trees down."""
    found = tilestore.changed_tiles(stored(spark, rasters.event_mask(spark, sf_dir), 32), edited_store(spark, sf_dir))
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("ty", "tx")])


PARTS_EDITED_SQL = "edited AS (SELECT y, x, CASE WHEN y BETWEEN 3 AND 6 AND x BETWEEN 2 AND 7 AND (y + x) % 3 = 1 THEN 1 + v % 3 ELSE v END AS v FROM mask WHERE NOT (y BETWEEN 3 AND 6 AND x BETWEEN 2 AND 7 AND (y + x) % 3 = 0))"


LIBRARY_SQL = f"""{PART_MASK_SQL}, {PARTS_EDITED_SQL}, {labelled_sql("{before}")}, {labelled_sql("edited", "z")},
ids AS (SELECT component, row_number() OVER (ORDER BY component) AS id, count(*) AS area FROM pix GROUP BY component),
m AS (SELECT component, min(v) AS label_value, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM zpix GROUP BY component),
pr AS (SELECT z.component AS new_id, p.component AS old_id, max(z.v) AS nv, max(p.v) AS ov, count(*) AS n FROM zpix z JOIN pix p USING (y, x) GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY new_id) AS a, count(*) OVER (PARTITION BY old_id) AS b FROM pr),
j AS (SELECT m.*, i.id, k.n = m.area AND k.n = i.area AS same, row_number() OVER (PARTITION BY i.id IS NULL ORDER BY m.component) AS fresh FROM m LEFT JOIN k ON k.new_id = m.component AND a = 1 AND b = 1 AND nv = ov LEFT JOIN ids i ON i.component = k.old_id)"""


@query(f"""WITH RECURSIVE {LIBRARY_SQL.replace("{before}", "mask")}
SELECT coalesce(id, (SELECT count(*) FROM ids) + fresh)::BIGINT AS component_id, label_value, area, y0, x0, y1, x1, coalesce(id = 1 AND same, false) AS included, coalesce(id IS NOT NULL AND NOT same, false) AS needs_review FROM j""")
def library_incremental(spark, sf_dir):
    """A library of the mask of parts after a choice and an edit of some pixels, kept up to date from the tiles that the edit touched."""
    mask = rasters.part_mask(spark, sf_dir)
    store = stored(spark, mask, 64)
    lib = library.ComponentLibrary.create(spark, fresh_folder(spark, "library"), 1 << 20, 1 << 20, "parts", 64)
    lib.update(store)
    lib.select(1, True)
    near = store.read((3, 2, 7, 8)).withColumn("k", (F.col("y") + F.col("x")) % 3).where("k < 2")
    store.edit(near.select("y", "x", F.col("v").alias("old"), F.when(F.col("k") == 1, 1 + F.col("v") % 3).alias("new")))
    lib.mark_dirty(spark.createDataFrame([(1, 3, 2, 7, 8)], "seq long, y0 long, x0 long, y1 long, x1 long"))
    lib.update(store)
    return lib.table("components").where("active").select("component_id", "label_value", "area", "y0", "x0", "y1", "x1", "included", "needs_review")


@query(f"""WITH RECURSIVE {LIBRARY_SQL.replace("{before}", "(SELECT * FROM mask WHERE NOT (y BETWEEN 3 AND 6 AND x BETWEEN 2 AND 7))")} SELECT count(*) AS total, 0::BIGINT AS selected, count(*) FILTER (WHERE id IS NOT NULL AND NOT same) AS review FROM j""")
def library_found_by_digests(spark, sf_dir):
    """An edit that nobody noted is found by the trees' digests; the counts are those that the state keeps."""
    mask = rasters.part_mask(spark, sf_dir)
    store = stored(spark, mask.where("NOT (y BETWEEN 3 AND 6 AND x BETWEEN 2 AND 7)"), 64)
    lib = library.ComponentLibrary.create(spark, fresh_folder(spark, "library"), 1 << 20, 1 << 20, "parts", 64)
    lib.update(store)
    near = mask.where("y BETWEEN 3 AND 6 AND x BETWEEN 2 AND 7").withColumn("k", (F.col("y") + F.col("x")) % 3).where("k > 0")
    store.edit(near.select("y", "x", F.lit(None).cast("long").alias("old"), F.when(F.col("k") == 1, 1 + F.col("v") % 3).otherwise(F.col("v")).alias("new")))
    lib.update(store, verify=True)
    lib.verify(store, (0, 0, 64, 64))
    return lib.counts()
