"""Queries of crop sampling and of kept holdouts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import crops, holdouts
from gridloom.plans.queries import labelled_sql, query
from gridloom.sources import rasters
from gridloom.sources.rasters import EVENT_MASK_SQL

#: Height and width of the mask of clusters, crop, least side of a block, scan tile.
CLUSTER_SHAPE, CROP, BLOCK, SCAN_TILE = (960, 768), 32, 64, 4


def cluster_mask(spark, sf_dir):
    """Tens of the events' mask, a third of them, set apart."""
    mask = rasters.event_mask(spark, sf_dir).where("(floor(y / 10) + floor(x / 10)) % 3 = 0")
    return mask.select(*[(F.floor(F.col(c) / 10) * 64 + F.col(c) % 10).cast("long").alias(c) for c in "yx"], "v")


ANCHORS_SQL = f"""{EVENT_MASK_SQL}, cl AS (SELECT (y // 10) * 64 + y % 10 AS y, (x // 10) * 64 + x % 10 AS x FROM mask WHERE (y // 10 + x // 10) % 3 = 0),
sc AS (SELECT y, x, 1 + ((y // 64) * 12 + x // 64) * 1000 + (y % 64 // 4) * 20 + x % 64 // 4 AS v FROM cl), {labelled_sql("sc", "z")},
mid AS (SELECT (y // 64) * 12 + x // 64 AS block, y, x FROM zpix QUALIFY row_number() OVER (PARTITION BY component ORDER BY y, x) - 1 = count(*) OVER (PARTITION BY component) // 2),
an AS (SELECT block, y, x, row_number() OVER (PARTITION BY block ORDER BY md5('7:' || y || ':' || x)) AS rank, count(*) OVER (PARTITION BY block) AS seen FROM mid QUALIFY rank <= 16)"""


@query(f"WITH RECURSIVE {ANCHORS_SQL} SELECT block, y, x, rank::INTEGER AS rank, seen FROM an")
def crop_block_anchors(spark, sf_dir):
    """One middle pixel for each piece of foreground, sixteen a block: a large piece has one chance as a small one has."""
    mask = cluster_mask(spark, sf_dir)
    last = mask.agg(F.max("y")).first()[0] or 0
    shape = max(CLUSTER_SHAPE[0], (last // BLOCK + 1) * BLOCK), CLUSTER_SHAPE[1]  # whole blocks around all users
    return crops.anchors(mask, *shape, *crops.block_counts(*shape, CROP, BLOCK), "7", SCAN_TILE).drop("ticket")


def draw_sql(what: str) -> str:
    return f"('0x' || substr(md5(seed || ':{what}:' || split || ':' || i || ':' || attempt), 1, 8))::UINTEGER::BIGINT"


SCHEDULE_SQL = f"""{ANCHORS_SQL},
bl AS (SELECT b AS block, b // 12 * 64 AS y0, b % 12 * 64 AS x0, b IN (SELECT block FROM an) AS positive FROM (SELECT unnest(range(180)) AS b)),
sp AS (SELECT *, CASE WHEN row_number() OVER w <= greatest(positive::INT, count(*) OVER (PARTITION BY positive) // 4) THEN 'validation' ELSE 'training' END AS split FROM bl WINDOW w AS (PARTITION BY positive ORDER BY md5('42:' || block))),
po AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY block) - 1 AS pool, row_number() OVER (PARTITION BY split, positive ORDER BY md5('42:' || block)) - 1 AS place, count(*) OVER (PARTITION BY split) AS n_pool, count(*) FILTER (WHERE positive) OVER (PARTITION BY split) AS n_positive FROM sp),
want AS (SELECT split, seed, i, CASE WHEN i % 2 = 0 THEN 'positive' WHEN i % 4 = 1 THEN 'nearby background' ELSE 'background' END AS requested FROM (SELECT 'training' AS split, '7' AS seed, unnest(range(150)) AS i UNION ALL SELECT 'validation', '42', unnest(range(50)))),
att AS (SELECT *, unnest(range(CASE WHEN requested = 'positive' THEN 1 ELSE 64 END)) AS attempt FROM want),
d AS (SELECT *, requested = 'nearby background' AND attempt < 32 AS near, {", ".join(f"{draw_sql(w)} AS d_{w}" for w in ("block", "anchor", "y", "x", "direction", "step"))} FROM att),
e AS (SELECT d.*, b.block, b.y0 AS by0, b.x0 AS bx0 FROM d JOIN po b ON b.split = d.split AND CASE WHEN requested = 'positive' THEN b.positive AND b.place = i // 2 % n_positive WHEN near THEN b.positive AND b.place = d_block % n_positive ELSE b.pool = d_block % n_pool END),
f AS (SELECT e.*, a.y AS ay, a.x AS ax, (0.8::DOUBLE + 0.6::DOUBLE * (d_step / 4294967296.0::DOUBLE)) * 32 AS far, [1, -1, 0, 0, 1, -1, 1, -1][d_direction % 8 + 1] AS ty, [0, 0, 1, -1, 1, -1, -1, 1][d_direction % 8 + 1] AS tx
      FROM e LEFT JOIN an a ON a.block = e.block AND (requested = 'positive' OR near) AND a.rank = d_anchor % least(16, a.seen) + 1),
g AS (SELECT split, i, requested, attempt, block, CASE WHEN requested = 'positive' THEN 'positive' WHEN near THEN 'nearby background' ELSE 'background' END AS kind,
      CASE WHEN near THEN floor(least(greatest(ay + ty * far - 16, by0), by0 + 32)) WHEN requested = 'positive' THEN least(greatest(ay - 16 + d_y % 17 - 8, by0), by0 + 32) ELSE by0 + d_y % 33 END::BIGINT AS y0,
      CASE WHEN near THEN floor(least(greatest(ax + tx * far - 16, bx0), bx0 + 32)) WHEN requested = 'positive' THEN least(greatest(ax - 16 + d_x % 17 - 8, bx0), bx0 + 32) ELSE bx0 + d_x % 33 END::BIGINT AS x0 FROM f),
h AS (SELECT g.split, g.i, g.attempt, count(c.y) AS foreground FROM g LEFT JOIN cl c ON c.y >= g.y0 AND c.y < g.y0 + 32 AND c.x >= g.x0 AND c.x < g.x0 + 32 GROUP BY ALL),
best AS (SELECT g.*, foreground FROM g JOIN h USING (split, i, attempt) QUALIFY row_number() OVER (PARTITION BY split, i ORDER BY CASE WHEN requested = 'positive' OR foreground = 0 THEN attempt ELSE 1000 - attempt END) = 1)"""


@query(f"WITH RECURSIVE {SCHEDULE_SQL} SELECT split, i, requested, CASE WHEN requested <> 'positive' AND foreground > 0 THEN 'mixed context' ELSE kind END AS kind, block, y0, x0, 32::BIGINT AS size, foreground, attempt::INTEGER AS attempt FROM best")
def crop_schedule(spark, sf_dir):
    """Two hundred crops by the schedule of draws: around anchors, beside them, anywhere."""
    return crops.sample_crops(cluster_mask(spark, sf_dir), *CLUSTER_SHAPE, CROP, 200, "7", BLOCK, SCAN_TILE)


@query(f"""WITH RECURSIVE {SCHEDULE_SQL}, k AS (SELECT split, CASE WHEN requested <> 'positive' AND foreground > 0 THEN 'mixed context' ELSE kind END AS kind, foreground FROM best)
SELECT split, kind, count(*) AS crops, count(*) FILTER (WHERE foreground > 0) AS with_foreground FROM k GROUP BY ALL""")
def crop_kinds(spark, sf_dir):
    found = crop_schedule(spark, sf_dir)
    return found.groupBy("split", "kind").agg(F.count("*").alias("crops"), F.count_if(F.col("foreground") > 0).alias("with_foreground"))


# ---- holdouts

HOLDOUT_SQL = """o AS (SELECT o_orderkey % 3 AS image_id, o_orderkey * 7919 % 2950 AS y, (o_custkey * 104729 + o_orderkey) % 2950 AS x, o_orderstatus AS kind, o_orderkey % 70 AS reach FROM orders),
pa AS (SELECT DISTINCT image_id, y // 50 AS py, x // 50 AS px, (y // 100) || ':' || (x // 100) AS block, CASE WHEN (y // 100 * 7 + x // 100 * 3 + image_id) % 11 = 0 THEN 'validation' ELSE 'train' END AS split FROM o),
sh AS (SELECT DISTINCT image_id, (y // 100) || ':' || (x // 100) AS u, (y // 100) || ':' || ((x + reach) // 100) AS w FROM o WHERE kind = 'P'),
hr AS (SELECT s_suppkey % 3 AS image_id, CASE WHEN s_suppkey % 2 = 0 THEN 'validation' ELSE 'train' END AS split, s_suppkey * 37 % 2900 - 20 AS y0, s_suppkey * 53 % 2900 - 20 AS x0, s_suppkey * 37 % 2900 + 40 AS y1, s_suppkey * 53 % 2900 + 60 AS x1 FROM supplier
  UNION ALL SELECT n_nationkey % 3, 'validation', n_nationkey * 80, n_nationkey * 5 % 36 * 80, least(n_nationkey * 80 + 80, 2950), least(n_nationkey * 5 % 36 * 80 + 80, 2950) FROM nation),
ce AS (SELECT image_id, row, unnest(range(greatest(x0, 0) // 50, (x1 - 1) // 50 + 1)) AS col, split = 'validation' AS res FROM (SELECT *, unnest(range(greatest(y0, 0) // 50, (y1 - 1) // 50 + 1)) AS row FROM hr)),
cell AS (SELECT image_id, row, col, bool_or(res) AS reserved, bool_or(NOT res) AS trained FROM ce GROUP BY ALL),
gb AS (SELECT image_id || '|' || u AS a, image_id || '|' || w AS b FROM sh UNION SELECT image_id || '|' || w, image_id || '|' || u FROM sh),
gr(id, c) USING KEY (id) AS (SELECT DISTINCT a, a FROM gb UNION SELECT e.b, min(r.c) FROM gr r JOIN gb e ON e.a = r.id JOIN recurring.gr q ON q.id = e.b GROUP BY e.b, q.c HAVING min(r.c) < q.c),
hb AS (SELECT pa.image_id, block, any_value(coalesce(gr.c, pa.image_id || '|' || block)) AS grp, bool_or(split = 'validation') AS now, coalesce(bool_or(reserved), false) AS reserved, coalesce(bool_or(trained), false) AS trained
  FROM pa LEFT JOIN cell ON cell.image_id = pa.image_id AND cell.row = py AND cell.col = px LEFT JOIN gr ON gr.id = pa.image_id || '|' || block GROUP BY pa.image_id, block),
hg AS (SELECT grp, bool_or(now OR reserved) AS held, bool_or(reserved) AS kept, bool_or(trained) AS trained FROM hb GROUP BY grp)"""


def order_patches(spark, sf_dir):
    """(patches, pairs of blocks that share an object, cells of earlier runs)."""
    o = rasters.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    at = o.select((key % 3).alias("image_id"), (key * 7919 % 2950).alias("y"), ((F.col("o_custkey") * 104729 + key) % 2950).alias("x"), F.col("o_orderstatus").alias("kind"), (key % 70).alias("reach"))
    tile = lambda c, n: F.floor(F.col(c) / n).cast("long") if isinstance(c, str) else F.floor(c / n).cast("long")
    block = lambda y, x: F.concat_ws(":", tile(y, 100), tile(x, 100))
    held = (tile("y", 100) * 7 + tile("x", 100) * 3 + F.col("image_id")) % 11 == 0
    patches = at.select("image_id", block("y", "x").alias("block"), (tile("y", 50) * 50).alias("y0"), (tile("x", 50) * 50).alias("x0"), F.when(held, "validation").otherwise("train").alias("split")).distinct()
    shared = at.where("kind = 'P'").select("image_id", block("y", "x").alias("u"), block("y", F.col("x") + F.col("reach")).alias("w")).distinct()
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    rects = rasters.table(spark, sf_dir, "supplier").select((s % 3).cast("long").alias("image_id"), F.when(s % 2 == 0, "validation").otherwise("train").alias("split"), (s * 37 % 2900 - 20).alias("y0"), (s * 53 % 2900 - 20).alias("x0"), (s * 37 % 2900 + 40).alias("y1"), (s * 53 % 2900 + 60).alias("x1"))
    blocks = rasters.table(spark, sf_dir, "nation").select((n % 3).cast("long").alias("image_id"), F.concat_ws(":", n, n * 5 % 36).alias("block"), F.lit(40).alias("crop"), F.lit(2950).alias("height"), F.lit(2950).alias("width"))
    return patches, shared, holdouts.history_cells(rects.unionByName(holdouts.held_out_rects(blocks)), 50)


@query(f"""WITH RECURSIVE {HOLDOUT_SQL} SELECT image_id, block, string_split(grp, '|')[2] AS merged, CASE WHEN held THEN 'validation' ELSE 'train' END AS split, kept, kept AND hg.trained AS conflict FROM hb JOIN hg USING (grp)""")
def holdouts_kept(spark, sf_dir):
    """Blocks that earlier runs held out stay held out, with all that shares an object with them; groups on both sides are conflicts."""
    return holdouts.keep_holdouts(*order_patches(spark, sf_dir), 50)


@query(f"""WITH RECURSIVE {HOLDOUT_SQL}, v AS (SELECT image_id, py, px FROM pa JOIN hb USING (image_id, block) JOIN hg USING (grp) WHERE held)
SELECT image_id, py * 50 AS y0, px * 50 AS x0 FROM v WHERE EXISTS (SELECT 1 FROM cell c WHERE c.image_id = v.image_id AND c.row // 2 = py // 2 AND c.col // 2 = px // 2 AND trained)""")
def holdouts_seen(spark, sf_dir):
    patches, shared, cells = order_patches(spark, sf_dir)
    split = holdouts.keep_holdouts(patches, shared, cells, 50).select("image_id", "block", "split")
    shapes = spark.createDataFrame([(k, 2950, 2950) for k in range(3)], "image_id long, height long, width long")
    return holdouts.seen_before(patches.drop("split").join(split, ["image_id", "block"]), cells, shapes, 50)
