import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions.numbering import number_rows
from gridloom.operators import algebra, components, edits, library, pyramid, rects
from gridloom.operators import graph
from gridloom.operators.graph import connected_components


def mask_of(spark, array):
    rows = [(int(y), int(x), int(array[y, x])) for y, x in zip(*np.nonzero(array))]
    return spark.createDataFrame(rows, "y long, x long, v long")


def flood(array):
    """Smallest position of each pixel's component, by search."""
    out, stack = {}, []
    for y, x in zip(*np.nonzero(array)):
        if (y, x) in out:
            continue
        first, stack = y * components.STRIDE + x, [(y, x)]
        out[y, x] = first
        while stack:
            a, b = stack.pop()
            for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= p[0] < array.shape[0] and 0 <= p[1] < array.shape[1] and p not in out and array[p] == array[y, x]:
                    out[p] = first
                    stack.append(p)
    return out


def labels_of(spark, array):
    return {(r.y, r.x): r.component for r in components.label_pixels(mask_of(spark, array)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_components_like_flood_fill(spark, seed):
    array = np.random.default_rng(seed).choice([0, 0, 1, 2], (18, 23))
    assert labels_of(spark, array) == flood(array)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 2), min_size=6, max_size=6), min_size=1, max_size=6))
def test_components_of_any_mask(spark, rows):
    array = np.array(rows)
    assert labels_of(spark, array) == flood(array)


def test_a_frame_with_two_holes(spark):
    """A digit eight of nine rows and seven columns: 2 holes, its centre of mass where symmetry puts it."""
    array = np.zeros((20, 31), int)
    array[10:19, 21:28] = 6
    array[11:14, 22:27] = array[15:18, 22:27] = 0
    pixels = components.label_pixels(mask_of(spark, array))
    (row,) = components.component_table(pixels).collect()
    assert (row.label_value, row.area, row.centroid_y, row.centroid_x) == (6, 63 - 30, 14.0, 24.0)
    assert (row.bbox_y0, row.bbox_x0, row.bbox_y1, row.bbox_x1) == (10, 21, 19, 28) and components.euler(pixels).first().euler == -1


def test_a_checkerboard_is_all_single_pixels(spark):
    """No pixel has a neighbour of its value beside it; corners that touch don't join, nor do the two colours."""
    y, x = np.indices((6, 7))
    array = 4 + 5 * ((y + x) % 2)
    rows = components.component_table(components.label_pixels(mask_of(spark, array))).collect()
    assert len(rows) == 42 and {r.area for r in rows} == {1} and {r.label_value for r in rows} == {4, 9}


def test_long_snake_settles(spark):
    array = np.zeros((21, 40), int)
    array[::2] = 1
    array[1::4, -1] = array[3::4, 0] = 1
    assert set(labels_of(spark, array).values()) == {0}


def test_empty_mask(spark):
    pixels = components.label_pixels(spark.createDataFrame([], "y long, x long, v long"))
    assert components.component_table(pixels).count() == 0


def test_graph_of_texts_and_loops(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "z"), ("b", "a")], "u string, v string")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "z": "z"}


def test_contracted_parts_meet_in_star_steps(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 40)
    pairs = [(i, i + 1) for i in range(150) if i % 50 != 49] + [(200, 300), (300, 250), (7, 7), (999, 999)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    expected = {i: i // 50 * 50 for i in range(150)} | {200: 200, 250: 200, 300: 200, 999: 999}
    assert found == expected
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_addresses_at_the_seams_of_a_grid(spark):
    """A centroid on a seam belongs to the cell that begins there; one before it to the cell that ends."""
    seams = [(r * 2.5 + d, c * 7.0 + d) for r in (0, 1, 13) for c in (0, 3, 11) for d in (0.0, 0.25, -0.25)]
    df = spark.createDataFrame(seams, "centroid_y double, centroid_x double")
    want = [f"R{max(0, int(y // 2.5)):02d}C{max(0, int(x // 7)):02d}" for y, x in seams]
    assert [r.grid_id for r in components.grid_address(df, 2.5, 7).collect()] == want
    none = components.grid_address(df, 2.5, None).first()
    assert none.grid_id is None and none.grid_row is None
    for steps in ((-1, 7), (2.5, 0)):
        with pytest.raises(ValueError, match="positive"):
            components.grid_address(df, *steps)


def test_numbers_are_gapless(spark):
    rows = [r.n for r in number_rows(spark.range(0, 500).select((F.col("id") * 7919 % 500).alias("k")), ["k"]).orderBy("k").collect()]
    assert rows == list(range(1, 501))


def test_label_tools_like_numpy(spark):
    """Three random layers against the same rules on arrays."""
    rng = np.random.default_rng(12)
    arrays = [rng.choice([0, 0, n, n + 1], (9, 11)) for n in (1, 4, 8)]
    stacked = np.array(arrays) > 0
    layers = None
    for k, array in enumerate(arrays, 1):
        part = mask_of(spark, array).withColumn("layer", F.lit(k))
        layers = part if layers is None else layers.unionByName(part)

    def dense(df):
        out = np.zeros((9, 11), int)
        for r in df.collect():
            out[r.y, r.x] = r.v
        return out.tolist()

    votes = stacked.sum(axis=0)
    assert dense(algebra.union(layers)) == (votes > 0).astype(int).tolist() and dense(algebra.votes(layers)) == votes.tolist()
    assert dense(algebra.merge_same(layers, 21)) == np.where(votes > 0, 21, 0).tolist()
    assert dense(algebra.compose_last_wins(layers)) == (stacked * np.array([1, 2, 3])[:, None, None]).max(axis=0).tolist()
    for least in (1, 2, 3):
        assert dense(algebra.consensus(layers, least, 30, 3)) == np.where(votes >= least, 30, 0).tolist()
    for least in (0, 4):
        with pytest.raises(ValueError, match="votes"):
            algebra.consensus(layers, least, 30, 3)
    several, single = mask_of(spark, arrays[0]), mask_of(spark, np.where(arrays[1] == 4, 4, 0))
    assert dense(algebra.reassign(several, 77, 2)) == np.where(arrays[0] == 2, 77, arrays[0]).tolist()
    assert dense(algebra.reassign(single, 77)) == np.where(arrays[1] == 4, 77, 0).tolist()
    with pytest.raises(Exception, match="several values"):
        algebra.reassign(several, 77).collect()


def test_restore_deleted_only_where_empty(spark):
    deleted = spark.createDataFrame([(0, 0, 5), (0, 1, 5)], "y long, x long, v long")
    now = spark.createDataFrame([(0, 1, 2)], "y long, x long, v long")
    assert {(r.x, r.restored) for r in components.restore_deleted(now, deleted).collect()} == {(0, True), (1, False)}


def test_ids_over_three_versions(spark):
    """A square that moves by a row keeps its id, a frame that is cut in two gets two new ones, one that is painted over goes."""
    first = np.zeros((20, 30), int)
    first[2:6, 2:6], first[10:18, 10:18], first[12:16, 12:16], first[3, 20:28] = 4, 6, 0, 2
    second = np.zeros((20, 30), int)
    second[3:7, 2:6], second[10:18, 10:18], second[12:16, 12:16] = 4, 6, 0
    second[10:18, 13] = 0
    second[3, 20:28] = 5
    snap = lambda m: library.labelled_snapshot(components.label_pixels(mask_of(spark, m)))
    matched = library.match_identity(snap(first), snap(second))
    given = {r.new_id: r.component_id for r in library.allocate(matched, 10**12).collect()}
    at = lambda y, x: y * components.STRIDE + x
    assert given[at(3, 2)] == at(2, 2) and sorted(v for v in given.values() if v >= 10**12) == [10**12, 10**12 + 1, 10**12 + 2]
    prints = lambda m: components.fingerprints(components.label_pixels(mask_of(spark, m)))
    table = prints(first).select(F.col("component").alias("component_id"), "fingerprint", F.lit(True).alias("included"), F.lit(True).alias("active"), F.lit(False).alias("needs_review"))
    fresh = prints(second).join(library.allocate(matched, 10**12), F.col("component") == F.col("new_id")).select("component_id", "fingerprint")
    out = {r.component_id: (r.included, r.active, r.needs_review) for r in library.publish(table, fresh, table).collect()}
    assert out[at(2, 2)] == (False, True, True)  # changed: to be reviewed
    assert out[at(10, 10)] == out[at(3, 20)] == (False, False, False)  # gone; review stays as it was
    assert {out[10**12 + k] for k in range(3)} == {(False, True, False)}  # new ones ask for no review
    kept = library.publish(table, prints(first).select(F.col("component").alias("component_id"), "fingerprint"), table)
    assert {(r.included, r.active, r.needs_review) for r in kept.collect()} == {(True, True, False)}


def test_closure_of_a_long_chain(spark):
    boxes = spark.createDataFrame([(2 * i, 0, 2 * i + 3, 4) for i in range(70)], "y0 long, x0 long, y1 long, x1 long")
    dirty = spark.createDataFrame([(0, 1, 1, 2)], boxes.schema)
    assert tuple(library.closure(boxes, dirty).first()) == (0, 0, 141, 4)


@pytest.mark.parametrize("most", [0, 3, 50_000])
def test_closure_like_a_plain_loop(spark, monkeypatch, most):
    monkeypatch.setattr(library, "NEAR_BOXES", most)
    rng = np.random.default_rng(most)
    for density in (30, 200):
        y, x = rng.integers(0, 400, density), rng.integers(0, 400, density)
        rows = [tuple(map(int, r)) for r in np.column_stack([y, x, y + rng.integers(1, 30, density), x + rng.integers(1, 30, density)])]
        want = (190, 190, 200, 200)
        while True:
            hit = [r for r in rows if r[0] < want[2] and r[2] > want[0] and r[1] < want[3] and r[3] > want[1]] + [want]
            new = (min(r[0] for r in hit), min(r[1] for r in hit), max(r[2] for r in hit), max(r[3] for r in hit))
            if new == want:
                break
            want = new
        boxes = spark.createDataFrame(rows, "y0 long, x0 long, y1 long, x1 long")
        assert tuple(library.closure(boxes, spark.createDataFrame([(190, 190, 200, 200)], boxes.schema)).first()) == want


def test_versions_refuse_a_stale_writer(spark, tmp_path):
    table = library.VersionedTable(spark, str(tmp_path))
    assert table.commit(spark.range(3), 0) == 1
    with pytest.raises(RuntimeError):
        table.commit(spark.range(4), 0)
    assert table.read(spark).count() == 3
    with pytest.raises(Exception, match="DIVIDE"):
        table.commit(spark.range(3).selectExpr("id / (id - id)"), 1)
    assert table.commit(spark.range(5), 1) == 2 and table.read().count() == 5  # a failed write blocks no version


def test_rectangles_cover_and_subtract(spark):
    box = lambda *v: rects.box(*[F.lit(x) for x in v])
    row = spark.range(1).select(
        rects.subtract(box(0, 0, 10, 10), box(2, 3, 5, 6)).alias("p"), rects.subtract(box(0, 0, 4, 4), box(8, 8, 9, 9)).alias("q"),
        rects.covered(box(0, 0, 4, 4), F.array(box(0, 0, 4, 2), box(0, 2, 3, 4))).alias("part"), rects.covered(box(0, 0, 4, 4), F.array(box(0, 0, 4, 2), box(0, 2, 3, 4), box(3, 0, 9, 9))).alias("whole"),
    ).first()
    assert [tuple(p) for p in row.p] == [(0, 0, 2, 10), (5, 0, 10, 10), (2, 0, 5, 3), (2, 6, 5, 10)]
    assert len(row.q) == 1 and row.part is False and row.whole is True


def test_pyramid_takes_the_first_label_whole(spark):
    array = np.zeros((70, 50), np.int64)
    array[3, 3], array[2, 7], array[69, 48], array[68, 49] = 3_000_000_001, 12, 6_000_000_002, 5
    got = {(r.level, r.y, r.x, r.v) for r in pyramid.label_pyramid(mask_of(spark, array), 3).where("level > 0").collect()}
    assert got == {(1, 1, 1, 3_000_000_001), (1, 1, 3, 12), (1, 34, 24, 5), (2, 0, 0, 3_000_000_001), (2, 0, 1, 12), (2, 17, 12, 5)}
    assert pyramid.level_shapes(70, 50) == [(70, 50), (35, 25), (18, 13), (9, 7), (5, 4), (3, 2), (2, 1)]
    assert pyramid.level_shapes(3, 1) == [(3, 1), (2, 1), (1, 1)] and pyramid.level_shapes(1, 1) == [(1, 1)]
    assert pyramid.needs_image_pyramid(40_000, 10) and not pyramid.needs_image_pyramid(32_768, 32_768)


def test_edits_apply_or_conflict(spark):
    m = lambda *rows: spark.createDataFrame(list(rows), "y long, x long, v long")
    base, edited = m((0, 0, 1), (0, 1, 2)), m((0, 0, 1), (0, 1, 3), (1, 1, 4))
    assert {(r.y, r.x, r.v) for r in edits.write_back(base, base, edited).collect()} == {(0, 0, 1), (0, 1, 3), (1, 1, 4)}
    assert tuple(edits.changed_box(base, edited).first()) == (0, 1, 2, 2)
    assert tuple(edits.changed_box(base, base).first()) == (None,) * 4
    with pytest.raises(Exception, match="another writer"):
        edits.write_back(base, m((0, 0, 1), (0, 1, 9)), edited).collect()
    with pytest.raises(Exception, match="range"):
        edits.write_back(base, base, edited, high=3).collect()


def test_library_over_edits(spark, tmp_path):
    """Ids last while objects can be told, are never used twice, and choices survive where nothing changed."""
    array = np.zeros((60, 90), int)
    array[5:12, 5:12], array[30:33, 10:70], array[50:55, 80:88] = 3, 8, 3
    mask = lambda: mask_of(spark, array)
    lib = library.ComponentLibrary.create(spark, str(tmp_path / "lib"), 60, 90, "src", size=16)
    assert lib.update(mask()) and not lib.update(mask())
    active = lambda: {r.component_id: r for r in lib.table("components").where("active").collect()}
    first = active()
    assert sorted(first) == [1, 2, 3] and {r.area for r in first.values()} == {49, 180, 40}
    ids = {r.area: i for i, r in first.items()}
    lib.select(ids[49], True)
    lib.select(ids[180], True)
    assert tuple(lib.counts().first()) == (3, 2, 0)
    edit = lambda *b: lib.mark_dirty(spark.createDataFrame([(1, *b)], "seq long, y0 long, x0 long, y1 long, x1 long"))
    array[30:33, 70:72] = 8  # the bar grows beyond its tiles
    edit(30, 70, 33, 72)
    with pytest.raises(ValueError, match="update"):
        lib.select(ids[49], False)
    assert lib.update(mask())
    now = active()
    assert set(now) == {1, 2, 3} and now[ids[180]].area == 186 and (now[ids[180]].included, now[ids[180]].needs_review) == (False, True) and now[ids[49]].included
    assert (now[ids[180]].y0, now[ids[180]].x1) == (30, 72)
    array[30:33, 40] = 0  # cut in two, then joined again
    edit(30, 40, 33, 41)
    lib.update(mask())
    assert set(active()) == {ids[49], ids[40], 4, 5}
    array[30:33, 40] = 8
    edit(-9, 40, 33, 41)
    lib.update(mask())
    assert set(active()) == {ids[49], ids[40], 6} and not active()[6].needs_review
    with pytest.raises(ValueError, match="active"):
        lib.select(4, True)
    array[51, 81] = 0  # changed without being noted
    assert not lib.update(mask()) and lib.update(mask(), verify=True) and active()[ids[40]].area == 39
    held = {(r.y, r.x): r.id for r in lib.table("pixels").collect()}
    assert len(held) == (array != 0).sum() and set(held.values()) == set(active())
    state, version = lib.state()
    lib.mark_dirty(spark.createDataFrame([(1, 0, 0, 1, 1)], "seq long, y0 long, x0 long, y1 long, x1 long"))
    with pytest.raises(RuntimeError, match="expected"):
        lib._commit(state, version)


def test_areas_less_cuts_like_pixels(spark):
    rng = random.Random(8)
    box = lambda most: (lambda y, x: (y, x, y + rng.randint(0, most), x + rng.randint(0, most)))(rng.randrange(30), rng.randrange(30))
    areas, cuts = [(i, *box(25)) for i in range(12)], [box(6) for _ in range(60)]
    found = rects.areas_less_cuts(spark.createDataFrame(areas, "rect_id long, y0 long, x0 long, y1 long, x1 long"), spark.createDataFrame(cuts, "y0 long, x0 long, y1 long, x1 long"), 16).collect()
    cells = lambda b: {(y, x) for y in range(b[0], b[2]) for x in range(b[1], b[3])}
    gone = set().union(*map(cells, cuts))
    for i, *area in areas:
        parts = [cells(tuple(r)[1:]) for r in found if r.rect_id == i]
        assert sum(map(len, parts)) == len(set().union(*parts)) and set().union(*parts) == cells(area) - gone


def test_a_whole_slide_with_many_cuts(spark):
    area = spark.createDataFrame([(1, 0, 0, 84_175, 79_966)], "rect_id long, y0 long, x0 long, y1 long, x1 long")
    i = F.col("id")
    cuts = spark.range(20_000).select((i * 7919 % 84_000).alias("y0"), (i * 104_729 % 79_900).alias("x0")).select("y0", "x0", (F.col("y0") + 40).alias("y1"), (F.col("x0") + 30).alias("x1"))
    left = rects.areas_less_cuts(area, cuts, 4096).agg(F.count("*").alias("n"), F.sum((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).alias("size")).first()
    assert 84_175 * 79_966 - 20_000 * 1200 <= left["size"] < 84_175 * 79_966 - 19_000 * 1200 and left.n < 200_000
    cells = rects.cell_coverage(area, 84_175, 79_966, 1024, 1024, cuts=cuts).agg(F.count("*").alias("n"), F.count_if("covered").alias("covered"), F.count_if("touched").alias("touched")).first()
    assert cells.n == cells.touched == 83 * 79 and cells.covered < 600


def test_rectangles_of_all_sizes_meet_once(spark):
    rng = random.Random(3)
    side = lambda: rng.choice([1, 3, 9, 60, 700])
    rows = lambda n: [(i, y, x, y + side(), x + side()) for i, y, x in ((i, rng.randrange(-300, 900), rng.randrange(-300, 900)) for i in range(n))]
    a, b = rows(150), rows(150)
    schema = "rect_id long, y0 long, x0 long, y1 long, x1 long"
    found = [(r.l_rect_id, r.r_rect_id) for r in rects.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 8).collect()]
    assert sorted(found) == sorted((p[0], q[0]) for p in a for q in b if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4])


def test_closure_of_many_boxes_reads_none_of_them(spark, monkeypatch):
    """A dense plane: tasks grow the rectangle, the driver gets rectangles alone."""
    monkeypatch.setattr(library, "NEAR_BOXES", 10)
    read = []
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: read.append(self) or collect(self))
    at = F.col("id")
    boxes = spark.range(0, 40_000, 1, 4).select((at % 200 * 7).alias("y0"), (F.floor(at / 200) * 7).cast("long").alias("x0"), (at % 200 * 7 + 9).alias("y1"), (F.floor(at / 200) * 7 + 9).cast("long").alias("x1"))
    found = library.closure(boxes, spark.createDataFrame([(700, 700, 710, 710)], boxes.schema))
    assert sum(collect(r.limit(11)).__len__() > 10 for r in read) == 0
    assert tuple(collect(found)[0]) == (0, 0, 1402, 1402)


def test_euler_numbers_in_as_many_tasks_as_pixels_need(spark, monkeypatch):
    """No task of the last step gets more than its share of components, however many there are."""
    from gridloom.plans import shared

    i = F.col("id")
    pixels = spark.range(4000).select((F.floor(i / 100) * 2).alias("y"), (i % 100 * 2).alias("x"), (F.floor(i / 100) * 2 * components.STRIDE + i % 100 * 2).alias("component"))
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    found = components.euler(pixels, 16)
    parts = found.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(parts) == 40 and max(r["count"] for r in parts) < 200
    assert {r.euler for r in found.select("euler").distinct().collect()} == {1} and found.count() == 4000
