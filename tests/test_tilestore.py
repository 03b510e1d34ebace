import random

import pytest
from pyspark.sql import functions as F

from gridloom.sources import tilestore
from gridloom.sources.tilestore import Region, StaleVersion, TileStore, changed_tiles

PIXELS, CHANGES = "y long, x long, v long", "y long, x long, old long, new long"


def held(df):
    rows = [tuple(r) for r in df.select("y", "x", "v").collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return set(rows)


def leaves(store):
    return {(r.ty, r.tx): (r.n, r.h1, r.h2) for r in store.leaves().where("n <> 0").collect()}


def segment_folders(path):
    return {p.name for p in path.iterdir() if p.name.startswith(("tiles-", "pixels-"))}


def test_random_edits_like_a_plain_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tilestore, "NAMED_TILES", 3)
    monkeypatch.setattr(tilestore, "SEGMENTS", 3)
    rng = random.Random(4)
    truth = {(rng.randrange(60), rng.randrange(90)): rng.randint(1, 5) for _ in range(300)}
    store = TileStore.create(spark, str(tmp_path / "s"), 60, 90, size=8)
    store.write(spark.createDataFrame([(y, x, v) for (y, x), v in truth.items()], PIXELS))
    monkeypatch.setattr(store.tiles, "merged", lambda segments, most=3: tilestore.TileLog.merged(store.tiles, segments, most))
    for step in range(7):
        spots = {(rng.randrange(60), rng.randrange(90)) for _ in range(rng.choice([1, 9, 60]))}
        new = {s: rng.choice([0, 1, 7]) for s in spots}
        store.edit(spark.createDataFrame([(*s, truth.get(s, 0) or None, v) for s, v in new.items()], CHANGES))
        truth = {s: v for s, v in {**truth, **new}.items() if v}
    assert held(store.read()) == {(*s, v) for s, v in truth.items()} and len(store.state()["segments"]) <= 4
    assert held(store.read((5, 20, 33, 61))) == {(y, x, v) for (y, x), v in truth.items() if 5 <= y < 33 and 20 <= x < 61}
    fresh = TileStore.create(spark, str(tmp_path / "t"), 60, 90, size=8)
    fresh.write(store.read())
    assert leaves(store) == leaves(fresh) and changed_tiles(store, fresh).isEmpty()
    before = held(store.read())
    store.compact()
    assert held(store.read()) == before and len(store.state()["segments"]) == 1 and leaves(store) == leaves(fresh)


def test_an_edit_reads_and_writes_its_tiles_only(spark, tmp_path):
    mask = spark.range(40_000).select((F.col("id") % 200).alias("y"), F.floor(F.col("id") / 200).alias("x"), F.lit(3).cast("long").alias("v"))
    store = TileStore.create(spark, str(tmp_path), 200, 200, size=16)
    store.write(mask)
    before = segment_folders(tmp_path)
    store.edit(spark.createDataFrame([(17 + k // 3, 33 + k % 3, 3, 5) for k in range(9)], CHANGES))
    new = segment_folders(tmp_path) - before
    assert len(new) == 1 and spark.read.parquet(str(tmp_path / new.pop() / "pixels")).count() == 9
    assert [tuple(r) for r in store.changed_since(2).collect()] == [(1, 2)]
    plan = store.tiles.read(store.state()["segments"][:1], Region.window(17, 33, 20, 36, 16))._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ty,1), LessThanOrEqual(ty,1)" in pushed
    assert held(store.read((16, 32, 20, 36))) == {(y, x, 5 if 17 <= y < 20 and 33 <= x < 36 else 3) for y in range(16, 20) for x in range(32, 36)}
    assert held(store.read((17, 33, 18, 34), version=2)) == {(17, 33, 3)}


def test_conflicts_ranges_and_repeats(spark, tmp_path):
    store = TileStore.create(spark, str(tmp_path), 10, 10, size=4)
    edit = lambda *rows: store.edit(spark.createDataFrame(list(rows), CHANGES))
    version = edit((0, 0, None, 1), (9, 9, 0, 2))
    for rows, why in (([(0, 0, 5, 7)], "another writer"), ([(1, 1, None, 1 << 40)], "range"), ([(1, 1, None, -5)], "range"), ([(10, 0, None, 1)], "outside")):
        with pytest.raises(ValueError, match=why):
            edit((2, 2, None, 1), *rows)
    assert held(store.read()) == {(0, 0, 1), (9, 9, 2)}
    assert edit((0, 0, None, 1)) == version  # written already
    assert edit((0, 0, 1, None), (5, 5, None, 3)) == version + 1 and held(store.read()) == {(5, 5, 3), (9, 9, 2)}
    assert store.edit(spark.createDataFrame([], CHANGES)) == version + 1
    with pytest.raises(ValueError, match="range"):
        store.write(spark.createDataFrame([(0, 0, -1)], PIXELS))


def test_crashes_leave_the_former_version(spark, tmp_path, monkeypatch):
    store = TileStore.create(spark, str(tmp_path), 10, 10, size=4)
    rows = lambda *r: spark.createDataFrame(list(r), CHANGES)
    version = store.edit(rows((0, 0, None, 1)))

    def crash(*args):
        raise OSError("gone")

    for step in ("_store", "patch"):  # before the segment's files, before its state
        with monkeypatch.context() as m:
            m.setattr(store.tiles, step, crash)
            with pytest.raises(OSError):
                store.edit(rows((1, 1, None, 4)))
        assert held(TileStore(spark, str(tmp_path)).read()) == {(0, 0, 1)}
    with monkeypatch.context() as m:  # the segment is whole, the mark isn't made
        m.setattr(store.log, "commit", crash)
        with pytest.raises(OSError):
            store.edit(rows((1, 1, None, 4)))
    store.log._write(f"{tmp_path}/versions/{version + 1}", "", False)  # the mark is made, its content isn't
    assert store.log.latest()[0] == version and held(store.read()) == {(0, 0, 1)} and store.log.recover() == []
    with pytest.raises(StaleVersion):
        store.edit(rows((1, 1, None, 4)))
    assert store.log.recover(0) == [version + 1]
    assert store.edit(rows((1, 1, None, 4))) == version + 1 and held(store.read()) == {(0, 0, 1), (1, 1, 4)}
    named = {s["name"] for s in store.state()["segments"]}
    lost = segment_folders(tmp_path) - named
    assert len(lost) == 5 and set(store.vacuum(older_than=0)) == lost and segment_folders(tmp_path) == named and held(store.read()) == {(0, 0, 1), (1, 1, 4)}


def test_an_edit_goes_on_top_of_another_writers(spark, tmp_path, monkeypatch):
    store, other = TileStore.create(spark, str(tmp_path), 10, 10, size=4), TileStore(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), CHANGES)
    commit, first = store.log.commit, []

    def late(state, expected):
        if not first:
            first.append(other.edit(rows((0, 1, None, 8))))
        return commit(state, expected)

    monkeypatch.setattr(store.log, "commit", late)
    assert store.edit(rows((0, 0, None, 1))) == first[0] + 1 and held(store.read()) == {(0, 0, 1), (0, 1, 8)}
    first.clear()
    monkeypatch.setattr(other, "edit", lambda _: TileStore(spark, str(tmp_path)).edit(rows((0, 0, 1, 6))))
    with pytest.raises(ValueError, match="another writer"):
        store.edit(rows((0, 0, 1, 2)))


def test_trees_differ_where_pixels_do(spark, tmp_path):
    a, b = (TileStore.create(spark, str(tmp_path / n), 5000, 5000, size=4) for n in "ab")
    base = [(y, y * 7 % 5000, 1) for y in range(0, 5000, 50)]
    a.write(spark.createDataFrame(base, PIXELS))
    b.write(spark.createDataFrame(base[1:-1] + [(4000, 1, 9), (base[-1][0], base[-1][1], 2)], PIXELS))
    assert {tuple(r) for r in changed_tiles(a, b).collect()} == {(0, 0), (1000, 0), (base[-1][0] // 4, base[-1][1] // 4)}
    assert {tuple(r) for r in changed_tiles(b, a).collect()} == {tuple(r) for r in changed_tiles(a, b).collect()}
    empty = TileStore.create(spark, str(tmp_path / "c"), 10, 10, size=4)
    assert changed_tiles(empty, empty).isEmpty()
    with pytest.raises(ValueError, match="size"):
        changed_tiles(a, TileStore.create(spark, str(tmp_path / "d"), 10, 10, size=8))
