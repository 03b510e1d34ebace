"""Raster queries against their SQL on small tables with rows that the given ones lack."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from gridloom.plans import history_queries, more_queries, sampling_queries, store_queries  # noqa: F401  (they register their queries)
from gridloom.plans.queries import QUERIES, SQL


def same_rows(spark, folder, name: str, **tables: list[dict]) -> list[tuple]:
    """The rows of a query over these tables, which must be those of its SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    return got


def order(key: int, customer: int, status: str = "F") -> dict:
    return {"o_orderkey": key, "o_custkey": customer, "o_orderstatus": status, "o_totalprice": 1000.0 * (key + 1)}


def event(user: int, day: int, kind: str = "view") -> dict:
    return {"event_id": user * 100 + day, "ts": datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=6 * day), "user_id": user, "event_type": kind, "value": 1.0}


def line(part: int, supplier: int, flag: str = "A", status: str = "F") -> dict:
    return {"l_orderkey": part, "l_partkey": part, "l_suppkey": supplier, "l_linenumber": 1, "l_quantity": 1.0, "l_returnflag": flag, "l_linestatus": status}


def test_class_loss_leaves_out_patches_known_nowhere(spark, tmp_path):
    rows = same_rows(spark, tmp_path, "class_loss", orders=[order(1, 7), order(2, 7, "O"), order(5, 8), order(10, 8, "P"), order(5, 9), order(6, 9)])
    assert sorted(r[1] for r in rows) == [7, 9]


def test_multilabel_loss_leaves_out_patches_known_nowhere(spark, tmp_path):
    rows = same_rows(spark, tmp_path, "multilabel_loss", orders=[order(1, 7), order(3, 7, "O"), order(2, 8), order(5, 8), order(15, 8)] + [order(5 * k, 9) for k in range(4)])
    assert [r[2] for r in rows] == [7]


def test_crop_block_anchors_of_more_users_than_a_fixed_plane_holds(spark, tmp_path):
    rows = same_rows(spark, tmp_path, "crop_block_anchors", events=[event(u, d) for u in (0, 3, 150, 151, 1499, 30, 1501) for d in (0, 1, 33, 61)])
    assert max(r[0] for r in rows) >= 180


def test_patch_index_without_foreground_has_no_count_of_classes(spark, tmp_path):
    rows = same_rows(spark, tmp_path, "patch_index", lineitem=[line(5, 3), line(25, 4, "N"), line(300, 30, "R"), line(310, 30, "N"), line(900, 2, "A", "O")])
    assert {r[1] for r in rows} == {1, None}


def test_pyramid_problems_of_a_mask_of_any_size(spark, tmp_path):
    assert same_rows(spark, tmp_path, "pyramid_problems", events=[event(5, 3), event(1200, 4)]) == [(1, "pixels outside"), (2, "missing level")]


def test_patch_digests_of_places_without_a_known_flag(spark, tmp_path):
    """A place without a label stays without one; one that is neither labelled nor reviewed is in no patch. The lines are dealt once."""
    rows = same_rows(spark, tmp_path, "patch_digests", lineitem=[line(5, 5, "X"), line(5, 21, "A"), line(5, 37, "N", "O"), line(5, 53, "X", "O"), line(5, 54, "R"), line(100, 5, "X"), line(101, 6, "R")])
    assert {(r[2], r[3]): r[-1] for r in rows} == {(1, 0): None, (5, 0): "labels", (9, 0): "labels", (13, 0): None, (1, 1): None}
    plan = QUERIES["patch_digests"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
