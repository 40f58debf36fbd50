"""Every registered query with SQL against DuckDB, and all of them for shape."""

import os

import duckdb
import pytest

from corvia.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_the_others_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_motion_is_scored_on_every_point(spark, sf_dir):
    from corvia.plans import fixtures

    n = fixtures.cloud(spark, sf_dir).count()
    got = QUERIES["motion_score"](spark, sf_dir).groupBy("travel").sum("points").collect()
    assert len(got) == 97 and {r["sum(points)"] for r in got} == {n}


def test_walls_turn_by_every_point(spark, sf_dir):
    import numpy as np

    p = registry.local(spark, sf_dir).select("frame_idx", "station", "offset").toPandas()
    want = {}
    for f, g in p.groupby("frame_idx"):
        r = g.station / g.station.max()
        d = 3 * (np.median(g.offset[r >= 0.8]) - np.median(g.offset[(r >= 0.4) & (r <= 0.65)]))
        want[f] = 1 if d > 1.2 else -1 if d < -1.2 else 0
    assert {r["frame_idx"]: r["direction"] for r in QUERIES["wall_turn_direction"](spark, sf_dir).collect()} == want


def test_components_of_all_points_against_all_pairs(spark, sf_dir):
    import numpy as np

    p = registry.local(spark, sf_dir).select("frame_idx", "point_idx", "station", "offset", "height", "range_m").toPandas()
    want = {}
    for f, g in p.groupby("frame_idx"):
        near = lambda c: np.abs(np.subtract.outer(g[c].to_numpy(), g[c].to_numpy()))
        far = np.maximum.outer(g.range_m.to_numpy(), g.range_m.to_numpy()) * 0.006
        link = (near("station") <= 1.2) & (near("offset") <= np.maximum(0.25, far)) & (near("height") <= np.maximum(0.2, far))
        root = g.point_idx.to_numpy()
        while (least := np.where(link, root, root.max()).min(axis=1)).tolist() != root.tolist():
            root = least
        want |= {(f, i): r for i, r in zip(g.point_idx, root.tolist())}
    got = {(r["frame_idx"], r["point_idx"]): r["root"] for r in QUERIES["proximity_components"](spark, sf_dir).collect()}
    assert got == want


def test_every_point_is_seen_or_not(spark, sf_dir):
    seen, unseen = (QUERIES[n](spark, sf_dir).select("frame_idx", "point_idx") for n in ("seen_before", "not_seen_before"))
    every = registry.local(spark, sf_dir).select("frame_idx", "point_idx")
    assert sorted(map(tuple, seen.union(unseen).collect())) == sorted(map(tuple, every.collect()))


def test_order_and_partitions_dont_matter(spark, sf_dir):
    from corvia.operators import frames
    from corvia.plans import fixtures, more

    p = fixtures.cloud(spark, sf_dir)
    g = more.straight_geometry(p)
    a = frames.detect_obstacles(p.repartition(1), g).drop("points", "indices", "reasons")
    b = frames.detect_obstacles(p.repartition(7, "ring"), g).drop("points", "indices", "reasons")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_only_what_is_needed(spark, sf_dir):
    from pyspark.sql import functions as F

    plan = QUERIES["number_frames"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[-1]
    d = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("user_id") == 3).select("value")
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in d._jdf.queryExecution().toString()
