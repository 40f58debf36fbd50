import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from corvia.functions import pairs
from corvia.operators import frames
from corvia.operators import joins as J
from corvia.plans import registry

POINT = "recording string, frame_idx int, point_idx int, station double, offset double, height double, range_m double"


def cloud(n, frames=2, seed=5):
    """Points on a grid of 0.1, so that many lie at the limits, behind and ahead, some at the middle."""
    rng = np.random.default_rng(seed)
    p = pd.DataFrame({"recording": "r", "frame_idx": np.repeat(np.arange(frames), n).astype("int32"), "point_idx": np.tile(np.arange(n), frames).astype("int32")})
    p["station"], p["offset"], p["height"] = np.round(rng.uniform(-9, 30, n * frames), 1), np.round(rng.normal(0, 2, n * frames), 1), np.round(rng.uniform(-1, 2, n * frames), 1)
    p["offset"] = p["offset"].where(rng.random(len(p)) > 0.1, 0.0)
    p["range_m"] = np.sqrt(p.station**2 + p.offset**2 + p.height**2) * np.where(rng.random(len(p)) < 0.1, 4, 1)
    return p


def brute(p, near):
    out = set()
    for f, g in p.groupby("frame_idx"):
        c = {n: g[n].to_numpy() for n in p.columns[2:]}
        a, b = np.nonzero(near(*({n: v[:, None] for n, v in c.items()}, {n: v[None] for n, v in c.items()})) & (c["point_idx"][:, None] < c["point_idx"]))
        out |= {(f, i, j) for i, j in zip(c["point_idx"][a].tolist(), c["point_idx"][b].tolist())}
    return out


def band(a, b):
    far = np.maximum(a["range_m"], b["range_m"]) * 0.006
    return (np.abs(a["station"] - b["station"]) <= 1.2) & (np.abs(a["offset"] - b["offset"]) <= np.maximum(0.25, far)) & (np.abs(a["height"] - b["height"]) <= np.maximum(0.2, far))


def grid(a, b):
    ds, dd = a["station"] - b["station"], a["offset"] - b["offset"]
    return (ds * ds + dd * dd <= 9) & ((a["offset"] * b["offset"] > 0) | ((np.abs(a["offset"]) < 0.6) & (np.abs(b["offset"]) < 0.6) & (np.abs(dd) < 0.5)))


@pytest.mark.parametrize("find, near", [(J.band_edges, band), (J.grid_edges, grid)])
def test_pairs_against_all_pairs(spark, find, near):
    p = cloud(900)
    got = [tuple(r)[1:] for r in find(spark.createDataFrame(p, POINT)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(p, near)
    odd = spark.createDataFrame([("r", 0, 0, None, 0.0, 0.0, 1.0), ("r", 0, 1, float("nan"), 0.0, 0.0, 1.0), ("r", 0, 2, 1.0, None, 0.0, 1.0), ("r", 0, 3, 1.0, 0.1, 0.1, 1.0), ("r", 0, 4, 1.0, 0.2, 0.1, None), ("r", 1, 5, 1.0, 0.2, 0.1, 1.0)], POINT)
    assert [tuple(r) for r in find(odd).collect()] == [("r", 0, 3, 4)]
    assert find(odd.limit(0)).count() == 0


def test_pairs_of_registered_queries(spark, sf_dir):
    p = registry.local(spark, sf_dir).toPandas()
    p = p[["recording", "frame_idx", "point_idx", "station", "offset", "height", "range_m"]]
    for name, near in (("band_edges", band), ("grid_edges", grid)):
        assert {tuple(r)[1:] for r in registry.queries()[name](spark, sf_dir).collect()} == brute(p, near)


def test_work_follows_the_pairs(spark, monkeypatch):
    """Of a dense frame, fewer points are compared than there are pairs; station cells alone
    compare dozens of times as many."""
    seen = []
    plain = pairs.listed
    monkeypatch.setattr(pairs, "listed", lambda first, n: seen.append(int(n.sum())) or plain(first, n))
    rng = np.random.default_rng(1)
    s, d, h = rng.uniform(40, 44, 8000), rng.uniform(-2, 2, 8000), rng.uniform(-1, 2, 8000)
    gate = np.full(8000, 0.25)
    found = 0
    for order, (i, first, end), near in pairs.band_pairs(s, d, h, gate, gate, np.ones(8000, bool), 1.2):
        found += sum(len(j) for _, _, j in pairs.compared(i, first, end, near)) if near else int(np.maximum(end - first, 0).sum())
    assert found == sum(int(((np.abs(s[k + 1 :] - s[k]) <= 1.2) & (np.abs(d[k + 1 :] - d[k]) <= 0.25) & (np.abs(h[k + 1 :] - h[k]) <= 0.25)).sum()) for k in range(8000))
    assert sum(seen) < found


def test_pairs_are_not_joined_by_station_alone(spark, sf_dir):
    for name in ("band_edges", "grid_edges"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan


def exchanged(df):
    """(rows, bytes) that each shuffle of a plan has written."""
    df.write.format("noop").mode("overwrite").save()
    spark = df.sparkSession
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    metrics, found = store.executionMetrics(last.executionId()), []
    nodes = store.planGraph(last.executionId()).allNodes()
    for k in range(nodes.size()):
        if nodes.apply(k).name() == "Exchange":
            of = nodes.apply(k).metrics()
            ids = {of.apply(m).name(): of.apply(m).accumulatorId() for m in range(of.size())}
            found.append([metrics.get(ids[n]).get() for n in ("shuffle records written", "shuffle bytes written")])
    return found


@pytest.mark.parametrize("find, most", [(J.band_edges, 16), (J.grid_edges, 8)])
def test_points_are_shuffled_in_few_bytes(spark, find, most):
    """27 and more bytes a point when rows were shuffled."""
    n = 60000
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"recording": "r", "frame_idx": np.zeros(n, "int32"), "point_idx": np.arange(n, dtype="int32")})
    p["station"], p["offset"], p["height"] = rng.integers(0, 8000, n) / 100, rng.integers(-200, 201, n) / 100, rng.integers(-100, 200, n) / 100
    p["range_m"] = np.sqrt(p.station**2 + p.offset**2 + p.height**2)
    points = spark.createDataFrame(p, POINT).coalesce(1)
    (rows, size), *more = exchanged(find(points))
    units = {"B": 1, "KiB": 1024, "MiB": 1024**2}
    number, unit = size.split("\n")[-1].split(" (")[0].split()[:2]
    assert not more and int(rows.replace(",", "")) < 200
    assert float(number) * units[unit] < most * n


def test_packed_lots_hold_every_value(spark):
    odd = [0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e-300, 0.1]
    rows = [(r, f, b, i, odd[(i * 5 + b) % len(odd)], i * 0.37, i % 3 == 0) for r in ("r", "s") for f in (0, 1) for b in (-2, 7) for i in range(50)]
    np.random.default_rng(2).shuffle(rows)
    df = spark.createDataFrame([(r, int(f), int(b), int(i), float(x), float(y), bool(o)) for r, f, b, i, x, y, o in rows], "recording string, frame_idx int, block long, i int, x double, y double, o boolean")
    got = []
    for lot in frames.packed(df, ["i", "x", "y", "o"], "block", most=64).collect():
        for b in frames.unpacked([pa.RecordBatch.from_pydict({"lot": [bytes(lot.lot)]})]):
            got += [(lot.recording, lot.frame_idx, lot.block, *v.values()) for v in b.to_pylist()]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in df.collect())
    assert frames.packed(df.limit(0), ["i", "x", "y", "o"], "block").count() == 0
