import numpy as np
import pandas as pd
import pytest

from corvia.functions import detection, route
from tests import scenes


@pytest.fixture(scope="module")
def clear():
    return scenes.track()


@pytest.fixture(scope="module")
def blocked(clear):
    return np.concatenate((clear, scenes.box()))


def test_straight_route(clear):
    g, reason = route.estimate_route(clear)
    assert reason == "" and g.rails_end > 40
    s = np.arange(3.0, 40.0)
    centre = g.origin + np.column_stack((s, g.curves()[0](s), g.curves()[1](s))) @ g.basis.T
    assert np.abs(centre[:, 0]).max() < 0.07


@pytest.mark.parametrize("radius", [400.0, -400.0])
def test_curve_keeps_its_sign(radius):
    g, _ = route.estimate_route(scenes.track(curvature=1 / radius))
    assert np.sign(g.rails_curvature) == np.sign(-1 / radius * -1) or g.rails_curvature == 0


def test_membership_of_a_straight_corridor():
    g = route.straight_geometry(60.0)
    xyz = np.array([[0, -5, 0], [1.05, -6, 0], [1.06, -6, 0], [0, -7, 3.01], [0, -7, -0.7], [0, 1.2, 0], [0, 0, 0], [np.nan, 1, 1]], float)
    rows, local = route.members(xyz, g)
    assert rows.tolist() == [0, 1, 4]
    assert np.allclose(local[0], [5, 0, 0])


def test_membership_agrees_with_dense_search():
    g = route.straight_geometry(60.0, curvature=0.004)
    rng = np.random.default_rng(3)
    xyz = np.column_stack((rng.uniform(-3, 9, 400), -rng.uniform(0, 55, 400), rng.uniform(-1, 3.5, 400)))
    rows, local = route.members(xyz, g)
    s = np.arange(0, 60, 0.001)
    lat = g.curves()[0](s)
    p = g.local(xyz)
    near = np.array([np.min(np.hypot(s - a, lat - b)) for a, b in p[:, :2]])
    inside = (near <= 1.05) & (p[:, 2] >= -0.7) & (p[:, 2] <= 3.0) & (p[:, 0] > 1.2) & (p[:, 0] < 58)
    sure = np.abs(near - 1.05) > 1e-3
    got = np.zeros(400, bool)
    got[rows] = True
    assert (got == inside)[sure & (p[:, 0] > 1.2) & (p[:, 0] < 58)].all()
    assert np.allclose(np.abs(local[:, 1]), near[rows], atol=1e-3)


def test_clear_track_has_no_object(clear):
    g, _ = route.estimate_route(clear)
    rows, local = route.members(clear, g)
    found, _ = detection.detect(clear[rows], local, rails_end=g.rails_end)
    assert not [o for o in found if o.kind == "object" and o.confidence >= 0.5]


def test_box_is_an_object(blocked):
    g, _ = route.estimate_route(blocked)
    rows, local = route.members(blocked, g)
    found, _ = detection.detect(blocked[rows], local, rails_end=g.rails_end)
    best = found[0]
    assert best.kind == "object" and best.confidence > 0.5
    assert abs(best.station_m - 20) < 1.0 and abs(best.track_offset_m) < 0.2


def test_too_little_is_no_route():
    xyz = np.array([[0, -5, 0], [1, -6, 0], [-1, -6, 0], [0, -7, 0]], float)
    g, reason = route.estimate_route(xyz)
    assert g is None and reason


def test_spark_frames_in_order(spark, clear, blocked):
    from pyspark.sql import functions as F

    from corvia.operators import frames
    from corvia.streaming import processor

    parts = []
    for k in range(8):
        cloud = blocked
        parts.append(pd.DataFrame({"recording": "r", "frame_idx": k, "point_idx": np.arange(len(cloud)), "x": cloud[:, 0], "y": cloud[:, 1], "z": cloud[:, 2]}))
    pdf = pd.concat(parts)
    pdf["ring"] = None
    pts = spark.createDataFrame(pdf, "recording string, frame_idx int, point_idx int, x double, y double, z double, ring int").repartition(4)
    stamps = spark.range(8).select(F.lit("r").alias("recording"), F.col("id").cast("int").alias("frame_idx"), F.lit("lidar").alias("frame_id"), (F.col("id") * 100_000_000).alias("timestamp_ns"))
    raw = frames.raw_routes(pts)
    motion = processor.ego_motion(pts, raw)
    smooth = processor.smooth_routes(raw, motion)
    rows = processor.frame_rows(stamps, motion, smooth, frames.detect_obstacles(pts, smooth)).cache()
    out = {r["frame_idx"]: r for r in processor.process_batch(rows).collect()}
    assert len(out) == 8 and all(r["processing_ok"] for r in out.values())
    assert [out[k]["status"] for k in range(8)][-1] == "BLOCKED"
    assert out[0]["status"] == "CAUTION" and out[0]["path_clear"] is None
    first = min(k for k in out if out[k]["status"] == "BLOCKED")
    assert first == 4 and out[first]["event"] == "confirmed"
    assert all((r["status"] == "BLOCKED") == bool(r["blocking_ids"]) for r in out.values())
    assert 18 < out[7]["distance_m"] < 22
    verdict = frames.analyze_frames(pts.where("frame_idx = 0")).first()
    assert verdict["status"] == "BLOCKED" and verdict["path_clear"] is False


def test_stream_equals_batch(spark, tmp_path):
    from corvia.streaming import processor

    seen = [{"group_id": 1, "kind": "object", "station": 20.0, "offset": 0.0, "range_m": 20.0, "confidence": 0.9, "reasons": [], "low": [19.0, -1.0], "high": [21.0, 1.0], "points": [[20.0, 0.1 * k, 0.5] for k in range(5)]}]
    rows = [(name, k, "lidar", (k + (5 if k > 6 else 0)) * 100_000_000, 0.0, 60.0, seen if k != 3 else []) for name in "ab" for k in range(10)]
    df = spark.createDataFrame(rows, processor.FRAME)
    want = sorted(tuple(r[c] for c in ("recording", "frame_idx", "status", "event", "reset_reason", "distance_m")) for r in processor.process_batch(df).collect())
    assert any(r[4] == "timestamp_gap" for r in want)
    src = str(tmp_path / "in")
    for low in (0, 5):
        df.where(f"frame_idx >= {low} and frame_idx < {low + 5}").coalesce(1).write.mode("append").parquet(src)
    stream = processor.process_stream(spark.readStream.schema(processor.FRAME).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName("results").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r[c] for c in ("recording", "frame_idx", "status", "event", "reset_reason", "distance_m")) for r in spark.table("results").collect())
    assert got == want


def test_a_corridor_is_cut_block_by_block(clear):
    import json
    import tracemalloc

    import pyarrow as pa

    from corvia.operators import frames

    g = route.straight_geometry(60.0, curvature=0.004)
    row = frames._geometry_row(("r", 0), g, "")
    geo = pa.RecordBatch.from_pylist([{"recording": "r", "frame_idx": 0, "point_idx": None, "geo": json.dumps(row), "ring": None} | dict.fromkeys("xyz")])
    rng = np.random.default_rng(6)
    n = 300_000
    xyz = np.column_stack((rng.uniform(-9, 9, n), -rng.uniform(0, 80, n), rng.uniform(-1, 3.5, n)))
    names = ["recording", "frame_idx", "point_idx", "x", "y", "z", "ring"]

    def batch(i, j):
        part = [pa.repeat("r", j - i), pa.repeat(0, j - i), pa.array(np.arange(i, j, dtype=np.int32)), *(pa.array(c) for c in xyz[i:j].T), pa.array(np.arange(i, j, dtype=np.int32) % 128)]
        return pa.RecordBatch.from_arrays([*part, pa.nulls(j - i, geo.schema.field("geo").type)], [*names, "geo"])

    cuts = [0, 7, 10_000, 77_777, 200_000, n]
    batches = [geo.select([*names, "geo"]), *(batch(i, j) for i, j in zip(cuts, cuts[1:]))]
    tracemalloc.start()
    (key, parts), = ((k, list(p)) for k, p in frames.frame_parts(batches))
    found, (idx, ring, inside, local), rings = frames.corridor(parts, 1 << 14)
    peak = tracemalloc.get_traced_memory()[1]
    rows, want = route.members(xyz, g)
    assert key == ("r", 0) and rings and found.extent == g.extent
    assert idx.tolist() == rows.tolist() and np.allclose(local, want, atol=1e-8) and (inside == xyz[rows]).all() and (ring == rows % 128).all()
    assert peak < 60e6
    tracemalloc.reset_peak()
    route.members(xyz, g)
    assert tracemalloc.get_traced_memory()[1] > 2 * peak
    tracemalloc.stop()


def test_frames_are_not_one_group_of_the_jvm(spark, sf_dir):
    from corvia.plans import registry

    for name in ("detect_obstacles", "proximity_components", "ego_motion"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "InPandas" not in plan


def test_the_ordered_pass_gets_few_returns_of_a_group(spark, blocked):
    from pyspark.sql import functions as F

    from corvia.operators import frames
    from corvia.plans import more
    from corvia.streaming import processor, state

    pdf = pd.concat(pd.DataFrame({"recording": "r", "frame_idx": k, "point_idx": np.arange(len(blocked)), "x": blocked[:, 0], "y": blocked[:, 1] + k, "z": blocked[:, 2] + 1.62}) for k in range(3))
    pts = spark.createDataFrame(pdf, "recording string, frame_idx int, point_idx int, x double, y double, z double")
    g = more.straight_geometry(pts)
    stamps = spark.range(3).select(F.lit("r").alias("recording"), F.col("id").cast("int").alias("frame_idx"), F.lit("lidar").alias("frame_id"), (F.col("id") * 100_000_000).alias("timestamp_ns"))
    motion = processor.ego_motion(pts).cache()
    ego = state.EgoMotion()
    want = [ego.update(p[list("xyz")].to_numpy())["travel_m"] for _, p in pdf.groupby("frame_idx")]
    assert [r["travel_m"] for r in motion.orderBy("frame_idx").collect()] == want
    every, few = (processor.frame_rows(stamps, motion, g, frames.detect_obstacles(pts, g, columns=c)) for c in (None, frames.BOXED))
    assert max(len(o["points"]) for r in few.collect() for o in r["seen"]) <= 3
    drop = "elapsed_ms"
    a, b = (processor.process_batch(d).drop(drop).orderBy("frame_idx").collect() for d in (every, few))
    assert a == b and any(r["tracks"] for r in a)
