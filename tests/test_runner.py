import json
import sqlite3

import numpy as np
import pytest

from corvia import runner
from corvia.sources import cloud_codec as C
from corvia.sources import recordings as R
from tests.scenes import box, track


def bag(path, clouds):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE topics(id INTEGER PRIMARY KEY, name TEXT, type TEXT, serialization_format TEXT)")
    con.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    con.execute("INSERT INTO topics VALUES (1, '/points', ?, 'cdr')", (R.KIND,))
    for k, data in enumerate(clouds):
        con.execute("INSERT INTO messages VALUES (?, 1, ?, ?)", (k + 1, 10**9 + k * 100_000_000, data))
    con.commit()
    con.close()


def message(xyz):
    return C.to_cdr(C.pack(xyz, allow_nonfinite=True, frame_id="lidar"))


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    cloud = np.concatenate((track(step=0.2), box()))
    gone = np.concatenate((cloud, np.full((3, 3), np.nan)))
    bag(d / "ride.db3", [message(gone if k == 1 else cloud) if k != 2 else b"broken" for k in range(8)])
    runner.main([str(d / "out"), str(d / "ride.db3"), "--max-frames", "7"])
    return d


def test_a_recording_becomes_files(spark, done):
    csv = spark.read.option("header", True).csv(str(done / "out/ride/frames.csv"))
    assert csv.count() == 7 and "elapsed_ms" in csv.columns
    assert spark.read.json(str(done / "out/ride/summary.json")).first()["frames"] == 7
    with pytest.raises(Exception):
        runner.process_recording(spark, str(done / "ride.db3"), str(done / "out/ride"), max_frames=1)


def test_output_rows(spark, done):
    rows = [json.loads(r["value"]) for r in spark.read.text(str(done / "out/ride/frames.jsonl")).collect()]
    rows = {r["frame_index"]: r for r in rows}
    assert sorted(rows) == list(range(7))
    for k, r in rows.items():
        assert r["schema_version"] == 1 and r["header"]["timestamp_ns"] == 10**9 + k * 100_000_000
        assert r["removed_points"] == (3 if k == 1 else 0) and set(r["timing_ms"]) == {"ordered_pass"}
        assert ("error" in r) == (k == 2) == (not r["processing_ok"])
    assert rows[2]["status"] == "CAUTION" and rows[2]["path_clear"] is None and rows[2]["tracks"] == [] and not rows[2]["route_available"]
    assert rows[3]["header"]["frame_id"] == "lidar" and rows[3]["processing_ok"] and rows[3]["route_available"]
    (near,) = [t for t in rows[6]["tracks"] if t["kind"] == "object"]
    assert abs(near["centre"][0] - 20) < 1 and abs(near["centre"][1]) < 0.3 and near["centre"][2] > 0


@pytest.mark.parametrize("own", [["--max-frames", "-1"], ["--max-gap", "nan"], ["b/ride.db3"]])
def test_arguments_are_checked(own, tmp_path):
    with pytest.raises(SystemExit):
        runner.main([str(tmp_path), "a/ride.db3", *own])


def test_a_cloud_without_a_route(spark, tmp_path):
    """Four points: caution, no route."""
    np.save(tmp_path / "few.npy", np.array([[0, -5, 0], [1, -6, 0], [-1, -6, 0], [0, -7, 0]], np.float32))
    (r,) = runner.process_recording(spark, str(tmp_path / "few.npy"), str(tmp_path / "out")).collect()
    assert (r["status"], r["path_clear"], r["route_available"], r["processing_ok"]) == ("CAUTION", None, False, True)
