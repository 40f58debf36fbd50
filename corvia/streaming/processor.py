"""Ordered passes over recordings: as a batch, and as Structured Streaming.

Frames of a recording depend on those before, so a recording is one ordered run;
recordings are independent. The batch pass streams sorted rows through a task and
holds one frame at a time, whatever a recording's length. In a stream, state is
kept by recording; a micro-batch's rows are sorted first, and what comes out of
order after that resets the state, as a gap does.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.schema import schema
from .state import EgoMotion, Recording, look

FRAME = schema(
    "recording string, frame_idx int, frame_id string, timestamp_ns bigint, travel_m double, extent_m double, "
    "seen array<struct<group_id:int,kind:string,station:double,offset:double,range_m:double,confidence:double,reasons:array<string>,low:array<double>,high:array<double>,points:array<array<double>>>>"
)
RESULT = schema(
    "recording string, frame_idx int, timestamp_ns bigint, status string, path_clear boolean, distance_m double, confidence double, event string, blocking_ids array<bigint>, caution_ids array<bigint>, "
    "travel_m double, route_available boolean, processing_ok boolean, error string, reset_reason string, "
    "tracks array<struct<id:bigint,decision:string,relation:string,range_m:double,exists:boolean,confirmed:boolean,seen:boolean,kind:string,station_m:double,offset_m:double,evidence:double,speed_m_per_frame:double,low:array<double>,high:array<double>>>, elapsed_ms double"
)
MOTION = schema("recording string, frame_idx int, travel_m double, yaw_rad double, forward_m double, lateral_m double, measured boolean, locked boolean")


#: A piece of what motion is measured by: of a frame's sample or of its occupied voxels.
LOOK = schema("recording string, frame_idx int, part int, sample boolean, k double, piece binary")


def _pieces(values: np.ndarray, most: int = 600) -> list[np.ndarray]:
    return [values[n : n + most] for n in range(0, len(values), most)]


def _corner(of) -> Column:
    """Of the box around a group's points (station, offset, height), and so on."""

    def along(k):  # a second parameter would be the element's position
        return F.transform("points", lambda p: p[k])

    return F.array(*(of(along(k)) for k in range(3)))


def frame_rows(frames: DataFrame, motion: DataFrame, geometry: DataFrame, obstacles: DataFrame) -> DataFrame:
    """FRAME: one summary row for each frame; no cloud goes into the ordered pass.

    Obstacles have all their points, or their boxes (low, high) and the decisive ones."""
    k = ["recording", "frame_idx"]
    item = F.struct(
        F.col("group_id").cast("int").alias("group_id"), "kind", F.col("station_m").alias("station"), F.col("track_offset_m").alias("offset"), "range_m", "confidence", "reasons",
        *(("low", "high", F.col("decisive").alias("points")) if "decisive" in obstacles.columns else (_corner(F.array_min).alias("low"), _corner(F.array_max).alias("high"), "points")),
    )
    seen = obstacles.groupBy(*k).agg(F.sort_array(F.collect_list(item)).alias("seen"))
    d = frames.join(motion.select(*k, "travel_m"), k, "left").join(geometry.select(*k, "extent_m"), k, "left").join(seen, k, "left")
    none = F.array().cast(FRAME["seen"].dataType)
    more = ["error"] if "error" in frames.columns else []
    return d.select(*k, "frame_id", "timestamp_ns", *more, F.coalesce("travel_m", F.lit(0.0)).alias("travel_m"), "extent_m", F.coalesce(F.col("seen").cast(FRAME["seen"].dataType), none).alias("seen"))


def _result(row, rec: Recording) -> dict:
    """RESULT of one frame; elapsed_ms is its time in the ordered pass. A frame whose
    message could not be decoded (column error, if there is one) clears the state."""
    began = time.perf_counter()
    own = {"recording": row.recording, "frame_idx": int(row.frame_idx), "timestamp_ns": int(row.timestamp_ns)}
    error = getattr(row, "error", None)
    if isinstance(error, str):
        rec.reset()
        none = dict.fromkeys(("path_clear", "distance_m", "confidence", "event", "reset_reason"))
        return own | none | {"travel_m": 0.0, "route_available": False, "status": "CAUTION", "blocking_ids": [], "caution_ids": [], "tracks": [], "processing_ok": False, "error": error, "elapsed_ms": 1e3 * (time.perf_counter() - began)}
    extent = None if row.extent_m is None or pd.isna(row.extent_m) else float(row.extent_m)
    seen = [dict(o) | {"reasons": list(o["reasons"] if o["reasons"] is not None else []), "points": [list(p) for p in o["points"]], "low": list(o["low"]), "high": list(o["high"])} for o in (row.seen if row.seen is not None else [])]
    out = rec.frame(row.frame_id, int(row.timestamp_ns), seen, float(row.travel_m), extent)
    return own | {"travel_m": float(row.travel_m), "route_available": extent is not None} | {k: v for k, v in out.items() if k != "lost"} | {"elapsed_ms": 1e3 * (time.perf_counter() - began)}


def process_batch(frames: DataFrame, max_gap_s: float = 0.25) -> DataFrame:
    """RESULT rows of FRAME rows, recordings in order of frame_idx."""

    def run(batches):
        rec, name = None, None
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                if rec is None or row.recording != name:
                    rec, name = Recording(max_gap_s), row.recording
                rows.append(_result(row, rec))
            yield pd.DataFrame(rows, columns=RESULT.names)

    ordered = frames.repartition("recording").sortWithinPartitions("recording", "frame_idx")
    return ordered.mapInPandas(run, RESULT)


def process_stream(frames: DataFrame, max_gap_s: float = 0.25) -> DataFrame:
    """The same for a streaming DataFrame of FRAME rows."""

    def run(key, pdfs, state):
        rec = Recording.load(state.get[0] if state.exists else None, max_gap_s=max_gap_s)
        pdf = pd.concat(list(pdfs)).sort_values(["timestamp_ns", "frame_idx"], kind="stable")
        rows = [_result(row, rec) for row in pdf.itertuples(index=False)]
        state.update((rec.dump(),))
        yield pd.DataFrame(rows, columns=RESULT.names)

    return frames.groupBy("recording").applyInPandasWithState(run, RESULT, schema("state string"), "append", "NoTimeout")


def ego_motion(points: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """MOTION of every frame. Clouds are looked at in parallel by frame; the ordered pass
    gets a frame's sample and its occupied voxels, in pieces."""
    from ..operators.frames import by_frame, columns_of, frame_parts

    k = ["recording", "frame_idx"]
    curvature = F.lit(0.0).alias("k") if geometry is None else F.coalesce("rails_end_curvature_per_m", F.lit(0.0)).alias("k")
    p = points if geometry is None else points.join(geometry.select(*k, "rails_end_curvature_per_m"), k, "left")
    # only what motion is measured on travels
    near = (-F.col("y")).between(3, 40) & (F.abs("x") <= 6) & (F.col("z") > -4) & (F.col("z") < 5)
    every = points.select(*k).distinct().select(*k, F.lit(None).cast("int").alias("point_idx"), *(F.lit(None).cast("double").alias(c) for c in "xyz"), F.lit(0.0).alias("k"))
    rows = p.where(near).select(*k, "point_idx", *(F.col(c).cast("double").alias(c) for c in "xyz"), curvature).unionByName(every)

    def seen(batches):
        for key, parts in frame_parts(batches):
            idx, x, y, z, kappa = columns_of(parts, "point_idx", *"xyz", "k")
            body = ~np.isnan(idx)
            sample, occupied = look(np.column_stack((x, y, z))[body])
            pieces = [np.zeros(0)] if sample is None else _pieces(sample.ravel()) + _pieces(occupied)
            bend = float(kappa[body][0]) if body.any() else 0.0
            yield pa.RecordBatch.from_pylist([{"recording": key[0], "frame_idx": key[1], "part": n, "sample": p.dtype == float, "k": bend, "piece": p.tobytes()} for n, p in enumerate(pieces)], to_arrow_schema(LOOK))

    def run(batches):
        as_arrow, ego, name = to_arrow_schema(MOTION), EgoMotion(), None
        for (recording, frame), parts in frame_parts(batches):
            if recording != name:
                ego, name = EgoMotion(), recording
            read = [(r["sample"], r["k"], r["piece"]) for b in parts for r in b.select(["sample", "k", "piece"]).to_pylist()]
            sample, occupied = (np.frombuffer(b"".join(p for s, _, p in read if s == of), kind) for of, kind in ((True, float), (False, np.int64)))
            row = ego.advance(sample.reshape(-1, 3) if len(sample) else None, occupied, read[0][1])
            yield pa.RecordBatch.from_pylist([{"recording": recording, "frame_idx": frame} | row], as_arrow)

    looks = by_frame(rows).mapInArrow(seen, LOOK)
    return looks.repartition("recording").sortWithinPartitions("recording", "frame_idx", "part").mapInArrow(run, MOTION)


def smooth_routes(geometry: DataFrame, motion: DataFrame) -> DataFrame:
    """The filtered route of every frame, from raw routes and motion. The filter takes
    a bend's direction from far stations, recovers from a wrong shape and lets the
    route bend one way only (EarlyDirectionRouteFilter)."""
    from ..operators.frames import GEOMETRY, _geometry_row, geometry_frame, geometry_of
    from .filters import EarlyDirectionRouteFilter

    k = ["recording", "frame_idx"]
    rows = geometry.join(motion.select(*k, "yaw_rad", "forward_m", "lateral_m"), k, "left")

    def run(batches):
        flt, name = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if flt is None or row["recording"] != name:
                    flt, name = EarlyDirectionRouteFilter(), row["recording"]
                step = tuple(0.0 if pd.isna(row[c]) else float(row[c]) for c in ("yaw_rad", "forward_m", "lateral_m"))
                g = flt.update(geometry_of(row), step)
                new = _geometry_row((name, row["frame_idx"]), g, row["reason"] or "")
                if g is not None:
                    new["status"] = "TEMPORALLY_ESTIMATED"
                out.append(new)
            yield geometry_frame(out)

    return rows.repartition("recording").sortWithinPartitions("recording", "frame_idx").mapInPandas(run, GEOMETRY)


def process_recordings(points: DataFrame, frames: DataFrame, max_gap_s: float = 0.25) -> DataFrame:
    """Clouds to RESULT rows: raw routes and detection in parallel by frame, motion,
    smoothing, tracking and gauge in order by recording."""
    from ..operators.frames import BOXED, detect_obstacles, raw_routes

    raw = raw_routes(points)
    motion = ego_motion(points, raw)
    smooth = smooth_routes(raw, motion)
    return process_batch(frame_rows(frames, motion, smooth, detect_obstacles(points, smooth, columns=BOXED)), max_gap_s)
