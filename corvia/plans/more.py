"""Queries of operators that run numeric solvers or keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import route
from ..functions import scalar as S
from ..operators import frames as Fr
from ..operators import projection as P
from ..streaming import processor
from . import fixtures


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .registry import local

    return local(spark, sf_dir)


def straight_geometry(points: DataFrame, extent: float = 60.0) -> DataFrame:
    """The same straight route for every frame, as GEOMETRY rows."""
    g = route.straight_geometry(extent)
    arrays = {"origin": g.origin, "basis": g.basis.ravel(), "knots": g.knots, "lateral": g.lateral, "height": g.height}
    cols = {n: F.array(*(F.lit(float(v)) for v in a)) for n, a in arrays.items()}
    more = {"extent_m": g.extent, "half_width_m": g.half_width, "gauge_height_m": g.gauge_height, "rails_end_curvature_per_m": 0.0}
    d = points.select(*P.K).distinct().withColumns({"status": F.lit("MEASURED"), "reason": F.lit(None).cast("string"), "rails_end_m": F.lit(None).cast("double"), **cols, **{n: F.lit(float(v)) for n, v in more.items()}})
    return d.select(*Fr.GEOMETRY.names)


def corridor_membership(spark, sf):
    p = fixtures.cloud(spark, sf)
    r = Fr.select_region(p, straight_geometry(p))
    return r.select(*P.K, "point_idx", *(F.round(c, 6).alias(c) for c in ("station", "offset", "height")), "in_gauge")


def proximity_components(spark, sf):
    """Groups as each member's smallest member."""
    return Fr.grouped_components(_local(spark, sf)).select(*P.K, "point_idx", "root")


def travel_motion(spark, sf):
    p = _local(spark, sf)
    m = S.travel_motion(F.col("station") / 23, (F.col("ring") - 64) / 128.0 * 0.0103)
    return p.select(*P.K, "point_idx", *(F.round(c, 6).alias(n) for n, c in m.items()))


def surface_points(spark, sf):
    p = fixtures.cloud(spark, sf)
    return Fr.surface_points(Fr.select_region(p, straight_geometry(p)))


def detect_obstacles(spark, sf):
    p = fixtures.cloud(spark, sf)
    return Fr.detect_obstacles(p, straight_geometry(p), columns=[n for n in Fr.SUMMARY if n != "reasons"])


def raw_routes(spark, sf):
    return Fr.raw_routes(fixtures.cloud(spark, sf)).select(*P.K, "status", "reason")


def ego_motion(spark, sf):
    return processor.ego_motion(fixtures.cloud(spark, sf))


def track_and_gauge(spark, sf):
    """Detection, tracking and gauge over all frames, on a straight route."""
    p = fixtures.cloud(spark, sf)
    g = straight_geometry(p)
    stamps = p.select(*P.K).distinct().withColumns({"frame_id": F.lit("lidar"), "timestamp_ns": F.col("frame_idx").cast("long") * 100_000_000})
    rows = processor.frame_rows(stamps, processor.ego_motion(p), g, Fr.detect_obstacles(p, g, columns=Fr.BOXED))
    return processor.process_batch(rows).select(*P.K, "status", "path_clear", F.round("distance_m", 6).alias("distance_m"), "event", "route_available", "processing_ok", "reset_reason", F.size("tracks").alias("n_tracks"))


def queries():
    return {
        f.__name__: f
        for f in (corridor_membership, proximity_components, travel_motion, surface_points, detect_obstacles, raw_routes, ego_motion, track_and_gauge)
    }


def oracle_sql():
    from .registry import CLOUD_CTE

    return {
        "corridor_membership": f"""{CLOUD_CTE} SELECT recording, frame_idx, point_idx, round(station, 6) AS station, round("offset", 6) AS "offset", round(height, 6) AS height, height >= -1e-8 AS in_gauge
            FROM local WHERE NOT (x = 0 AND y = 0 AND z = 0) AND station >= 0 AND station <= 60 AND abs("offset") <= 1.05 + 1e-8 AND height BETWEEN -0.7 - 1e-8 AND 3.0 + 1e-8""",
        "proximity_components": f"""{CLOUD_CTE.replace("WITH cloud", "WITH RECURSIVE cloud")}, p AS (SELECT *, CAST(floor(station / 1.2) AS BIGINT) AS own FROM local), x AS (SELECT *, unnest([own - 1, own, own + 1]) AS cell FROM p),
            e AS MATERIALIZED (SELECT a.recording, a.frame_idx, a.point_idx AS a, b.point_idx AS b FROM x a JOIN p b ON a.recording = b.recording AND a.frame_idx = b.frame_idx AND a.cell = b.own
                WHERE abs(a.station - b.station) <= 1.2 AND abs(a."offset" - b."offset") <= greatest(0.25, 0.006 * a.range_m, 0.006 * b.range_m) AND abs(a.height - b.height) <= greatest(0.20, 0.006 * a.range_m, 0.006 * b.range_m)),
            r(recording, frame_idx, point_idx, root) USING KEY (recording, frame_idx, point_idx) AS (SELECT recording, frame_idx, point_idx, point_idx FROM p
                UNION SELECT e.recording, e.frame_idx, e.b, min(r.root) FROM r JOIN e ON e.recording = r.recording AND e.frame_idx = r.frame_idx AND e.a = r.point_idx
                    JOIN recurring.r o ON o.recording = e.recording AND o.frame_idx = e.frame_idx AND o.point_idx = e.b WHERE r.root < o.root GROUP BY e.recording, e.frame_idx, e.b)
            SELECT recording, frame_idx, point_idx, root FROM r""",
        "travel_motion": f"""{CLOUD_CTE}, m AS (SELECT recording, frame_idx, point_idx, station / 23 AS d, (ring - 64) / 128.0::DOUBLE * 0.0103 AS k FROM local), n AS (SELECT *, k * d AS t, sqrt(greatest(1 - (k * 10.5 / 2) * (k * 10.5 / 2), 0)) AS lean FROM m)
            SELECT recording, frame_idx, point_idx, round(t, 6) AS yaw_rad, round(lean * CASE WHEN abs(t) < 1e-9 THEN d ELSE d * sin(t) / t END - 5.25 * (1 - cos(t)), 6) AS forward_m,
            round(lean * CASE WHEN abs(t) < 1e-9 THEN d * t / 2 ELSE d * (1 - cos(t)) / t END + 5.25 * sin(t), 6) AS lateral_m FROM n""",
    }
