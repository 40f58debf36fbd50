"""Registered queries of the point-cloud operators, each with its SQL.

Queries run an operator over a whole table: the point cloud projected from
lineitem, the frame sequence from events, or arrays from embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregation as A
from ..operators import groups as G
from ..operators import joins as J
from ..operators import projection as P
from ..operators import ranking as R
from ..operators import windows as Wn
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

CLOUD_CTE = f"WITH cloud AS ({fixtures.CLOUD}), local AS (SELECT *, -y AS station, x AS \"offset\", z AS height, sqrt(x*x+y*y+z*z) AS range_m FROM cloud)"


def query(name: str, sql: str | None = None):
    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud with station, offset, height and range."""
    p = P.to_sensor(fixtures.cloud(spark, sf_dir))
    return p.withColumn("range_m", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))


def six(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


# ---- row-wise ---------------------------------------------------------------

POINT = "recording, frame_idx, point_idx"


@query("box_near_field", f"{CLOUD_CTE} SELECT {POINT}, round(station, 6) AS station, round(\"offset\", 6) AS \"offset\", round(height, 6) AS height FROM local WHERE station BETWEEN 1 AND 20 AND \"offset\" BETWEEN -4 AND 4 AND height BETWEEN -5 AND 2")
def _near(spark, sf):
    return P.near_field(fixtures.cloud(spark, sf)).select(*P.K, "point_idx", *six("station", "offset", "height"))


@query("box_far_field", f"{CLOUD_CTE} SELECT {POINT}, round(station, 6) AS station FROM local WHERE station BETWEEN 13 AND 83 AND \"offset\" BETWEEN -12 AND 12 AND height BETWEEN -0.8 AND 0.8")
def _far(spark, sf):
    return P.far_field(fixtures.cloud(spark, sf)).select(*P.K, "point_idx", *six("station"))


@query("finite_report", f"{CLOUD_CTE} SELECT recording, frame_idx, count(*) FILTER (WHERE ring % 7 <> 0) AS kept, count(*) FILTER (WHERE ring % 7 = 0) AS removed_points FROM cloud GROUP BY ALL")
def _finite(spark, sf):
    holed = fixtures.cloud(spark, sf).withColumn("z", F.when(F.col("ring") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("z")))
    return P.finite_report(holed)


@query("forward_points", f"{CLOUD_CTE}, e AS (SELECT recording, frame_idx, max(station) AS extent FROM local GROUP BY ALL) SELECT {POINT}, round(extent, 6) AS extent FROM local JOIN e USING (recording, frame_idx) WHERE station >= 0 AND NOT (x = 0 AND y = 0 AND z = 0)")
def _forward(spark, sf):
    return P.forward_points(fixtures.cloud(spark, sf)).select(*P.K, "point_idx", *six("extent"))


@query("height_slice", f"{CLOUD_CTE} SELECT {POINT} FROM local WHERE station >= 0 AND height BETWEEN 0.5 - 0.8 / 2 AND 0.5 + 0.8 / 2")
def _slice(spark, sf):
    return P.height_slice(fixtures.cloud(spark, sf), 0.5).select(*P.K, "point_idx")


@query("usable_split", f"{CLOUD_CTE} SELECT {POINT}, round(range_m, 6) AS range_m, height >= -1e-8 AS in_gauge FROM local WHERE range_m >= 2.5")
def _usable(spark, sf):
    return P.split_gauge(P.usable(local(spark, sf))).select(*P.K, "point_idx", *six("range_m"), "in_gauge")


@query(
    "visible_pixels",
    f"""{CLOUD_CTE}, p AS (SELECT *, CAST(floor(480 + 700.0::DOUBLE * -"offset" / station) AS INT) AS u, CAST(floor(270 - 700.0::DOUBLE * height / station) AS INT) AS v FROM local WHERE range_m >= 2.5 AND station > 0.1 AND station < 160)
    SELECT recording, frame_idx, u, v, round(min(station), 6) AS depth, arg_min(point_idx, {{'s': station, 'i': point_idx}}) AS point_idx FROM p WHERE u >= 0 AND u < 960 AND v >= 0 AND v < 540 GROUP BY recording, frame_idx, u, v""",
)
def _visible(spark, sf):
    return P.visible(fixtures.cloud(spark, sf)).select(*P.K, "u", "v", *six("depth"), "point_idx")


@query(
    "scalar_scores",
    f"""{CLOUD_CTE} SELECT {POINT}, round(least(greatest((station - 30) / 20, 0), 1) * 0.30, 6) AS margin,
    round((0.07 + least(abs(ring / 128.0::DOUBLE * 1e-3) / 4e-4, 1) * 0.034 * greatest(station - 40, 0) + (1 - least(abs(ring / 128.0::DOUBLE * 1e-3) / 4e-4, 1)) * 0.0006 * greatest(station - 40, 0) * greatest(station - 40, 0)) * 0.99731, 6) AS uncertainty,
    round((2*height - 0.01*(station*station + height*height)) / (1 + sqrt((1 - 0.01*height)*(1 - 0.01*height) + 0.01*station*0.01*station)), 6) AS arc_distance,
    CASE WHEN height >= 0.2 THEN CAST(floor(height / 0.8) AS INT) END AS layer,
    round(0.99731 * (0.30*least(greatest((height - 0.1)/0.2, 0), 1) + 0.15*least(greatest("offset"/0.1 + 0.5, 0), 1) + 0.25*least(greatest((ring - 3)/8.0::DOUBLE, 0), 1) + 0.18*least(greatest((ring % 5 - 1)/2.0::DOUBLE, 0), 1) + 0.12*least(1, ring/12.0::DOUBLE)) * least(1, (ring - 1)/4.0::DOUBLE), 6) AS confidence
    FROM local""",
)
def _scores(spark, sf):
    # scaled, so that no value lies halfway between two of six decimals
    p = local(spark, sf)
    k = F.col("ring") / 128.0 * 1e-3
    return p.select(
        *P.K,
        "point_idx",
        F.round(S.margin_width(F.col("station")), 6).alias("margin"),
        F.round(S.lateral_uncertainty(F.col("station"), F.lit(40.0), k) * 0.99731, 6).alias("uncertainty"),
        F.round(S.arc_distance(F.col("station"), F.col("height"), F.lit(0.0), F.lit(0.0), F.lit(0.01)), 6).alias("arc_distance"),
        S.height_layer(F.col("height")).alias("layer"),
        F.round(S.evidence_confidence(F.col("height"), F.col("offset"), F.col("ring"), F.col("ring") % 5, F.col("ring")) * 0.99731, 6).alias("confidence"),
    )


@query(
    "path_samples",
    f"""{CLOUD_CTE}, f AS (SELECT recording, frame_idx, CAST(max(ring) AS DOUBLE) / 128 * 0.004 AS k, CAST(min(ring) + 1 AS DOUBLE) / 128 * 0.1 AS yaw FROM cloud GROUP BY ALL),
    s AS (SELECT *, unnest(range(0, 241)) * 0.25::DOUBLE AS s FROM f)
    SELECT recording, frame_idx, s, round(CASE WHEN abs(k*s/2) < 1e-9 THEN s ELSE s*sin(k*s/2)/(k*s/2) END * cos(yaw + k*s/2), 6) AS px, round(CASE WHEN abs(k*s/2) < 1e-9 THEN s ELSE s*sin(k*s/2)/(k*s/2) END * sin(yaw + k*s/2), 6) AS py FROM s""",
)
def _path(spark, sf):
    f = fixtures.cloud(spark, sf).groupBy(*P.K).agg((F.max("ring").cast("double") / 128 * 0.004).alias("k"), ((F.min("ring") + 1).cast("double") / 128 * 0.1).alias("yaw"))
    s = f.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(240)))).withColumn("s", F.col("n") * F.lit(0.25))
    x, y = S.path_point(F.col("s"), F.lit(0.0), F.col("yaw"), F.col("k"))
    return s.select(*P.K, "s", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


# ---- aggregation --------------------------------------------------------------


@query(
    "nearest_rank_quantile",
    f"""{CLOUD_CTE}, r AS (SELECT recording, frame_idx, CAST(floor("offset" / 0.05) AS BIGINT) AS cell, height, row_number() OVER w AS rn, count(*) OVER (PARTITION BY recording, frame_idx, floor("offset" / 0.05)) AS n FROM local WINDOW w AS (PARTITION BY recording, frame_idx, floor("offset" / 0.05) ORDER BY height, point_idx))
    SELECT recording, frame_idx, cell, n, CASE WHEN n >= 4 THEN round(height, 6) END AS value FROM r WHERE rn = least(n, floor(n * 0.95) + 1)""",
)
def _nearest_rank(spark, sf):
    p = local(spark, sf).withColumn("cell", A.cell("offset", 0.05))
    return A.nearest_rank(p, [*P.K, "cell"], "height", 95, 4, tie=["point_idx"]).select(*P.K, "cell", "n", *six("value"))


_BINS = """b AS (SELECT *, least(greatest(CAST(floor(("offset" + 1.65) / 0.05) AS INT), 0), 65) AS cell, least(CAST(trunc(station / 0.5) AS INT), 299) AS bin FROM local),
    t AS (SELECT recording, frame_idx, cell, bin, max(height) AS top FROM b GROUP BY ALL)"""


def _binned(spark, sf):
    return A.station_bins(A.lateral_cells(local(spark, sf), 1.05))


@query(
    "track_shape",
    f"""{CLOUD_CTE}, {_BINS}, r AS (SELECT *, row_number() OVER (PARTITION BY recording, frame_idx, cell ORDER BY top, bin) AS rn, count(*) OVER (PARTITION BY recording, frame_idx, cell) AS n FROM t)
    SELECT recording, frame_idx, cell, n, CASE WHEN n >= 4 THEN round(top, 6) END AS shape FROM r WHERE rn = least(n, floor(n * 0.95) + 1)""",
)
def _shape(spark, sf):
    return A.track_shape(_binned(spark, sf)).select(*P.K, "cell", "n", *six("shape"))


@query(
    "steady_cells",
    f"""{CLOUD_CTE}, {_BINS}, r AS (SELECT *, row_number() OVER (PARTITION BY recording, frame_idx, cell ORDER BY top, bin) AS rn, count(*) OVER (PARTITION BY recording, frame_idx, cell) AS n FROM t),
    s AS (SELECT recording, frame_idx, cell, max(top) FILTER (WHERE rn = least(n, floor(n * 0.9) + 1)) - max(top) FILTER (WHERE rn = least(n, floor(n * 0.1) + 1)) AS spread FROM r GROUP BY ALL),
    l AS (SELECT recording, frame_idx, quantile_cont(spread, 0.4) AS typical FROM s GROUP BY ALL)
    SELECT recording, frame_idx, cell, round(spread, 6) AS spread, spread <= greatest(typical, 0.12) AS steady FROM s JOIN l USING (recording, frame_idx)""",
)
def _steady(spark, sf):
    return A.steady_cells(_binned(spark, sf)).select(*P.K, "cell", *six("spread"), "steady")


@query("cell_medians", f"{CLOUD_CTE} SELECT recording, frame_idx, CAST(floor(x / 0.4) AS BIGINT) AS cx, CAST(floor(y / 4.0::DOUBLE) AS BIGINT) AS cy, round(median(x), 6) AS mx, round(median(y), 6) AS my, round(median(z), 6) AS mz FROM cloud GROUP BY ALL")
def _medians(spark, sf):
    p = fixtures.cloud(spark, sf)
    m = p.groupBy(*P.K, A.cell("x", 0.4).alias("cx"), A.cell("y", 4.0).alias("cy")).agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.median("z").alias("mz"))
    return m.select(*P.K, "cx", "cy", *six("mx", "my", "mz"))


@query("voxel_first", f"{CLOUD_CTE} SELECT recording, frame_idx, CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 2.0::DOUBLE) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz, min(point_idx) AS point_idx, arg_min(x, point_idx) AS x, arg_min(y, point_idx) AS y, arg_min(z, point_idx) AS z FROM cloud GROUP BY ALL")
def _voxels(spark, sf):
    return A.voxel_first(fixtures.cloud(spark, sf), (0.5, 2.0, 0.5))


@query("lateral_profile", f"{CLOUD_CTE} SELECT recording, frame_idx, CAST(floor(\"offset\" / 0.035) AS BIGINT) AS bin, count(*) AS n, round(quantile_cont(height, 0.8), 6) AS p80, round(quantile_cont(height, 0.25), 6) AS p25 FROM local GROUP BY ALL HAVING count(*) >= 3")
def _profile(spark, sf):
    return A.lateral_profile(local(spark, sf)).select(*P.K, "bin", "n", *six("p80", "p25"))


def _case_bins(extent: float) -> str:
    e = A.distance_edges(extent)
    return "CASE " + " ".join(f"WHEN station >= {a!r} AND station < {b!r} THEN {k}" for k, (a, b) in enumerate(zip(e, e[1:]))) + " END"


@query(
    "range_extremes",
    f"""{CLOUD_CTE}, b AS (SELECT *, CAST({_case_bins(80.0)} AS INT) AS bin FROM local)
    SELECT recording, frame_idx, bin, count(*) AS n, min(station) AS s_min, max(station) AS s_max, min("offset") AS d_min, max("offset") AS d_max, min(height) AS h_min, max(height) AS h_max,
    arg_min(point_idx, {{'d': "offset", 'i': point_idx}}) AS left_idx, arg_max(point_idx, {{'d': "offset", 'i': -point_idx}}) AS right_idx, bit_or(1::BIGINT << least(greatest(CAST(floor(height / 0.8) AS INT), 0), 15)) AS layers
    FROM b WHERE bin IS NOT NULL GROUP BY recording, frame_idx, bin""",
)
def _extremes(spark, sf):
    return A.range_extremes(local(spark, sf), A.distance_edges(80.0))


@query(
    "observed_bands",
    f"""{CLOUD_CTE} SELECT recording, frame_idx, CAST(floor(station / 4) AS BIGINT) AS band, count(*) AS n, count(DISTINCT floor((station % 4) / 1)) AS occupied, min("offset") AS low, max("offset") AS high FROM local WHERE station >= 0 GROUP BY ALL
    HAVING count(*) >= 8 AND count(DISTINCT floor((station % 4) / 1)) >= 2 AND max("offset") - min("offset") >= 2.5""",
)
def _bands(spark, sf):
    return A.observed_bands(local(spark, sf))


@query(
    "sub_cell_grid",
    f"""{CLOUD_CTE}, p AS (SELECT *, CAST(floor(station / 4) AS BIGINT) AS cs, CAST(floor("offset" / 0.25) AS BIGINT) AS cd, CAST(floor(height / 0.8) AS BIGINT) AS ch,
    ((CAST(floor(station / 1) AS BIGINT) % 4 * 4 + CAST(floor("offset" / 0.0625) AS BIGINT) % 4) % 16 + 16) % 16 AS sub FROM local WHERE station >= 0),
    f AS (SELECT recording, frame_idx, cs, cd, ch, sub, arg_min(station, point_idx) AS s, arg_min("offset", point_idx) AS d FROM p GROUP BY ALL)
    SELECT recording, frame_idx, cs, cd, ch, count(*) AS n, round(sum(s), 4) AS sum_s, round(sum(d), 4) AS sum_d, bit_or(1::BIGINT << CAST(sub AS INT)) AS bits FROM f GROUP BY ALL""",
)
def _grid(spark, sf):
    return A.sub_cell_grid(local(spark, sf)).select(*P.K, "cs", "cd", "ch", "n", F.round("sum_s", 4).alias("sum_s"), F.round("sum_d", 4).alias("sum_d"), "bits")


@query(
    "tall_columns",
    f"""{CLOUD_CTE}, w AS (SELECT *, max(height) OVER a - min(height) OVER a AS t0, max(height) OVER b - min(height) OVER b AS t1 FROM local
    WINDOW a AS (PARTITION BY recording, frame_idx, floor(station), floor("offset" / 0.5)), b AS (PARTITION BY recording, frame_idx, floor(station + 0.5), floor("offset" / 0.5 + 0.5)))
    SELECT {POINT} FROM w WHERE t0 >= 0.4 OR t1 >= 0.4""",
)
def _columns(spark, sf):
    return A.tall_columns(local(spark, sf)).select(*P.K, "point_idx")


@query("distinct_keys", f"{CLOUD_CTE} SELECT recording, frame_idx, ring, min(point_idx) AS first_idx, count(*) AS n FROM cloud GROUP BY ALL")
def _keys(spark, sf):
    return A.distinct_keys(fixtures.cloud(spark, sf), [F.col("ring")])


@query(
    "closest_faces",
    f"""{CLOUD_CTE} SELECT recording, frame_idx, CAST(floor(station / 0.5) AS BIGINT) AS cell, CAST(sign("offset") AS INT) AS side, arg_min(point_idx, {{'d': abs("offset"), 'i': point_idx}}) AS point_idx, min(abs("offset")) AS distance FROM local WHERE "offset" <> 0 GROUP BY ALL""",
)
def _faces(spark, sf):
    return A.closest_faces(local(spark, sf))


_MEMBERS = "m AS (SELECT *, CAST(floor(station / 4) AS BIGINT) AS group_id, height + 0.5 AS excess FROM local WHERE height > -0.5)"


def _members(spark, sf):
    return local(spark, sf).where("height > -0.5").withColumns({"group_id": F.floor(F.col("station") / 4).cast("long"), "excess": F.col("height") + 0.5})


@query(
    "group_features",
    f"""{CLOUD_CTE}, {_MEMBERS} SELECT recording, frame_idx, group_id, count(*) AS returns, count(DISTINCT (x, y, z)) AS unique_returns, count(DISTINCT ring) AS rings, count(DISTINCT round_even(height / 0.05, 0)) AS levels,
    round(median(station), 6) AS station_m, round(median("offset"), 6) AS offset_m, round(min(range_m), 6) AS range_m, max(height) AS top_m, round(max(station) - min(station), 6) AS length_m, round(max("offset") - min("offset"), 6) AS width_m,
    arg_max(point_idx, {{'e': excess, 'i': -point_idx}}) AS crown_idx FROM m GROUP BY recording, frame_idx, group_id""",
)
def _features(spark, sf):
    f = A.group_features(_members(spark, sf))
    return f.select(*P.K, "group_id", "returns", "unique_returns", "rings", "levels", *six("station_m", "offset_m", "range_m"), "top_m", *six("length_m", "width_m"), "crown_idx")


@query(
    "group_observations",
    f"""{CLOUD_CTE}, {_MEMBERS} SELECT recording, frame_idx, group_id, round(avg(x), 9) AS mean_x, round(avg(y), 9) AS mean_y, round(avg(z), 9) AS mean_z, min(station) AS low_station, max(station) AS high_station, min("offset") AS low_offset, max("offset") AS high_offset, min(height) AS low_height, max(height) AS high_height, count(DISTINCT (x, y, z)) AS unique_returns
    FROM m GROUP BY recording, frame_idx, group_id HAVING count(DISTINCT (x, y, z)) >= 3""",
)
def _observed(spark, sf):
    o = A.observations(_members(spark, sf))
    return o.select(*[F.round(c, 9).alias(c) if c.startswith("mean") else F.col(c) for c in o.columns])


@query("near_voxels", f"{CLOUD_CTE} SELECT DISTINCT recording, frame_idx, CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(floor(z / 0.1) AS BIGINT) AS vz FROM cloud WHERE -y BETWEEN 3 AND 40 AND abs(x) <= 6 AND z > -4 AND z < 5")
def _near_voxels(spark, sf):
    return A.near_voxels(fixtures.cloud(spark, sf))


@query(
    "motion_score",
    f"""{CLOUD_CTE}, occ AS (SELECT DISTINCT recording, frame_idx, floor(x / 0.1) AS vx, floor(y / 0.1) AS vy, floor(z / 0.1) AS vz FROM cloud WHERE -y BETWEEN 3 AND 40 AND abs(x) <= 6 AND z > -4 AND z < 5),
    cand AS (SELECT unnest(range(-6, 91)) * 0.05::DOUBLE AS travel),
    mv AS (SELECT recording, frame_idx + 1 AS frame_idx, travel, floor(x / 0.1) AS vx, floor((y + travel) / 0.1) AS vy, floor(z / 0.1) AS vz FROM cloud, cand)
    SELECT recording, frame_idx, round(travel, 6) AS travel, count(*) AS points, count(o.hit) AS hits FROM mv LEFT JOIN (SELECT *, 1 AS hit FROM occ) o USING (recording, frame_idx, vx, vy, vz) GROUP BY recording, frame_idx, travel""",
)
def _motion(spark, sf):
    p = fixtures.cloud(spark, sf)
    cand = spark.range(-6, 91).select((F.col("id") * F.lit(0.05)).alias("travel"), F.lit(0.0).alias("tx"), (F.col("id") * F.lit(0.05)).alias("ty"), F.lit(0.0).alias("tz"))
    return A.motion_score(p, A.near_voxels(p), cand).select(*P.K, *six("travel"), "points", "hits")


@query("status_summary", f"{CLOUD_CTE}, f AS (SELECT recording, frame_idx, CASE WHEN max(height) > 1.9 THEN 'BLOCKED' WHEN count(*) % 2 = 0 THEN 'CAUTION' ELSE 'CLEAR' END AS status FROM local GROUP BY ALL) SELECT recording, status, count(*) AS frames, min(frame_idx) AS first_frame FROM f GROUP BY ALL")
def _summary(spark, sf):
    f = local(spark, sf).groupBy(*P.K).agg(F.when(F.max("height") > 1.9, "BLOCKED").when(F.count(F.lit(1)) % 2 == 0, "CAUTION").otherwise("CLEAR").alias("status"))
    return A.status_summary(f)


@query(
    "centre_curvature",
    f"""{CLOUD_CTE}, c AS (SELECT recording, frame_idx, floor(station) AS s, avg("offset") AS c FROM local GROUP BY ALL), d AS (SELECT *, s - avg(s) OVER (PARTITION BY recording, frame_idx) AS u FROM c),
    m AS (SELECT recording, frame_idx, count(*)::DOUBLE AS n, max(s) - min(s) AS span, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(c) AS t0, sum(c*u) AS t1, sum(c*u*u) AS t2 FROM d GROUP BY ALL)
    SELECT recording, frame_idx, round(CASE WHEN n >= 4 AND span >= 10 THEN 2*(t2*(s2*n-s1*s1) - s3*(t1*n-s1*t0) + s2*(t1*s1-s2*t0)) / (s4*(s2*n-s1*s1) - s3*(s3*n-s1*s2) + s2*(s3*s1-s2*s2)) ELSE 0 END, 7) AS curvature FROM m""",
)
def _curvature(spark, sf):
    c = local(spark, sf).groupBy(*P.K, F.floor("station").cast("double").alias("station")).agg(F.avg("offset").alias("centre"))
    return A.quadratic_curvature(c).select(*P.K, F.round("curvature", 7).alias("curvature"))


# ---- joins ----------------------------------------------------------------------


@query(
    "band_edges",
    f"""{CLOUD_CTE}, p AS (SELECT *, CAST(floor(station / 1.2) AS BIGINT) AS own FROM local), x AS (SELECT *, unnest([own, own + 1]) AS cell FROM p)
    SELECT a.recording, a.frame_idx, least(a.point_idx, b.point_idx) AS a, greatest(a.point_idx, b.point_idx) AS b FROM x a JOIN p b ON a.recording = b.recording AND a.frame_idx = b.frame_idx AND a.cell = b.own
    WHERE (a.own < b.own OR a.point_idx < b.point_idx) AND abs(a.station - b.station) <= 1.2
    AND abs(a."offset" - b."offset") <= greatest(0.25, 0.006 * a.range_m, 0.006 * b.range_m) AND abs(a.height - b.height) <= greatest(0.20, 0.006 * a.range_m, 0.006 * b.range_m)""",
)
def _band(spark, sf):
    return J.band_edges(local(spark, sf))


@query(
    "grid_edges",
    f"""{CLOUD_CTE}, p AS (SELECT *, CAST(floor(station / 3) AS BIGINT) AS cs, CAST(floor("offset" / 3) AS BIGINT) AS cd FROM local), n AS (SELECT *, cs + i AS ns, cd + j AS nd FROM p, (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j))
    SELECT a.recording, a.frame_idx, a.point_idx AS a, b.point_idx AS b FROM n a JOIN p b ON a.recording = b.recording AND a.frame_idx = b.frame_idx AND a.ns = b.cs AND a.nd = b.cd AND a.point_idx < b.point_idx
    AND (a.station - b.station)*(a.station - b.station) + (a."offset" - b."offset")*(a."offset" - b."offset") <= 9 AND (a."offset" * b."offset" > 0 OR (abs(a."offset") < 0.6 AND abs(b."offset") < 0.6 AND abs(a."offset" - b."offset") < 0.5))""",
)
def _grid_edges(spark, sf):
    return J.grid_edges(local(spark, sf))


_SEEN = "EXISTS (SELECT 1 FROM local o WHERE o.recording = g.recording AND o.frame_idx = g.frame_idx - 1 AND o.station - g.station BETWEEN 0 AND 5 AND abs(o.\"offset\" - g.\"offset\") <= 0.5 + 0.01 * g.range_m AND abs(o.height - g.height) <= 0.4)"


@query("seen_before", f"{CLOUD_CTE} SELECT {POINT} FROM local g WHERE {_SEEN}")
def _seen(spark, sf):
    p = local(spark, sf)
    return J.seen_before(p, p).select(*P.K, "point_idx")


@query("not_seen_before", f"{CLOUD_CTE} SELECT {POINT} FROM local g WHERE NOT {_SEEN}")
def _unseen(spark, sf):
    p = local(spark, sf)
    return J.seen_before(p, p, kind="left_anti").select(*P.K, "point_idx")


_PEAKS = "peaks AS (SELECT recording, frame_idx, CAST(floor(station / 3) AS BIGINT) AS station, CAST(floor(\"offset\" / 0.2) AS BIGINT) AS peak, avg(\"offset\") AS centre FROM local WHERE height > 1 GROUP BY ALL)"


@query(
    "gauge_pairs",
    f"{CLOUD_CTE}, {_PEAKS} SELECT a.recording, a.frame_idx, a.station, a.peak AS left_peak, b.peak AS right_peak, round(b.centre - a.centre, 6) AS gauge, round((a.centre + b.centre) / 2, 6) AS centre FROM peaks a JOIN peaks b ON a.recording = b.recording AND a.frame_idx = b.frame_idx AND a.station = b.station AND b.centre - a.centre BETWEEN 1.2 AND 1.85",
)
def _gauge(spark, sf):
    p = local(spark, sf).where("height > 1")
    peaks = p.groupBy(*P.K, F.floor(F.col("station") / 3).cast("long").alias("station"), F.floor(F.col("offset") / 0.2).cast("long").alias("peak")).agg(F.avg("offset").alias("centre"))
    return J.gauge_pairs(peaks, [*P.K, "station"]).select(*P.K, "station", "left_peak", "right_peak", *six("gauge", "centre"))


@query(
    "ring_pairs",
    f"""{CLOUD_CTE}, p AS (SELECT *, CAST(floor("offset" / 1.62) AS BIGINT) AS own FROM local), x AS (SELECT *, unnest([own, own + 1]) AS cell FROM p)
    SELECT a.recording, a.frame_idx, a.ring, a.point_idx AS a, b.point_idx AS b, round((a."offset" + b."offset") / 2, 6) AS centre, round((a.station + b.station) / 2, 6) AS station
    FROM x a JOIN p b ON a.recording = b.recording AND a.frame_idx = b.frame_idx AND a.ring = b.ring AND a.cell = b.own WHERE abs(b."offset" - a."offset" - 1.52) < 0.1 AND abs(b.height - a.height) < 0.25""",
)
def _ring_pairs(spark, sf):
    return J.ring_pairs(local(spark, sf)).select(*P.K, "ring", "a", "b", *six("centre", "station"))


@query(
    "attach_to_tracks",
    f"""{CLOUD_CTE}, p AS (SELECT *, CAST(floor(station / 4) AS BIGINT) AS cs, CAST(floor("offset" / 0.25) AS BIGINT) AS cd FROM local), o AS (SELECT recording, frame_idx, cs, cd, CAST(ring % 3 AS INT) AS owner, max("offset") AS place FROM p GROUP BY ALL)
    SELECT p.recording, p.frame_idx, point_idx, arg_min(owner, {{'d': abs("offset" - place), 'o': owner}}) AS owner FROM p JOIN o USING (recording, frame_idx, cs, cd) GROUP BY p.recording, p.frame_idx, point_idx""",
)
def _attach(spark, sf):
    p = local(spark, sf)
    cells = p.withColumns({"cs": F.floor(F.col("station") / 4).cast("long"), "cd": F.floor(F.col("offset") / 0.25).cast("long")})
    owners = cells.groupBy(*P.K, "cs", "cd", (F.col("ring") % 3).alias("owner")).agg(F.max("offset").alias("at"))
    return J.attach_to_tracks(p, owners)


@query(
    "match_candidates",
    f"""{CLOUD_CTE}, {_MEMBERS}, o AS (SELECT recording, frame_idx, group_id, median(station) AS station, median("offset") AS "offset", min(range_m) AS range_m FROM m GROUP BY ALL)
    SELECT a.recording, b.frame_idx, a.group_id AS track_id, b.group_id, round(abs(a.station - b.station) / (1 + 0.03 * a.range_m) + abs(a."offset" - b."offset") / (0.7 + 0.01 * a.range_m), 6) AS cost FROM o a JOIN o b ON a.recording = b.recording AND b.frame_idx = a.frame_idx + 1
    AND abs(a.station - b.station) <= 1 + 0.03 * a.range_m AND abs(a."offset" - b."offset") <= 0.7 + 0.01 * a.range_m""",
)
def _match(spark, sf):
    o = A.group_features(_members(spark, sf)).select(*P.K, "group_id", F.col("station_m").alias("station"), F.col("offset_m").alias("offset"), "range_m")
    tracks = o.select("recording", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("group_id").alias("track_id"), F.col("station").alias("track_station"), F.col("offset").alias("track_offset"), F.col("range_m").alias("track_range"))
    return J.match_candidates(tracks, o.drop("range_m")).select(*P.K, "track_id", "group_id", *six("cost"))


@query(
    "interpolate_at",
    f"""{CLOUD_CTE}, line AS (SELECT recording, frame_idx, floor(station / 5) * 5 AS station, avg("offset") AS value FROM local GROUP BY ALL), probes AS (SELECT DISTINCT recording, frame_idx, unnest(range(0, 160)) * 0.5::DOUBLE AS station FROM local)
    SELECT a.recording, a.frame_idx, a.station, round(CASE WHEN lo.station = hi.station THEN lo.value ELSE lo.value + (hi.value - lo.value) * (a.station - lo.station) / (hi.station - lo.station) END, 6) AS value
    FROM probes a ASOF LEFT JOIN line lo ON a.recording = lo.recording AND a.frame_idx = lo.frame_idx AND a.station >= lo.station ASOF LEFT JOIN line hi ON a.recording = hi.recording AND a.frame_idx = hi.frame_idx AND a.station <= hi.station""",
)
def _interpolate(spark, sf):
    p = local(spark, sf)
    line = p.groupBy(*P.K, (F.floor(F.col("station") / 5) * 5).cast("double").alias("station")).agg(F.avg("offset").alias("value"))
    at = p.select(*P.K).distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(159)))).withColumn("station", F.col("n") * F.lit(0.5))
    return J.interpolate_at(line, at, P.K).select(*P.K, "station", *six("value"))


# ---- windows --------------------------------------------------------------------

SEQ_CTE = f"WITH seq AS ({fixtures.sequence_sql()})"


@query("number_frames", f"{SEQ_CTE} SELECT recording, event_id, CAST(row_number() OVER (PARTITION BY recording ORDER BY timestamp_ns, event_id) - 1 AS INT) AS frame_idx FROM seq")
def _number(spark, sf):
    return Wn.number_frames(fixtures.sequence(spark, sf), ["timestamp_ns", "event_id"]).select("recording", "event_id", "frame_idx")


@query(
    "sequence_guard",
    f"""{SEQ_CTE}, g AS (SELECT recording, event_id, CASE WHEN lag(event_id) OVER w IS NULL THEN NULL WHEN lag(frame_id) OVER w IS DISTINCT FROM frame_id THEN 'frame_id_changed' WHEN timestamp_ns < lag(timestamp_ns) OVER w THEN 'timestamp_moved_backwards' WHEN timestamp_ns - lag(timestamp_ns) OVER w > 86400000000000 THEN 'timestamp_gap' END AS reset_reason FROM seq WINDOW w AS (PARTITION BY recording ORDER BY event_id))
    SELECT *, CAST(sum(CASE WHEN reset_reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY event_id) AS BIGINT) AS session FROM g""",
)
def _guard(spark, sf):
    return Wn.sequence_guard(fixtures.sequence(spark, sf), 86400.0, order=["event_id"]).select("recording", "event_id", "reset_reason", "session")


_LINE = "l AS (SELECT recording, frame_idx, CAST(floor(station / 0.5) AS BIGINT) AS bin, median(height) AS v FROM local GROUP BY ALL)"


def _line(spark, sf):
    return local(spark, sf).groupBy(*P.K, F.floor(F.col("station") / 0.5).cast("long").alias("bin")).agg(F.median("height").alias("v"))


@query(
    "running_median",
    f"""{CLOUD_CTE}, {_LINE}, e AS (SELECT recording, frame_idx, min(bin) AS lo, max(bin) AS hi, arg_min(v, bin) AS a, arg_max(v, bin) AS z FROM l GROUP BY ALL),
    u AS (SELECT recording, frame_idx, bin, 0 AS pad, v FROM l UNION ALL SELECT recording, frame_idx, lo, unnest(range(-10, 0)), a FROM e UNION ALL SELECT recording, frame_idx, hi, unnest(range(1, 11)), z FROM e),
    w AS (SELECT *, median(v) OVER (PARTITION BY recording, frame_idx ORDER BY bin, pad ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS smooth FROM u)
    SELECT recording, frame_idx, bin, round(v, 6) AS v, round(smooth, 6) AS smooth FROM w WHERE pad = 0""",
)
def _median(spark, sf):
    return Wn.running_median(_line(spark, sf), P.K, "bin", "v", 10).select(*P.K, "bin", *six("v", "smooth"))


@query("running_ceiling", f"{CLOUD_CTE}, {_LINE} SELECT recording, frame_idx, bin, round(v, 6) AS v, round(max(v) OVER (PARTITION BY recording, frame_idx ORDER BY bin ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS ceiling FROM l")
def _ceiling(spark, sf):
    return Wn.running_extreme(_line(spark, sf), P.K, "bin", "v", 7).select(*P.K, "bin", *six("v", "ceiling"))


@query(
    "fill_gaps",
    f"""{CLOUD_CTE}, {_LINE}, h AS (SELECT *, CASE WHEN bin % 3 = 0 THEN v END AS g FROM l),
    k AS (SELECT *, last_value(CASE WHEN g IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS x0, last_value(g IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN g IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS x1, first_value(g IGNORE NULLS) OVER b AS v1 FROM h
    WINDOW a AS (PARTITION BY recording, frame_idx ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY recording, frame_idx ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT recording, frame_idx, bin, round(coalesce(g, CASE WHEN x1 > x0 THEN v0 + (v1 - v0) * (bin - x0) / (x1 - x0) END, v0, v1, 0), 6) AS filled FROM k""",
)
def _fill(spark, sf):
    holed = _line(spark, sf).withColumn("g", F.when(F.col("bin") % 3 == 0, F.col("v")))
    return Wn.fill_gaps(holed, P.K, "bin", "g").select(*P.K, "bin", *six("filled"))


@query("hits_in_last", f"{SEQ_CTE} SELECT recording, event_id, sum((value > 50)::INT) OVER (PARTITION BY recording ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS seen FROM seq")
def _hits(spark, sf):
    return Wn.hits_in_last(fixtures.sequence(spark, sf), ["recording"], ["event_id"], F.col("value") > 50, 3, 2, "seen").select("recording", "event_id", "seen")


@query(
    "steady_of_last",
    f"""{SEQ_CTE}, w AS (SELECT *, count(value) OVER o AS n, median(value) OVER o AS m, min(value) OVER o AS lo, max(value) OVER o AS hi FROM seq WINDOW o AS (PARTITION BY recording ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT recording, event_id, CASE WHEN n = 3 AND greatest(hi - m, m - lo) <= 20 THEN round(m, 6) END AS agreed FROM w""",
)
def _steady_last(spark, sf):
    return Wn.steady_of_last(fixtures.sequence(spark, sf), ["recording"], ["event_id"], "value", 3, 20.0).select("recording", "event_id", *six("agreed"))


@query(
    "turn_votes",
    f"""{SEQ_CTE}, w AS (SELECT *, sum((value - 50 > 5)::INT) OVER o AS l, sum((value - 50 < -5)::INT) OVER o AS r FROM seq WINDOW o AS (PARTITION BY recording ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT recording, event_id, CAST(CASE WHEN l + r >= 3 AND l >= 0.7 * (l + r) THEN 1 WHEN l + r >= 3 AND r >= 0.7 * (l + r) THEN -1 END AS INT) AS direction FROM w""",
)
def _votes(spark, sf):
    s = fixtures.sequence(spark, sf).withColumn("k", F.col("value") - 50)
    return Wn.turn_votes(s, ["recording"], ["event_id"], "k", deadband=5.0).select("recording", "event_id", "direction")


@query(
    "sustained_conflicts",
    f"""{CLOUD_CTE}, {_LINE}, w AS (SELECT *, count(v) OVER o AS n, max(bin) OVER o - min(bin) OVER o AS span, median(v) OVER o AS m, sum((v > 0)::INT) OVER o AS p, sum((v < 0)::INT) OVER o AS q FROM l WINDOW o AS (PARTITION BY recording, frame_idx ORDER BY bin ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT recording, frame_idx, bin, n = 4 AND span >= 3 AND abs(m) > 0.5 AND greatest(p, q) >= 3 AS conflict FROM w""",
)
def _conflicts(spark, sf):
    return Wn.sustained_conflicts(_line(spark, sf), P.K, "bin", "v", span=3.0).select(*P.K, "bin", "conflict")


@query(
    "chain_until_gap",
    f"""{CLOUD_CTE}, c AS (SELECT DISTINCT recording, frame_idx, station FROM local), g AS (SELECT *, coalesce(station - lag(station) OVER (PARTITION BY recording, frame_idx ORDER BY station), 0) > 1.0 AS gap FROM c), b AS (SELECT *, max(gap::INT) OVER (PARTITION BY recording, frame_idx ORDER BY station) AS broken FROM g)
    SELECT recording, frame_idx, station FROM b WHERE broken = 0""",
)
def _chain(spark, sf):
    return Wn.chain_until_gap(local(spark, sf).select(*P.K, "station").distinct(), P.K, "station", 1.0)


@query(
    "arc_length",
    f"""{CLOUD_CTE}, l AS (SELECT recording, frame_idx, CAST(floor(station / 5) AS BIGINT) AS bin, CAST(floor(station / 5) * 5 AS DOUBLE) AS s, avg("offset") AS d FROM local GROUP BY ALL), c AS (SELECT *, coalesce(sqrt((s - lag(s) OVER w)*(s - lag(s) OVER w) + (d - lag(d) OVER w)*(d - lag(d) OVER w)), 0) AS chord FROM l WINDOW w AS (PARTITION BY recording, frame_idx ORDER BY bin))
    SELECT recording, frame_idx, bin, round(sum(chord) OVER (PARTITION BY recording, frame_idx ORDER BY bin), 6) AS length FROM c""",
)
def _length(spark, sf):
    bin_ = F.floor(F.col("station") / 5).cast("long")
    line = local(spark, sf).groupBy(*P.K, bin_.alias("bin")).agg(F.avg("offset").alias("d")).withColumn("s", (F.col("bin") * 5).cast("double"))
    return Wn.arc_length(line, P.K, "bin", "s", "d").select(*P.K, "bin", *six("length"))


@query(
    "wall_turn_direction",
    f"""{CLOUD_CTE}, e AS (SELECT *, "offset" * 3 AS edge, station / max(station) OVER (PARTITION BY recording, frame_idx) AS r FROM local), m AS (SELECT recording, frame_idx, median(edge) FILTER (WHERE r >= 0.8) - median(edge) FILTER (WHERE r BETWEEN 0.4 AND 0.65) AS d FROM e GROUP BY ALL)
    SELECT recording, frame_idx, CAST(CASE WHEN d > 1.2 THEN 1 WHEN d < -1.2 THEN -1 ELSE 0 END AS INT) AS direction FROM m""",
)
def _wall_turn(spark, sf):
    return Wn.turn_direction(local(spark, sf).withColumn("edge", F.col("offset") * 3), P.K)


# ---- order and sets -----------------------------------------------------------

_OBST = """o AS (SELECT recording, frame_idx, CAST(floor(station / 2) AS BIGINT) AS group_id, median(station) AS station_m, min(range_m) AS range_m, CASE count(*) % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'transient' WHEN 2 THEN 'unplaced' WHEN 3 THEN 'track_furniture' ELSE 'structure' END AS kind, CAST(count(*) % 11 AS DOUBLE) / 10 AS confidence FROM local GROUP BY recording, frame_idx, CAST(floor(station / 2) AS BIGINT))"""


def _obstacles(spark, sf):
    n = F.count(F.lit(1))
    kind = F.when(n % 5 == 0, "object").when(n % 5 == 1, "transient").when(n % 5 == 2, "unplaced").when(n % 5 == 3, "track_furniture").otherwise("structure")
    g = local(spark, sf).groupBy(*P.K, F.floor(F.col("station") / 2).cast("long").alias("group_id"))
    return g.agg(F.median("station").alias("station_m"), F.min("range_m").alias("range_m"), kind.alias("kind"), ((n % 11).cast("double") / 10).alias("confidence"))


@query(
    "label_obstacles",
    f"""{CLOUD_CTE}, {_OBST} SELECT recording, frame_idx, group_id, kind, CAST(row_number() OVER (PARTITION BY recording, frame_idx ORDER BY list_position(['object', 'transient', 'unplaced', 'track_furniture', 'structure'], kind), confidence DESC, station_m, group_id) - 1 AS INT) AS label FROM o""",
)
def _labels(spark, sf):
    return R.label_obstacles(_obstacles(spark, sf)).select(*P.K, "group_id", "kind", "label")


@query("nearest_of_frame", f"{CLOUD_CTE}, {_OBST} SELECT recording, frame_idx, round(min(range_m), 6) AS distance_m, arg_min(confidence, {{'r': range_m, 'g': group_id}}) AS confidence FROM o GROUP BY recording, frame_idx")
def _nearest(spark, sf):
    return R.nearest_of_frame(_obstacles(spark, sf)).select(*P.K, *six("distance_m"), "confidence")


@query(
    "best_of_window",
    f"""{CLOUD_CTE}, r AS (SELECT *, CAST(floor(station / 20) AS BIGINT) AS win, height AS q FROM local), w AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording, frame_idx, win ORDER BY -q - 0.005 * least(ring, 40), point_idx) AS INT) AS rank, count(*) OVER (PARTITION BY recording, frame_idx, win) AS n FROM r)
    SELECT recording, frame_idx, win, point_idx, rank, greatest(n - 32, 0) AS overflow FROM w WHERE rank <= 32""",
)
def _best(spark, sf):
    c = local(spark, sf).withColumn("win", F.floor(F.col("station") / 20).cast("long"))
    return R.best_of_window(c, [*P.K, "win"], "height", "ring", "point_idx").select(*P.K, "win", "point_idx", "rank", "overflow")


@query("distinct_returns", f"{CLOUD_CTE} SELECT recording, frame_idx, count(DISTINCT (x, y, z)) AS unique_returns FROM cloud GROUP BY ALL")
def _returns(spark, sf):
    return R.distinct_returns(fixtures.cloud(spark, sf))


@query("first_of_rounded", f"{CLOUD_CTE} SELECT recording, frame_idx, round_even(x / 8, 1) AS r_a, round_even(z / 8, 1) AS r_b, min(point_idx) AS point_idx, count(*) AS n FROM cloud GROUP BY ALL")
def _rounded(spark, sf):
    p = fixtures.cloud(spark, sf).withColumns({"a": F.col("x") / 8, "b": F.col("z") / 8})
    return R.first_of_rounded(p, ["a", "b"], "point_idx", 1)


_RES = """r AS (SELECT recording, frame_idx, list_sort(list(DISTINCT ring % 10) FILTER (WHERE height > 1.95 AND station < 40)) AS ids, CASE WHEN count(*) FILTER (WHERE height > 1.95 AND station < 40) > 0 THEN 'BLOCKED' WHEN frame_idx % 3 = 0 THEN 'CAUTION' ELSE 'CLEAR' END AS status FROM local GROUP BY recording, frame_idx)"""


@query(
    "result_events",
    f"""{CLOUD_CTE}, {_RES}, e AS (SELECT *, coalesce(ids, []) AS now, coalesce(lag(ids) OVER w, []) AS was, lag(status) OVER w AS before FROM r WINDOW w AS (PARTITION BY recording ORDER BY frame_idx))
    SELECT recording, frame_idx, status, CASE WHEN len(list_filter(now, lambda v: NOT list_contains(was, v))) > 0 THEN 'confirmed' WHEN len(list_filter(was, lambda v: NOT list_contains(now, v))) > 0 THEN 'released' WHEN status = 'CAUTION' AND before IS DISTINCT FROM 'CAUTION' THEN 'warning' END AS event FROM e""",
)
def _events(spark, sf):
    hit = (F.col("height") > 1.95) & (F.col("station") < 40)
    r = local(spark, sf).groupBy(*P.K).agg(F.collect_set(F.when(hit, (F.col("ring") % 10).cast("long"))).alias("blocking_ids"), F.count_if(hit).alias("n"))
    r = r.withColumn("status", F.when(F.col("n") > 0, "BLOCKED").when(F.col("frame_idx") % 3 == 0, "CAUTION").otherwise("CLEAR"))
    return R.events_of(r).select(*P.K, "status", "event")


@query(
    "maximal_sets",
    f"""{CLOUD_CTE}, s AS (SELECT recording, frame_idx, CAST(floor(station) AS BIGINT) AS set_id, list(DISTINCT ring) AS members FROM local GROUP BY ALL)
    SELECT recording, frame_idx, set_id, CAST(len(members) AS INT) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.recording = s.recording AND t.frame_idx = s.frame_idx AND len(t.members) > len(s.members) AND list_has_all(t.members, s.members))""",
)
def _maximal(spark, sf):
    s = local(spark, sf).groupBy(*P.K, F.floor("station").cast("long").alias("set_id")).agg(F.collect_set("ring").alias("members"))
    return R.maximal_sets(s).select(*P.K, "set_id", F.size("members").alias("n"))


@query(
    "frame_decision",
    f"""{CLOUD_CTE}, {_OBST}, f AS (SELECT DISTINCT recording, frame_idx, frame_idx % 2 = 0 AS route_supported, frame_idx % 3 <> 0 AS surface_supported FROM cloud), a AS (SELECT recording, frame_idx, min(range_m) AS range_m, arg_min(confidence, {{'r': range_m, 'g': group_id}}) AS confidence FROM o WHERE kind = 'object' AND confidence >= 0.5 AND group_id > 15 GROUP BY ALL),
    w AS (SELECT DISTINCT recording, frame_idx, true AS weak FROM o WHERE kind = 'object' AND confidence < 0.5 AND group_id > 15),
    d AS (SELECT f.*, a.range_m, a.confidence, concat_ws(';', CASE WHEN NOT route_supported THEN 'route_not_fully_supported' END, CASE WHEN NOT surface_supported THEN 'surface_not_supported' END, CASE WHEN weak THEN 'low_confidence_object' END) AS reasons FROM f LEFT JOIN a USING (recording, frame_idx) LEFT JOIN w USING (recording, frame_idx))
    SELECT recording, frame_idx, CASE WHEN range_m IS NOT NULL THEN 'BLOCKED' WHEN reasons <> '' THEN 'UNKNOWN' ELSE 'CLEAR' END AS status, CASE WHEN range_m IS NOT NULL THEN false WHEN reasons <> '' THEN NULL ELSE true END AS path_clear, round(range_m, 6) AS distance_m, confidence, reasons FROM d""",
)
def _decision(spark, sf):
    frames = fixtures.cloud(spark, sf).select(*P.K).distinct().withColumns({"route_supported": F.col("frame_idx") % 2 == 0, "surface_supported": F.col("frame_idx") % 3 != 0})
    d = R.frame_decision(_obstacles(spark, sf).where("group_id > 15"), frames)
    return d.select(*P.K, "status", "path_clear", *six("distance_m"), "confidence", "reasons")


# ---- groups -------------------------------------------------------------------


@query(
    "gauge_class",
    f"""{CLOUD_CTE}, {_MEMBERS}, d AS (SELECT DISTINCT recording, frame_idx, group_id, station, "offset", height, CASE WHEN height >= 0 THEN greatest(abs("offset") - 1.15, height - 2.4) END AS gap FROM m)
    SELECT recording, frame_idx, group_id, count(*) FILTER (WHERE gap < -0.10 - 1e-8) AS deep, CASE WHEN count(*) FILTER (WHERE gap < -0.10 - 1e-8) >= 3 THEN 'inside' WHEN min(gap) <= 0.30 + 1e-8 THEN 'borderline' ELSE 'outside' END AS relation FROM d GROUP BY recording, frame_idx, group_id""",
)
def _gauge_class(spark, sf):
    return G.gauge_class(_members(spark, sf))


_BLOCKS = "m AS (SELECT *, CAST(floor(station / 0.25) AS BIGINT) AS group_id FROM local)"


@query(
    "upright_faces",
    f"""{CLOUD_CTE}, {_BLOCKS}, s AS (SELECT recording, frame_idx, group_id, max("offset") - min("offset") AS w, max(station) - min(station) AS d, count(DISTINCT (station, "offset", height)) AS n FROM m GROUP BY ALL),
    k AS (SELECT recording, frame_idx, group_id, CAST(floor("offset" / 0.5) AS BIGINT) AS col, max(height) - min(height) AS tall FROM m GROUP BY ALL), g AS (SELECT * FROM k WHERE tall >= 0.4 AND abs((col + 0.5) * 0.5) <= 1.5),
    f AS (SELECT DISTINCT p.recording, p.frame_idx, p.group_id FROM g p JOIN g q ON p.recording = q.recording AND p.frame_idx = q.frame_idx AND p.group_id = q.group_id AND q.col = p.col + 1 JOIN g r ON p.recording = r.recording AND p.frame_idx = r.frame_idx AND p.group_id = r.group_id AND r.col = p.col + 2)
    SELECT s.recording, s.frame_idx, s.group_id FROM s JOIN f ON s.recording = f.recording AND s.frame_idx = f.frame_idx AND s.group_id = f.group_id WHERE w >= 0.6 AND d <= 0.25 * w + 0.05 AND n >= 6""",
)
def _upright(spark, sf):
    m = local(spark, sf).withColumn("group_id", F.floor(F.col("station") / 0.25).cast("long"))
    return G.upright_faces(m, column=0.5, reach=1.5, unique=6)


@query(
    "without_retired",
    f"""{CLOUD_CTE}, t AS (SELECT DISTINCT recording, ring AS id FROM cloud), l AS (SELECT DISTINCT recording, ring AS id FROM cloud WHERE z > 1.95) SELECT recording, id FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.recording = t.recording AND l.id = t.id)""",
)
def _retired(spark, sf):
    c = fixtures.cloud(spark, sf)
    return R.without_retired(c.select("recording", F.col("ring").alias("id")).distinct(), c.where("z > 1.95").select("recording", F.col("ring").alias("id")).distinct())


@query(
    "promotable",
    f"""{CLOUD_CTE}, {_MEMBERS}, r AS (SELECT recording, frame_idx, group_id, max(height) >= 1.9 AS clipped, count(*) % 2 = 0 AS flat FROM m GROUP BY ALL) SELECT recording, frame_idx, group_id, NOT clipped AS promotable FROM r""",
)
def _promotable(spark, sf):
    g = _members(spark, sf).groupBy(*P.K, "group_id").agg((F.max("height") >= 1.9).alias("clipped"), (F.count(F.lit(1)) % 2 == 0).alias("flat"))
    g = g.withColumn("reasons", F.array_compact(F.array(F.when(F.col("clipped"), "clipped"), F.when(F.col("flat"), "flat"))))
    return R.promotable(g, ["clipped", "edged"]).select(*P.K, "group_id", "promotable")


@query(
    "strict_json",
    f"""{CLOUD_CTE}, r AS (SELECT recording, frame_idx, count(*) AS n_points, CASE WHEN frame_idx % 4 <> 0 THEN max(z) END AS top, frame_idx % 2 = 0 AS path_clear FROM cloud GROUP BY recording, frame_idx)
    SELECT recording, frame_idx, '{{"recording":"' || recording || '","frame_idx":' || frame_idx || ',"n_points":' || n_points || ',"top":' || coalesce(CAST(top AS VARCHAR), 'null') || ',"path_clear":' || path_clear || '}}' AS value FROM r""",
)
def _json(spark, sf):
    from ..sources.recordings import result_json

    top = F.when(F.col("frame_idx") % 4 == 0, F.lit(float("nan"))).otherwise(F.max("z"))
    r = fixtures.cloud(spark, sf).groupBy(*P.K).agg(F.count(F.lit(1)).alias("n_points"), top.alias("top"), (F.col("frame_idx") % 2 == 0).alias("path_clear"))
    return result_json(r)


# ---- axes, bends, frames and topics -----------------------------------------

_AXES = S.frame_basis((0.1, -1.0, 0.05), (0.0, 0.05, 1.0))
_ORIGIN = (0.2, -0.1, 0.3)


def _dot_sql(axis) -> str:
    return " + ".join(f"({c} - CAST({o!r} AS DOUBLE)) * CAST({a!r} AS DOUBLE)" for c, o, a in zip("xyz", _ORIGIN, axis))


@query("project_axes", f"""{CLOUD_CTE} SELECT {POINT}, round({_dot_sql(_AXES[0])}, 6) AS forward, round({_dot_sql(_AXES[1])}, 6) AS lateral, round({_dot_sql(_AXES[2])}, 6) AS up FROM cloud""")
def _project_axes(spark, sf):
    f, lat, up = S.project(F.col("x"), F.col("y"), F.col("z"), _ORIGIN, _AXES)
    return fixtures.cloud(spark, sf).select(*P.K, "point_idx", F.round(f, 6).alias("forward"), F.round(lat, 6).alias("lateral"), F.round(up, 6).alias("up"))


@query(
    "bend_offset",
    f"""{CLOUD_CTE}, b AS (SELECT *, ring * CAST(0.5 AS DOUBLE) AS onset, greatest(station - ring * CAST(0.5 AS DOUBLE), 0) / greatest(80 - ring * CAST(0.5 AS DOUBLE), 1e-9) AS t FROM local)
    SELECT {POINT}, round("offset" * (CAST(0.7 AS DOUBLE) * t * t + CAST(0.3 AS DOUBLE) * t * t * t), 6) AS bend FROM b""",
)
def _bend_offset(spark, sf):
    return local(spark, sf).select(*P.K, "point_idx", F.round(S.bend(F.col("station"), F.col("offset"), F.col("ring") * 0.5, 80.0, 0.7), 6).alias("bend"))


@query("with_geometry", f"""{CLOUD_CTE}, g AS (SELECT recording, frame_idx, max(station) AS extent_m, avg("offset") AS centre_m FROM local WHERE ring < 64 GROUP BY ALL) SELECT {POINT}, round(station / extent_m, 6) AS share, round("offset" - centre_m, 6) AS aside FROM local JOIN g USING (recording, frame_idx)""")
def _with_geometry(spark, sf):
    p = local(spark, sf)
    g = p.where("ring < 64").groupBy(*P.K).agg(F.max("station").alias("extent_m"), F.avg("offset").alias("centre_m"))
    return J.with_geometry(p, g).select(*P.K, "point_idx", F.round(F.col("station") / F.col("extent_m"), 6).alias("share"), F.round(F.col("offset") - F.col("centre_m"), 6).alias("aside"))


@query("first_frames", f"""{CLOUD_CTE} SELECT recording, frame_idx, count(*) AS points FROM local WHERE frame_idx < 7 GROUP BY ALL""")
def _first_frames(spark, sf):
    return R.first_frames(local(spark, sf), 7).groupBy(*P.K).agg(F.count("*").alias("points"))


@query(
    "topic_messages",
    """SELECT 'bag' AS recording, event_id AS id, user_id % 25 AS topic_id, n_name AS topic FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE n_nationkey % 2 = 1 AND n_nationkey % 3 <> 0""",
)
def _topic_messages(spark, sf):
    fixtures.register(spark, sf, "events", "nation")
    messages = spark.sql("SELECT 'bag' AS recording, event_id AS id, user_id % 25 AS topic_id FROM events")
    topics = spark.sql(
        "SELECT 'bag' AS recording, CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 1 THEN 'sensor_msgs/msg/PointCloud2' ELSE 'other' END AS type, "
        "CASE WHEN n_nationkey % 3 <> 0 THEN 'cdr' ELSE 'json' END AS serialization_format FROM nation"
    )
    return J.topic_messages(messages, topics).select("recording", "id", "topic_id", "topic")


def queries() -> dict[str, Query]:
    from . import more

    return _queries | more.queries()


def oracle_sql() -> dict[str, str]:
    from . import more

    return _sql | more.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raised groups of every frame and the frame's decision."""
    return _decision(spark, sf_dir)
