"""Row-wise operators on points(recording, frame_idx, point_idx, x, y, z, ring)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

K = ["recording", "frame_idx"]


def finite_points(points: DataFrame) -> DataFrame:
    """Rows whose coordinates are all finite."""
    return points.where(S.finite(F.col("x"), F.col("y"), F.col("z")))


def finite_report(points: DataFrame) -> DataFrame:
    """Kept and removed rows of each frame."""
    good = S.finite(F.col("x"), F.col("y"), F.col("z"))
    return points.groupBy(*K).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("removed_points"))


def to_sensor(points: DataFrame, origin=(0.0, 0.0, 0.0), axes=S.SENSOR_AXES) -> DataFrame:
    """points with station, offset and height along the axes; only finite rows."""
    s, d, h = S.project(F.col("x"), F.col("y"), F.col("z"), origin, axes)
    return finite_points(points).withColumns({"station": s, "offset": d, "height": h})


def box(local: DataFrame, station=(None, None), offset=(None, None), height=(None, None)) -> DataFrame:
    """Rows inside the closed ranges; None leaves a side open. The conditions are
    plain comparisons, so they reach the scan where the columns are stored."""
    for name, (low, high) in (("station", station), ("offset", offset), ("height", height)):
        if low is not None:
            local = local.where(F.col(name) >= low)
        if high is not None:
            local = local.where(F.col(name) <= high)
    return local


def near_field(points: DataFrame) -> DataFrame:
    """The box in which rails are looked for first."""
    return box(to_sensor(points), (1, 20), (-4, 4), (-5, 2))


def far_field(points: DataFrame) -> DataFrame:
    """The box of rails further along."""
    return box(to_sensor(points), (13, 83), (-12, 12), (-0.8, 0.8))


def forward_points(points: DataFrame) -> DataFrame:
    """Finite points ahead that aren't the placeholder (0, 0, 0), with the frame's
    extent over all finite points."""
    local = to_sensor(points)
    extent = local.groupBy(*K).agg(F.max("station").alias("extent"))
    real = (F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)
    # one row a frame; Spark broadcasts it when its size allows
    return local.where(real & (F.col("station") >= 0)).join(extent, K)


def height_slice(points: DataFrame, centre: float, thickness: float = 0.8) -> DataFrame:
    """A bird's-eye slice: points ahead within thickness/2 of a height."""
    return box(to_sensor(points), (0, None), (None, None), (centre - thickness / 2, centre + thickness / 2))


def split_gauge(region: DataFrame) -> DataFrame:
    """in_gauge: at rail height or above."""
    return region.withColumn("in_gauge", F.col("height") >= -1e-8)


def usable(region: DataFrame, nearest: float = S.SELF_RETURN_M) -> DataFrame:
    """Rows that aren't returns of the vehicle itself."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return region.withColumn("range_m", r).where(F.col("range_m") >= nearest)


def raised(surface: DataFrame, rise: float = 0.10) -> DataFrame:
    """Rows of region ⋈ surface that stand out of their base."""
    return surface.withColumn("excess", F.col("height") - F.col("base")).where(F.col("excess") > rise)


def visible(points: DataFrame, width: int = 960, height: int = 540, focal: float = 700.0) -> DataFrame:
    """Nearest point of each pixel of a perspective view along -y."""
    p = usable(to_sensor(points)).where((F.col("station") > 0.1) & (F.col("station") < 160))
    u = F.floor(F.lit(width / 2) + focal * -F.col("offset") / F.col("station")).cast("int")
    v = F.floor(F.lit(height / 2) - focal * F.col("height") / F.col("station")).cast("int")
    p = p.withColumns({"u": u, "v": v}).where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))
    first = F.min(F.struct("station", "point_idx"))
    return p.groupBy(*K, "u", "v").agg(first.alias("m")).select(*K, "u", "v", F.col("m.station").alias("depth"), F.col("m.point_idx").alias("point_idx"))
