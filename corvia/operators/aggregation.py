"""Grouped operators: cells, voxels, exact quantiles, range bins, rasters.

All are plain groupBy/agg plans, so Spark aggregates partially before its one
shuffle; exact quantiles, which have no partial form, sort within their groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .projection import K


def cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(size))).cast("long")


def nearest_rank(df: DataFrame, keys: list[str], value: str, percent: float, minimum: int = 1, name: str = "value", tie: list[str] | None = None) -> DataFrame:
    """sorted[min(n - 1, int(n * percent / 100))] of each group with `minimum`
    values; null for smaller groups. Null values don't count."""
    order = W.partitionBy(*keys).orderBy(value, *(tie or []))
    whole = W.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, *(tie or []))
    ranked = ranked.withColumns({"_rn": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole)})
    wanted = F.least(F.col("_n"), F.floor(F.col("_n") * F.lit(percent / 100)) + 1)
    picked = ranked.where(F.col("_rn") == wanted)
    return picked.select(*keys, F.col("_n").alias("n"), F.when(F.col("_n") >= minimum, F.col(value)).alias(name))


def lateral_cells(region: DataFrame, half_width: float, size: float = 0.05, reach: float = 0.6) -> DataFrame:
    """region with its lateral cell, clipped to the span."""
    span = half_width + reach
    n = int(round(2 * span / size))
    c = F.floor((F.col("offset") + span) / size).cast("int")
    return region.withColumn("cell", F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)))


def station_bins(region: DataFrame, size: float = 0.5, most: int = 300) -> DataFrame:
    return region.withColumn("bin", F.least((F.col("station") / size).cast("int"), F.lit(most - 1)))


def track_shape(region: DataFrame, quantile: float = 95.0, least_bins: int = 4) -> DataFrame:
    """Shape across the track: largest height of each (cell, bin), then over bins
    the nearest-rank quantile of each cell."""
    tops = region.groupBy(*K, "cell", "bin").agg(F.max("height").alias("top"))
    return nearest_rank(tops, [*K, "cell"], "top", quantile, least_bins, "shape", ["bin"])


def steady_cells(region: DataFrame, least: float = 0.12, share: float = 0.40) -> DataFrame:
    """Cells whose tops hardly vary along the track: p90 - p10 is at most the
    larger of `least` and the frame's `share` quantile of that spread. A cell's tops,
    one of each bin along the track, are few and are sorted in an array. Null heights
    don't count; a cell with no other gives no row."""
    tops = region.groupBy(*K, "cell", "bin").agg(F.max("height").alias("top"))
    cells = tops.groupBy(*K, "cell").agg(F.sort_array(F.collect_list("top")).alias("sorted")).where(F.size("sorted") > 0)

    def rank(part):
        n = F.size("sorted")
        return F.element_at("sorted", F.least(n, F.floor(n * F.lit(part)).cast("int") + 1))

    spread = cells.select(*K, "cell", (rank(0.9) - rank(0.1)).alias("spread"))
    limit = spread.groupBy(*K).agg(F.percentile("spread", F.lit(share)).alias("typical"))
    out = spread.join(limit, K)
    return out.select(*K, "cell", "spread", (F.col("spread") <= F.greatest(F.col("typical"), F.lit(least))).alias("steady"))


def cell_medians(points: DataFrame, size: float) -> DataFrame:
    """Median of each coordinate in horizontal cells; of even counts the mean of
    the middle two."""
    return points.groupBy(*K, cell("x", size).alias("cx"), cell("y", size).alias("cy")).agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.median("z").alias("mz"))


def voxel_first(points: DataFrame, sizes: tuple[float, float, float]) -> DataFrame:
    """The first return (smallest point_idx) of each voxel."""
    keys = [cell(c, s).alias(f"v{c}") for c, s in zip("xyz", sizes)]
    first = F.min_by(F.struct("point_idx", "x", "y", "z"), F.col("point_idx"))
    return points.groupBy(*K, *keys).agg(first.alias("p")).select(*K, "vx", "vy", "vz", "p.*")


def lateral_profile(local: DataFrame, size: float = 0.035, least: int = 3) -> DataFrame:
    """Count, p80 and p25 (interpolated) of heights in lateral bins."""
    g = local.groupBy(*K, F.floor(F.col("offset") / size).cast("long").alias("bin"))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.percentile("height", F.array(F.lit(0.8), F.lit(0.25))).alias("q"))
    return out.where(F.col("n") >= least).select(*K, "bin", "n", F.col("q")[0].alias("p80"), F.col("q")[1].alias("p25"))


def distance_edges(extent: float) -> list[float]:
    """Range bins that widen with distance: 8, 12, 16 and 24 m; a short last bin
    joins its neighbour."""
    edges = [0.0]
    while edges[-1] < extent:
        s = edges[-1]
        edges.append(s + (8 if s < 40 else 12 if s < 80 else 16 if s < 140 else 24))
    if len(edges) > 2 and extent - edges[-2] < 0.5 * (edges[-1] - edges[-2]):
        edges.pop()
    edges[-1] = float(extent)
    return edges


def range_bin(station: Column, edges: list[float]) -> Column:
    """Number of the range bin of a station; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((station >= edges[k]) & (station < edges[k + 1]), F.lit(k)).otherwise(out)
    return out


def range_extremes(local: DataFrame, edges: list[float]) -> DataFrame:
    """Per range bin: extent across and up, the outermost point of each side, and
    the height layers that are present as bits."""
    layer = F.least(F.greatest(F.floor(F.col("height") / 0.8).cast("int"), F.lit(0)), F.lit(15))
    b = local.withColumn("bin", range_bin(F.col("station"), edges)).where("bin is not null").withColumn("bit", F.expr("shiftleft(1L, least(greatest(cast(floor(height / 0.8D) as int), 0), 15))"))
    return b.groupBy(*K, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("station").alias("s_min"),
        F.max("station").alias("s_max"),
        F.min("offset").alias("d_min"),
        F.max("offset").alias("d_max"),
        F.min("height").alias("h_min"),
        F.max("height").alias("h_max"),
        F.min_by("point_idx", F.struct("offset", "point_idx")).alias("left_idx"),
        F.max_by("point_idx", F.struct(F.col("offset"), -F.col("point_idx"))).alias("right_idx"),
        F.bit_or("bit").alias("layers"),
    )


def observed_bands(local: DataFrame, size: float = 4.0, least: int = 8, least_cells: int = 2, least_width: float = 2.5) -> DataFrame:
    """Bands along the track with enough returns, occupied quarters and width."""
    quarter = F.floor((F.col("station") % size) / (size / 4)).cast("int")
    b = local.where("station >= 0").withColumns({"band": F.floor(F.col("station") / size).cast("long"), "quarter": quarter})
    g = b.groupBy(*K, "band").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("quarter").alias("occupied"), F.min("offset").alias("low"), F.max("offset").alias("high"))
    return g.where((F.col("n") >= least) & (F.col("occupied") >= least_cells) & (F.col("high") - F.col("low") >= least_width))


def sub_cell_grid(local: DataFrame, sizes=(4.0, 0.25, 0.8), parts: int = 4) -> DataFrame:
    """3-D grid: of each sub-cell the first return only; per cell the sums of those
    and the sub-cells' bits."""
    s, d, h = sizes
    sub = (F.floor(F.col("station") / (s / parts)) % parts * parts + F.floor(F.col("offset") / (d / parts)) % parts).cast("int")
    p = local.where("station >= 0").withColumns(
        {"cs": F.floor(F.col("station") / s).cast("long"), "cd": F.floor(F.col("offset") / d).cast("long"), "ch": F.floor(F.col("height") / h).cast("long"), "sub": F.pmod(sub, F.lit(parts * parts))}
    )
    first = p.groupBy(*K, "cs", "cd", "ch", "sub").agg(F.min_by(F.struct("station", "offset"), F.col("point_idx")).alias("p"))
    return first.groupBy(*K, "cs", "cd", "ch").agg(F.count(F.lit(1)).alias("n"), F.sum("p.station").alias("sum_s"), F.sum("p.offset").alias("sum_d"), F.expr("bit_or(shiftleft(1L, sub))").alias("bits"))


def tall_columns(local: DataFrame, along: float = 1.0, across: float = 0.5, tall: float = 0.4) -> DataFrame:
    """Rows in a vertical column of at least `tall` in either of two staggered
    grids. Each grid is one window over its cell."""
    out = local
    for k, shift in enumerate((0.0, 0.5)):
        a = F.floor(F.col("station") / along + shift).cast("long")
        b = F.floor(F.col("offset") / across + shift).cast("long")
        out = out.withColumns({f"_a{k}": a, f"_b{k}": b})
    for k in (0, 1):
        w = W.partitionBy(*K, f"_a{k}", f"_b{k}")
        out = out.withColumn(f"_t{k}", F.max("height").over(w) - F.min("height").over(w))
    return out.where((F.col("_t0") >= tall) | (F.col("_t1") >= tall)).drop(*(f"_{c}{k}" for c in "abt" for k in (0, 1)))


def distinct_keys(points: DataFrame, columns: list[Column]) -> DataFrame:
    """Distinct integer keys with their first row and rows."""
    return points.groupBy(*K, *columns).agg(F.min("point_idx").alias("first_idx"), F.count(F.lit(1)).alias("n"))


def closest_faces(local: DataFrame, size: float = 0.5) -> DataFrame:
    """Closest return of each side in every station cell; the first of equals."""
    p = local.where("offset <> 0").withColumns({"cell": F.floor(F.col("station") / size).cast("long"), "side": F.signum("offset").cast("int")})
    near = F.min_by("point_idx", F.struct(F.abs("offset"), F.col("point_idx")))
    return p.groupBy(*K, "cell", "side").agg(near.alias("point_idx"), F.min(F.abs("offset")).alias("distance"))


def group_features(members: DataFrame, group: str = "group_id") -> DataFrame:
    """What describes a raised group: counts, extents, medians, distinct returns,
    rings and height levels, and where it stands out most. Distinct values are counted
    in sets beside the medians, which hold a group's values as well: several distinct
    counts in one aggregation would copy every row for each. Nulls don't count."""
    level = F.bround(F.col("height") / 0.05, 0).cast("long")
    # -0.0 is 0.0; a return without all coordinates is none
    place = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull(), F.struct(*((F.col(c) + F.lit(0.0)).alias(c) for c in "xyz")))

    def distinct(c):
        return F.size(F.collect_set(c)).cast("long")

    return members.groupBy(*K, group).agg(
        F.count(F.lit(1)).alias("returns"),
        distinct(place).alias("unique_returns"),
        distinct("ring").alias("rings"),
        distinct(level).alias("levels"),
        F.median("station").alias("station_m"),
        F.median("offset").alias("offset_m"),
        F.min("range_m").alias("range_m"),
        F.max("height").alias("top_m"),
        (F.max("station") - F.min("station")).alias("length_m"),
        (F.max("offset") - F.min("offset")).alias("width_m"),
        F.max_by("point_idx", F.struct(F.col("excess"), -F.col("point_idx"))).alias("crown_idx"),
    )


def observations(members: DataFrame, group: str = "group_id", least: int = 3) -> DataFrame:
    """Centroid and bounding box of each group with enough distinct returns."""
    g = members.groupBy(*K, group).agg(
        *(F.avg(c).alias(f"mean_{c}") for c in "xyz"),
        *(f(c).alias(f"{n}_{c}") for c in ("station", "offset", "height") for n, f in (("low", F.min), ("high", F.max))),
        F.count_distinct("x", "y", "z").alias("unique_returns"),
    )
    return g.where(F.col("unique_returns") >= least)


def near_voxels(points: DataFrame, size: float = 0.1) -> DataFrame:
    """Occupied voxels of the near field in which motion is measured."""
    near = points.where((-F.col("y")).between(3, 40) & (F.abs("x") <= 6) & (F.col("z") > -4) & (F.col("z") < 5))
    return near.select(*K, *(cell(c, size).alias(f"v{c}") for c in "xyz")).distinct()


def motion_score(sample: DataFrame, occupied: DataFrame, candidates: DataFrame, size: float = 0.1) -> DataFrame:
    """Share of each frame's sampled points that land in a voxel the next frame
    occupies, for every candidate (travel, tx, ty, tz).

    Occupied voxels are masks of 64 along y. A point is dealt to the blocks that any
    candidate moves it to, which are few, and tries the candidates on their masks
    after the join; so rows in a shuffle don't grow with the candidates. Those are
    one row with an array, as the steps of a search don't grow with data. Points with
    a null coordinate count and hit nothing.
    """
    keys, spot, block = ["recording", "frame_idx"], ["x", "y", "z"], ["vx", "block", "vz"]
    one = candidates.agg(F.sort_array(F.collect_list(F.struct("tx", "tz", "ty", "travel"))).alias("steps"))
    steps = F.broadcast(one.select(F.transform("steps", lambda c, k: F.struct(c.alias("to"), F.get("steps", k - 1).alias("last"))).alias("steps")))
    moved = sample.select("recording", (F.col("frame_idx") + 1).alias("frame_idx"), *spot)

    def landed(step: str):
        v = {c: F.floor((F.col(c) + F.col(f"{step}.t{c}")) / size).cast("long") for c in spot}
        return [v["x"], F.shiftright(v["y"], 6), v["z"]], v["y"].bitwiseAND(63).cast("int")

    masks = occupied.groupBy(*keys, "vx", F.shiftright("vy", 6).alias("block"), "vz").agg(F.bit_or(F.expr("shiftleft(1L, cast(vy & 63 as int))")).alias("mask"))
    spots = moved.groupBy(*keys, *spot).agg(F.count(F.lit(1)).alias("n"))
    to, bit = landed("step.to")
    # a block is listed where it differs from the last candidate's, then once
    new = ~F.struct(*to).eqNullSafe(F.struct(*landed("step.last")[0]))
    tried = spots.join(steps).select(*keys, *spot, "n", F.explode("steps").alias("step"))
    dealt = tried.where(new).select(*keys, *spot, "n", *(c.alias(n) for c, n in zip(to, block))).distinct()
    met = dealt.join(masks, [*keys, *block]).join(steps).select(*keys, *spot, *block, "n", "mask", F.explode("steps").alias("step"))
    for c, n in zip(to, block):
        met = met.where(c == F.col(n))
    hits = met.where(F.getbit("mask", bit) == 1).groupBy(*keys, F.col("step.to.travel").alias("travel")).agg(F.sum("n").alias("hits"))
    every = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(candidates.select("travel"))).groupBy(*keys, "travel").agg(F.sum("n").alias("points"))
    return every.join(hits, [*keys, "travel"], "left").select(*keys, "travel", "points", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def status_summary(results: DataFrame) -> DataFrame:
    """Frames of each status and the first of them, by recording."""
    return results.groupBy("recording", "status").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_idx").alias("first_frame"))


def quadratic_curvature(centres: DataFrame, least: int = 4, span: float = 10.0) -> DataFrame:
    """Twice the leading coefficient of a least-squares parabola through each
    frame's (station, centre) rows, by sums of powers; 0 for few or short rows."""
    s, y = F.col("station") - F.col("_m"), F.col("centre")
    mid = centres.groupBy(*K).agg(F.avg("station").alias("_m"))
    sums = centres.join(mid, K).groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("station") - F.min("station")).alias("span"),
        *(F.sum(F.pow(s, F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)),
        *(F.sum(y * F.pow(s, F.lit(float(k)))).alias(f"t{k}") for k in range(3)),
    )
    det = F.expr("s4*(s2*n-s1*s1) - s3*(s3*n-s1*s2) + s2*(s3*s1-s2*s2)")
    top = F.expr("t2*(s2*n-s1*s1) - s3*(t1*n-s1*t0) + s2*(t1*s1-s2*t0)")
    good = (F.col("n") >= least) & (F.col("span") >= span) & (F.abs(det) > 0)
    return sums.select(*K, F.when(good, 2 * top / det).otherwise(F.lit(0.0)).alias("curvature"))
