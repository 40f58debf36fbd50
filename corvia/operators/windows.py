"""Ordered operators: smoothing, gap filling, sequence guards, rolling counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_frames(messages: DataFrame, order: list[str]) -> DataFrame:
    """frame_idx by recording, from 0, in the order of the columns."""
    return messages.withColumn("frame_idx", F.row_number().over(W.partitionBy("recording").orderBy(*order)) - 1)


def running_median(df: DataFrame, keys: list[str], order: str, value: str, reach: int, name: str = "smooth") -> DataFrame:
    """Median of 2*reach+1 rows; the first and last row are repeated beyond the
    ends, so every window is full."""
    w = W.partitionBy(*keys).orderBy(order)
    whole = W.partitionBy(*keys)
    d = df.select(*keys, order, value).withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole)})
    pads = F.when(F.col("_rn") == 1, F.sequence(F.lit(-reach), F.lit(0))).otherwise(F.array(F.lit(0)))
    tail = F.when(F.col("_rn") == F.col("_n"), F.sequence(F.lit(0), F.lit(reach))).otherwise(F.array(F.lit(0)))
    d = d.withColumn("_pad", F.explode(F.array_distinct(F.concat(pads, tail))))
    ordered = W.partitionBy(*keys).orderBy(order, "_pad").rowsBetween(-reach, reach)
    d = d.withColumn(name, F.percentile(value, F.lit(0.5)).over(ordered))
    return d.where("_pad = 0").select(*keys, order, value, name)


def running_extreme(df: DataFrame, keys: list[str], order: str, value: str, reach: int, largest: bool = True, name: str = "ceiling") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn(name, (F.max if largest else F.min)(value).over(w))


def fill_gaps(df: DataFrame, keys: list[str], order: str, value: str, name: str = "filled") -> DataFrame:
    """Null values between known ones by linear interpolation over `order`, those
    beyond the ends by the nearest; 0 where a key has none."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("x"), F.col(value).alias("v")))
    back = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    d = df.withColumns({"_a": F.last(known, ignorenulls=True).over(back), "_b": F.first(known, ignorenulls=True).over(ahead)})
    gap = F.col("_b.x") - F.col("_a.x")
    inner = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(order) - F.col("_a.x")) / gap
    out = F.when(F.col(value).isNotNull(), F.col(value)).when(gap > 0, inner)
    return d.withColumn(name, F.coalesce(out, F.col("_a.v"), F.col("_b.v"), F.lit(0.0))).drop("_a", "_b")


def sequence_guard(frames: DataFrame, max_gap_s: float = 0.25, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Why state must be reset before a frame, and the session it belongs to.

    In this order: the sensor's frame id changed; the stamp went back; the gap is
    larger than max_gap_s (0: gaps are allowed)."""
    if not (max_gap_s >= 0 and max_gap_s != float("inf")):
        raise ValueError("a finite gap of at least 0 is needed")
    keys = keys or ["recording"]
    order = order or ["frame_idx"]
    w = W.partitionBy(*keys).orderBy(*order)
    last_id, last = F.lag("frame_id").over(w), F.lag("timestamp_ns").over(w)
    first = F.row_number().over(w) == 1
    reason = F.when(first, F.lit(None).cast("string")).when(~last_id.eqNullSafe(F.col("frame_id")), "frame_id_changed").when(F.col("timestamp_ns") < last, "timestamp_moved_backwards")
    if max_gap_s > 0:
        reason = reason.when(F.col("timestamp_ns") - last > int(round(max_gap_s * 1e9)), "timestamp_gap")
    out = frames.withColumn("reset_reason", reason)
    return out.withColumn("session", F.sum(F.col("reset_reason").isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def hits_in_last(df: DataFrame, keys: list[str], order: list[str], hit: Column, n: int, needed: int, name: str) -> DataFrame:
    """True where at least `needed` of the last n rows hit."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.sum(hit.cast("int")).over(w) >= needed)


def steady_of_last(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 3, spread: float = 0.2) -> DataFrame:
    """Median of the last n values if all are within `spread` of it."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    d = df.withColumns({"_n": F.count(value).over(w), "_m": F.percentile(value, F.lit(0.5)).over(w), "_lo": F.min(value).over(w), "_hi": F.max(value).over(w)})
    ok = (F.col("_n") == n) & (F.greatest(F.col("_hi") - F.col("_m"), F.col("_m") - F.col("_lo")) <= spread)
    return d.withColumn("agreed", F.when(ok, F.col("_m"))).drop("_n", "_m", "_lo", "_hi")


def turn_votes(df: DataFrame, keys: list[str], order: list[str], curvature: str, n: int = 10, deadband: float = 5e-5, least: int = 3, share: float = 0.7) -> DataFrame:
    """Direction on which the last n curvatures agree: 1, -1 or null."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    left, right = F.sum((F.col(curvature) > deadband).cast("int")).over(w), F.sum((F.col(curvature) < -deadband).cast("int")).over(w)
    d = df.withColumns({"_l": F.coalesce(left, F.lit(0)), "_r": F.coalesce(right, F.lit(0))})
    both = F.col("_l") + F.col("_r")
    vote = F.when((both >= least) & (F.col("_l") >= share * both), 1).when((both >= least) & (F.col("_r") >= share * both), -1)
    return d.withColumn("direction", vote.cast("int")).drop("_l", "_r")


def sustained_conflicts(rows: DataFrame, keys: list[str], order: str, error: str, n: int = 4, span: float = 8.0, limit: float = 0.5, share: float = 0.75) -> DataFrame:
    """Windows of n rows, long enough, whose median error is large and whose signs
    mostly agree."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    d = rows.withColumns(
        {"_n": F.count(error).over(w), "_span": F.max(order).over(w) - F.min(order).over(w), "_m": F.percentile(error, F.lit(0.5)).over(w), "_p": F.sum((F.col(error) > 0).cast("int")).over(w), "_q": F.sum((F.col(error) < 0).cast("int")).over(w)}
    )
    bad = (F.col("_n") == n) & (F.col("_span") >= span) & (F.abs("_m") > limit) & (F.greatest("_p", "_q") >= share * n)
    return d.withColumn("conflict", bad).drop("_n", "_span", "_m", "_p", "_q")


def chain_until_gap(rows: DataFrame, keys: list[str], order: str, gap: float = 16.0) -> DataFrame:
    """Rows of each key up to the first gap larger than `gap`."""
    w = W.partitionBy(*keys).orderBy(order)
    d = rows.withColumn("_g", F.coalesce(F.col(order) - F.lag(order).over(w), F.lit(0.0)) > gap)
    return d.withColumn("_b", F.max("_g").over(w.rowsBetween(W.unboundedPreceding, 0))).where(~F.col("_b")).drop("_g", "_b")


def arc_length(samples: DataFrame, keys: list[str], station: str, x: str, y: str) -> DataFrame:
    """Length along a sampled curve: running sum of its chords."""
    w = W.partitionBy(*keys).orderBy(station)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    d = samples.withColumn("_c", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return d.withColumn("length", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_c")


def turn_direction(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Where a frame's wall edges shift: median of the far fifth against that of
    40 to 65 % of the extent; 1 or -1 beyond 1.2 m, else 0."""
    extent = F.max("station").over(W.partitionBy(*keys))
    d = edges.withColumn("_r", F.col("station") / extent)
    g = d.groupBy(*keys).agg(F.median(F.when(F.col("_r") >= 0.8, F.col("edge"))).alias("far"), F.median(F.when(F.col("_r").between(0.4, 0.65), F.col("edge"))).alias("near"))
    shift = F.col("far") - F.col("near")
    return g.select(*keys, F.when(shift > 1.2, 1).when(shift < -1.2, -1).otherwise(0).cast("int").alias("direction"))
