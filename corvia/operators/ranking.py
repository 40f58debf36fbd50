"""Order, top-k, distinct and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .projection import K

#: Order in which kinds of obstacles are listed (fixed by the output's contract).
KINDS = ["object", "transient", "unplaced", "track_furniture", "structure"]


def kind_rank(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for k in range(len(KINDS) - 1, -1, -1):
        out = F.when(kind == KINDS[k], F.lit(k)).otherwise(out)
    return out


def label_obstacles(obstacles: DataFrame) -> DataFrame:
    """label: place of each obstacle in its frame by kind, confidence, station."""
    w = W.partitionBy(*K).orderBy(kind_rank(F.col("kind")), F.col("confidence").desc(), "station_m", "group_id")
    return obstacles.withColumn("label", F.row_number().over(w) - 1)


def nearest_of_frame(obstacles: DataFrame) -> DataFrame:
    """Distance and confidence of each frame's nearest obstacle."""
    g = obstacles.groupBy(*K).agg(F.min(F.struct("range_m", "group_id", "confidence")).alias("m"))
    return g.select(*K, F.col("m.range_m").alias("distance_m"), F.col("m.confidence").alias("confidence"))


def best_of_window(candidates: DataFrame, keys: list[str], quality: str, cells: str, tie: str, k: int = 32) -> DataFrame:
    """The k best rows of each window, and how many were left out."""
    score = -F.col(quality) - 0.005 * F.least(F.col(cells), F.lit(40))
    w = W.partitionBy(*keys).orderBy(score, tie)
    d = candidates.withColumns({"rank": F.row_number().over(w), "_n": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    return d.where(F.col("rank") <= k).withColumn("overflow", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n")


def first_frames(frames: DataFrame, most: int = 0) -> DataFrame:
    """Frames below a number; 0: all."""
    return frames.where(F.col("frame_idx") < most) if most else frames


def distinct_returns(points: DataFrame) -> DataFrame:
    return points.groupBy(*K).agg(F.count_distinct("x", "y", "z").alias("unique_returns"))


def first_of_rounded(rows: DataFrame, columns: list[str], tie: str, digits: int = 2) -> DataFrame:
    """Of rows that agree when rounded half to even, the first."""
    keys = [F.bround(F.col(c), digits).alias(f"r_{c}") for c in columns]
    return rows.groupBy(*K, *keys).agg(F.min(tie).alias(tie), F.count(F.lit(1)).alias("n"))


def events_of(results: DataFrame, warn: bool = True) -> DataFrame:
    """event of each frame: new blocking ids, else lost ones, else (warn) the
    begin of caution. Columns: blocking_ids (array), status."""
    w = W.partitionBy("recording").orderBy("frame_idx")
    before = F.coalesce(F.lag("blocking_ids").over(w), F.array().cast("array<bigint>"))
    d = results.withColumns({"_b": before, "_s": F.lag("status").over(w)})
    event = F.when(F.size(F.array_except("blocking_ids", "_b")) > 0, "confirmed").when(F.size(F.array_except("_b", "blocking_ids")) > 0, "released")
    if warn:
        event = event.when((F.col("status") == "CAUTION") & ~F.col("_s").eqNullSafe("CAUTION"), "warning")
    return d.withColumn("event", event).drop("_b", "_s")


def maximal_sets(sets: DataFrame) -> DataFrame:
    """Sets (K, set_id, members) that no other of the frame strictly contains.
    Partners share a member, so the join is on members."""
    m = sets.select(*K, "set_id", F.size("members").alias("n"), F.explode("members").alias("member"))
    a, b = m.alias("a"), m.select(*K, F.col("set_id").alias("other"), F.col("n").alias("m"), "member")
    shared = a.join(b, [*K, "member"]).where((F.col("set_id") != F.col("other")) & (F.col("m") > F.col("n"))).groupBy(*K, "set_id", "other", "n").agg(F.count(F.lit(1)).alias("common"))
    inside = shared.where("common = n").select(*K, "set_id").distinct()
    return sets.join(inside, [*K, "set_id"], "left_anti")


def without_retired(tracks: DataFrame, lost: DataFrame) -> DataFrame:
    return tracks.join(lost.select("recording", "id"), ["recording", "id"], "left_anti")


def promotable(readings: DataFrame, vetoes: list[str]) -> DataFrame:
    """Readings none of whose reasons is a veto."""
    return readings.withColumn("promotable", ~F.arrays_overlap(F.coalesce("reasons", F.array().cast("array<string>")), F.array(*(F.lit(v) for v in vetoes))))


def frame_decision(obstacles: DataFrame, frames: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """BLOCKED with the nearest accepted object, UNKNOWN with reasons, or CLEAR.
    frames has route_supported and surface_supported for every frame."""
    ok = obstacles.where((F.col("kind") == "object") & (F.col("confidence") >= min_confidence))
    g = ok.groupBy(*K).agg(F.min(F.struct("range_m", "group_id", "confidence")).alias("m"), F.count(F.lit(1)).alias("accepted"))
    weak = obstacles.where((F.col("kind") == "object") & (F.col("confidence") < min_confidence)).select(*K).distinct().withColumn("weak", F.lit(True))
    d = frames.join(g, K, "left").join(weak, K, "left")
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("route_supported"), "route_not_fully_supported"),
            F.when(~F.col("surface_supported"), "surface_not_supported"),
            F.when(F.col("weak"), "low_confidence_object"),
        )
    )
    d = d.withColumn("reasons", F.array_distinct(reasons))
    status = F.when(F.col("accepted") > 0, "BLOCKED").when(F.size("reasons") > 0, "UNKNOWN").otherwise("CLEAR")
    clear = F.when(status == "CLEAR", True).when(status == "BLOCKED", False)
    return d.select(*K, status.alias("status"), clear.alias("path_clear"), F.col("m.range_m").alias("distance_m"), F.col("m.confidence").alias("confidence"), F.concat_ws(";", "reasons").alias("reasons"))
