"""Whole recordings from source to files, and the command line.

    python -m corvia.runner OUT SOURCE [SOURCE ...] [--topic NAME] [--max-frames N]

A source is a bag (a .db3 file or a folder of its parts) or a .npy/.npz cloud. Each
gets a folder below OUT by its name, with frames.csv, frames.jsonl and summary.json.
"""

from __future__ import annotations

import argparse
import math
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import strict_number
from .operators.ranking import first_frames
from .sources import cloud_codec, recordings
from .streaming import processor

SCHEMA_VERSION = 1


def _middle(low: Column, high: Column) -> Column:
    return F.zip_with(low, high, lambda a, b: (a + b) / 2)


def output_rows(results: DataFrame, headers: DataFrame) -> DataFrame:
    """(recording, frame_idx, value): one strict JSON text for each frame.

    headers: recording, frame_idx, frame_id, removed_points. NaN and infinities are
    null; a frame that failed has its error beside the other fields, the others have
    no such field. A track's centre is the middle of its box in the route's
    coordinates (station, offset, height).
    """
    k = ["recording", "frame_idx"]
    d = results.join(headers.select(*k, "frame_id", "removed_points"), k, "left")
    track = F.transform(
        "tracks",
        lambda t: F.struct(
            t["id"].alias("id"), t["decision"].alias("decision"), t["confirmed"].alias("confirmed"), t["seen"].alias("seen"), t["exists"].alias("exists"), t["kind"].alias("kind"),
            strict_number(t["range_m"]).alias("range_m"), _middle(t["low"], t["high"]).alias("centre"), strict_number(t["station_m"]).alias("station_m"), strict_number(t["offset_m"]).alias("offset_m"),
            strict_number(t["speed_m_per_frame"]).alias("speed_m_per_frame"),
        ),
    )
    fields = [
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct("frame_id", "timestamp_ns").alias("header"),
        F.col("frame_idx").alias("frame_index"),
        "processing_ok",
        "status",
        "path_clear",
        strict_number(F.col("distance_m")).alias("distance_m"),
        strict_number(F.col("confidence")).alias("confidence"),
        "route_available",
        F.when(F.col("route_available"), F.lit("TEMPORALLY_ESTIMATED")).otherwise(F.lit("UNAVAILABLE")).alias("route_status"),
        strict_number(F.col("travel_m")).alias("travel_m"),
        "blocking_ids",
        track.alias("tracks"),
        F.struct(strict_number(F.col("elapsed_ms")).alias("ordered_pass")).alias("timing_ms"),
        F.coalesce("removed_points", F.lit(0)).alias("removed_points"),
        "reset_reason",
    ]
    options = {"ignoreNullFields": "false"}
    text = F.when(F.col("processing_ok"), F.to_json(F.struct(*fields), options)).otherwise(F.to_json(F.struct(*fields, "error"), options))
    return d.select(*k, text.alias("value"))


def process_recording(spark: SparkSession, source: str, folder: str, *, topic: str | None = None, max_frames: int = 0, max_gap_s: float = 0.25) -> DataFrame:
    """Results of a source, written to folder; refuses to overwrite. max_frames: the
    first frames only, 0 for all. A frame that can't be decoded has an error row and
    clears the state; the next ones go on."""
    if max_frames < 0:
        raise ValueError("max_frames must be 0 or more")
    if not (math.isfinite(max_gap_s) and max_gap_s >= 0):
        raise ValueError("max_gap_s must be finite and 0 or more")
    if source.endswith((".npy", ".npz")):
        points = recordings.read_arrays(spark, source)
        frames = points.groupBy("recording", "frame_idx").agg(F.lit("").alias("frame_id"), F.lit(0).cast("bigint").alias("timestamp_ns"), F.lit(0).cast("bigint").alias("removed_points"), F.lit(None).cast("string").alias("error"))
    else:
        messages = first_frames(recordings.read_bag(spark, source, topic), max_frames)
        points = cloud_codec.decode_frames(messages, skip_broken=True)
        k = ["recording", "frame_idx"]
        frames = messages.select(*k, "timestamp_ns").join(cloud_codec.message_headers(messages), k)
    # clouds are decoded once, into a folder that all executors see
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{folder}/_clouds"
    base = f"{base.rstrip('/')}/clouds-{uuid.uuid4().hex}"
    held = {}
    for name, df in (("points", points), ("frames", frames)):
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
        held[name] = spark.read.schema(df.schema).parquet(f"{base}/{name}")
    results = processor.process_recordings(held["points"], held["frames"].drop("points", "removed_points"), max_gap_s)
    results.write.mode("errorifexists").parquet(f"{base}/results")
    results = spark.read.schema(results.schema).parquet(f"{base}/results")
    recordings.write_results(results, folder)
    rows = output_rows(results, held["frames"])
    rows.repartitionByRange("recording", "frame_idx").sortWithinPartitions("recording", "frame_idx").select("value").write.mode("errorifexists").text(f"{folder}/frames.jsonl")
    return results


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="corvia.runner", description="Process recordings of point clouds.")
    args.add_argument("out")
    args.add_argument("sources", nargs="+")
    args.add_argument("--topic")
    args.add_argument("--max-frames", type=int, default=0)
    args.add_argument("--max-gap", type=float, default=0.25, help="seconds between frames after which the state is cleared")
    own = args.parse_args(argv)
    names = [os.path.splitext(os.path.basename(os.path.normpath(s)))[0] for s in own.sources]
    if len(set(names)) != len(names):
        args.error("sources need names of their own")
    if own.max_frames < 0 or not (math.isfinite(own.max_gap) and own.max_gap >= 0):
        args.error("--max-frames and --max-gap must be 0 or more")
    spark = SparkSession.builder.appName("corvia").getOrCreate()
    for name, source in zip(names, own.sources):
        process_recording(spark, source, f"{own.out}/{name}", topic=own.topic, max_frames=own.max_frames, max_gap_s=own.max_gap)


if __name__ == "__main__":
    main()
