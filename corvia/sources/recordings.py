"""Sources of recordings: SQLite bags (one file or parts), .npy and .npz clouds.

spark.read.format("lidarbag").option("topic", ...).load(path) gives the messages
of a bag; each part is cut into ranges of message ids, which tasks read on their
own. The path must be reachable by every executor.
"""

from __future__ import annotations

import glob
import io
import os
import sqlite3

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.windows import number_frames
from .cloud_codec import POINTS

KIND, ENCODING = "sensor_msgs/msg/PointCloud2", "cdr"


def bag_parts(path: str) -> list[str]:
    parts = sorted(glob.glob(os.path.join(path, "*.db3"))) if os.path.isdir(path) else [path]
    if not parts:
        raise ValueError(f"no .db3 part in {path}")
    return parts


def _open(part: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{part}?mode=ro", uri=True)


def choose_topic(parts: list[str], wanted: str | None) -> str:
    names = set()
    for p in parts:
        with _open(p) as con:
            names |= {n for (n,) in con.execute("SELECT name FROM topics WHERE type = ? AND serialization_format = ?", (KIND, ENCODING))}
    if wanted:
        if wanted not in names:
            raise ValueError(f"no point cloud topic {wanted}; there are: {', '.join(sorted(names)) or 'none'}")
        return wanted
    if len(names) != 1:
        raise ValueError(f"one point cloud topic is needed, or the option topic; there are: {', '.join(sorted(names)) or 'none'}")
    return names.pop()


class IdRange(InputPartition):
    def __init__(self, part: str, number: int, low: int, high: int):
        self.part, self.number, self.low, self.high = part, number, low, high


class BagReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options.get("path"), int(options.get("rowspertask", "200"))
        if not self.path:
            raise ValueError("a path is needed")
        self.parts = bag_parts(self.path)
        self.topic = choose_topic(self.parts, options.get("topic"))

    def partitions(self):
        out = []
        for k, p in enumerate(self.parts):
            with _open(p) as con:
                low, high = con.execute("SELECT min(id), max(id) FROM messages").fetchone()
            if low is not None:
                out += [IdRange(p, k, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out or [IdRange(self.parts[0], 0, 1, 0)]

    def read(self, part: IdRange):
        name = os.path.basename(os.path.normpath(self.path))
        sql = "SELECT m.timestamp, m.id, m.data FROM messages m JOIN topics t ON m.topic_id = t.id WHERE t.name = ? AND t.type = ? AND t.serialization_format = ? AND m.id BETWEEN ? AND ?"
        with _open(part.part) as con:
            for stamp, key, data in con.execute(sql, (self.topic, KIND, ENCODING, part.low, part.high)):
                yield (name, part.number, key, stamp, data)


class BagSource(DataSource):
    @classmethod
    def name(cls):
        return "lidarbag"

    def schema(self):
        return "recording string, part int, id bigint, timestamp_ns bigint, data binary"

    def reader(self, schema):
        return BagReader(self.options)


def read_bag(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Messages with frame_idx: all parts in the order of (stamp, part, id)."""
    spark.dataSource.register(BagSource)
    reader = spark.read.format("lidarbag")
    if topic:
        reader = reader.option("topic", topic)
    return number_frames(reader.load(path), ["timestamp_ns", "part", "id"])


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """POINTS of .npy and .npz files (a glob), each a recording of one frame. Files
    come as bytes through Spark, so any store that it reads will do."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                got = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                xyz = got if isinstance(got, np.ndarray) else got["xyz"]
                ring = None if isinstance(got, np.ndarray) or "ring" not in got else got["ring"]
                if xyz.ndim != 2 or xyz.shape[1] != 3 or xyz.dtype.kind != "f":
                    raise ValueError(f"{p}: xyz must be floats of the shape (n, 3)")
                if ring is not None and (ring.shape != (len(xyz),) or ring.dtype.kind not in "iu"):
                    raise ValueError(f"{p}: ring must be integers, one a point")
                name = os.path.splitext(os.path.basename(p))[0]
                yield pd.DataFrame({"recording": name, "frame_idx": 0, "point_idx": np.arange(len(xyz)), "x": xyz[:, 0].astype(float), "y": xyz[:, 1].astype(float), "z": xyz[:, 2].astype(float), "ring": None if ring is None else ring.astype("int32")})

    return files.mapInPandas(run, POINTS)


def write_results(results: DataFrame, folder: str) -> None:
    """frames.csv and summary.json as folders of Spark's writers; refuses to
    overwrite. Rows are in frame order by range partition, not in one task."""
    csv = results.select(
        "recording", "frame_idx", "timestamp_ns", "status", "path_clear", "distance_m", "confidence", F.concat_ws(";", F.col("blocking_ids").cast("array<string>")).alias("blocking_ids"),
        F.concat_ws(";", F.col("caution_ids").cast("array<string>")).alias("caution_ids"), "travel_m", "route_available",
        *(c for c in ("elapsed_ms",) if c in results.columns),
    )
    csv.repartitionByRange("recording", "frame_idx").sortWithinPartitions("recording", "frame_idx").write.mode("errorifexists").option("header", True).csv(f"{folder}/frames.csv")
    summary = results.groupBy("recording").agg(
        F.count(F.lit(1)).alias("frames"),
        *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("CLEAR", "CAUTION", "BLOCKED")),
        F.min(F.when(F.col("status") == "BLOCKED", F.col("frame_idx"))).alias("first_blocked"),
    )
    summary.write.mode("errorifexists").json(f"{folder}/summary.json")


def result_json(results: DataFrame) -> DataFrame:
    """One strict JSON text for each frame: nulls stay, NaN and infinities are null."""
    from ..functions.scalar import strict_number

    clean = results.withColumns({c: strict_number(F.col(c)) for c, t in results.dtypes if t == "double"})
    return clean.select(*[c for c in ("recording", "frame_idx") if c in clean.columns], F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
