"""Point clouds and frame sequences projected from the driver's tables.

The same text runs in Spark and DuckDB. Coordinates are metres, forward is -y and
up is +z. `recording` is constant, so keys are (recording, frame_idx).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLOUD = """
SELECT 'lineitem' AS recording,
       CAST(l_suppkey % 20 AS INT) AS frame_idx,
       CAST(row_number() OVER (PARTITION BY l_suppkey % 20
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS point_idx,
       ((l_orderkey * 7 + l_linenumber * 13) % 401 - 200) / CAST(100 AS DOUBLE) AS x,
       -((l_partkey * 31 + l_orderkey) % 8000) / CAST(100 AS DOUBLE) AS y,
       (CAST(l_quantity AS INT) * 17 % 300 - 100) / CAST(100 AS DOUBLE) AS z,
       CAST(l_orderkey % 128 AS INT) AS ring
FROM lineitem
"""

#: Stamps of each user's events as a sequence of frames.
SEQUENCE = """
SELECT CAST(user_id AS STRING) AS recording, event_id, CAST(epoch_us AS BIGINT) * 1000 AS timestamp_ns, event_type AS frame_id, value
FROM (SELECT *, {micros} AS epoch_us FROM events)
"""


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "lineitem")
    return spark.sql(CLOUD)


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "events")
    return spark.sql(SEQUENCE.format(micros="unix_micros(CAST(ts AS TIMESTAMP))"))


def sequence_sql() -> str:
    return SEQUENCE.format(micros="epoch_us(ts)").replace("STRING", "VARCHAR")
