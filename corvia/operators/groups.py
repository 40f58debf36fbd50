"""Rules over the returns of a group, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .projection import K


def gauge_class(members: DataFrame, half_width: float = 1.15, height: float = 2.4, inner: float = 0.10, outer: float = 0.30, minimum: int = 3, group: str = "group_id") -> DataFrame:
    """inside, borderline or outside, by distinct returns at or above the rails:
    how many are deeper inside than `inner`, and how far out the nearest is."""
    gap = F.greatest(F.abs("offset") - half_width, F.col("height") - height)
    p = members.select(*K, group, "station", "offset", "height").distinct().withColumn("gap", F.when(F.col("height") >= 0, gap))
    g = p.groupBy(*K, group).agg(F.count_if(F.col("gap") < -inner - 1e-8).alias("deep"), F.min("gap").alias("nearest"))
    relation = F.when(F.col("deep") >= minimum, "inside").when(F.col("nearest") <= outer + 1e-8, "borderline").otherwise("outside")
    return g.select(*K, group, "deep", relation.alias("relation"))


def upright_faces(members: DataFrame, column: float = 0.2, tall: float = 0.4, reach: float = 0.7, width: float = 0.6, unique: int = 12, group: str = "group_id") -> DataFrame:
    """Groups with a broad, thin front: three neighbouring columns that are tall.
    Columns are aggregated first, so that the window sees one row for each."""
    span = members.groupBy(*K, group).agg(
        (F.max("offset") - F.min("offset")).alias("w"), (F.max("station") - F.min("station")).alias("d"), F.count_distinct("station", "offset", "height").alias("n")
    )
    col = F.floor(F.col("offset") / column).cast("long")
    cols = members.groupBy(*K, group, col.alias("c")).agg((F.max("height") - F.min("height")).alias("h"))
    good = cols.where((F.col("h") >= tall) & (F.abs((F.col("c") + 0.5) * column) <= reach))
    w = W.partitionBy(*K, group).orderBy("c")
    runs = good.withColumn("third", F.lead("c", 2).over(w)).where(F.col("third") == F.col("c") + 2).select(*K, group).distinct()
    ok = (F.col("w") >= width) & (F.col("d") <= 0.25 * F.col("w") + 0.05) & (F.col("n") >= unique)
    return span.where(ok).select(*K, group).join(runs, [*K, group], "left_semi")
