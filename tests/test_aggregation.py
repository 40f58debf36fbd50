from pyspark.sql import functions as F

from corvia.operators import aggregation as A

POINT = "recording string, frame_idx int, point_idx int, group_id int, x double, y double, z double, ring int, station double, offset double, height double, range_m double, excess double"


def test_distinct_counts_of_groups(spark):
    """Ties, nulls and signed zeros as count(distinct) has them."""
    nan = float("nan")
    rows = [
        ("r", 0, k, k % 2, x, y, 1.0, ring, 5.0 + k, 0.1, h, 5.0, 0.2)
        for k, (x, y, ring, h) in enumerate([(0.0, 1.0, 1, 0.1), (-0.0, 1.0, 1, 0.1), (0.0, 1.0, None, 0.1), (None, 1.0, 2, None), (-0.0, 1.0, 2, 0.12), (nan, 1.0, 1, 0.3), (0.0, -0.0, 1, 0.1), (nan, 1.0, 1, 0.31)])
    ]
    df = spark.createDataFrame(rows, POINT)
    got = {r["group_id"]: (r["unique_returns"], r["rings"], r["levels"], r["returns"]) for r in A.group_features(df).collect()}
    level = F.bround(F.col("height") / 0.05, 0).cast("long")
    want = df.groupBy("group_id").agg(F.count_distinct("x", "y", "z").alias("u"), F.count_distinct("ring").alias("r"), F.count_distinct(level).alias("l"), F.count("*").alias("n"))
    assert got == {r["group_id"]: (r["u"], r["r"], r["l"], r["n"]) for r in want.collect()}
    assert A.group_features(df.limit(0)).count() == 0


def test_steady_cells_by_ranks(spark):
    """Against two nearest-rank quantiles."""
    rows = [("r", f, c, b, None if (c + b) % 7 == 0 else ((b * 37 + c * 11) % 23) / (10.0 if c % 2 else 100.0)) for f in range(2) for c in range(9) for b in range(1 + 4 * c)]
    df = spark.createDataFrame(rows + rows[:5], "recording string, frame_idx int, cell int, bin int, height double")
    tops = df.groupBy("recording", "frame_idx", "cell", "bin").agg(F.max("height").alias("top"))
    keys = ["recording", "frame_idx", "cell"]
    low, high = (A.nearest_rank(tops, keys, "top", q, 1, "v", ["bin"]).drop("n") for q in (10, 90))
    want = {(r["frame_idx"], r["cell"]): r["hi"] - r["v"] for r in low.join(high.withColumnRenamed("v", "hi"), keys).collect()}
    got = {(r["frame_idx"], r["cell"]): r["spread"] for r in A.steady_cells(df).collect()}
    assert got == want and len(got) > 10


def test_motion_tries_every_candidate_once(spark):
    """Candidates on all axes, out of order, repeated points, blocks left and met again, a null."""
    import math
    import random
    from collections import Counter

    rng = random.Random(4)
    spots = [tuple(rng.uniform(-8, 8) for _ in range(3)) for _ in range(120)]
    rows = [("r", f, i, *p) for f in (0, 1) for i, p in enumerate([*spots, *spots[:20]])] + [("r", 0, 999, None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "recording string, frame_idx int, point_idx int, x double, y double, z double")
    steps = [(k / 8, *(rng.choice([-0.1, 0.0, 0.03, 0.1, 6.4]) for _ in range(3))) for k in range(40)] + [(9.0, 0.0, 0.0, 0.0)]
    rng.shuffle(steps)
    voxel = lambda p: tuple(math.floor(c / 0.1) for c in p)
    taken = set(map(voxel, spots))
    occupied = spark.createDataFrame([("r", 1, *v) for v in taken], "recording string, frame_idx int, vx long, vy long, vz long")
    got = A.motion_score(points, occupied, spark.createDataFrame(steps, "travel double, tx double, ty double, tz double")).collect()
    want = Counter()
    for travel, *t in steps:
        for frame in (0, 1):
            own = [r[3:] for r in rows if r[1] == frame]
            hit = sum(voxel([a + b for a, b in zip(p, t)]) in taken for p in own if None not in p) if frame == 0 else 0
            want[frame + 1, travel, len(own), hit] += 1
    assert Counter((r["frame_idx"], r["travel"], r["points"], r["hits"]) for r in got) == want
    assert any(h for _, t, _, h in want if t != 9.0) and want[1, 9.0, 141, 140] == 1
