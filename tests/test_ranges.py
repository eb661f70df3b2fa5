"""Ranks and percentiles over ranges against sorting everything."""

import math
import random

from pyspark.sql import functions as F

from leafmill.operators import ranges


def rows():
    rng = random.Random(1)
    return [(k, rng.choice([None, *map(float, range(50))])) for k in [None, "a", "b"] for _ in range(300)] + [("c", 1.0), ("d", None)]


def test_percentiles_and_median(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r["k"]: (r["p10"], r["p50"], r["p100"], r["n"]) for r in ranges.nearest_rank(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()}
    for k in {k for k, _ in data}:
        v = sorted(x for key, x in data if key == k and x is not None)
        assert got.get(k) == ((*[v[math.ceil(s * len(v)) - 1] for s in (0.1, 0.5, 1.0)], len(v)) if v else None)
    v = sorted(x for _, x in data if x is not None)
    one = ranges.middle(df, "v").first()
    assert one["n"] == len(v) and one["median"] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    none = ranges.middle(df.limit(0), "v").first()
    assert none["median"] is None and none["n"] == 0


def test_rank_is_the_place_in_the_whole_order(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, v double").repartition(3)
    got = ranges.ranked(df, F.desc("v"), F.asc("k")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(data) + 1))
    order = lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or "")
    assert [(r["k"], r["v"]) for r in got] == sorted(data, key=order)
    assert ranges.ranked(df.limit(0), F.desc("v")).count() == 0
