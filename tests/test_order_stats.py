import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import order_stats
from tidemark.functions.order_stats import nth, ordered_values

RANKS = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "top": 1.0}


def brute(rows):
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    return {g: (len(v), *(sorted(v)[min(len(v) - 1, int(len(v) * s))] for s in RANKS.values())) for g, v in groups.items()}


@pytest.mark.parametrize("direct", [order_stats.DIRECT, 50, 1], ids=["one pass", "narrowed", "narrowed to the end"])
def test_elements_are_those_of_the_sorted_group(spark, direct):
    rng = np.random.default_rng(2)
    rows = [("skewed", float(x)) for x in np.round(rng.lognormal(0, 3, 4000), 2)] + [("ties", float(x)) for x in rng.integers(0, 3, 3000)] + [("one", 5.0), ("two", 2.0), ("two", -2.0), ("none", None), ("nan", float("nan"))]
    rows += [(None, float(x)) for x in rng.standard_normal(77)] + [("same", 7.0)] * 500 + [("inf", float("inf")), ("inf", 1.0), ("inf", float("-inf"))]
    df = spark.createDataFrame([(g, v, 1, "x") for g, v in rows], "g string, v double, n int, low string")
    got = {r[0]: tuple(r)[1:] for r in ordered_values(df, ["g"], "v", {k: nth(s) for k, s in RANKS.items()}, direct).collect()}
    assert got == brute(rows)


def test_without_groups_and_other_types(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("d"))
    assert ordered_values(df, [], "v", {"m": nth(0.5)}, 10).collect()[0] == (1000, 500)
    assert str(ordered_values(df, [], "d", {"m": F.col("n") - 1}).collect()[0]["m"]) == "2026-09-26"
    assert ordered_values(df.limit(0), [], "v", {"m": nth(0.5)}).collect() == []
    assert ordered_values(df.limit(0).withColumn("g", F.lit(1)), ["g"], "v", {"m": nth(0.5)}).collect() == []
