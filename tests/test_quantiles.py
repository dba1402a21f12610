"""Sketches and exact selection against sorted lists."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docledger.operators import quantiles as qs
from docledger.plans import jobstats as js

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "g STRING, v DOUBLE"


def _groups():
    rng = random.Random(3)
    return {
        "one outlier": [rng.random() for _ in range(3_000)] + [1e300],
        "ties": [7.0] * 2_000 + [rng.gauss(0, 1) for _ in range(900)],
        "signs": [rng.gauss(0, 1e6) for _ in range(800)] + [0.0] * 40,
        "single": [5.0],
        "constant": [-2.5] * 50,
        "scales": [10 ** rng.uniform(-200, 200) for _ in range(700)],
        None: [1.0, 2.0, 3.0, 4.0],
    }


def _frame(spark, groups, nulls=3):
    rows = [(g, v) for g, values in groups.items() for v in values] + [(g, None) for g in groups for _ in range(nulls)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([*rows, ("all null", None)], SCHEMA)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_is_the_interpolated_value_of_the_sorted_list(spark, q):
    groups = _groups()
    got = {r.g: (r.quantile, r.n) for r in qs.exact(_frame(spark, groups), ["g"], "v", q).collect()}
    assert got.pop("all null") == (None, 1) and set(got) == set(groups)
    for g, values in groups.items():
        assert got[g][0] == pytest.approx(float(np.quantile(values, q)), rel=1e-9) and got[g][1] == len(values) + 3


def test_only_the_parts_that_hold_the_rank_are_put_in_order(spark):
    """With an outlier in the table, a part of the middle zone is sorted, not the whole group."""
    plan = qs.exact(_frame(spark, _groups()), ["g"], "v", 0.95)._jdf.queryExecution().optimizedPlan().toString()
    assert "_before" in plan and "percentile_approx" in plan
    assert qs.exact(spark.createDataFrame([], SCHEMA), ["g"], "v", 0.5).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_estimates_keep_the_proven_error(spark, q):
    groups = _groups()
    got = {r.g: (r.quantile, r.n) for r in qs.estimated(qs.sketch(_frame(spark, groups), ["g"], "v"), ["g"], q).collect()}
    assert got.pop("all null") == (None, 1) and set(got) == set(groups)
    for g, values in groups.items():
        true = sorted(values)[math.floor(q * (len(values) - 1))]
        assert abs(got[g][0] - true) <= abs(true) * (qs.ACCURACY + 1e-9), g


def test_parts_merge_to_the_sketch_of_all(spark):
    df = _frame(spark, _groups()).withColumn("part", F.pmod(F.hash("v"), F.lit(5)))
    whole = qs.sketch(df, ["g"], "v").select("g", "bucket", "n")
    parts = qs.merged(qs.sketch(df, ["part", "g"], "v"), ["g"]).select("g", "bucket", "n")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))


def test_values_without_a_logarithm(spark):
    values = [float("-inf"), -1.0, 0.0, 5e-324, 1.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([("a", v) for v in reversed(values)], SCHEMA)
    for i, true in enumerate(values):
        found = qs.estimated(qs.sketch(df, ["g"], "v"), ["g"], i / (len(values) - 1) + 1e-9).first().quantile
        assert (math.isnan(found) and math.isnan(true)) or found == pytest.approx(true, rel=0.011)


def test_an_array_gives_the_same_estimate(spark):
    s = qs.sketch(_frame(spark, _groups()), ["g"], "v")
    arrays = s.groupBy("g").agg(F.collect_list(F.struct("bucket", "n")).alias("b")).select("g", qs.estimated_from_array(F.col("b"), 0.95).alias("q"))
    assert sorted(map(repr, arrays.collect())) == sorted(map(repr, qs.estimated(s, ["g"], 0.95).select("g", F.col("quantile").alias("q")).collect()))


def test_hours_merge_into_days(spark):
    rows = [(f"/{i % 3}", float(i % 97) if i % 11 else None, T0 + dt.timedelta(minutes=7 * i)) for i in range(1_000)]
    calls = spark.createDataFrame(rows, "endpoint STRING, response_time DOUBLE, ts TIMESTAMP")
    hourly = js.hourly_sketches(calls, ["endpoint"]).withColumn("day", F.to_date("hour"))
    for r in qs.estimated(qs.merged(hourly, ["endpoint", "day"]), ["endpoint", "day"], 0.95).collect():
        day = [(v, t) for e, v, t in rows if e == r.endpoint and t.date() == r.day]
        values = sorted(v for v, _ in day if v is not None)
        assert r.n == len(day) and r.quantile == pytest.approx(values[math.floor(0.95 * (len(values) - 1))], rel=0.0101)


def test_the_rank_of_an_array_is_sought_once(spark):
    """A rank inside the running sum would sort and count the whole array again for every bucket."""
    s = qs.sketch(_frame(spark, _groups()), ["g"], "v").groupBy("g").agg(F.collect_list(F.struct("bucket", "n")).alias("b"))
    plan = s.select(qs.estimated_from_array(F.col("b"), 0.95).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(") == 1 and plan.count("aggregate(") == 2
