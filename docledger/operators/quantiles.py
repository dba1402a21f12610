"""Quantiles of groups of any size: a mergeable sketch with a proven error, and exact selection.

The sketch counts values by buckets that grow by a constant factor g = (1 + a) / (1 - a): bucket k holds the values in
(g^(k-1), g^k], and 2 g^k / (g + 1) is within the share a of each of them. Sketches are plain rows of counts, so they merge by
a sum, over any windows, and the merged one is the sketch of all values. The value at a rank lies in the bucket that the
running counts give, so the estimate is off by the share a of the value at most. Doubles span some 72,600 buckets a sign at
a = 0.01: that bounds what a group can hold.

Negative values have buckets of their own, zero and infinite values and NaN one each, in Spark's order. Null values are
counted, but have no rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.regexes import let

# The error of an estimate, as a share of the value.
ACCURACY = 0.01
# Exact selection: error of the ranks that cut a group into zones, and equal parts of a zone.
RANK_ERROR, PARTS = 1e-4, 1_024


def _factor(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """Struct (sign, k) of the bucket of a value; structs are in the order of the values. NULL for NULL."""
    v = value.cast("double")
    infinite = F.abs(v) == float("inf")
    sign = F.when(F.isnan(v), 3).when(infinite, 2 * F.signum(v)).otherwise(F.signum(v))
    finite = ~F.isnan(v) & ~infinite & (v != 0)
    k = F.when(finite, F.ceil(F.ln(F.abs(v)) / math.log(_factor(accuracy))) * F.signum(v)).otherwise(0)
    return F.when(v.isNotNull(), F.struct(sign.cast("int").alias("sign"), k.cast("int").alias("k")))


def bucket_value(b: Column, accuracy: float = ACCURACY) -> Column:
    """The value that stands for a bucket."""
    g, sign = _factor(accuracy), b["sign"]
    finite = sign * F.pow(F.lit(g), sign * b["k"]) * (2 / (g + 1))
    special = F.when(sign == 3, float("nan")).when(sign == 2, float("inf")).when(sign == -2, float("-inf")).when(sign == 0, 0.0)
    return F.when(b.isNotNull(), F.coalesce(special, finite))


def sketch(rows: DataFrame, by: Sequence[str | Column], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(``by``, bucket, n): the sketch of each group, one row for each bucket that it fills. Counts combine map-side."""
    return rows.groupBy(*by, bucket(F.col(value), accuracy).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of parts of a group as one; without parts there are no rows."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def estimated(sketches: DataFrame, by: Sequence[str], q: float, accuracy: float = ACCURACY) -> DataFrame:
    """(``by``, quantile, n) from merged sketches: the value at rank floor(q (known - 1)), off by ``accuracy`` of it at most.

    NULL where all values are null. A group's rows are its buckets, whose number is bounded.
    """
    w = Window.partitionBy(*by)
    known = F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).over(w), F.lit(0))
    end = F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).over(w.orderBy("bucket"))
    placed = sketches.select(*by, "bucket", "n", known.alias("_known"), end.alias("_end"))
    at = F.min(F.when(F.col("_end") > F.floor((F.col("_known") - 1) * F.lit(q)), F.col("bucket")))
    return placed.groupBy(*by).agg(at.alias("_at"), F.sum("n").alias("n")).select(*by, bucket_value(F.col("_at"), accuracy).alias("quantile"), "n")


def estimated_from_array(buckets: Column, q: float, accuracy: float = ACCURACY) -> Column:
    """The same estimate from one sketch held as an array of (bucket, n); a bucket may stand there in several parts."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("struct<sign:int,k:int>").alias("at"))

    def at_rank(known: Column, rank: Column) -> Column:
        def step(a: Column, b: Column) -> Column:
            at = F.when(a["at"].isNull() & (a["seen"] + b["n"] > rank), b["bucket"]).otherwise(a["at"])
            return F.struct((a["seen"] + b["n"]).alias("seen"), at.alias("at"))

        return F.aggregate(known, start, step)["at"]

    def placed(known: Column) -> Column:
        # The rank is bound too: a step that held its expression would count the whole array for every bucket.
        n = F.aggregate(known, F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
        return let(F.floor((n - 1) * F.lit(q)), lambda rank: at_rank(known, rank))

    found = let(F.sort_array(F.filter(buckets, lambda b: b["bucket"].isNotNull())), placed)
    return let(found, lambda b: bucket_value(b, accuracy))


def exact(rows: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """(``by``, quantile, n) with linear interpolation between the two values around the rank; null values have no rank.

    Equal values are counted first, map-side. A sketch of ranks then cuts each group into three zones, of which the middle one
    holds the rank but few values; each zone is cut into equal parts, so that a value far out widens the parts of an outer
    zone alone. Exact counts of the parts say which of them hold the rank, whatever the sketch's error, and only their values
    are put in order.
    """
    keys = list(by)
    known_rows = rows.where(F.col(value).isNotNull())
    cuts = F.percentile_approx(value, F.array(F.lit(max(0.0, q - 2 * RANK_ERROR)), F.lit(min(1.0, q + 2 * RANK_ERROR))), int(1 / RANK_ERROR))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("_known"), F.min(value).alias("_low"), F.max(value).alias("_high"), cuts.alias("_cuts"))
    counted = known_rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    same = F.lit(True)
    sides = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    for s in sides:
        same = same & s
    named = totals.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_known", "_low", "_high", "_cuts")
    zoned = counted.join(named, same).drop(*[f"_g{i}" for i in range(len(keys))])
    v, first, last = F.col("_v"), F.col("_cuts")[0], F.col("_cuts")[1]
    zone = F.when(v < first, 0).when(v <= last, 1).otherwise(2)
    low = F.when(v < first, F.col("_low")).when(v <= last, first).otherwise(last)
    high = F.when(v < first, first).when(v <= last, last).otherwise(F.col("_high"))
    part = F.least(F.greatest(F.floor((v - low) / ((high - low) / PARTS)), F.lit(0)), F.lit(PARTS - 1))
    parts = zoned.withColumn("_b", (zone * PARTS + F.when(high > low, part).otherwise(0)).cast("int")).select(*keys, "_known", "_b", "_v", "_c")
    rank = (F.col("_known") - 1) * F.lit(q)
    sizes = parts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_size"), F.max("_known").alias("_known"))
    ends = sizes.withColumn("_to", F.sum("_size").over(Window.partitionBy(*keys).orderBy("_b"))).withColumn("_before", F.col("_to") - F.col("_size"))
    holding = [(F.col("_before") <= r) & (F.col("_to") > r) for r in (F.floor(rank), F.ceil(rank))]
    chosen = ends.where(holding[0] | holding[1]).select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_b").alias("_p"), "_before")
    placed = parts.join(chosen, same & (F.col("_b") == F.col("_p"))).withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v")))
    picked = placed.groupBy(*keys).agg(
        F.min(F.when(F.col("_end") > F.floor(rank), v)).alias("_a"), F.min(F.when(F.col("_end") > F.ceil(rank), v)).alias("_z"), F.max(rank - F.floor(rank)).alias("_f")
    )
    found = picked.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias("quantile"))
    return totals.join(found, same, "left").select(*keys, "quantile", "n")
