"""Routes as data: tables of patterns over feature columns, of which the most specific one that matches decides.

A route has a column for each feature, NULL where any value will do, and ``extractor``, ``params``, ``rules`` (maps of texts)
and ``min_confidence``. Of the matching routes the one with most features set decides; with as many set, the one whose last
feature, in the order given, comes later; of routes with the same pattern, the one with the largest ``version``, then the
least extractor. Without a match the extractor is ``default``.

Matching is an equality join: for each combination of features that the documents hold there are as many keys as subsets of
features that routes set. Combinations are made distinct first, so the join does not grow with the documents but with their
variety. A key that many combinations share meets its route by a broadcast of bounded size, so no task gets all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators.classify import RouteNode

# A key asked for by more combinations than this is frequent; of these, as many of the most frequent as the second number says are
# broadcast. Of any other key a task gets less than the first number of rows, or one in MOST_FREQUENT of all.
FREQUENT = 100_000
MOST_FREQUENT = 10_000

_TEXTS = "map<string,string>"
_DECIDED = "extractor STRING, params MAP<STRING,STRING>, rules MAP<STRING,STRING>, min_confidence DOUBLE, version BIGINT"
TREE_FEATURES = ["doc_type", "has_tables", "has_line_items", "language"]


def _none() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _pattern(features: Sequence[str]) -> Column:
    return F.struct(*[_text(f).alias(f"f{i}") for i, f in enumerate(features)])


def _set(features: Sequence[str]) -> Column:
    """Number whose bits are the features that a route sets."""
    return sum((F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(features)), F.lit(0))


def decided(routes: DataFrame, features: Sequence[str]) -> DataFrame:
    """One route for each pattern, with ``version``."""
    have = set(routes.columns)
    params, rules = (F.coalesce(F.col(c).cast(_TEXTS), _none()) if c in have else _none() for c in ("params", "rules"))
    least, version = (F.col(c).cast(t) if c in have else F.lit(None).cast(t) for c, t in (("min_confidence", "double"), ("version", "bigint")))
    rows = routes.select(*[_text(f).alias(f) for f in features], F.col("extractor"), params.alias("params"), rules.alias("rules"), least.alias("min_confidence"), F.coalesce(version, F.lit(0)).alias("version"))
    values = F.struct("extractor", "params", "rules", "min_confidence", "version")
    # Least of the largest version: maps have no order, so their texts stand for them.
    order = F.struct((-F.col("version")).alias("v"), "extractor", F.to_json("params").alias("p"), F.to_json("rules").alias("r"), "min_confidence")
    return rows.groupBy(*features).agg(F.min_by(values, order).alias("_r")).select(*features, "_r.*")


def upserted(routes: DataFrame, changes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Routes with those of ``changes`` in the place of routes with the same pattern, or added."""
    old, new = decided(routes, features), decided(changes, features)
    return decided(old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1))), features).withColumn("version", F.lit(0).cast("bigint"))


def _matched(asked: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """(_pattern, _mask, _route) of the keys asked for that have a route; the most frequent ones meet theirs by a broadcast."""
    asks = asked.groupBy(*on).agg(F.count("*").alias("_asks")).where(F.col("_asks") > FREQUENT)
    often = asks.orderBy(F.desc("_asks"), *on).limit(MOST_FREQUENT).join(keys, on, "left")
    staged = asked.join(F.broadcast(often.select(*on, F.lit(True).alias("_often"), F.col("_route").alias("_its"))), on, "left")
    # Rows that have met their route already are spread by their pattern and find no other.
    spread = F.when(F.col("_often"), F.xxhash64("_pattern")).otherwise(F.lit(0))
    found = staged.withColumn("_spread", spread).join(keys.withColumn("_spread", F.lit(0).cast("bigint")), [*on, "_spread"], "left")
    return found.select("_pattern", "_mask", F.coalesce("_its", "_route").alias("_route")).where(F.col("_route").isNotNull())


def routed(docs: DataFrame, routes: DataFrame, features: Sequence[str], confidence: str | None = None) -> DataFrame:
    """Documents with ``extractor``, ``params`` and ``rules`` of the route that decides.

    A route with a ``min_confidence`` above the column ``confidence`` gives way to ``default``; an unknown confidence is enough.
    Any columns of these names that documents have already are replaced.
    """
    kept = [c for c in docs.columns if c not in ("extractor", "params", "rules")]
    n = len(features)
    keyed = docs.select(*kept, _pattern(features).alias("_pattern"))
    masks = F.explode(F.array(*[F.lit(m) for m in range(1 << n)])).alias("_mask")
    asked = keyed.select("_pattern").distinct().select("_pattern", masks)
    # A feature outside the mask matches any value; one inside it has to be known.
    at = [F.col(f"_pattern.f{i}") for i in range(n)]
    inside = [F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(n)]
    for i in range(n):
        asked = asked.filter(~inside[i] | at[i].isNotNull())
    asked = asked.select("_pattern", "_mask", *[F.when(inside[i], at[i]).otherwise("").alias(f"_k{i}") for i in range(n)])
    on = ["_mask", *[f"_k{i}" for i in range(n)]]
    table = decided(routes, features)
    keys = table.select(_set(features).alias("_mask"), *[F.coalesce(F.col(f), F.lit("")).alias(f"_k{i}") for i, f in enumerate(features)], F.struct("extractor", "params", "rules", "min_confidence").alias("_route"))
    # At most as many rows as there are subsets of features.
    asked = asked.join(F.broadcast(keys.select("_mask").distinct()), "_mask", "left_semi")
    matched = _matched(asked, keys, on)
    best = matched.groupBy("_pattern").agg(F.max_by("_route", F.struct(F.bit_count("_mask"), "_mask")).alias("_route"))
    joined = keyed.alias("d").join(best.alias("b"), F.col("d._pattern").eqNullSafe(F.col("b._pattern")), "left")
    route = F.col("b._route")
    passed = F.lit(True) if confidence is None else ~F.coalesce(F.col(f"d.{confidence}") < route["min_confidence"], F.lit(False))
    return joined.select(
        *[F.col(f"d.`{c}`") for c in kept],
        F.coalesce(F.when(passed, route["extractor"]), F.lit("default")).alias("extractor"),
        *(F.coalesce(F.when(passed, route[c]), _none()).alias(c) for c in ("params", "rules")),
    )


def tree_routes(spark: SparkSession, tree: dict[str, RouteNode]) -> DataFrame:
    """The routes of a tree of types: one for each type and one for each of its subtypes, over :data:`TREE_FEATURES`."""
    rows = []
    for kind, node in tree.items():
        rows.append((kind, None, None, None, node.extractor, node.params, None, node.confidence_threshold, 0))
        for feature, values in node.subtypes.items():
            for value, sub in values.items():
                at = [value if f == feature else None for f in TREE_FEATURES[1:]]
                rows.append((kind, *at, sub.extractor, sub.params, None, node.confidence_threshold, 0))
    return spark.createDataFrame(rows, ", ".join(f"{f} STRING" for f in TREE_FEATURES) + ", " + _DECIDED)
