"""Thresholds: where a fitted response turns from positive to negative, and how robust that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import crossings, fitted, on_grid, polyfit, prediction_se
from ..functions import t_quantile
from ..sources import materialize
from .ordered import placed
from .resample import draw


def enough_bins(points: DataFrame, keys: list[str], least: int = 15) -> DataFrame:
    """Points of the groups that have at least `least` of them."""
    ok = points.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return points.join(ok, keys, "left_semi")


def threshold(points: DataFrame, keys: list[str], degree: int = 4, n_grid: int = 500) -> DataFrame:
    """(keys, crossing) of the polynomial fitted to each group's points."""
    grid = on_grid(polyfit(points, keys, degree), n_grid).select(*keys, "x", fitted(degree).alias("y"))
    return crossings(grid, keys)


def threshold_band(points: DataFrame, keys: list[str], degree: int = 4, n_grid: int = 500) -> DataFrame:
    """(keys, crossing, lower, upper): crossings of the fit and of its 95 % prediction band."""
    grid = on_grid(polyfit(points, keys, degree), n_grid)
    half = t_quantile(F.col("n") - degree - 1) * prediction_se(degree)
    y = fitted(degree)
    grid = grid.select(*keys, "x", y.alias("fit"), (y - half).alias("low"), (y + half).alias("high"))
    out = crossings(grid, keys, "fit")
    for name, col in (("lower", "low"), ("upper", "high")):
        out = out.join(crossings(grid, keys, col).withColumnRenamed("crossing", name), keys)
    return out


def leave_one_out(curves: DataFrame, entity: str = "entity") -> DataFrame:
    """(removed, x, y, k, n_entities): median and number of the values at x without each entity in turn.

    curves has one row per entity and bin.  Values are ranked within their bins
    by ranges; a median without one value lies among three neighbours in the
    middle, and an entity's own rank tells which.  No array holds the entities.
    """
    ranked = materialize(placed(curves.select(entity, "x", "y"), ["x"], ["y", entity], "rank"))
    sizes = ranked.groupBy("x").agg(F.count("*").alias("n"))
    # of the n - 1 values left, the middle one is at this rank, or the next one too
    at = F.floor(F.col("n") / 2)
    rows = ranked.join(sizes, "x")
    near = [F.max(F.when(F.col("rank") == at + i, F.col("y"))).alias(f"v{i}") for i in range(3)]
    bins = rows.groupBy("x").agg(F.first("n").alias("n"), *near)
    everyone = ranked.select(entity).distinct()
    spine = everyone.crossJoin(bins).crossJoin(everyone.agg(F.count("*").alias("n_entities")))  # bins are few
    own = spine.join(ranked.select(entity, "x", "rank"), [entity, "x"], "left")
    odd, r = F.col("n") % 2 == 1, F.col("rank")
    first, second = F.when(r > at, F.col("v0")).otherwise(F.col("v1")), F.when(r > at + 1, F.col("v1")).otherwise(F.col("v2"))
    without = F.when(odd, (first + second) / 2).otherwise(first)
    whole = F.when(odd, F.col("v1")).otherwise((F.col("v0") + F.col("v1")) / 2)
    k = F.col("n") - r.isNotNull().cast("int")
    return own.select(F.col(entity).alias("removed"), "x", F.when(r.isNull(), whole).otherwise(without).alias("y"), k.alias("k"), "n_entities").where("k > 0")


def resampled(curves: DataFrame, n_rep: int, seed: int, entity: str = "entity") -> DataFrame:
    """curves with a `rep` key and `times`: how often each entity was drawn in each replicate.

    Slot k of a replicate draws a place among the entities in order of name.
    Draws are made in tasks that share out all slots and counted before they meet
    the entities of those places, so no array holds the entities and a curve's
    rows are copied once per replicate at most.
    """
    spark = curves.sparkSession
    numbered = materialize(placed(curves.select(entity).distinct(), [], [entity], "_place"))
    n = numbered.count()
    slots = spark.range(n_rep * n).select(F.expr(f"id div {max(n, 1)}").alias("rep"), (F.col("id") % max(n, 1)).alias("_s"))
    drawn = slots.groupBy("rep", (draw(F.col("rep"), F.col("_s"), seed) % max(n, 1) + 1).alias("_place")).agg(F.count("*").alias("times"))
    return curves.join(drawn.join(numbered, "_place").select("rep", entity, "times"), entity)


def to_physical(z: Column, mean: Column, sd: Column, scale: float = 10) -> Column:
    return (mean + z * sd) / scale


def to_sigma(value: Column, mean: Column, sd: Column, scale: float = 10) -> Column:
    return (value * scale - mean) / sd
