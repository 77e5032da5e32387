"""Two-dimensional bins per entity, and grids across entities with one vote each.

A cell's number is floor(10 * z), an integer; the label is divided out last, so
no label suffers from float steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOW, HIGH = -80, 99


def bin_number(z: Column, per_unit: float = 10) -> Column:
    """Lower-edge bin of z: floor(z * per_unit) from -8.0 to below 10.0; NULL outside."""
    n = F.floor(z * per_unit)
    return F.when((z >= LOW / 10) & (z < (HIGH + 1) / 10), n)


def bin2d_mean(df: DataFrame, x: str, y: str, values: list[str], per_unit: float = 10, by: list[str] | None = None) -> DataFrame:
    """(by, bx, cy, n, means): all columns in one aggregation."""
    rows = df.withColumns({"bx": bin_number(F.col(x), per_unit), "cy": bin_number(F.col(y), per_unit)}).dropna(subset=["bx", "cy"])
    return rows.groupBy(*(by or ["entity"]), "bx", "cy").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def bin2d_pairs(df: DataFrame, pairs: list[tuple[str, str]], values: list[str], per_unit: float = 10, by: list[str] | None = None) -> DataFrame:
    """bin2d_mean of several variable pairs with a `pair` column; one scan, each row exploded once per pair."""
    cells = F.array(*[F.struct(F.lit(f"{x}+{y}").alias("pair"), bin_number(F.col(x), per_unit).alias("bx"), bin_number(F.col(y), per_unit).alias("cy")) for x, y in pairs])
    by = by or ["entity"]
    rows = df.select(*by, *values, F.explode(cells).alias("c")).select(*by, *values, "c.pair", "c.bx", "c.cy").dropna(subset=["bx", "cy"])
    return rows.groupBy("pair", *by, "bx", "cy").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def bin1d_mean(grid: DataFrame, value: str, by: list[str] | None = None, axis: str = "bx") -> DataFrame:
    """Mean over all cells of a bin, every cell counting alike."""
    return grid.groupBy(*(by or ["entity"]), axis).agg(F.avg(value).alias(value))


def bin1d_nearest(df: DataFrame, x: str, value: str, least: int = 10, by: list[str] | None = None) -> DataFrame:
    """Nearest tenth (half to even), mean and size; bins of fewer rows go."""
    return df.withColumn("bx", F.rint(F.col(x) * 10).cast("long")).groupBy(*(by or ["entity"]), "bx").agg(F.avg(value).alias(value), F.count("*").alias("n")).where(F.col("n") >= least)


def across(grid: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Per cell (and keys such as class): mean, median, max, min, count, std, sem of entity values and n_entities, the number of all entities of the keys."""
    keys = keys or []
    v = F.col(value)
    cells = grid.groupBy(*keys, "bx", "cy").agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.max(v).alias("max"), F.min(v).alias("min"), F.count(v).alias("count"), F.stddev_samp(v).alias("std"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))
    totals = grid.groupBy(*keys).agg(F.count_distinct("entity").alias("n_entities"))
    # without keys, one row; with keys their number is not known here, so Spark chooses by size
    return cells.join(totals, keys) if keys else cells.crossJoin(F.broadcast(totals))


def coverage_filter(cells: DataFrame) -> DataFrame:
    """Cells that at least half of the entities fill."""
    return cells.where(F.col("count") >= F.ceil(F.col("n_entities") / 2))


def focal_extreme(cells: DataFrame, value: str, k: int = 9, radius: int = 2) -> DataFrame:
    """(bx, cy, focal): mean of the k nearest cells of each cell that has a value, if all k have one.

    Neighbours are made by offsets within the radius, so each cell is copied a
    fixed number of times and met by an equi-join.
    """
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * i + j * j).alias("d2")) for i, j in offsets])
    asked = cells.where(F.col(value).isNotNull()).select(F.col("bx").alias("ox"), F.col("cy").alias("oy"), F.explode(near).alias("o"))
    asked = asked.select("ox", "oy", (F.col("ox") + F.col("o.i")).alias("bx"), (F.col("oy") + F.col("o.j")).alias("cy"), "o.d2")
    met = asked.join(cells.select("bx", "cy", F.col(value).alias("_v")), ["bx", "cy"], "left")
    w = W.partitionBy("ox", "oy").orderBy("d2", "bx", "cy")
    best = met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy(F.col("ox").alias("bx"), F.col("oy").alias("cy")).agg(F.avg("_v").alias("focal"), F.count("_v").alias("c")).where(F.col("c") == k).drop("c")
