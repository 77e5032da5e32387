"""Repeatable draws: bootstrap replicates, folds, samples.  Draws are plain integer arithmetic, so any engine gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import placed

_PRIME, _MODULUS = 48271, 2147483647


def draw(a: Column, b: Column, c: Column | int = 0) -> Column:
    """A pseudo-random integer in 0 .. 2**31 - 2 from two or three integers."""
    c = F.lit(c) if isinstance(c, int) else c
    return F.pmod((a.cast("long") * 1000003 + b.cast("long") * 10007 + c.cast("long")) * _PRIME, F.lit(_MODULUS))


def replicates(spark, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "rep")


def bootstrap(values: DataFrame, value: str, by: list[str], order: list[str], n_rep: int, seed: int, stats: dict) -> DataFrame:
    """(by, rep, stats): statistics of n_rep resamples, with replacement, of each group's values.

    values has one row per unit (an entity, say), never raw records.  A group's
    values become one array in the given order; slot s of replicate r takes the
    value at draw(r, s, seed) modulo its size.  Replicates are made from the
    array, so nothing is joined.  stats maps names to functions of an array
    column.
    """
    pairs = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_s"))
    arrays = pairs.select(*by, F.transform("_s", lambda s: s["_v"]).alias("_a"))
    reps = arrays.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))))
    n = F.size("_a")
    picked = F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.element_at(F.col("_a"), (draw(F.col("rep"), s, seed) % n + 1).cast("int")))
    out = reps.withColumn("_d", picked)
    return out.select(*by, "rep", *[f(F.col("_d")).alias(k) for k, f in stats.items()])


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    at = lambda i: F.element_at(s, i.cast("int"))
    return (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2


def kfold(df: DataFrame, keys: list[Column], k: int = 5, seed: int = 42, by: str = "entity") -> DataFrame:
    """fold 0..k-1 by draw() of up to two integer keys, without a shuffle, so that sizes vary as draws do; inner is True for the validation share (15 %) of training rows."""
    key = draw(keys[0], keys[1], seed)
    return df.withColumns({"fold": (key % k).cast("int"), "inner": (F.floor(key / k) % 100) < 15})


def balanced_kfold(df: DataFrame, keys: list[Column], order: list[str], k: int = 5, seed: int = 42, by: str = "entity") -> DataFrame:
    """fold 0..k-1 of sizes that differ by one row at most within an entity: places in the order of draw(), then of `order`, dealt in turn.

    Places come from ranges, so a large entity is not sorted by one task; `order`
    tells the rows of an entity apart.
    """
    rows = placed(df.withColumn("_draw", draw(keys[0], keys[1], seed)), [by], ["_draw", *order], "_place")
    return rows.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_draw", "_place")


def leave_one_year_out(df: DataFrame, by: str = "entity", ts: str = "ts") -> DataFrame:
    """fold = rank of the calendar year within its entity, from 0; entities of one year are left out."""
    years = df.select(by, F.year(ts).alias("year")).distinct()
    w = W.partitionBy(by)
    years = years.withColumns({"fold": F.row_number().over(w.orderBy("year")) - 1, "n": F.count("*").over(w)}).where("n >= 2").drop("n")
    return df.withColumn("year", F.year(ts)).join(years, [by, "year"])
