"""Summaries per entity, stage, class and scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stage_stats_entity(staged: DataFrame, entities: DataFrame, stages: list[int], columns: list[str], net: str = "net") -> DataFrame:
    """Per entity and stage, for each column: means of positives and negatives, mean, SD, median, mean, median and SD of absolute values; for net: mean, SEM, SD.

    entities (entity, class) times stages is the spine, so that an entity without
    records in a stage has a row with n_values 0 and NULLs.
    """
    out = [F.count("*").alias("n_values")]
    for c in columns:
        v = F.col(c)
        out += [F.avg(F.when(v > 0, v)).alias(f"{c}_pos"), F.avg(F.when(v < 0, v)).alias(f"{c}_neg"), F.avg(v).alias(f"{c}_avg"), F.stddev_samp(v).alias(f"{c}_sd"), F.median(v).alias(f"{c}_med"), F.avg(F.abs(v)).alias(f"{c}_absavg"), F.median(F.abs(v)).alias(f"{c}_absmed"), F.stddev_samp(F.abs(v)).alias(f"{c}_abssd")]
    out += [F.avg(net).alias("net_avg"), (F.stddev_samp(net) / F.sqrt(F.count(net))).alias("net_sem"), F.stddev_samp(net).alias("net_sd")]
    spine = entities.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    return spine.join(staged.groupBy("entity", "stage").agg(*out), ["entity", "stage"], "left").withColumn("n_values", F.coalesce("n_values", F.lit(0).cast("long")))


def sets_of(df: DataFrame, sets: list[list[str]], aggs: list[Column], names: list[str]) -> DataFrame:
    """Grouping sets over names; columns that a set leaves out are NULL, `level` counts those left out."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.grouping_id(*[F.col(c) for c in names]).cast("long").alias("level"), *aggs)


def spread(value: str, sd: str) -> list[Column]:
    """Mean, SEM, least, most, count of entity means, and total SD = sqrt(mean(SD^2) + population variance of means)."""
    v = F.col(value)
    return [F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"), F.sqrt(F.avg(F.col(sd) * F.col(sd)) + F.var_pop(v)).alias("total_sd")]


def quartiles(value: str, prefix: str = "") -> list[Column]:
    v = F.col(value)
    return [F.percentile(v, 0.25).alias(f"{prefix}q25"), F.median(v).alias(f"{prefix}median"), F.percentile(v, 0.75).alias(f"{prefix}q75")]


def skill(observed: str, predicted: str, least: int = 10) -> list[Column]:
    """n, r2, rmse, mae, bias; NULL below `least` rows, r2 NULL without variance."""
    y, p = F.col(observed), F.col(predicted)
    n = F.count(y)
    sst = F.var_pop(y) * n
    enough = lambda c: F.when(n >= least, c)
    return [n.alias("n"), enough(F.when(sst > 0, 1 - F.sum((p - y) * (p - y)) / sst)).alias("r2"), enough(F.sqrt(F.avg((p - y) * (p - y)))).alias("rmse"), enough(F.avg(F.abs(p - y))).alias("mae"), enough(F.avg(p - y)).alias("bias")]


def coverage(df: DataFrame, columns: list[str], peaks: DataFrame, by: str = "entity") -> DataFrame:
    """Per entity and variable: rows, values, shares, also within the entity's peak months, whose numbers are joined by '+'."""
    rows = df.withColumn("month", F.month("ts")).join(peaks.select(by, "month", F.lit(True).alias("_p")), [by, "month"], "left")
    aggs = [F.count("*").alias("n_total"), F.count("_p").alias("n_total_peak")] + [f.alias(f"{c}|{k}") for c in columns for k, f in (("a", F.count(c)), ("p", F.count(F.when(F.col("_p"), F.col(c)))))]
    wide = rows.groupBy(by).agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}|a`, `{c}|p`" for c in columns)
    long = wide.select(by, "n_total", "n_total_peak", F.expr(f"stack({len(columns)}, {stack}) as (variable, n_valid, n_valid_peak)"))
    months = peaks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("month")), lambda m: m.cast("string")), "+").alias("peak_months"))
    return long.join(months, by, "left").withColumns({"pct": 100 * F.try_divide("n_valid", "n_total"), "pct_peak": 100 * F.try_divide("n_valid_peak", "n_total_peak")})


def versus_reference(cover: DataFrame, reference: str, by: str = "entity") -> DataFrame:
    """ratio of a layer's peak count to that of the reference layer of the entity; NULL where that is 0."""
    ref = F.max(F.when(F.col("variable") == reference, F.col("n_valid_peak"))).over(W.partitionBy(by))
    return cover.withColumn("ratio", F.try_divide(F.col("n_valid_peak").cast("double"), ref.cast("double")))


def deepest_layer(ratios: DataFrame, share: float = 0.9, by: str = "entity") -> DataFrame:
    """(entity, variable, layer): the deepest layer below the first whose ratio reaches the share; others are absent."""
    layers = ratios.withColumn("layer", F.regexp_extract("variable", r"(\d+)$", 1).cast("int")).where((F.col("layer") > 1) & (F.col("ratio") >= share))
    return layers.groupBy(by).agg(F.max_by("variable", "layer").alias("variable"), F.max("layer").alias("layer"))


def exceedance(df: DataFrame, x: str, limits: dict[str, Column], by: list[str]) -> DataFrame:
    """Rows, rows above each limit with their share, and the mean excess over the first limit (0 where none is above)."""
    v = F.col(x)
    first = next(iter(limits.values()))
    aggs = [F.count(v).alias("n")]
    for name, limit in limits.items():
        aggs += [F.count_if(v > limit).alias(f"n_above_{name}"), (100 * F.avg((v > limit).cast("double"))).alias(f"pct_above_{name}")]
    return df.where(v.isNotNull()).groupBy(*by).agg(*aggs, F.coalesce(F.avg(F.when(v > first, v - first)), F.lit(0.0)).alias("mean_excess"))


def climate_cascade(df: DataFrame, limit: float = 0.25) -> DataFrame:
    """value, source and reason per entity from product, alternative, reported value, slope and override.

    The product's value holds unless it is missing, its slope says it was not
    scaled (-9999), or it is more than `limit` off the reported value and the
    alternative is closer; an override takes the alternative.
    """
    product, alt, rep = F.col("product"), F.col("alternative"), F.col("reported")
    dev_p, dev_a = F.abs(product - rep) / rep, F.abs(alt - rep) / rep
    why = (
        F.when(F.col("override").isNotNull(), F.concat(F.lit("override: "), F.col("override")))
        .when(product.isNull(), "no product value").when(F.col("slope") == -9999, "not scaled")
        .when(rep.isNotNull() & (dev_p > limit) & (dev_a < dev_p), "off the reported value").otherwise("")
    )
    return df.withColumn("reason", why).withColumns({"source": F.when(F.col("reason") == "", "product").otherwise("alternative"), "value": F.when(F.col("reason") == "", product).otherwise(alt)})


def reported_value(*ranked: str) -> tuple[Column, Column]:
    """(value, source): first of the columns that holds a number other than 0 and -9999."""
    clean = {c: F.when(~F.col(c).isin(0.0, -9999.0), F.col(c)) for c in ranked}
    return F.coalesce(*clean.values()), F.coalesce(*[F.when(v.isNotNull(), F.lit(c)) for c, v in clean.items()], F.lit(""))
