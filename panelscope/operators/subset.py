"""From a merged panel to model input: months, flags, years, completeness, z-scores, funnel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import materialize

PEAK_MONTHS, LIGHT_CUT = 4, 20.0


def peak_months(df: DataFrame, value: str, n: int = PEAK_MONTHS) -> DataFrame:
    """(entity, month, rank): the n months of highest mean over all rows; NULL means are ignored, ties go to the lower month."""
    means = df.groupBy("entity", F.month("ts").alias("month")).agg(F.avg(value).alias("mean")).where("mean is not null")
    # twelve rows per entity at most
    return means.withColumn("rank", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("mean"), "month"))).where(F.col("rank") <= n)


def qc_filter(df: DataFrame, qc: str = "qc") -> DataFrame:
    return df.where(F.col(qc) == 0)


def daytime_filter(df: DataFrame, light: str = "light_pot", cut: float = LIGHT_CUT) -> DataFrame:
    return df.where(F.col(light) > cut)


def in_peak_months(df: DataFrame, peaks: DataFrame) -> DataFrame:
    keys = peaks.select("entity", "month")
    return df.withColumn("month", F.month("ts")).join(keys, ["entity", "month"], "left_semi")


def balance_years(df: DataFrame) -> DataFrame:
    """Every month keeps its latest m years, m being the least number of years of the entity's months that have rows."""
    years = df.select("entity", F.month("ts").alias("month"), F.year("ts").alias("year")).distinct()
    years = years.withColumn("recency", F.row_number().over(W.partitionBy("entity", "month").orderBy(F.desc("year"))))
    counts = years.groupBy("entity", "month").agg(F.count("*").alias("n")).groupBy("entity").agg(F.min("n").alias("m"))
    keep = years.join(counts, "entity").where("recency <= m").select("entity", "month", "year")
    return df.withColumns({"month": F.month("ts"), "year": F.year("ts")}).join(keep, ["entity", "month", "year"], "left_semi")


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def zscore(df: DataFrame, columns: list[str], by: list[str] | None = None, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population SD per entity; NULL where the SD is 0.

    Means and SDs are aggregated first and joined back, so that a large entity is
    never sorted or held by one task.  They are written, as Spark knows the size of
    a written table: rows are shuffled only to more entities than it broadcasts.
    """
    by = by or ["entity"]
    stats = materialize(df.groupBy(*by).agg(*[f(c).alias(f"_{p}_{c}") for c in columns for p, f in (("m", F.avg), ("s", F.stddev_pop))]))
    out = df.join(stats, by).withColumns({f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns})
    return out.drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


def monthly_counts(df: DataFrame, value: str, predictors: list[str], target: str, light_cut: float = LIGHT_CUT) -> DataFrame:
    """(entity, month, year): rows, those that pass the record-wise filters one after the other, and sum and count of value; one scan."""
    out, so_far = [F.count("*").alias("all_records")], F.lit(True)
    tests: list[tuple[str, Column]] = [
        ("measured", F.col("qc") == 0), ("daytime", F.col("light_pot") > light_cut),
        ("complete_predictors", reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in predictors])), ("complete_cases", F.col(target).isNotNull()),
    ]
    for name, test in tests:
        so_far = so_far & test
        out.append(F.count_if(so_far).alias(name))
    return df.groupBy("entity", F.month("ts").alias("month"), F.year("ts").alias("year")).agg(*out, F.sum(value).alias("_sum"), F.count(value).alias("_n"))


def funnel(counts: DataFrame) -> DataFrame:
    """Rows per entity left after each filter, from monthly_counts: peak months and balanced years are decided on its few rows."""
    months = counts.groupBy("entity", "month").agg((F.sum("_sum") / F.sum("_n")).alias("mean")).where("mean is not null")
    peaks = months.withColumn("rank", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("mean"), "month"))).where(F.col("rank") <= PEAK_MONTHS)
    rows = counts.join(peaks.select("entity", "month", F.lit(True).alias("_peak")), ["entity", "month"], "left").withColumn("_peak", F.coalesce("_peak", F.lit(False)))
    # the years of a peak month that have rows left, the latest first
    rows = rows.withColumn("_open", F.col("_peak") & (F.col("daytime") > 0))
    rows = rows.withColumn("_recency", F.sum(F.col("_open").cast("int")).over(W.partitionBy("entity", "month").orderBy(F.desc("year"))))
    least = rows.where("_open").groupBy("entity", "month").agg(F.count("*").alias("n")).groupBy("entity").agg(F.min("n").alias("_m"))
    rows = rows.join(least, "entity", "left").withColumn("_kept", F.coalesce(F.col("_open") & (F.col("_recency") <= F.col("_m")), F.lit(False)))
    of = lambda test, c: F.coalesce(F.sum(F.when(F.col(test), F.col(c))), F.lit(0)).cast("long")
    return rows.groupBy("entity").agg(
        F.sum("all_records").alias("all_records"), F.sum("measured").alias("measured"), F.sum("daytime").alias("daytime"), of("_peak", "daytime").alias("peak"), of("_kept", "daytime").alias("balanced"),
        of("_kept", "complete_predictors").alias("complete_predictors"), of("_kept", "complete_cases").alias("complete_cases"),
    )


def basic_stats(df: DataFrame, columns: list[str], total: str) -> DataFrame:
    """Dates, records, calendar years spanned, mean and count of each column, yearly sum of `total`."""
    years = F.year(F.max("ts")) - F.year(F.min("ts")) + 1
    per = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("n", F.count))]
    return df.groupBy("entity").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_date"), F.count("*").alias("n_records"), years.cast("long").alias("n_years"), *per, F.try_divide(F.sum(total), years).alias(f"{total}_per_year"))


def subset_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per entity and column: min, max, mean (_z0), sample SD (_sd), mean plus and minus two SD."""
    out = []
    for c in columns:
        m, s = F.avg(c), F.stddev_samp(c)
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), m.alias(f"{c}_z0"), s.alias(f"{c}_sd"), (m + 2 * s).alias(f"{c}_zp2"), (m - 2 * s).alias(f"{c}_zm2")]
    return df.groupBy("entity").agg(F.count("*").alias("n_records"), *out)
