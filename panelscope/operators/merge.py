"""Overlapping sources of one entity: resampling, merge by priority, metadata gaps, time alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import materialize
from .ordered import previous


def resample(df: DataFrame, minutes: int, means: list[str], lasts: list[str], by: str = "entity", ts: str = "ts") -> DataFrame:
    """Means of numbers and last texts of intervals closed on the left, stamped with the interval's middle."""
    w = F.window(ts, f"{minutes} minutes")
    out = df.groupBy(by, w.alias("w")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in means], *[F.max_by(c, ts).alias(c) for c in lasts])
    return out.withColumn(ts, F.col("w.end") - F.expr(f"make_dt_interval(0, 0, 0, {minutes * 30})")).drop("w")


def priority_merge(primary: DataFrame, secondary: DataFrame, by: str = "entity", ts: str = "ts", measured: str = "qc = 0") -> DataFrame:
    """Rows of two sources of each entity, with `status`.

    In the first year of the primary, the source with fewer measured rows drops
    that year (a tie drops none).  The source that ends later then leads; the
    other is cut off before the leader's first row.  Entities of one source pass
    unchanged ('single'); an entity that the first step leaves without rows of a
    source keeps all rows, marked 'emptied'; others are 'merged'.

    Everything about an entity is known from one small aggregate, which is
    written and joined back; rows are filtered, not sorted.
    """
    rows = primary.withColumn("_src", F.lit(1)).unionByName(secondary.withColumn("_src", F.lit(2)), allowMissingColumns=True).withColumn("_year", F.year(ts))
    # written, as the plan of every entity comes from it alone: a row per entity, source and year
    yearly = materialize(rows.groupBy(by, "_src", "_year").agg(F.count_if(F.expr(measured)).alias("m"), F.min(ts).alias("lo"), F.max(ts).alias("hi")))
    w = W.partitionBy(by)  # a source's years
    years = yearly.withColumns({"y0": F.min(F.when(F.col("_src") == 1, F.col("_year"))).over(w), "two": F.min("_src").over(w) != F.max("_src").over(w)})
    pick = lambda src: F.coalesce(F.max(F.when((F.col("_src") == src) & (F.col("_year") == F.col("y0")), F.col("m"))).over(w), F.lit(0))
    years = years.withColumns({"m1": pick(1), "m2": pick(2)})
    years = years.withColumn("drops", F.when(F.col("two") & (F.col("m1") > F.col("m2")), 2).when(F.col("two") & (F.col("m2") > F.col("m1")), 1).otherwise(0))
    left = ~F.coalesce((F.col("_src") == F.col("drops")) & (F.col("_year") == F.col("y0")), F.lit(False))
    side = lambda src, f, c: f(F.when(left & (F.col("_src") == src), F.col(c)))
    plan = years.groupBy(by).agg(*[F.max(c).alias(c) for c in ("y0", "drops", "two")], side(1, F.min, "lo").alias("lo1"), side(1, F.max, "hi").alias("hi1"), side(2, F.min, "lo").alias("lo2"), side(2, F.max, "hi").alias("hi2"))
    plan = plan.withColumn("status", F.when(~F.col("two"), "single").when(F.col("lo1").isNull() | F.col("lo2").isNull(), "emptied").otherwise("merged"))
    plan = plan.withColumn("leader", F.when(F.col("hi2") > F.col("hi1"), 2).otherwise(1)).withColumn("edge", F.when(F.col("leader") == 1, F.col("lo1")).otherwise(F.col("lo2")))
    out = rows.join(materialize(plan.select(by, "y0", "drops", "status", "leader", "edge")), by)
    keep = (F.col("status") != "merged") | (~((F.col("_src") == F.col("drops")) & (F.col("_year") == F.col("y0"))) & ((F.col("_src") == F.col("leader")) | (F.col(ts) < F.col("edge"))))
    return out.where(keep).drop("_src", "_year", "y0", "drops", "leader", "edge")


def merge_sources(sources: dict[str, DataFrame], meta: DataFrame, columns: list[str], allowed: list[str], by: str = "entity", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows, sites) of named sources in order of priority, merged one after the other.

    rows: the merged rows with their `source`.  sites: one row per entity with
    `origin` (its sources joined by '+'), `variable` (the first allowed one that
    its first source has), the metadata columns, filled from the source of best
    priority that has a value, and `status`: 'variable' if any of its sources
    lacks that variable, 'emptied' if a merge would have left a side without
    rows, 'duplicate' if a time occurs twice, else 'single' or 'merged'.  Rows of
    the first three are not fit for use; the reference stops at them.  Each merge
    is written, so that a task holds one merge's state however many sources there are.
    """
    named = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = named[0].withColumn("_emptied", F.lit(False))
    for nxt in named[1:]:
        out = priority_merge(out, nxt, by, ts)
        out = materialize(out.withColumn("_emptied", F.coalesce("_emptied", F.lit(False)) | (F.col("status") == "emptied")).drop("status"))
    present = [df.groupBy(by).agg(*[F.count(v).alias(v) for v in allowed]).withColumn("priority", F.lit(i)) for i, df in enumerate(named)]
    present = reduce(lambda a, b: a.unionByName(b), present)
    first = present.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("priority", *allowed))).alias("_p"))  # as many as there are sources
    first = first.withColumn("variable", F.coalesce(*[F.when(F.col("_p")[0][v] > 0, F.lit(v)) for v in allowed]))
    lacks = F.exists("_p", lambda p: ~F.coalesce(*[F.when(F.col("variable") == v, p[v] > 0) for v in allowed], F.lit(False)))
    first = materialize(first.select(by, "variable", lacks.alias("_lacks"), (F.size("_p") == 1).alias("_one")))
    state = materialize(out.groupBy(by).agg(F.max("_emptied").alias("_emptied"), (F.count("*") != F.count_distinct(ts)).alias("_twice")))
    status = F.when(F.col("_lacks"), "variable").when(F.col("_emptied"), "emptied").when(F.col("_twice"), "duplicate").when(F.col("_one"), "single").otherwise("merged")
    sites = first.join(state, by).withColumn("status", status).join(materialize(metadata_gapfill(meta, columns, by)), by, "left")
    return out.drop("_emptied"), materialize(sites.select(by, "origin", "variable", "status", *columns))


def metadata_gapfill(meta: DataFrame, columns: list[str], by: str = "entity", priority: str = "priority") -> DataFrame:
    """One row per entity: each column's value from the source of best priority that has one; origins joined by '+' in order."""
    best = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(priority))).alias(c) for c in columns]
    origin = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(priority, "origin"))), lambda s: s["origin"]), "+")
    return meta.groupBy(by).agg(origin.alias("origin"), *best)


def detect_variable(presence: DataFrame, allowed: list[str], by: str = "entity", name: str = "variable") -> DataFrame:
    """(entity, variable): first allowed variable that the entity has; NULL if none."""
    return presence.groupBy(by).agg(*[F.max(F.col(name) == a).alias(a) for a in allowed]).select(by, F.coalesce(*[F.when(F.col(a), F.lit(a)) for a in allowed]).alias(name))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def time_spine(df: DataFrame, step: str, by: str = "entity", ts: str = "ts") -> DataFrame:
    """df with empty rows for the missing steps between each entity's first and last row."""
    span = df.groupBy(by).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    spine = span.select(by, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(ts))
    return spine.join(df, [by, ts], "left")


def infer_frequency(df: DataFrame, by: str = "entity", ts: str = "ts") -> DataFrame:
    """(entity, seconds, n): most frequent step between neighbouring rows; ties go to the shorter one.

    A row's predecessor is found by ranges of (entity, time), so that a large
    entity is not sorted by one task.  Times are distinct within an entity.
    """
    at = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    steps = previous(df.select(by, ts), [by], [ts], [ts]).where("not _first").select(by, (at(ts) - at(f"_last.{ts}")).alias("seconds"))
    counts = steps.groupBy(by, "seconds").agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max_by(F.struct("seconds", "n"), F.struct("n", -F.col("seconds"))).alias("m")).select(by, "m.seconds", "m.n")


def overlap_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(kind, key): keys in both tables, only in the left, only in the right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), key)
    return tag(a.intersect(b), "both").union(tag(a.exceptAll(b), "left")).union(tag(b.exceptAll(a), "right"))
