"""Joins: metadata, unions of sources, matching within calipers, dense grids, count checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import materialize

#: Right rows in a cell of the finest grid, about.
CROWD = 8


def kv_pivot(eav: DataFrame) -> DataFrame:
    """One row per site of key/value metadata: igbp, elev, lat, long; text that is no number becomes NULL."""
    names = {"IGBP": "igbp", "LOCATION_ELEV": "elev", "LOCATION_LAT": "lat", "LOCATION_LONG": "long"}
    wide = eav.where(F.col("variable").isin(*names)).groupBy("site").pivot("variable", list(names)).agg(F.first("datavalue", ignorenulls=True))
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    return wide.select("site", F.col("IGBP").alias("igbp"), *[number(k).alias(v) for k, v in names.items() if k != "IGBP"])


def enrich(sites: DataFrame, places: DataFrame, key: str, how: str) -> DataFrame:
    """Sites with the place's columns ('inner' drops sites without place, 'left' keeps them); the unit is cut off elevations."""
    out = sites.join(places, key, how)
    return out.withColumns({"how": F.lit(how), "elevation": F.expr("try_cast(regexp_replace(elevation, '[^0-9.eE+-]', '') as double)")})


def union_sources(sources: dict[str, DataFrame], priority: dict[str, int], class_col: str, allowed: list) -> DataFrame:
    """All sources' rows of the allowed classes, with source and priority; columns that a source lacks are NULL."""
    tagged = [df.withColumns({"source": F.lit(name), "priority": F.lit(priority[name])}) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).where(F.col(class_col).isin(*allowed))


def outer_timestamp(left: DataFrame, right: DataFrame, on: str, shared: list[str]) -> DataFrame:
    """Full outer merge on a timestamp that each side has once; shared columns take the left value, else the right one."""
    r = right.select(on, *[F.col(c).alias(f"_{c}") if c in shared else c for c in right.columns if c != on])
    return left.join(r, on, "full").withColumns({c: F.coalesce(c, f"_{c}") for c in shared}).drop(*[f"_{c}" for c in shared])


def _rings(left: DataFrame, right: DataFrame, groups: list[str], on: list[str], width: float, caliper: float) -> DataFrame:
    """(groups, on, d2, b_row): the nearest right row in the cells of `width` around each left row, within the caliper."""
    near = left
    for i, c in enumerate(on):
        near = near.withColumn(f"_c{i}", F.explode(F.array(*[F.floor(F.col(c) / width) + d for d in (-1, 0, 1)])))
    cells = right.select(*groups, "b_row", *[F.col(c).alias(f"b_{c}") for c in on], *[F.floor(F.col(c) / width).alias(f"_c{i}") for i, c in enumerate(on)])
    pairs = near.join(cells, [*groups, *[f"_c{i}" for i in range(len(on))]])
    pairs = pairs.where(reduce(lambda p, q: p & q, [F.abs(F.col(c) - F.col(f"b_{c}")) <= caliper for c in on]))
    d2 = reduce(lambda p, q: p + q, [(F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in on])
    # rounded, so that equal distances are ties whatever the order of sums
    return pairs.groupBy(*groups, *on).agg(F.min(F.struct(F.round(d2, 9).alias("d2"), F.col("b_row"))).alias("best"))


def caliper_nearest(left: DataFrame, right: DataFrame, on: list[str], caliper: float, order: list[str], by: str = "entity", strict: bool = False, ts: str = "ts", crowd: int = CROWD) -> DataFrame:
    """Each left row with its nearest right row of the same entity: match (its `order` columns) and d2, NULL if none.

    All differences of the `on` columns are at most the caliper; strict also asks
    for the same month and hours at most one apart.  Right rows may match many
    times; ties go to the earliest by time, then by `order`.

    Rows meet in cells of a nested grid, as equi-joins.  The finest cells are so
    small that about `crowd` right rows are in one; a left row whose best match
    there is nearer than a cell's width is done, as no row outside the ring of
    cells around it can be nearer.  The others go on with cells twice as wide,
    up to the caliper.  Rows that stand at one place are one row in the joins.
    """
    month, hour = F.month(ts), F.hour(ts)
    groups = [by, *(["_month", "_hour"] if strict else [])]
    times = {"_month": month, "_hour": hour} if strict else {}
    rows = materialize(left.withColumns(times))  # matches are joined back by the values of `on`, which may differ in their last digit when computed again
    places = rows.dropna(subset=on).select(*groups, *on).distinct()
    b = right.dropna(subset=on).withColumns(times).withColumn("b_row", F.struct(ts, *[c for c in order if c != ts]))
    if strict:  # a right row serves the hours around its own
        b = b.withColumn("_hour", F.explode(F.array(*[F.col("_hour") + d for d in (-1, 0, 1)])))
    b = materialize(b.groupBy(*groups, *on).agg(F.min("b_row").alias("b_row")))
    most = b.groupBy(*groups, *[F.floor(F.col(c) / caliper) for c in on]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = 0
    while most > crowd * 2 ** (levels * len(on)):
        levels += 1
    open_, done = materialize(places), []
    for level in range(levels, -1, -1):
        width = caliper / 2**level
        best = _rings(open_, b, groups, on, width, caliper)
        if level == 0:
            done.append(best)
            break
        # d2 is rounded: a little less than the width keeps ties outside the ring from being missed
        best = materialize(best.where(F.col("best.d2") + 1e-8 <= width * width))
        done.append(best)
        open_ = materialize(open_.join(best, [*groups, *on], "left_anti"))
    found = reduce(lambda p, q: p.unionByName(q), done)
    return rows.join(found, [*groups, *on], "left").select(*left.columns, F.col("best.b_row").alias("match"), F.col("best.d2").alias("d2"))


def densify(sparse: DataFrame, keys: list[str], bin_col: str, low: int, high: int) -> DataFrame:
    """Every key with every bin low..high; bins without rows are NULL."""
    spine = sparse.select(*keys).distinct().withColumn(bin_col, F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))))
    return spine.join(sparse, [*keys, bin_col], "left")


def check_counts(left: DataFrame, right: DataFrame, a: str, b: str, on: str = "entity") -> DataFrame:
    """Counts of two stages side by side, with whether they agree."""
    return left.join(right, on).withColumn("same", F.col(a) == F.col(b))
