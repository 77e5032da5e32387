"""Order inside groups of any size: running sums, predecessors and exact quantiles without a task that holds a whole group.

Rows are dealt by ranges of (group, order), so a large group is cut into many
ranges and equal keys stay together.  Work inside a range is local; what one
range hands to the next is one small row per range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import materialize

#: Values that a task may hold of one group.
HELD = 10_000
#: Values that a sketch splits a larger group at, and the sketch's accuracy (its buffers hold a few times as many values).
SPLITS, ACCURACY = 64, 1_000


def ranged(df: DataFrame, by: list[str], order: list[Column | str], parts: int | None = None) -> DataFrame:
    """df with _part, the number of its range of (by, order); written, so that all that follows sees the same ranges."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))


def _carried(rows: DataFrame, by: list[str], per: DataFrame, name: str) -> DataFrame:
    """rows with the column `name` that per has by range and group; written, as Spark broadcasts what it knows to be small."""
    per = materialize(per.select("_part", *by, name))
    same = F.col("a._part") == F.col("b._part")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return rows.alias("a").join(per.alias("b"), same).select("a.*", f"b.{name}")


def running_sum(df: DataFrame, by: list[str], order: list[Column | str], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """df with the sum of value over the group's rows up to and including each row, in an order without ties."""
    rows = ranged(df.withColumn("_v", value), by, order, parts)
    w = W.partitionBy(*by).orderBy("_part")  # as many rows as a group has ranges
    before = rows.groupBy("_part", *by).agg(F.sum("_v").alias("_s")).withColumn("_before", F.sum("_s").over(w) - F.col("_s"))
    local = rows.withColumn("_here", F.sum("_v").over(W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return _carried(local, by, before, "_before").withColumn(out, F.col("_before") + F.col("_here")).drop("_part", "_v", "_here", "_before")


def placed(df: DataFrame, by: list[str], order: list[Column | str], out: str, parts: int | None = None) -> DataFrame:
    """df with the place of each row in its group, from 1, in an order without ties.

    Ranges are written in their order with consecutive numbers, so rows are
    shuffled once and sorted once; places differ from numbers by one value per
    range and group.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the upper bits of the number are the range's
    rows = materialize(df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_seq", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_seq", 33))
    w = W.partitionBy(*by).orderBy("_part")  # as many rows as a group has ranges
    shift = rows.groupBy("_part", *by).agg(F.count("*").alias("_c"), F.min("_seq").alias("_lo")).withColumn("_shift", F.sum("_c").over(w) - F.col("_c") - F.col("_lo") + 1)
    return _carried(rows, by, shift, "_shift").withColumn(out, F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")


def previous(df: DataFrame, by: list[str], order: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """df with _first (no row of its group comes before) and _last, a struct of the values of the row before, in an order without ties."""
    rows = ranged(df, by, order, parts)
    v = F.struct(F.lit(1).alias("_one"), *values)
    ends = rows.groupBy("_part", *by).agg(F.max_by(v, F.struct(*order)).alias("_end"))
    edges = ends.withColumn("_edge", F.lag("_end").over(W.partitionBy(*by).orderBy("_part"))).drop("_end")
    local = rows.withColumn("_last", F.lag(v).over(W.partitionBy("_part", *by).orderBy(*order)))
    both = _carried(local, by, edges, "_edge")
    return both.withColumn("_last", F.coalesce("_last", "_edge")).withColumn("_first", F.col("_last").isNull()).drop("_part", "_edge")


# -- quantiles ---------------------------------------------------------------
_G = ["_group", "_path"]


def _slots(live: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their slot, chosen slots) of groups too large to hold.

    A sketch of bounded size gives each group SPLITS values of its own.  Slot
    2i lies between two of them, slot 2i + 1 holds one of them, so ties are
    counted, never sorted.  Counting the slots tells in which ones the ranks lie.
    """
    at = F.array(*[F.lit((i + 0.5) / SPLITS) for i in range(SPLITS)])
    edges = live.join(large.select(*_G), _G, "left_semi").groupBy(*_G).agg(F.array_sort(F.array_distinct(F.percentile_approx("x", at, ACCURACY))).alias("edges"))
    info = materialize(large.join(edges, _G))
    dealt = live.join(info.select(*_G, "edges"), _G)
    dealt = dealt.withColumn("slot", F.size(F.filter("edges", lambda e: e < F.col("x"))) * 2 + F.array_contains("edges", F.col("x")).cast("int"))
    w = W.partitionBy(*_G).orderBy("slot")  # as many rows as slots
    counted = dealt.groupBy(*_G, "slot").agg(F.count("*").alias("c")).withColumn("below", F.sum("c").over(w) - F.col("c")).join(info, _G)
    inside = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c")))
    chosen = counted.withColumn("ranks", inside).where(F.size("ranks") > 0)
    return dealt.drop("edges"), materialize(chosen.select(*_G, "slot", "c", "below", "ranks", "off", "edges"))


def order_statistics(df: DataFrame, by: list[str], x: str, ranks: Column, held: int = HELD) -> DataFrame:
    """(by, n, found): a map from the ranks sought (from 0; an array column over n) to the values of each group there, exactly.

    Groups of up to `held` values are sorted in one row.  Of larger ones only the
    values in the slots of the ranks sought go on to the next pass, each slot as
    a group of its own.  by has columns without NULL; NULL and NaN values do not
    count, and a group that has no others is missing.
    """
    v = F.col(x).cast("double")
    # zeros of both signs are one value
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.struct(F.lit(0).alias("_"), *by).alias("_group"), F.lit("").alias("_path"), (v + F.lit(0.0)).alias("x"))
    rows = materialize(rows)  # two columns, read once for each pass
    info = materialize(rows.groupBy(*_G).agg(F.count("*").alias("n")).withColumns({"ranks": F.array_distinct(ranks), "off": F.lit(0).cast("long")}))
    sizes, live, found = info.select("_group", "n"), rows, []
    while True:
        few = info.where(F.col("n") <= held)
        small = live.join(few.select(*_G), _G, "left_semi").groupBy(*_G).agg(F.array_sort(F.collect_list("x")).alias("a"))
        sorted_ = small.join(few.select(*_G, "ranks", "off"), _G)
        found.append(sorted_.select("_group", F.explode("ranks").alias("r"), "off", "a").select("_group", (F.col("r") + F.col("off")).alias("rank"), F.element_at("a", (F.col("r") + 1).cast("int")).alias("x")))
        large = info.where(F.col("n") > held)
        if large.isEmpty():
            break
        dealt, chosen = _slots(live, large)
        ties = chosen.where("slot % 2 = 1").select("_group", F.explode("ranks").alias("r"), "off", F.element_at("edges", F.expr("slot div 2 + 1").cast("int")).alias("x"))
        found.append(ties.select("_group", (F.col("r") + F.col("off")).alias("rank"), "x"))
        step = F.concat_ws(",", F.col("_path"), F.col("slot").cast("string"))
        open_ = chosen.where("slot % 2 = 0")
        live = materialize(dealt.join(open_.select(*_G, "slot"), [*_G, "slot"], "left_semi").select("_group", step.alias("_path"), "x"))
        info = materialize(open_.select("_group", step.alias("_path"), F.col("c").alias("n"), F.transform("ranks", lambda r: r - F.col("below")).alias("ranks"), (F.col("off") + F.col("below")).alias("off")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    maps = every.groupBy("_group").agg(F.map_from_entries(F.collect_set(F.struct("rank", "x"))).alias("found"))
    return maps.join(sizes, "_group").select(*[F.col("_group")[c].alias(c) for c in by], "n", "found")


def quantiles(df: DataFrame, by: list[str], x: str, probabilities: list[float], out: str = "q", held: int = HELD) -> DataFrame:
    """(by, n, out): exact quantiles of x by group, one array in the order of the probabilities, interpolated between neighbouring values."""
    n, p = F.col("n"), F.array(*[F.lit(float(v)) for v in probabilities])
    got = order_statistics(df, by, x, F.flatten(F.transform(p, lambda v: F.array(F.floor(v * (n - 1)), F.ceil(v * (n - 1))))), held)

    def between(v):
        place = v * (n - 1)
        low, high = F.floor(place), F.ceil(place)
        # from the lower value on, so that between equal neighbours the quantile is their value to the last digit
        a, b = F.col("found")[low], F.col("found")[high]
        return F.when(low == high, a).otherwise(a + (b - a) * (place - low))

    return got.select(*by, "n", F.transform(p, between).alias(out))
