"""Ranks, tests and association between variables."""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chi2_sf, normal_sf
from ..sources import materialize
from .ordered import placed, previous, quantiles, running_sum

#: Up to this number of values in the smaller group, ranks are tested by their exact distribution.
EXACT = 8


def average_rank(df: DataFrame, x: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Mid-ranks of x among its group's values that are not NULL.

    Rows of one value are counted first; the counts of distinct values are then
    summed up in order by ranges, so that no task sorts a whole group, and ranks
    are joined back.
    """
    by = by or []
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_c"))
    ranks = running_sum(counts, by, [x], F.col("_c"), out).withColumn(out, F.col(out) - (F.col("_c") - 1) / 2).drop("_c")
    return df.join(ranks, [*by, x], "left")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"))


def kruskal_wallis(df: DataFrame, x: str, group: str, groups: int) -> DataFrame:
    """One row: H with tie correction, and its p-value on groups - 1 degrees of freedom."""
    r = average_rank(df.where(F.col(x).isNotNull()), x, "_r")
    ties = r.groupBy(x).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    per = r.groupBy(group).agg(F.count("*").alias("n"), F.sum("_r").alias("s")).agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    out = per.crossJoin(F.broadcast(ties)).select(n, h.alias("h"))
    return out.withColumn("p", chi2_sf(F.col("h"), groups - 1))


def mann_whitney_pairs(df: DataFrame, x: str, group: str) -> DataFrame:
    """(a, b, n_a, n_b, u, p) for each pair of groups, two-sided.

    Where a group has up to EXACT values and no values are tied, p comes from the
    null distribution of U itself, otherwise from the normal approximation with
    tie and continuity correction.  df has one row per entity.  For each pair the
    two groups' values are ranked together.
    """
    v = df.where(F.col(x).isNotNull()).select(F.col(group).alias("g"), F.col(x).alias("x"))
    names = v.agg(F.collect_set("g").alias("all"))  # one row of group names
    # each value goes to the pairs of its group: one copy for each other group
    rows = v.crossJoin(F.broadcast(names)).withColumn("other", F.explode(F.array_except("all", F.array("g"))))
    rows = rows.select("g", "x", F.least("g", "other").alias("a"), F.greatest("g", "other").alias("b"))
    r = average_rank(rows, "x", "_r", ["a", "b"])
    ties = r.groupBy("a", "b", "x").agg(F.count("*").alias("t")).groupBy("a", "b").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    is_a = F.col("g") == F.col("a")
    s = r.groupBy("a", "b").agg(F.count_if(is_a).alias("n_a"), F.count_if(~is_a).alias("n_b"), F.sum(F.when(is_a, F.col("_r"))).alias("ra")).join(ties, ["a", "b"])
    na, nb = F.col("n_a"), F.col("n_b")
    n, u = na + nb, F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(u - na * nb / 2) - 0.5) / sd
    exact = (F.least(na, nb) <= EXACT) & (F.col("ties") == 0)
    out = s.select("a", "b", "n_a", "n_b", u.alias("u"), F.least(F.lit(1.0), 2 * normal_sf(z)).alias("p"), exact.alias("exact"))
    kinds = dict(out.dtypes)
    return out.mapInArrow(_exact_p, ", ".join(f"{c} {kinds[c]}" for c in out.columns if c != "exact"))


def u_tail(u: int, m: int, n: int) -> float:
    """P(U <= u) for samples of m and n values without ties.

    The numbers of orders with each U are the coefficients of the product of
    (1 - q^(n+i)) / (1 - q^i) over i to m; each factor is a shifted difference
    and a running sum in steps of i, in whole numbers.
    """
    ways = np.zeros(u + 1, object)
    ways[0] = 1
    for i in range(1, m + 1):
        if n + i <= u:
            ways[n + i :] = ways[n + i :] - ways[: u + 1 - n - i]
        for r in range(min(i, u + 1)):
            ways[r::i] = np.cumsum(ways[r::i])
    return float(Fraction(int(ways.sum()), comb(m + n, m)))


def _exact_p(batches):
    """A row for each pair of groups: those marked exact get their p."""
    for batch in batches:
        p = batch.column("p").to_pylist()
        for i, row in enumerate(batch.to_pylist()):
            if row["exact"]:
                few, many = sorted((row["n_a"], row["n_b"]))
                p[i] = min(1.0, 2 * u_tail(round(min(row["u"], few * many - row["u"])), few, many))
        names = [c for c in batch.schema.names if c != "exact"]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64()) if c == "p" else batch.column(c) for c in names], names)


def places(df: DataFrame, order: list[Column], out: str = "place", parts: int | None = None) -> DataFrame:
    """df with its rows' places in a total order, from 1."""
    return placed(df, [], order, out, parts)


def holm(df: DataFrame, p: str, order: list[str]) -> DataFrame:
    """Step-down adjusted p-values of a table of tests: the running maximum of min(1, p * (m - i))."""
    w = W.orderBy(p, *order)  # a family of tests is a handful of rows
    m = F.count("*").over(W.partitionBy(F.lit(0)))
    raw = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1))
    return df.withColumn("_adj", raw).withColumn(f"{p}_holm", F.max("_adj").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_adj")


def label_runs(df: DataFrame, label: str, order: str, by: list[str]) -> DataFrame:
    """(by, run, label, first, last, n): neighbouring rows of one label.

    Rows are compared with their predecessors by ranges of (by, order); a run
    that crosses ranges is stitched by the last row of the range before.  Rows of
    one group have unlike values of `order`.
    """
    seen = previous(df.select(*by, label, order), by, [order], [label])
    new = F.when(F.col("_first") | ~F.col(f"_last.{label}").eqNullSafe(F.col(label)), 1).otherwise(0)
    runs = running_sum(seen, by, [order], new, "run")
    return runs.groupBy(*by, "run").agg(F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def quartile_strata(df: DataFrame, x: str) -> DataFrame:
    """stratum 1 to 4 by the quartiles of x: right-closed, the first holds the minimum."""
    df = materialize(df)  # x computed again may differ in its last digit, and quartiles are values of x
    edges = quantiles(df, [], x, [0.25, 0.5, 0.75], "_e").select("_e")
    v, every = F.col(x), df.crossJoin(F.broadcast(edges)) if not edges.isEmpty() else df.withColumn("_e", F.lit(None).cast("array<double>"))
    return every.withColumn("stratum", F.when(v <= F.col("_e")[0], 1).when(v <= F.col("_e")[1], 2).when(v <= F.col("_e")[2], 3).when(v.isNotNull(), 4)).drop("_e")


def equal_width(df: DataFrame, x: str, n: int = 10) -> DataFrame:
    """class 1 to n of equal width over the range of x: right-closed, the first holds the minimum."""
    span = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    k = F.ceil((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * n)
    return df.crossJoin(F.broadcast(span)).withColumn("class_no", F.greatest(F.lit(1), k).cast("long")).drop("_lo", "_hi")


def ttest_1samp(df: DataFrame, x: str, mean: float, by: list[str] | None = None) -> DataFrame:
    n, v = F.count(x), F.col(x)
    return df.groupBy(*(by or [])).agg(n.alias("n"), ((F.avg(v) - mean) / (F.stddev_samp(v) / F.sqrt(n))).alias("t"))


def correlations(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row per group with the correlation of every pair, r_<i>_<j>, over complete rows; one pass."""
    d = df.dropna(subset=columns)
    return d.groupBy(*by).agg(F.count("*").alias("n"), *[F.corr(columns[i], columns[j]).alias(f"r_{i}_{j}") for i in range(len(columns)) for j in range(i)])


def _r(i: int, j: int) -> Column:
    return F.lit(1.0) if i == j else F.col(f"r_{max(i, j)}_{min(i, j)}")


def partial_correlations(df: DataFrame, target: str, features: list[str], by: list[str]) -> DataFrame:
    """(by, n, partial_<feature>): correlation of target and feature given the other features, from the inverse correlation matrix."""
    cols = [target, *features]
    c = correlations(df, cols, by)
    k = len(cols)
    # elimination step by step, as columns, keeps the expressions short
    for i in range(k):
        for j in range(i + 1):
            c = c.withColumn(f"m_{i}_{j}", _r(i, j))
    names = {(i, j): f"m_{max(i, j)}_{min(i, j)}" for i in range(k) for j in range(k)}
    inv = _sweep(c, names, k)
    return inv.select(*by, "n", *[F.try_divide(-F.col(names[0, f + 1]), F.sqrt(F.col(names[0, 0]) * F.col(names[f + 1, f + 1]))).alias(f"partial_{name}") for f, name in enumerate(features)])


def _sweep(df: DataFrame, names: dict, k: int) -> DataFrame:
    """Replace the symmetric matrix in columns names[i, j] by its inverse with the sweep operator."""
    for p in range(k):
        d = F.col(names[p, p])
        new = {}
        for i in range(k):
            for j in range(i + 1):
                if i == p and j == p:
                    new[names[i, j]] = F.try_divide(F.lit(-1.0), d)
                elif i == p or j == p:
                    new[names[i, j]] = F.try_divide(F.col(names[i, j]), d)
                else:
                    new[names[i, j]] = F.col(names[i, j]) - F.try_divide(F.col(names[i, p]) * F.col(names[p, j]), d)
        df = df.withColumns(new)
    return df.withColumns({names[i, j]: -F.col(names[i, j]) for i in range(k) for j in range(i + 1)})


def path_coefficients(df: DataFrame, target: str, features: list[str], by: list[str]) -> DataFrame:
    """Standardised regression coefficients path_<feature> and r2, with the features' pairwise correlations."""
    c = correlations(df, [*features, target], by)
    k = len(features)
    for i in range(k):
        for j in range(i + 1):
            c = c.withColumn(f"m_{i}_{j}", _r(i, j))
    names = {(i, j): f"m_{max(i, j)}_{min(i, j)}" for i in range(k) for j in range(k)}
    inv = _sweep(c, names, k)
    beta = [sum((F.col(names[i, j]) * _r(k, j) for j in range(k)), F.lit(0.0)) for i in range(k)]
    out = inv.withColumns({f"path_{f}": b for f, b in zip(features, beta, strict=True)})
    out = out.withColumn("r2", sum((F.col(f"path_{f}") * _r(k, i) for i, f in enumerate(features)), F.lit(0.0)))
    pairs = {f"corr_{features[i]}_{features[j]}": F.col(f"r_{i}_{j}") for i in range(k) for j in range(i)}
    return out.select(*by, "n", *[f"path_{f}" for f in features], "r2", *[v.alias(n) for n, v in pairs.items()])


def method_agreement(scores: DataFrame, by: list[str]) -> DataFrame:
    """Ranks features (by, feature, effect_range, partial, path) by the mean of the three sizes, with strength and sign agreement."""
    size = (F.abs("effect_range") + F.abs("partial") + F.abs("path")) / 3
    up = sum(((F.col(c) > 0).cast("int") for c in ("effect_range", "partial", "path")), F.lit(0))
    w = W.partitionBy(*by).orderBy(F.desc("size"), "feature")
    out = scores.withColumn("size", size).withColumn("rank", F.row_number().over(w))
    strength = F.when(F.col("size") >= 0.5, "strong").when(F.col("size") >= 0.2, "moderate").otherwise("weak")
    return out.withColumns({"strength": strength, "agreement": F.greatest(up, 3 - up).cast("long")})
