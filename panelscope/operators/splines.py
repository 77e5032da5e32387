"""Cubic splines per group: penalised ones from sums made in Spark, and smoothing splines with knots where residuals ask for them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENALTIES = np.logspace(-6, 6, 49)


def basis(u: Column, n: int) -> list[Column]:
    """n uniform cubic B-splines on u in 0..1."""
    t = u * (n - 3)
    out = []
    for i in range(n):
        s = t - (i - 3)
        out.append(
            F.when((s >= 0) & (s < 1), s * s * s / 6)
            .when((s >= 1) & (s < 2), (-3 * s * s * s + 12 * s * s - 12 * s + 4) / 6)
            .when((s >= 2) & (s < 3), (3 * s * s * s - 24 * s * s + 60 * s - 44) / 6)
            .when((s >= 3) & (s <= 4), (4 - s) * (4 - s) * (4 - s) / 6).otherwise(0.0)
        )
    return out


def penalized_spline(points: DataFrame, keys: list[str], n: int = 12, n_grid: int = 100, x: str = "x", y: str = "y", residual: float | None = None) -> DataFrame:
    """(keys, x, fit, se, edf, penalty): spline with the penalty of least generalised cross-validation.

    With `residual`, the largest penalty is taken whose squared residuals stay
    within that share of the points' variance (the least penalty, if none does).

    A group's points become n (n + 1) / 2 sums in one aggregation; what goes to
    the solver is one row per group, whatever the number of points.
    """
    span = points.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    rows = points.join(span, keys).where("hi > lo")
    b = basis((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")), n)
    rows = rows.select(*keys, "lo", "hi", F.col(y).alias("y"), *[c.alias(f"b{i}") for i, c in enumerate(b)])
    sums = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")) for i in range(n) for j in range(n)]
    agg = rows.groupBy(*keys, "lo", "hi").agg(F.array(*sums).alias("xtx"), F.array(*[F.sum(F.col(f"b{i}") * F.col("y")) for i in range(n)]).alias("xty"), F.sum(F.col("y") * F.col("y")).alias("yty"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    diff = np.diff(np.eye(n), 2, axis=0)
    penalty = diff.T @ diff

    def solve(batches):
        grid = np.linspace(0, 1, n_grid)
        t = grid * (n - 3)
        s = t[:, None] - (np.arange(n)[None, :] - 3)
        phi = np.select([(s >= 0) & (s < 1), (s >= 1) & (s < 2), (s >= 2) & (s < 3), (s >= 3) & (s <= 4)], [s**3 / 6, (-3 * s**3 + 12 * s**2 - 12 * s + 4) / 6, (3 * s**3 - 24 * s**2 + 60 * s - 44) / 6, (4 - s) ** 3 / 6], 0.0)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                a, c = np.array(row.xtx).reshape(n, n), np.array(row.xty)
                best = None
                for lam in PENALTIES:
                    inv = np.linalg.pinv(a + lam * penalty)
                    beta = inv @ c
                    edf = float(np.trace(inv @ a))
                    rss = max(0.0, row.yty - 2 * beta @ c + beta @ a @ beta)
                    if row.n > edf + 1e-9:
                        if residual is None:
                            rank = row.n * rss / (row.n - edf) ** 2
                        else:
                            rank = -lam if rss <= residual * max(0.0, row.yty - row.sy**2 / row.n) else np.inf
                        if best is None or rank < best[0]:
                            best = (rank, lam, beta, edf, inv @ a @ inv * rss / (row.n - edf))
                if best is None:
                    continue
                _, lam, beta, edf, cov = best
                part = pd.DataFrame({k: [getattr(row, k)] * n_grid for k in keys})
                part["x"] = row.lo + (row.hi - row.lo) * grid
                part["fit"], part["se"] = phi @ beta, np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", phi, cov, phi)))
                part["edf"], part["penalty"] = edf, lam
                out.append(part)
            if out:
                yield pd.concat(out)

    kinds = dict(points.dtypes)
    return agg.mapInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x double, fit double, se double, edf double, penalty double"]))


def _basis(knots: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cubic B-splines of a knot vector with fourfold ends, by the two-term recurrence; x by basis function."""
    m = len(knots) - 1
    at = np.clip(np.searchsorted(knots, x, side="right") - 1, 3, m - 4)
    b = np.zeros((len(x), m))
    b[np.arange(len(x)), at] = 1.0
    for d in range(1, 4):
        low, high = knots[: m - d], knots[1 + d : m + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(knots[d:m] > low, (x[:, None] - low) / (knots[d:m] - low), 0.0)
            down = np.where(high > knots[1 : m + 1 - d], (high - x[:, None]) / (high - knots[1 : m + 1 - d]), 0.0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


def _jumps(knots: np.ndarray) -> np.ndarray:
    """Jumps of the third derivative of each cubic B-spline at the inner knots."""
    c = np.eye(len(knots) - 4)
    for d in (3, 2, 1):
        inner = knots[4 - d : len(knots) - 4 + d]
        c = np.diff(c, axis=0) * (d / (inner[d:] - inner[:-d]))[:, None]
    return np.diff(c, axis=0)


def smooth(x: np.ndarray, y: np.ndarray, residual: float) -> tuple[np.ndarray, np.ndarray]:
    """(knots, coefficients) of the smoothing spline through rising x whose squared residuals are a share `residual` of the variance.

    Knots are set one by one, at a point in the middle of the stretch between two
    knots that has the largest squared residuals, until least squares meets the
    target.  With these knots, the spline whose third derivative jumps least and
    that meets it is found by bisection of the weight of the jumps.
    """
    target = residual * ((y - y.mean()) ** 2).sum()
    ends = lambda inner: np.concatenate([np.full(4, x[0]), np.sort(inner), np.full(4, x[-1])])
    inner: list[float] = []
    while True:
        knots = ends(inner)
        basis = _basis(knots, x)
        c = np.linalg.lstsq(basis, y, rcond=None)[0]
        off = (y - basis @ c) ** 2
        if off.sum() <= target or len(inner) >= len(x) - 4:
            break
        stretch = np.searchsorted(np.sort(inner), x, side="right")
        free = [(off[stretch == i].sum(), np.flatnonzero((stretch == i) & ~np.isin(x, inner) & (x > x[0]) & (x < x[-1]))) for i in range(len(inner) + 1)]
        free = [(size, i, at) for i, (size, at) in enumerate(free) if len(at)]
        if not free:
            break
        _, _, at = max(free, key=lambda f: (f[0], -f[1]))
        inner.append(float(x[at[len(at) // 2]]))
    if not inner or off.sum() >= target:
        return knots, c
    jumps = _jumps(knots)
    scale = np.sqrt((basis**2).sum() / (jumps**2).sum())

    def weighed(log_weight):
        a = np.vstack([basis, 10.0**log_weight * scale * jumps])
        c = np.linalg.lstsq(a, np.concatenate([y, np.zeros(len(jumps))]), rcond=None)[0]
        return c, ((y - basis @ c) ** 2).sum()

    low, high = -12.0, 8.0
    if weighed(high)[1] <= target:
        return knots, weighed(high)[0]
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if weighed(middle)[1] <= target else (low, middle)
    return knots, weighed(low)[0]


def smoothing_spline(points: DataFrame, keys: list[str], residual: float, n_grid: int = 1000, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, x, fit, knots): each group's smoothing spline on an even grid, and its number of inner knots.

    points has a row per bin of a curve, so a group's points are one array;
    points of one x count by their mean.  Groups of fewer than four are left out.
    """
    means = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x).agg(F.avg(y).alias("y"))
    rows = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), "y"))).alias("p")).where(F.size("p") >= 4)
    rows = rows.select(*keys, F.transform("p", lambda s: s["x"]).alias("px"), F.transform("p", lambda s: s["y"]).alias("py"))

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                px = np.array(row.px)
                knots, c = smooth(px, np.array(row.py), residual)
                part = pd.DataFrame({k: [getattr(row, k)] * n_grid for k in keys})
                part["x"] = np.linspace(px[0], px[-1], n_grid)
                part["fit"], part["knots"] = _basis(knots, part.x.to_numpy()) @ c, len(knots) - 8
                out.append(part)
            if out:
                yield pd.concat(out)

    kinds = dict(points.dtypes)
    return rows.mapInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x double, fit double, knots int"]))
