"""Curves and fits: interpolation, polynomials by orthogonal recurrence, crossings, peaks, smoothers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interp_grid(curve: DataFrame, keys: list[str], start: float, step: float, n: int, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, grid_ix, y): linear interpolation at start + step * i, within each curve's own range only.

    Every segment between neighbouring points makes the grid points it holds, so
    there is no join; the last point gives none.
    """
    w = W.partitionBy(*keys).orderBy(x)
    seg = curve.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1")).where("x1 is not null")
    low = F.greatest(F.lit(0), F.floor((F.col("x0") - start) / step))
    high = F.least(F.lit(n - 1), F.ceil((F.col("x1") - start) / step))
    pts = seg.where(low <= high).withColumn("grid_ix", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    g = start + step * F.col("grid_ix")
    pts = pts.where((g >= F.col("x0")) & (g < F.col("x1")))
    return pts.select(*keys, "grid_ix", (F.col("y0") + (g - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("y"))


def _poly(z: Column, alphas: list[Column], betas: list[Column]) -> list[Column]:
    """p_0 .. p_d at z by the three-term recurrence."""
    ps = [F.lit(1.0)]
    for k in range(len(alphas)):
        nxt = (z - alphas[k]) * ps[k]
        if k:
            nxt = nxt - betas[k] * ps[k - 1]
        ps.append(nxt)
    return ps


def polyfit(points: DataFrame, keys: list[str], degree: int = 4, x: str = "x", y: str = "y") -> DataFrame:
    """Least-squares polynomial of each group, kept in the orthogonal basis of its own points.

    One row per group: n, x_min, x_max, a0.. and b0.. of the recurrence, norms
    q0.., coefficients c0.., sse, sst, r2, mse, aic.  A group's points, scaled to
    -1..1, become 3 * degree + 4 sums in one partial aggregation, so a group of any
    size is spread; the recurrence then runs on one row per group.  Groups need
    more than degree + 1 points and more than one x.
    """
    pts = points.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])
    span = pts.groupBy(*keys).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.avg("y").alias("y_mean"))
    z = (F.col("x") - (F.col("x_min") + F.col("x_max")) / 2) / ((F.col("x_max") - F.col("x_min")) / 2)
    scaled = pts.join(span.where("x_max > x_min"), keys).select(*keys, "x_min", "x_max", "y_mean", z.alias("z"), (F.col("y") - F.col("y_mean")).alias("v"))
    powers = lambda k: F.lit(1.0) if k == 0 else F.pow(F.col("z"), F.lit(float(k)))
    sums = scaled.groupBy(*keys, "x_min", "x_max", "y_mean").agg(
        F.count("*").alias("n"), F.array(*[F.sum(powers(k)) for k in range(2 * degree + 1)]).alias("m"), F.array(*[F.sum(powers(k) * F.col("v")) for k in range(degree + 1)]).alias("t"), F.sum(F.col("v") * F.col("v")).alias("sst")
    )
    names = [f"{c}{k}" for k in range(degree + 1) for c in "abcq"]

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m, t = np.stack(pdf["m"]), np.stack(pdf["t"])
            half, mid, mean = (pdf["x_max"] - pdf["x_min"]).to_numpy() / 2, (pdf["x_max"] + pdf["x_min"]).to_numpy() / 2, pdf["y_mean"].to_numpy()
            size = degree + 1
            inner = lambda p, q, shift=0: sum(p[:, i] * q[:, j] * m[:, i + j + shift] for i in range(size) for j in range(size) if i + j + shift <= 2 * degree)
            last, p, q_last, explained = np.zeros((len(m), size)), np.zeros((len(m), size)), np.ones(len(m)), np.zeros(len(m))
            p[:, 0] = 1
            out = {}
            with np.errstate(divide="ignore", invalid="ignore"):
                for k in range(size):
                    q = inner(p, p)
                    c = (p * t).sum(axis=1) / q
                    a = inner(p, p, 1) / q if k < degree else np.zeros(len(m))
                    b = q / q_last if k else np.zeros(len(m))
                    explained += c * c * q
                    out[f"a{k}"], out[f"b{k}"], out[f"q{k}"], out[f"c{k}"] = mid + half * a, half**2 * b, half ** (2 * k) * q, c / half**k + (mean if k == 0 else 0)
                    step = np.concatenate((np.zeros((len(m), 1)), p[:, :-1]), axis=1) - a[:, None] * p - b[:, None] * last
                    last, p, q_last = p, step, q
            frame = pdf.drop(columns=["m", "t", "y_mean"]).assign(**{n: out[n] for n in names})
            frame["sse"] = np.maximum(0, frame["sst"] - explained)
            yield frame[np.isfinite(frame[names]).all(axis=1)]

    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x_min double, x_max double, n long, sst double", *(f"{c} double" for c in names), "sse double"])
    order = [*keys, "x_min", "x_max", "n", "sst", *names, "sse"]
    ready = sums.where(F.col("n") > degree + 1).select(*keys, F.col("x_min").cast("double").alias("x_min"), F.col("x_max").cast("double").alias("x_max"), "n", "sst", "y_mean", "m", "t")
    fit = ready.mapInPandas(lambda batches: (f[order] for f in solve(batches)), schema)
    n = F.col("n")
    return fit.withColumns({"r2": 1 - F.try_divide(F.col("sse"), F.col("sst")), "mse": F.col("sse") / (n - degree - 1), "aic": n * F.log(F.col("sse") / n) + 2 * (degree + 1)})


def _terms(degree: int, x: Column) -> list[Column]:
    return _poly(x, [F.col(f"a{i}") for i in range(degree)], [F.col(f"b{i}") for i in range(degree)])


def fitted(degree: int, x: Column | None = None) -> Column:
    """Value of a polyfit row's polynomial at x."""
    x = F.col("x") if x is None else x
    return sum((F.col(f"c{k}") * p for k, p in enumerate(_terms(degree, x))), F.lit(0.0))


def prediction_se(degree: int, x: Column | None = None) -> Column:
    """Standard error of a new observation at x."""
    x = F.col("x") if x is None else x
    lever = sum((p * p / F.col(f"q{k}") for k, p in enumerate(_terms(degree, x))), F.lit(1.0))
    return F.sqrt(F.col("mse") * lever)


def slope(degree: int, x: Column | None = None) -> Column:
    """First derivative of the fitted polynomial at x, by the derivative of the recurrence."""
    x = F.col("x") if x is None else x
    p = _terms(degree, x)
    d = [F.lit(0.0)]
    for k in range(degree):
        nxt = p[k] + (x - F.col(f"a{k}")) * d[k]
        if k:
            nxt = nxt - F.col(f"b{k}") * d[k - 1]
        d.append(nxt)
    return sum((F.col(f"c{k}") * v for k, v in enumerate(d)), F.lit(0.0))


def on_grid(fit: DataFrame, n: int) -> DataFrame:
    """fit rows repeated for n evenly spaced x from x_min to x_max, with grid_ix."""
    out = fit.withColumn("grid_ix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return out.withColumn("x", F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("grid_ix") / (n - 1))


def crossings(curve: DataFrame, keys: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """(keys, crossing): highest x at which y goes from above zero to zero or below, interpolated; NULL if it never does."""
    w = W.partitionBy(*keys).orderBy(x)
    nxt = curve.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    at = F.when((F.col("y0") > 0) & (F.col("y1") <= 0), F.col("x0") + F.col("y0") / (F.col("y0") - F.col("y1")) * (F.col("x1") - F.col("x0")))
    return nxt.groupBy(*keys).agg(F.max(at).alias("crossing"))


def ale_crossings(curve: DataFrame, keys: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """As crossings(), but NULL for curves that never go below zero or never above it."""
    signs = curve.groupBy(*keys).agg(F.min(y).alias("low"), F.max(y).alias("high"))
    return crossings(curve, keys, y, x).join(signs, keys).select(*keys, F.when((F.col("low") < 0) & (F.col("high") > 0), F.col("crossing")).alias("crossing"))


def curve_points(fit: DataFrame, keys: list[str], degree: int = 4, n: int = 2000, edge: float = 0.02) -> DataFrame:
    """Peak, steepest decline after it, crossing and minimum on a grid of n points, and whether each is within `edge` of the range's ends."""
    grid = on_grid(fit, n).select(*keys, "x_min", "x_max", "x", fitted(degree).alias("y"), slope(degree).alias("slope"))
    peaks = grid.groupBy(*keys).agg(F.max_by("x", F.struct("y", -F.col("x"))).alias("peak"), F.min_by("x", F.struct("y", "x")).alias("minimum"), F.first("x_min").alias("x_min"), F.first("x_max").alias("x_max"))
    after = grid.join(peaks.select(*keys, "peak"), keys).where("x >= peak").groupBy(*keys).agg(F.min_by("x", F.struct("slope", "x")).alias("steepest"))
    out = peaks.join(after, keys).join(crossings(grid, keys), keys)
    margin = (F.col("x_max") - F.col("x_min")) * edge
    near = lambda c: (F.col(c) <= F.col("x_min") + margin) | (F.col(c) >= F.col("x_max") - margin)
    return out.withColumns({f"{c}_edge": near(c) for c in ("peak", "steepest", "crossing", "minimum")})


def refine_peak(fit: DataFrame, keys: list[str], degree: int = 4, n: int = 200) -> DataFrame:
    """(keys, peak_x, peak_y): the highest grid point moved to the vertex of the parabola through its neighbours, within the range."""
    grid = on_grid(fit, n).select(*keys, "grid_ix", "x", fitted(degree).alias("y"))
    w = W.partitionBy(*keys).orderBy("grid_ix")
    trio = grid.withColumns({"yl": F.lag("y").over(w), "yr": F.lead("y").over(w), "xr": F.lead("x").over(w)})
    bend = F.col("yl") - 2 * F.col("y") + F.col("yr")
    shift = F.when(bend < 0, 0.5 * (F.col("yl") - F.col("yr")) / bend)
    trio = trio.withColumns({"peak_x": F.col("x") + F.coalesce(shift, F.lit(0.0)) * F.coalesce(F.col("xr") - F.col("x"), F.lit(0.0)), "peak_y": F.col("y") - F.coalesce(0.25 * (F.col("yl") - F.col("yr")) * shift, F.lit(0.0))})
    best = trio.groupBy(*keys).agg(F.max_by(F.struct("peak_x", "peak_y"), F.struct("y", -F.col("x"))).alias("p"))
    return best.select(*keys, "p.peak_x", "p.peak_y")


def rebin(points: DataFrame, keys: list[str], width: float, x: str = "x", y: str = "y", whole: bool = False) -> DataFrame:
    """Coarser bins from the least x of each group, or from the whole number below it: means of x and y."""
    first = points.groupBy(*keys).agg((F.floor(F.min(x)) if whole else F.min(x)).alias("_x0"))
    cell = F.floor((F.col(x) - F.col("_x0")) / width + 1e-9)
    return points.join(first, keys).groupBy(*keys, cell.alias("cell")).agg(F.avg(x).alias(x), F.avg(y).alias(y))


def lowess(points: DataFrame, keys: list[str], frac: float | Column = 0.6, iterations: int = 3, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, x, y, fit): local linear smoother with tricube weights over the nearest floor(frac * n) points, and robust reweighting.

    points holds one row per bin of a curve, so a group is small by construction
    (bins, not records) and travels as one row of two arrays.  frac may be one of
    the keys.
    """
    share = frac if isinstance(frac, Column) else F.lit(frac)
    pts = points.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), share.alias("_frac")).dropna(subset=["x", "y"])
    arr = pts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"), F.first("_frac").alias("_frac"))
    arr = arr.select(*keys, "_frac", F.transform("p", lambda v: v["x"].cast("double")).alias("_x"), F.transform("p", lambda v: v["y"].cast("double")).alias("_y"))

    def fit(px: np.ndarray, py: np.ndarray, share: float) -> np.ndarray:
        n = len(px)
        k = min(n, max(2, int(np.floor(share * n + 1e-10))))
        away = np.abs(px[:, None] - px[None, :])
        h = np.sort(away, axis=1)[:, k - 1 : k]
        near = np.where((h > 0) & (away < h), (1 - (away / np.where(h > 0, h, 1)) ** 3) ** 3, (away <= 0) * 1.0)
        robust = np.ones(n)
        for step in range(iterations + 1):
            w = near * robust
            with np.errstate(divide="ignore", invalid="ignore"):
                mx, my = (w * px).sum(1) / w.sum(1), (w * py).sum(1) / w.sum(1)
                dx, dy = px[None, :] - mx[:, None], py[None, :] - my[:, None]
                sxx = (w * dx * dx).sum(1)
                out = my + np.where(sxx > 1e-12, (w * dx * dy).sum(1) / sxx, 0.0) * (px - mx)
            off = np.abs(py - out)
            scale = 6 * np.nanmedian(off) if step < iterations and np.isfinite(off).any() else 0
            if scale <= 1e-7 * np.nanmean(off) or scale == 0:
                break  # most points are met exactly: nothing is left to weigh
            robust = np.where(off < scale, (1 - (off / scale) ** 2) ** 2, 0.0)
        return out

    def run(batches):
        for pdf in batches:
            fits = [fit(np.array(a), np.array(b), f) for a, b, f in zip(pdf["_x"], pdf["_y"], pdf["_frac"], strict=True)]
            yield pdf[keys].assign(x=pdf["_x"], y=pdf["_y"], fit=fits).explode(["x", "y", "fit"])

    kinds = dict(points.dtypes)
    out = arr.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x double, y double, fit double"]))
    return out.withColumn("fit", F.when(~F.isnan("fit"), F.col("fit")))
