"""Curves, fits and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import curves as C
from ..sources import materialize
from ..operators import splines
from ..operators import summaries as S
from ..operators import thresholds as T
from ..operators.ranks import average_rank, quartile_strata
from ..plans.panels import attributed, zpanel
from .base import VIEWS, query

# one point per entity and tenth of sigma; entities vary in shape by the entity's own term
VIEWS["b1"] = "SELECT entity, any_value(class) AS class, floor(dry_z * 10)::BIGINT AS bx, floor(dry_z * 10) / 10 AS x, avg(net) AS y, avg(phi_dry) AS yd, count(*) AS n FROM phi GROUP BY entity, floor(dry_z * 10)"
VIEWS["b1e"] = "SELECT * FROM b1 WHERE entity IN (SELECT entity FROM b1 GROUP BY entity HAVING count(*) >= 15)"
_B = "pn z phi b1 b1e"


def cells_of(rows):
    return rows.groupBy("entity", F.floor(F.col("dry_z") * 10).alias("bx")).agg(F.first("class").alias("class"), F.avg("net").alias("y"), F.avg("phi_dry").alias("yd"), F.count("*").alias("n")).withColumn("x", F.col("bx") / 10)


def binned(spark, sf):
    """One row per entity and tenth of sigma, written once: plans below start from it several times."""
    return materialize(cells_of(attributed(spark, sf)))


def curves15(spark, sf):
    return T.enough_bins(binned(spark, sf), ["entity"])


def _p(k: int, x: str = "x") -> str:
    """Text of the k-th orthogonal polynomial."""
    if k == 0:
        return "1.0"
    if k == 1:
        return f"({x} - a0)"
    return f"(({x} - a{k - 1}) * {_p(k - 1, x)} - b{k - 1} * {_p(k - 2, x)})"


def _val(d: int, x: str = "x") -> str:
    return "(" + " + ".join(f"c{k} * {_p(k, x)}" for k in range(d + 1)) + ")"


def fit_views(name: str, src: str, keys: str, degree: int = 4, y: str = "y") -> str:
    """Views of a polynomial fit of src's (x, y) by keys; returns their names, the last is name_fit."""
    names, prev = [], None
    for k in range(degree + 1):
        extra = f", count(*) AS n, min(x) AS x_min, max(x) AS x_max, var_pop({y}) * count(*) AS sst" if k == 0 else ""
        base = src if prev is None else f"{src} JOIN {prev} USING ({keys})"
        got = f"SELECT {keys}, sum({_p(k)} * {_p(k)}) AS q{k}, sum(x * {_p(k)} * {_p(k)}) / nullif(sum({_p(k)} * {_p(k)}), 0) AS a{k}, sum({y} * {_p(k)}) / nullif(sum({_p(k)} * {_p(k)}), 0) AS c{k}{extra} FROM {base} GROUP BY {keys}"
        v = f"{name}_{k}"
        if prev is None:
            VIEWS[v] = f"SELECT * FROM ({got}) WHERE n > {degree + 1}"
        else:
            VIEWS[v] = f"SELECT *, q{k} / nullif(q{k - 1}, 0) AS b{k} FROM {prev} JOIN ({got}) USING ({keys})"
        names.append(v)
        prev = v
    VIEWS[f"{name}_fit"] = f"SELECT *, 1 - sse / nullif(sst, 0) AS r2, sse / (n - {degree + 1}) AS mse, n * ln(sse / n) + {2 * (degree + 1)} AS aic FROM {prev} JOIN (SELECT {keys}, sum(({y} - {_val(degree)}) ** 2) AS sse FROM {src} JOIN {prev} USING ({keys}) GROUP BY {keys}) USING ({keys})"
    return " ".join([*names, f"{name}_fit"])


def grid_sql(fit: str, keys: str, n: int, degree: int = 4, cols: str = "") -> str:
    return f"SELECT {keys}, i AS grid_ix, x, {_val(degree)} AS y{cols} FROM (SELECT f.*, i, x_min + (x_max - x_min) * i / {n - 1} AS x FROM {fit} f, range({n}) t(i))"


def cross_sql(src: str, keys: str, y: str = "y") -> str:
    return f"SELECT {keys}, max(CASE WHEN y0 > 0 AND y1 <= 0 THEN x0 + y0 / (y0 - y1) * (x1 - x0) END) AS crossing FROM (SELECT {keys}, x AS x0, {y} AS y0, lead(x) OVER (PARTITION BY {keys} ORDER BY x) AS x1, lead({y}) OVER (PARTITION BY {keys} ORDER BY x) AS y1 FROM {src}) GROUP BY {keys}"


_F4 = fit_views("f4", "b1e", "entity")
VIEWS["g5"] = grid_sql("f4_fit", "entity", 500)
VIEWS["thr"] = cross_sql("g5", "entity")
_T = f"{_B} {_F4} g5 thr"


@query("polyfit_group", "entity n", "r2 aic mse c0 c1 c2", views=f"{_B} {_F4}", sql="SELECT * FROM f4_fit", digits=5)
def _(spark, sf):
    return C.polyfit(curves15(spark, sf), ["entity"])


_SE = "sqrt(mse * (1 + " + " + ".join(f"{_p(k)} ** 2 / q{k}" for k in range(5)) + "))"
_TQ = "(SELECT t FROM tq WHERE dof = v)"


@query("polyfit_prediction_band", "entity grid_ix", "y low high", views=f"{_B} tq {_F4}", digits=5, sql=f"SELECT entity, grid_ix, y, y - t * se AS low, y + t * se AS high FROM (SELECT *, {_TQ} AS t FROM ({grid_sql('f4_fit', 'entity', 50, cols=f', {_SE} AS se, (n - 5)::DOUBLE AS v')}))")
def _(spark, sf):
    from ..functions import t_quantile

    g = C.on_grid(C.polyfit(curves15(spark, sf), ["entity"]), 50)
    half = t_quantile((F.col("n") - 5).cast("double")) * C.prediction_se(4)
    return g.select("entity", "grid_ix", C.fitted(4).alias("y"), (C.fitted(4) - half).alias("low"), (C.fitted(4) + half).alias("high"))


@query("curve_grid_eval", "entity grid_ix", "x y", views=f"{_B} {_F4}", sql=grid_sql("f4_fit", "entity", 200))
def _(spark, sf):
    g = C.on_grid(C.polyfit(curves15(spark, sf), ["entity"]), 200)
    return g.select("entity", "grid_ix", "x", C.fitted(4).alias("y"))


@query("zero_crossing_highest", "entity", "crossing", views=_B, sql=cross_sql("b1e", "entity"))
def _(spark, sf):
    return C.crossings(curves15(spark, sf), ["entity"])


@query("ale_zero_crossing", "entity", "crossing", views=_B, sql=f"SELECT entity, CASE WHEN lo < 0 AND hi > 0 THEN crossing END AS crossing FROM ({cross_sql('b1e', 'entity', 'yd')}) JOIN (SELECT entity, min(yd) AS lo, max(yd) AS hi FROM b1e GROUP BY entity) USING (entity)")
def _(spark, sf):
    return C.ale_crossings(curves15(spark, sf), ["entity"], "yd")


VIEWS["g2p"] = "SELECT *, lag(y) OVER w AS yl, lead(y) OVER w AS yr, lead(x) OVER w AS xr FROM (" + grid_sql("f4_fit", "entity", 200) + ") WINDOW w AS (PARTITION BY entity ORDER BY x)"


@query("curve_peak", "entity", "peak_x peak_y", views=f"{_B} {_F4} g2p", digits=5, sql="SELECT entity, x + coalesce(shift, 0) * coalesce(xr - x, 0) AS peak_x, y - coalesce(0.25 * (yl - yr) * shift, 0) AS peak_y FROM (SELECT *, CASE WHEN yl - 2 * y + yr < 0 THEN 0.5 * (yl - yr) / (yl - 2 * y + yr) END AS shift, row_number() OVER (PARTITION BY entity ORDER BY y DESC, x) AS place FROM g2p) WHERE place = 1")
def _(spark, sf):
    return C.refine_peak(C.polyfit(curves15(spark, sf), ["entity"]), ["entity"])


VIEWS["g2k"] = "SELECT *, x - lag(x) OVER (PARTITION BY entity ORDER BY x) AS dx FROM (" + grid_sql("f4_fit", "entity", 2000, cols=", x_min, x_max") + ")"


@query("curve_points", "entity peak_edge minimum_edge", "peak minimum crossing", views=f"{_B} {_F4} g2k", digits=5, sql=f"SELECT p.entity, peak, minimum, crossing, peak <= x_min + 0.02 * (x_max - x_min) OR peak >= x_max - 0.02 * (x_max - x_min) AS peak_edge, minimum <= x_min + 0.02 * (x_max - x_min) OR minimum >= x_max - 0.02 * (x_max - x_min) AS minimum_edge FROM (SELECT entity, arg_max(x, y) AS peak, arg_min(x, y) AS minimum, any_value(x_min) AS x_min, any_value(x_max) AS x_max FROM g2k GROUP BY entity) p JOIN ({cross_sql('g2k', 'entity')}) USING (entity)")
def _(spark, sf):
    return C.curve_points(C.polyfit(curves15(spark, sf), ["entity"]), ["entity"])


def thresholds(spark, sf):
    return T.threshold(curves15(spark, sf), ["entity"])


@query("entity_thresholds", "entity", "crossing", views=_T, sql="SELECT * FROM thr", digits=5)
def _(spark, sf):
    return thresholds(spark, sf)


VIEWS["cls"] = "SELECT DISTINCT entity, class FROM phi"


def with_class(spark, sf):
    return thresholds(spark, sf).join(attributed(spark, sf).select("entity", "class").distinct(), "entity")


@query("class_threshold_summary", "class n", "q25 median q75 low high", views=f"{_T} cls", digits=5, sql="WITH v AS (SELECT class, crossing, row_number() OVER (PARTITION BY class ORDER BY entity) - 1 AS k, count(*) OVER (PARTITION BY class) AS n FROM thr JOIN cls USING (entity) WHERE crossing IS NOT NULL), d AS (SELECT DISTINCT class, n, rep, s FROM v, range(10000) r(rep), range(30) q(s) WHERE s < n), m AS (SELECT d.class, rep, median(v.crossing) AS m FROM d JOIN v ON v.class = d.class AND v.k = ((rep * 1000003 + s * 10007 + 5) * 48271) % 2147483647 % d.n GROUP BY ALL) SELECT class, n, q25, median, q75, low, high FROM (SELECT class, count(*) AS n, quantile_cont(crossing, 0.25) AS q25, median(crossing) AS median, quantile_cont(crossing, 0.75) AS q75 FROM v GROUP BY class) JOIN (SELECT class, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY class) USING (class)")
def _(spark, sf):
    from ..operators.resample import array_median, bootstrap

    t = with_class(spark, sf).where("crossing is not null")
    reps = bootstrap(t, "crossing", ["class"], ["entity"], 10_000, 5, {"m": array_median})
    ci = reps.groupBy("class").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return t.groupBy("class").agg(F.count("*").alias("n"), *S.quartiles("crossing")).join(ci, "class")


@query("sigma_to_physical", "entity", "value back", views=f"{_T} cls", digits=4, sql="SELECT entity, (m + crossing * s) / 10 AS value, ((m + crossing * s) / 10 * 10 - m) / s AS back FROM thr JOIN (SELECT entity, avg(dry) AS m, stddev_samp(dry) AS s FROM z GROUP BY entity) USING (entity)")
def _(spark, sf):
    stats = zpanel(spark, sf).groupBy("entity").agg(F.avg("dry").alias("m"), F.stddev_samp("dry").alias("s"))
    out = thresholds(spark, sf).join(stats, "entity").withColumn("value", T.to_physical(F.col("crossing"), F.col("m"), F.col("s")))
    return out.withColumn("back", T.to_sigma(F.col("value"), F.col("m"), F.col("s")))


# curve across entities: cells of at least half of them
VIEWS["acr"] = "SELECT 0 AS one, x, median(y) AS y, count(*) AS k FROM b1 GROUP BY x HAVING count(*) >= ceil((SELECT count(DISTINCT entity) FROM b1) / 2.0)"
_FA = fit_views("fa", "acr", "one")
VIEWS["ga"] = grid_sql("fa_fit", "one", 1000, cols=f", {_SE} AS se, (n - 5)::DOUBLE AS v")
VIEWS["bs"] = "SELECT rep, x, sum(y * times) / sum(times) AS y FROM b1 JOIN (SELECT rep, entity, count(*) AS times FROM (SELECT rep, e[(((rep * 1000003 + s * 10007 + 3) * 48271) % 2147483647 % len(e) + 1)::BIGINT] AS entity FROM range(2000) r(rep), range(100) q(s), (SELECT list(DISTINCT entity ORDER BY entity) AS e FROM b1) WHERE s < len(e)) GROUP BY ALL) USING (entity) GROUP BY rep, x HAVING sum(times) >= ceil((SELECT count(DISTINCT entity) FROM b1) / 2.0)"
_FB = fit_views("fb", "bs", "rep")
VIEWS["gb"] = grid_sql("fb_fit", "rep", 300)


def across_curve(b, agg=F.median):
    cells = b.groupBy("x").agg(agg("y").alias("y"), F.count("*").alias("k"))
    return cells.crossJoin(F.broadcast(b.agg(F.count_distinct("entity").alias("n_entities")))).where(F.col("k") >= F.ceil(F.col("n_entities") / 2)).withColumn("one", F.lit(0))


@query("threshold_with_bootstrap", "n_boot", "crossing lower upper boot_lower boot_upper", views=f"{_B} tq acr {_FA} ga bs {_FB} gb", digits=5, sql=f"SELECT (SELECT crossing FROM ({cross_sql('ga', 'one')})) AS crossing, (SELECT crossing FROM ({cross_sql('(SELECT one, x, y - ' + _TQ + ' * se AS l FROM ga)', 'one', 'l')})) AS lower, (SELECT crossing FROM ({cross_sql('(SELECT one, x, y + ' + _TQ + ' * se AS l FROM ga)', 'one', 'l')})) AS upper, count(*) AS n_boot, quantile_cont(crossing, 0.025) AS boot_lower, quantile_cont(crossing, 0.975) AS boot_upper FROM ({cross_sql('gb', 'rep')})")
def _(spark, sf):
    b = binned(spark, sf).select("entity", "x", "y")
    boot = bootstrap_interval(b)
    return T.threshold_band(across_curve(b), ["one"], n_grid=1000).crossJoin(F.broadcast(boot))


def bootstrap_interval(b):
    n = b.agg(F.count_distinct("entity").alias("n_entities"))
    reps = T.resampled(b, 2000, 3).groupBy("rep", "x").agg((F.sum(F.col("y") * F.col("times")) / F.sum("times")).alias("y"), F.sum("times").alias("k"))
    reps = reps.crossJoin(F.broadcast(n)).where(F.col("k") >= F.ceil(F.col("n_entities") / 2))
    return T.threshold(reps, ["rep"], n_grid=300).agg(F.count("*").alias("n_boot"), F.percentile("crossing", 0.025).alias("boot_lower"), F.percentile("crossing", 0.975).alias("boot_upper"))


VIEWS["loo"] = "SELECT removed, x, median(y) AS y FROM b1 JOIN (SELECT DISTINCT entity AS removed FROM b1) ON entity <> removed GROUP BY removed, x HAVING count(*) >= ceil(((SELECT count(DISTINCT entity) FROM b1) - 1) / 2.0)"
_FL = fit_views("fl", "loo", "removed")
VIEWS["gl"] = grid_sql("fl_fit", "removed", 300)
_LOO = f"{_B} acr {_FA} ga loo {_FL} gl"


def left_out(b):
    pts = T.leave_one_out(b.select("entity", "x", "y")).where(F.col("k") >= F.ceil((F.col("n_entities") - 1) / 2))
    return T.threshold(pts, ["removed"], n_grid=300)


@query("leave_one_entity_out", "removed", "crossing", views=_LOO, sql=cross_sql("gl", "removed"), digits=5)
def _(spark, sf):
    return left_out(binned(spark, sf))


VIEWS["rb"] = "SELECT entity, cell, avg(x) AS x, avg(y) AS y FROM (SELECT b1e.*, floor((x - x0) / 0.3 + 1e-9)::BIGINT AS cell FROM b1e JOIN (SELECT entity, min(x) AS x0 FROM b1e GROUP BY entity) USING (entity)) GROUP BY entity, cell"


@query("rebin", "entity cell", "x y", views=f"{_B} rb", sql="SELECT * FROM rb")
def _(spark, sf):
    return C.rebin(curves15(spark, sf), ["entity"], 0.3)


# the settings of the estimator sweep, all on the curve across entities
DEGREES, FRACS, WIDTHS, RANGES, PENALTIES = (2, 3, 4, 5, 6), (0.2, 0.3, 0.4, 0.5, 0.7), (0.1, 0.2, 0.3, 0.5), (2.0, 2.5, 3.0, 3.5, None), (0.001, 0.01, 0.05, 0.1)


def _range_name(limit):
    return "full range" if limit is None else f"range {limit}"


def lowess_views(name: str, src: str, keys: str, iterations: int = 3) -> str:
    """Views of a local linear smoother of src's (x, y) with its share frac; name_f holds (keys, x, y, fit)."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    views = {
        "k": f"SELECT {keys}, greatest(2, floor(any_value(frac) * count(*) + 1e-10))::BIGINT AS k FROM {src} GROUP BY {keys}",
        "d": f"SELECT {', '.join(f'a.{k}' for k in keys.split(', '))}, a.x AS x0, b.x, b.y, abs(b.x - a.x) AS d, row_number() OVER (PARTITION BY {', '.join(f'a.{k}' for k in keys.split(', '))}, a.x ORDER BY abs(b.x - a.x), b.x) AS r FROM {src} a JOIN {src} b ON {on}",
        "h": f"SELECT {keys}, x0, max(d) AS h FROM {name}_d JOIN {name}_k USING ({keys}) WHERE r <= k GROUP BY {keys}, x0",
        "r0": f"SELECT {keys}, x, 1.0 AS rob FROM {src}",
    }
    for i in range(iterations + 1):
        views[f"w{i}"] = f"SELECT d.*, CASE WHEN h > 0 AND d < h THEN (1 - (d / h) ** 3) ** 3 * rob WHEN d <= 0 THEN rob ELSE 0 END AS w FROM {name}_d d JOIN {name}_h USING ({keys}, x0) JOIN {name}_r{i} USING ({keys}, x)"
        views[f"m{i}"] = f"SELECT {keys}, x0, sum(w * x) / nullif(sum(w), 0) AS mx, sum(w * y) / nullif(sum(w), 0) AS my FROM {name}_w{i} GROUP BY {keys}, x0"
        views[f"s{i}"] = f"SELECT {keys}, x0, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) ** 2) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy FROM {name}_w{i} JOIN {name}_m{i} USING ({keys}, x0) GROUP BY {keys}, x0"
        views[f"f{i}"] = f"SELECT {keys}, x0 AS x, y, my + CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0 END * (x0 - mx) AS fit FROM {name}_s{i} JOIN (SELECT {keys}, x AS x0, y FROM {src}) USING ({keys}, x0)"
        if i < iterations:
            views[f"r{i + 1}"] = f"SELECT {keys}, x, CASE WHEN u IS NULL THEN 1 WHEN abs(u) < 1 THEN (1 - u * u) ** 2 ELSE 0 END AS rob FROM (SELECT {keys}, x, (y - fit) / nullif(6 * s, 0) AS u FROM {name}_f{i} JOIN (SELECT {keys}, median(abs(y - fit)) AS s FROM {name}_f{i} GROUP BY {keys}) USING ({keys}))"
    views["f"] = f"SELECT * FROM {name}_f{iterations}"
    for k, v in views.items():
        VIEWS[f"{name}_{k}"] = v
    return " ".join(f"{name}_{k}" for k in views)


_SW = []
for _d in DEGREES:
    _SW.append(fit_views(f"w{_d}", "acr", "one", _d))
    VIEWS[f"gw{_d}"] = grid_sql(f"w{_d}_fit", "one", 500, _d)
    _SW.append(f"gw{_d}")
VIEWS["qs"] = " UNION ALL ".join(
    [f"SELECT 'width {w}' AS setting, avg(x) AS x, avg(y) AS y FROM (SELECT x, y, floor((x - (SELECT floor(min(x)) FROM acr)) / {w} + 1e-9) AS cell FROM acr) GROUP BY cell" for w in WIDTHS]
    + [f"SELECT '{_range_name(r)}', x, y FROM acr WHERE {'TRUE' if r is None else f'abs(x) <= {r}'}" for r in RANGES]
)
_SW += ["qs", fit_views("fq", "qs", "setting"), "gq", "lws"]
VIEWS["gq"] = grid_sql("fq_fit", "setting", 500)
VIEWS["lws"] = "SELECT 'lowess ' || f AS setting, f::DOUBLE AS frac, x, y FROM acr, (VALUES " + ", ".join(f"('{f}')" for f in FRACS) + ") t(f)"
_SW.append(lowess_views("lw", "lws", "setting"))
VIEWS["sw"] = " UNION ALL ".join([*(f"SELECT 'degree {d}' AS setting, crossing FROM ({cross_sql(f'gw{d}', 'one')})" for d in DEGREES), f"SELECT setting, crossing FROM ({cross_sql('gq', 'setting')})", f"SELECT setting, crossing FROM ({cross_sql('lw_f', 'setting', 'fit')})"])


def sweep(pts):
    """(setting, crossing) of all settings but the splines."""
    degrees = [T.threshold(pts, ["one"], d).select(F.lit(f"degree {d}").alias("setting"), "crossing") for d in DEGREES]
    widths = [C.rebin(pts, ["one"], w, whole=True).select(F.lit(f"width {w}").alias("setting"), "x", "y") for w in WIDTHS]
    ranges = [pts.where(F.lit(True) if r is None else F.abs("x") <= r).select(F.lit(_range_name(r)).alias("setting"), "x", "y") for r in RANGES]
    quartics = T.threshold(reduce(lambda a, b: a.union(b), widths + ranges), ["setting"])
    tried = pts.withColumn("frac", F.explode(F.array(*map(F.lit, FRACS)))).withColumn("setting", F.concat(F.lit("lowess "), F.col("frac").cast("string")))
    smooth = C.crossings(C.lowess(tried, ["setting", "frac"], F.col("frac")), ["setting"], "fit")
    return reduce(lambda a, b: a.unionByName(b), [*degrees, quartics, smooth])


@query("estimator_sweep", "setting", "crossing", views=f"{_B} acr {' '.join(_SW)} sw", sql="SELECT * FROM sw", digits=4)
def _(spark, sf):
    return sweep(materialize(across_curve(binned(spark, sf))))


@query("estimator_sweep_splines")
def _(spark, sf):
    """The four spline settings: knots set by the residuals until their share of the variance meets each factor."""
    return spline_sweep(across_curve(binned(spark, sf)))


def spline_sweep(pts):
    fits = [splines.smoothing_spline(pts, ["one"], r).withColumn("setting", F.lit(f"spline {r}")) for r in PENALTIES]
    return C.crossings(reduce(lambda a, b: a.unionByName(b), fits), ["setting"], "fit")


VIEWS["lwe"] = "SELECT *, 0.6 AS frac FROM b1e"
_LW = lowess_views("le", "lwe", "entity")


@query("lowess_curve", "entity", "x fit", views=f"{_B} lwe {_LW}", digits=5, sql="SELECT * FROM le_f")
def _(spark, sf):
    return C.lowess(curves15(spark, sf), ["entity"])


@query("penalized_spline")
def _(spark, sf):
    return splines.penalized_spline(curves15(spark, sf), ["entity"])


# other sets of entities: without a class, or with records of several years
MIN_YEARS = (3, 5, 7, 10)
VIEWS["sets"] = "SELECT 'without class ' || c AS scenario, entity FROM (SELECT DISTINCT entity, class FROM phi), (SELECT DISTINCT class AS c FROM phi) WHERE class <> c UNION ALL SELECT 'records of ' || y || ' years', entity FROM (SELECT entity, count(DISTINCT year(ts)) AS years FROM phi GROUP BY entity), (VALUES " + ", ".join(f"({y})" for y in MIN_YEARS) + ") t(y) WHERE years >= y"
VIEWS["scv"] = "SELECT scenario, x, median(y) AS y FROM b1 JOIN sets USING (entity) JOIN (SELECT scenario, count(*) AS size FROM sets GROUP BY scenario) USING (scenario) GROUP BY scenario, x, size HAVING count(*) >= ceil(size / 2.0)"
VIEWS["mea"] = "SELECT 'mean per bin' AS scenario, x, avg(y) AS y FROM b1 GROUP BY x HAVING count(*) >= ceil((SELECT count(DISTINCT entity) FROM b1) / 2.0)"
VIEWS["scx"] = "SELECT * FROM scv UNION ALL SELECT * FROM mea"
_FX = fit_views("fx", "scx", "scenario")
VIEWS["gx"] = grid_sql("fx_fit", "scenario", 500)


@query("robustness_table", "scenario note", "crossing low high shift", views=f"{_LOO} tq bs {_FB} gb {' '.join(_SW)} sw sets scv mea scx {_FX} gx", digits=4, sql=f"""WITH r AS (SELECT crossing AS ref FROM sw WHERE setting = 'degree 4'), lo AS ({cross_sql('gl', 'removed')}), bo AS ({cross_sql('gb', 'rep')}), t AS (
 SELECT setting AS scenario, 'estimator' AS note, crossing, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM sw
 UNION ALL SELECT 'all settings', 'spread across settings', median(crossing), min(crossing), max(crossing) FROM sw
 UNION ALL SELECT 'without ' || removed, 'one removed', crossing, NULL, NULL FROM lo
 UNION ALL SELECT 'any one removed', 'range across removals', median(crossing), min(crossing), max(crossing) FROM lo
 UNION ALL SELECT 'resampled entities', 'bootstrap interval', ref, quantile_cont(crossing, 0.025), quantile_cont(crossing, 0.975) FROM bo, r GROUP BY ref
 UNION ALL SELECT scenario, CASE WHEN scenario = 'mean per bin' THEN 'aggregation' ELSE 'entity set' END, crossing, NULL, NULL FROM ({cross_sql('gx', 'scenario')}))
 SELECT scenario, note, crossing, low, high, crossing - ref AS shift FROM t, r""")
def _(spark, sf):
    z = materialize(attributed(spark, sf).select("entity", "class", "dry_z", "net", "phi_dry", F.year("ts").alias("year")))
    b = materialize(cells_of(z))
    pts = materialize(across_curve(b))
    sw, loo = materialize(sweep(pts)), materialize(left_out(b))
    none = F.lit(None).cast("double")
    spread = [F.median("crossing").alias("crossing"), F.min("crossing").alias("low"), F.max("crossing").alias("high")]
    row = lambda df, scenario, note: df.select(F.lit(scenario).alias("scenario") if isinstance(scenario, str) else scenario.alias("scenario"), F.lit(note).alias("note"), "crossing", *(c if c in df.columns else none.alias(c) for c in ("low", "high")))
    ref = sw.where("setting = 'degree 4'").select(F.col("crossing").alias("ref"))
    boot = bootstrap_interval(b.select("entity", "x", "y")).select(F.col("boot_lower").alias("low"), F.col("boot_upper").alias("high")).crossJoin(F.broadcast(ref.withColumnRenamed("ref", "crossing")))

    # each entity's scenarios are an array, so nothing is joined on inequality
    ents = z.groupBy("entity", "class").agg(F.count_distinct("year").alias("years")).crossJoin(F.broadcast(z.agg(F.collect_set("class").alias("classes"))))
    others = F.transform(F.array_except("classes", F.array("class")), lambda c: F.concat(F.lit("without class "), c.cast("string")))
    long = F.filter(F.array(*[F.when(F.col("years") >= y, f"records of {y} years") for y in MIN_YEARS]), lambda s: s.isNotNull())
    sets = ents.select("entity", F.explode(F.concat(others, long)).alias("scenario"))
    sizes = sets.groupBy("scenario").agg(F.count("*").alias("n"))
    curve = b.join(sets, "entity").groupBy("scenario", "x").agg(F.median("y").alias("y"), F.count("*").alias("k")).join(sizes, "scenario").where(F.col("k") >= F.ceil(F.col("n") / 2)).select("scenario", "x", "y")
    curve = curve.unionByName(across_curve(b, F.avg).select(F.lit("mean per bin").alias("scenario"), "x", "y"))
    kinds = T.threshold(curve, ["scenario"])
    rows = [
        row(sw, F.col("setting"), "estimator"), row(sw.agg(*spread), "all settings", "spread across settings"), row(loo, F.concat(F.lit("without "), F.col("removed")), "one removed"),
        row(loo.agg(*spread), "any one removed", "range across removals"), row(boot, "resampled entities", "bootstrap interval"),
        row(kinds.where("scenario = 'mean per bin'"), F.col("scenario"), "aggregation"), row(kinds.where("scenario <> 'mean per bin'"), F.col("scenario"), "entity set"),
    ]
    return reduce(lambda a, b: a.unionByName(b), rows).crossJoin(F.broadcast(ref)).withColumn("shift", F.col("crossing") - F.col("ref"))


VIEWS["tg"] = "SELECT target, x, median(v) AS y FROM (SELECT entity, floor(dry_z * 10) / 10 AS x, target, avg(v) AS v FROM (SELECT entity, dry_z, unnest(['net', 'dry', 'gpp']) AS target, unnest([net, phi_dry, 1 - phi_heat - 0.8 * dry_z]) AS v FROM phi) GROUP BY ALL) GROUP BY target, x HAVING count(*) >= ceil((SELECT count(DISTINCT entity) FROM phi) / 2.0)"
_FT = fit_views("ft", "tg", "target")
VIEWS["gt"] = grid_sql("ft_fit", "target", 500)


@query("response_by_target", "target", "crossing r2", views=f"pn z phi tg {_FT} gt", digits=5, sql=f"SELECT target, crossing, r2 FROM ({cross_sql('gt', 'target')}) JOIN ft_fit USING (target)")
def _(spark, sf):
    long = attributed(spark, sf).select("entity", "dry_z", F.expr("stack(3, 'net', net, 'dry', phi_dry, 'gpp', 1 - phi_heat - 0.8 * dry_z) as (target, v)"))
    per = materialize(long.groupBy("entity", "target", (F.floor(F.col("dry_z") * 10) / 10).alias("x")).agg(F.avg("v").alias("v")))
    half = per.agg(F.ceil(F.count_distinct("entity") / 2).alias("half"))
    pts = materialize(per.groupBy("target", "x").agg(F.median("v").alias("y"), F.count("*").alias("k")).crossJoin(F.broadcast(half)).where("k >= half"))
    fit = C.polyfit(pts, ["target"])
    return T.threshold(pts, ["target"]).join(fit.select("target", "r2"), "target")


@query("coeff_table", "entity n label", "crossing c0 c1 c2", views=_T, digits=5, sql="SELECT entity, n, CASE WHEN crossing IS NULL THEN 'none' ELSE printf('%.2f', crossing) END AS label, crossing, c0, c1, c2 FROM f4_fit JOIN thr USING (entity)")
def _(spark, sf):
    fit = C.polyfit(curves15(spark, sf), ["entity"])
    return fit.join(thresholds(spark, sf), "entity").withColumn("label", F.when(F.col("crossing").isNull(), "none").otherwise(F.format_string("%.2f", "crossing")))


VIEWS["ph"] = "SELECT entity, (m + x * s) / 100000 AS x, y FROM (SELECT entity, x, y FROM (" + grid_sql("f4_fit", "entity", 50) + ")) JOIN (SELECT entity, avg(dry) AS m, stddev_samp(dry) AS s FROM z GROUP BY entity) USING (entity)"


@query("curve_resample_physical", "grid_ix entities", "q25 median q75", views=f"{_B} {_F4} ph", digits=5, sql="SELECT grid_ix, count(*) AS entities, quantile_cont(y, 0.25) AS q25, median(y) AS median, quantile_cont(y, 0.75) AS q75 FROM (SELECT entity, grid_ix, y0 + (g - x0) / (x1 - x0) * (y1 - y0) AS y FROM (SELECT i AS grid_ix, 0.02 * i AS g FROM range(60) t(i)) CROSS JOIN LATERAL (SELECT * FROM (SELECT entity, x AS x0, y AS y0, lead(x) OVER (PARTITION BY entity ORDER BY x) AS x1, lead(y) OVER (PARTITION BY entity ORDER BY x) AS y1 FROM ph) WHERE g >= x0 AND g < x1)) GROUP BY grid_ix HAVING count(*) >= ceil((SELECT count(DISTINCT entity) FROM ph) / 2.0)")
def _(spark, sf):
    stats = zpanel(spark, sf).groupBy("entity").agg(F.avg("dry").alias("m"), F.stddev_samp("dry").alias("s"))
    g = C.on_grid(C.polyfit(curves15(spark, sf), ["entity"]), 50).select("entity", "x", C.fitted(4).alias("y"))
    curve = materialize(g.join(stats, "entity").select("entity", ((F.col("m") + F.col("x") * F.col("s")) / 100000).alias("x"), "y"))
    on = C.interp_grid(curve, ["entity"], 0.0, 0.02, 60)
    half = curve.agg(F.ceil(F.count_distinct("entity") / 2).alias("half"))
    return on.groupBy("grid_ix").agg(F.count("*").alias("entities"), *S.quartiles("y")).crossJoin(F.broadcast(half)).where("entities >= half")


@query("ale_curve_summary", "bx entities", "mean median low high sd", views=_B, sql="SELECT bx, count(*) AS entities, avg(yd) AS mean, median(yd) AS median, quantile_cont(yd, 0.025) AS low, quantile_cont(yd, 0.975) AS high, stddev_samp(yd) AS sd FROM b1 GROUP BY bx HAVING count(*) >= ceil((SELECT count(DISTINCT entity) FROM b1) / 2.0)")
def _(spark, sf):
    b = binned(spark, sf)
    out = b.groupBy("bx").agg(F.count("*").alias("entities"), F.avg("yd").alias("mean"), F.median("yd").alias("median"), F.percentile("yd", 0.025).alias("low"), F.percentile("yd", 0.975).alias("high"), F.stddev_samp("yd").alias("sd"))
    return out.crossJoin(F.broadcast(b.agg(F.count_distinct("entity").alias("all")))).where(F.col("entities") >= F.ceil(F.col("all") / 2))


@query("group_threshold_ci", "class n", "mean sd se low high", views=f"{_T} tq cls", digits=5, sql=f"SELECT *, mean - {_TQ} * se AS low, mean + {_TQ} * se AS high FROM (SELECT class, count(crossing) AS n, avg(crossing) AS mean, stddev_samp(crossing) AS sd, stddev_samp(crossing) / sqrt(count(crossing)) AS se, (count(crossing) - 1)::DOUBLE AS v FROM thr JOIN cls USING (entity) GROUP BY class)")
def _(spark, sf):
    from ..functions import t_quantile

    out = with_class(spark, sf).groupBy("class").agg(F.count("crossing").alias("n"), F.avg("crossing").alias("mean"), F.stddev_samp("crossing").alias("sd"))
    out = out.withColumn("se", F.col("sd") / F.sqrt("n"))
    half = t_quantile((F.col("n") - 1).cast("double")) * F.col("se")
    return out.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


@query("growth_quartiles", "", "range_pct threshold_pct", views=f"{_T}", digits=4, sql="WITH e AS (SELECT entity, crossing, spread, CASE WHEN spread <= q[1] THEN 1 WHEN spread > q[3] THEN 4 ELSE 2 END AS s FROM thr JOIN (SELECT entity, stddev_samp(dry) AS spread FROM z GROUP BY entity) USING (entity), (SELECT quantile_cont(spread, [0.25, 0.5, 0.75]) AS q FROM (SELECT entity, stddev_samp(dry) AS spread FROM z GROUP BY entity) JOIN thr USING (entity))) SELECT 100 * (median(spread) FILTER (s = 4) / median(spread) FILTER (s = 1) - 1) AS range_pct, 100 * (median(crossing) FILTER (s = 4) / median(crossing) FILTER (s = 1) - 1) AS threshold_pct FROM e")
def _(spark, sf):
    spread = zpanel(spark, sf).groupBy("entity").agg(F.stddev_samp("dry").alias("spread"))
    e = quartile_strata(thresholds(spark, sf).join(spread, "entity"), "spread")
    growth = lambda c: 100 * (F.median(F.when(F.col("stratum") == 4, F.col(c))) / F.median(F.when(F.col("stratum") == 1, F.col(c))) - 1)
    return e.agg(growth("spread").alias("range_pct"), growth("crossing").alias("threshold_pct"))


@query("slope_split", "entity side n", "slope rho", views=_B, sql="SELECT entity, side, count(*) AS n, regr_slope(y, x) AS slope, corr(rx, ry) AS rho FROM (SELECT entity, x, y, CASE WHEN x < 0 THEN 'below' ELSE 'above' END AS side, rank() OVER (PARTITION BY entity, x < 0 ORDER BY x)::DOUBLE AS rx, rank() OVER (PARTITION BY entity, x < 0 ORDER BY y)::DOUBLE AS ry FROM b1e) GROUP BY ALL HAVING count(*) > 2")
def _(spark, sf):
    pts = curves15(spark, sf).withColumn("side", F.when(F.col("x") < 0, "below").otherwise("above"))
    r = average_rank(average_rank(pts, "x", "rx", ["entity", "side"]), "y", "ry", ["entity", "side"])
    return r.groupBy("entity", "side").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.corr("rx", "ry").alias("rho")).where("n > 2")


@query("loglog_exponent", "entity n", "exponent", views=_B, sql="SELECT entity, count(*) AS n, regr_slope(ln(y + 5), ln(x + 5)) AS exponent FROM b1 WHERE y + 5 > 0 AND x + 5 > 0 GROUP BY entity HAVING count(*) >= 8")
def _(spark, sf):
    pts = binned(spark, sf).where("y + 5 > 0 and x + 5 > 0")
    return pts.groupBy("entity").agg(F.count("*").alias("n"), F.regr_slope(F.log(F.col("y") + 5), F.log(F.col("x") + 5)).alias("exponent")).where("n >= 8")
