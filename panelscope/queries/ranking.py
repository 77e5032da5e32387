"""Windows, ranks, tests and association."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ranks as R
from ..operators.ordered import quantiles
from ..operators.resample import array_mean, array_median, bootstrap
from ..plans.panels import attributed, panel, table, zpanel
from .base import VIEWS, query

VIEWS["ent"] = "SELECT entity, any_value(class) AS class, avg(net) AS net, avg(heat) AS heat, avg(soil) AS soil, avg(phi_dry) AS phi_dry, median(dry_z) AS mz, count(*) AS n FROM phi GROUP BY entity"
_E = "pn z phi ent"


def entities(spark, sf):
    phi = attributed(spark, sf)
    out = phi.groupBy("entity").agg(F.first("class").alias("class"), F.avg("net").alias("net"), F.avg("heat").alias("heat"), F.avg("soil").alias("soil"), F.avg("phi_dry").alias("phi_dry"), F.count("*").alias("n"))
    middle = quantiles(phi, ["entity"], "dry_z", [0.5]).select("entity", F.col("q")[0].alias("mz"))
    return out.join(middle, "entity", "left")


@query("sort_latest_sites", "entity last place", views="p", sql="SELECT entity, max(ts) AS last, row_number() OVER (ORDER BY max(ts) DESC, entity) AS place FROM p GROUP BY entity")
def _(spark, sf):
    last = panel(spark, sf).groupBy("entity").agg(F.max("ts").alias("last"))
    return R.places(last, [F.desc("last"), F.col("entity")]).orderBy("place")


@query("argmax_setting", "entity", "dev", views=_E, sql="SELECT arg_max(entity, (round(abs(net - m), 9), entity)) AS entity, max(abs(net - m)) AS dev FROM ent, (SELECT avg(net) AS m FROM ent)")
def _(spark, sf):
    e = entities(spark, sf)
    d = e.crossJoin(F.broadcast(e.agg(F.avg("net").alias("m")))).withColumn("d", F.abs(F.col("net") - F.col("m")))
    return d.agg(F.max_by("entity", F.struct(F.round("d", 9), F.col("entity"))).alias("entity"), F.max("d").alias("dev"))


@query("top_movers", "entity", "shift", views=_E, sql="SELECT entity, net - m AS shift FROM ent, (SELECT avg(net) AS m FROM ent) WHERE abs(net - m) >= 0.03")
def _(spark, sf):
    e = entities(spark, sf)
    return e.crossJoin(F.broadcast(e.agg(F.avg("net").alias("m")))).withColumn("shift", F.col("net") - F.col("m")).where("abs(shift) >= 0.03").orderBy(F.desc(F.abs("shift")))


def _u_steps() -> str:
    """Views e0 to e8: numbers of orders with each U up to the one found, for pairs with a group of eight values at most and no ties."""
    first = "e0 AS (SELECT a, b, least(n_a, n_b) AS m, greatest(n_a, n_b) AS n, least(u, n_a * n_b - u)::INT AS l, [CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for k in range(least(u, n_a * n_b - u)::INT + 1)] AS w FROM us2 WHERE least(n_a, n_b) <= 8 AND ties = 0)"
    step = "e{i} AS (SELECT a, b, m, n, l, CASE WHEN m < {i} THEN w ELSE [list_sum(d[(k % {i}) + 1:k + 1:{i}]) for k in range(l + 1)] END AS w FROM (SELECT *, [w[k + 1] - CASE WHEN k >= n + {i} THEN w[(k + 1 - n - {i})::INT] ELSE 0 END for k in range(l + 1)] AS d FROM e{j}))"
    return ", ".join([first, *(step.format(i=i, j=i - 1) for i in range(1, 9))])


_MW = """ WITH pr AS (SELECT a.class AS a, b.class AS b FROM (SELECT DISTINCT class FROM ent) a, (SELECT DISTINCT class FROM ent) b WHERE a.class < b.class),
 rw AS (SELECT a, b, class, mz, rank() OVER (PARTITION BY a, b ORDER BY mz) + (count(*) OVER (PARTITION BY a, b, mz) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY a, b, mz) AS t FROM ent JOIN pr ON class = a OR class = b),
 us AS (SELECT a, b, count(*) FILTER (class = a) AS n_a, count(*) FILTER (class = b) AS n_b, sum(r) FILTER (class = a) AS ra, sum(t * t - 1.0) AS ties FROM rw GROUP BY a, b),
 us2 AS (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS u FROM us), """ + _u_steps() + """,
 uz AS (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS u, (abs(ra - n_a * (n_a + 1) / 2.0 - n_a * n_b / 2.0) - 0.5) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1.0)))) AS zz FROM us),
 ux AS (SELECT *, 1 / (1 + 0.3275911 * abs(zz) / sqrt(2.0)) AS tt FROM uz),
 ex AS (SELECT a, b, least(1, 2 * list_sum(w) / list_product([(n + j) / j for j in range(1, m + 1)])) AS p FROM e8),
 mw AS (SELECT x.a, x.b, n_a, n_b, u, coalesce(ex.p, least(1, 2 * CASE WHEN zz >= 0 THEN h ELSE 1 - h END)) AS p FROM (SELECT *, 0.5 * ((((1.061405429 * tt - 1.453152027) * tt + 1.421413741) * tt - 0.284496736) * tt + 0.254829592) * tt * exp(-zz * zz / 2) AS h FROM ux) x LEFT JOIN ex ON ex.a = x.a AND ex.b = x.b)"""


@query("mann_whitney_pairs", "a b n_a n_b", "u p", views=_E, sql=_MW.strip() + " SELECT * FROM mw")
def _(spark, sf):
    return R.mann_whitney_pairs(entities(spark, sf), "mz", "class")


@query("holm_correction", "a b", "p p_holm", views=_E, sql=_MW.strip() + " SELECT a, b, p, max(adj) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1)) AS adj FROM mw)")
def _(spark, sf):
    return R.holm(R.mann_whitney_pairs(entities(spark, sf), "mz", "class"), "p", ["a", "b"])


@query("average_rank", "entity l_orderkey l_linenumber l_partkey ts", "r", views="p", sql="SELECT *, rank() OVER (PARTITION BY entity ORDER BY heat) + (count(*) OVER (PARTITION BY entity, heat) - 1) / 2.0 AS r FROM p")
def _(spark, sf):
    return R.average_rank(panel(spark, sf), "heat", "r", ["entity"])


@query("label_runs", "entity run label first last n", sql="WITH e AS (SELECT user_id AS entity, ts, event_type AS label, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT entity, run, any_value(label) AS label, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY ts) AS run FROM e) GROUP BY entity, run")
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("entity"), "ts", F.col("event_type").alias("label"))
    return R.label_runs(ev, "label", "ts", ["entity"])


@query("quartile_strata", "stratum n", "median_net", views=_E, sql="SELECT CASE WHEN heat <= q[1] THEN 1 WHEN heat <= q[2] THEN 2 WHEN heat <= q[3] THEN 3 ELSE 4 END AS stratum, count(*) AS n, median(net) AS median_net FROM ent, (SELECT quantile_cont(heat, [0.25, 0.5, 0.75]) AS q FROM ent) GROUP BY 1")
def _(spark, sf):
    return R.quartile_strata(entities(spark, sf), "heat").groupBy("stratum").agg(F.count("*").alias("n"), F.median("net").alias("median_net"))


@query("equal_width_bins", "class_no n", views="p", sql="SELECT greatest(1, ceil((dry - lo) / (hi - lo) * 10))::BIGINT AS class_no, count(*) AS n FROM p, (SELECT min(dry) AS lo, max(dry) AS hi FROM p) WHERE dry IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return R.equal_width(panel(spark, sf).where("dry is not null"), "dry").groupBy("class_no").agg(F.count("*").alias("n"))


@query("step_diff", "entity year n diff", views="p", sql="SELECT *, n - lag(n) OVER (PARTITION BY entity ORDER BY year) AS diff FROM (SELECT entity, year(ts) AS year, count(*) AS n FROM p GROUP BY ALL)")
def _(spark, sf):
    y = panel(spark, sf).groupBy("entity", F.year("ts").alias("year")).agg(F.count("*").alias("n"))
    return y.withColumn("diff", F.col("n") - F.lag("n").over(W.partitionBy("entity").orderBy("year")))


@query("pearson", "entity", "r", views="pn z", sql="SELECT entity, corr(heat, target) AS r FROM z GROUP BY entity")
def _(spark, sf):
    return zpanel(spark, sf).groupBy("entity").agg(F.corr("heat", "target").alias("r"))


@query("spearman", "entity", "rho", views="pn z", sql="SELECT entity, corr(rx, ry) AS rho FROM (SELECT entity, rank() OVER (PARTITION BY entity ORDER BY soil) + (count(*) OVER (PARTITION BY entity, soil) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY entity ORDER BY target) + (count(*) OVER (PARTITION BY entity, target) - 1) / 2.0 AS ry FROM z) GROUP BY entity")
def _(spark, sf):
    return R.spearman(zpanel(spark, sf), "soil", "target", ["entity"])


@query("kruskal_wallis", "n", "h p", views=_E, sql="SELECT n, h, CASE k WHEN 5 THEN exp(-h / 2) * (1 + h / 2) END AS p FROM (SELECT n, k, (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n)) AS h FROM (SELECT sum(c)::BIGINT AS n, count(*) AS k, sum(s * s / c) AS q FROM (SELECT class, count(*) AS c, sum(r) AS s FROM (SELECT class, rank() OVER (ORDER BY mz) + (count(*) OVER (PARTITION BY mz) - 1) / 2.0 AS r FROM ent) GROUP BY class)), (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM ent GROUP BY mz)))")
def _(spark, sf):
    return R.kruskal_wallis(entities(spark, sf), "mz", "class", 5)


@query("ttest_1samp", "class n", "t", views=_E, sql="SELECT class, count(mz) AS n, avg(mz) / (stddev_samp(mz) / sqrt(count(mz))) AS t FROM ent GROUP BY class")
def _(spark, sf):
    return R.ttest_1samp(entities(spark, sf), "mz", 0.0, ["class"])


@query("partial_correlation", "entity n", "partial_heat partial_soil", views="pn z", sql="SELECT entity, n, (th - ts * hs) / sqrt((1 - ts * ts) * (1 - hs * hs)) AS partial_heat, (ts - th * hs) / sqrt((1 - th * th) * (1 - hs * hs)) AS partial_soil FROM (SELECT entity, count(*) AS n, corr(target, heat) AS th, corr(target, soil) AS ts, corr(heat, soil) AS hs FROM z GROUP BY entity)")
def _(spark, sf):
    return R.partial_correlations(zpanel(spark, sf), "target", ["heat", "soil"], ["entity"])


_PATH = "SELECT entity, n, (th - ts * hs) / (1 - hs * hs) AS path_heat, (ts - th * hs) / (1 - hs * hs) AS path_soil, (th * th + ts * ts - 2 * th * ts * hs) / (1 - hs * hs) AS r2, hs AS corr_soil_heat FROM (SELECT entity, count(*) AS n, corr(target, heat) AS th, corr(target, soil) AS ts, corr(heat, soil) AS hs FROM z GROUP BY entity)"


@query("path_coefficients", "entity n", "path_heat path_soil r2 corr_soil_heat", views="pn z", sql=_PATH)
def _(spark, sf):
    return R.path_coefficients(zpanel(spark, sf), "target", ["heat", "soil"], ["entity"])


@query("method_agreement", "entity feature rank strength agreement", "size", views="pn z phi", sql=f"WITH m AS (SELECT * FROM ({_PATH}) JOIN (SELECT entity, (th - ts * hs) / sqrt((1 - ts * ts) * (1 - hs * hs)) AS qh, (ts - th * hs) / sqrt((1 - th * th) * (1 - hs * hs)) AS qs FROM (SELECT entity, corr(target, heat) AS th, corr(target, soil) AS ts, corr(heat, soil) AS hs FROM z GROUP BY entity)) USING (entity) JOIN (SELECT entity, max(phi_heat) - min(phi_heat) AS eh, max(phi_soil) - min(phi_soil) AS es FROM phi GROUP BY entity) USING (entity)), f AS (SELECT entity, 'heat' AS feature, eh AS e, qh AS q, path_heat AS h FROM m UNION ALL SELECT entity, 'soil', es, qs, path_soil FROM m), g AS (SELECT *, (abs(e) + abs(q) + abs(h)) / 3 AS size, (e > 0)::INT + (q > 0)::INT + (h > 0)::INT AS up FROM f) SELECT entity, feature, size, row_number() OVER (PARTITION BY entity ORDER BY size DESC, feature) AS rank, CASE WHEN size >= 0.5 THEN 'strong' WHEN size >= 0.2 THEN 'moderate' ELSE 'weak' END AS strength, greatest(up, 3 - up)::BIGINT AS agreement FROM g")
def _(spark, sf):
    z = attributed(spark, sf)
    wide = R.partial_correlations(z, "target", ["heat", "soil"], ["entity"]).drop("n").join(R.path_coefficients(z, "target", ["heat", "soil"], ["entity"]), "entity")
    wide = wide.join(z.groupBy("entity").agg(*[(F.max(f"phi_{f}") - F.min(f"phi_{f}")).alias(f"range_{f}") for f in ("heat", "soil")]), "entity")
    long = wide.select("entity", F.expr("stack(2, 'heat', range_heat, partial_heat, path_heat, 'soil', range_soil, partial_soil, path_soil) as (feature, effect_range, partial, path)"))
    return R.method_agreement(long, ["entity"])


@query("bootstrap_generic", "class n_rep", "low high mean_of_medians", views=_E, sql="WITH v AS (SELECT class, net, row_number() OVER (PARTITION BY class ORDER BY entity) - 1 AS k, count(*) OVER (PARTITION BY class) AS n FROM ent), d AS (SELECT DISTINCT class, n, rep, s FROM v, range(500) r(rep), range(30) q(s) WHERE s < n), m AS (SELECT d.class, rep, avg(v.net) AS m, median(v.net) AS md FROM d JOIN v ON v.class = d.class AND v.k = ((rep * 1000003 + s * 10007 + 11) * 48271) % 2147483647 % d.n GROUP BY ALL) SELECT class, count(*) AS n_rep, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg(md) AS mean_of_medians FROM m GROUP BY class")
def _(spark, sf):
    reps = bootstrap(entities(spark, sf), "net", ["class"], ["entity"], 500, 11, {"m": array_mean, "md": array_median})
    return reps.groupBy("class").agg(F.count("*").alias("n_rep"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg("md").alias("mean_of_medians"))
