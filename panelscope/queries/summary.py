"""Aggregations over entities, stages, classes and scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import joins, stages, subset
from ..operators import summaries as S
from ..operators.ordered import quantiles
from ..operators.resample import array_mean, bootstrap
from ..plans.panels import EFFECTS, attributed, panel, staged, table, zpanel
from ..sources import materialize
from .access import _LAYERS, layers
from .base import VIEWS, query
from .merging import _ST, two_sources

_COLS = ["phi_dry", "phi_soil", "heat"]
_FORMS = ["pos", "neg", "avg", "sd", "med", "absavg", "absmed", "abssd"]
VIEWS["sse"] = (
    "SELECT e.entity, e.class, s.stage, coalesce(n_values, 0) AS n_values, " + ", ".join(f"{c}_{f}" for c in _COLS for f in _FORMS) + ", net_avg, net_sem, net_sd FROM (SELECT DISTINCT entity, class FROM phi) e CROSS JOIN (SELECT stage FROM rules) s LEFT JOIN (SELECT entity, stage, count(*) AS n_values, "
    + ", ".join(f"avg(CASE WHEN {c} > 0 THEN {c} END) AS {c}_pos, avg(CASE WHEN {c} < 0 THEN {c} END) AS {c}_neg, avg({c}) AS {c}_avg, stddev_samp({c}) AS {c}_sd, median({c}) AS {c}_med, avg(abs({c})) AS {c}_absavg, median(abs({c})) AS {c}_absmed, stddev_samp(abs({c})) AS {c}_abssd" for c in _COLS)
    + ", avg(net) AS net_avg, stddev_samp(net) / sqrt(count(net)) AS net_sem, stddev_samp(net) AS net_sd FROM stage GROUP BY ALL) x USING (entity, stage)"
)


def entity_stats(spark, sf):
    st = staged(spark, sf)
    return S.stage_stats_entity(st, attributed(spark, sf).select("entity", "class").distinct(), list(stages.MAIN), _COLS)


@query("stage_stats_entity", "entity class stage n_values", " ".join(f"{c}_{f}" for c in _COLS for f in _FORMS) + " net_avg net_sem net_sd", views=f"{_ST} sse", sql="SELECT * FROM sse")
def _(spark, sf):
    return entity_stats(spark, sf)


@query("stage_stats_across", "stage class level n", "mean sem min max total_sd", views=f"{_ST} sse", sql="SELECT stage, class, (CASE WHEN grouping(class) = 1 THEN 1 ELSE 0 END)::BIGINT AS level, avg(phi_dry_avg) AS mean, stddev_samp(phi_dry_avg) / sqrt(count(phi_dry_avg)) AS sem, min(phi_dry_avg) AS min, max(phi_dry_avg) AS max, count(phi_dry_avg) AS n, sqrt(avg(phi_dry_sd * phi_dry_sd) + var_pop(phi_dry_avg)) AS total_sd FROM sse GROUP BY GROUPING SETS ((stage), (stage, class))")
def _(spark, sf):
    return S.sets_of(entity_stats(spark, sf), [["stage"], ["stage", "class"]], S.spread("phi_dry_avg", "phi_dry_sd"), ["stage", "class"])


@query("stage_feature_stats", "stage n below", "mean q25 median q75 below_pct", views=f"{_ST} sse", sql="SELECT stage, count(phi_dry_avg) AS n, avg(phi_dry_avg) AS mean, quantile_cont(phi_dry_avg, 0.25) AS q25, median(phi_dry_avg) AS median, quantile_cont(phi_dry_avg, 0.75) AS q75, count(*) FILTER (phi_dry_avg < 0) AS below, 100.0 * count(*) FILTER (phi_dry_avg < 0) / nullif(count(phi_dry_avg), 0) AS below_pct FROM sse GROUP BY stage")
def _(spark, sf):
    v = F.col("phi_dry_avg")
    return entity_stats(spark, sf).groupBy("stage").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), *S.quartiles("phi_dry_avg"), F.count_if(v < 0).alias("below"), (100 * F.try_divide(F.count_if(v < 0).cast("double"), F.count(v).cast("double"))).alias("below_pct"))


@query("stage_distributions", "stage class level sites records", "q25 median q75", views=_ST, sql="SELECT stage, class, grouping(class)::BIGINT AS level, count(*) AS sites, sum(n)::BIGINT AS records, quantile_cont(m, 0.25) AS q25, median(m) AS median, quantile_cont(m, 0.75) AS q75 FROM (SELECT entity, class, stage, count(*) AS n, median(dry_z) AS m FROM stage GROUP BY ALL) GROUP BY GROUPING SETS ((stage), (stage, class))")
def _(spark, sf):
    st = staged(spark, sf)
    middle = quantiles(st, ["entity", "stage"], "dry_z", [0.5]).select("entity", "stage", F.col("q")[0].alias("m"))
    per = st.groupBy("entity", "class", "stage").agg(F.count("*").alias("n")).join(middle, ["entity", "stage"], "left")
    return S.sets_of(per, [["stage"], ["stage", "class"]], [F.count("*").alias("sites"), F.sum("n").alias("records"), *S.quartiles("m")], ["stage", "class"])


@query("stage_sequence_compare", "stage", "main mirrored ratio main_delta", views=f"{_ST} mirror", sql="SELECT a.stage, main, mirrored, main / nullif(mirrored, 0) AS ratio, main - lag(main) OVER (ORDER BY a.stage) AS main_delta FROM (SELECT stage, avg(m) AS main FROM (SELECT entity, stage, avg(net) AS m FROM stage WHERE stage > 0 GROUP BY ALL) GROUP BY stage) a JOIN (SELECT stage, avg(m) AS mirrored FROM (SELECT entity, stage, avg(net) AS m FROM mirror GROUP BY ALL) GROUP BY stage) b USING (stage)")
def _(spark, sf):
    from pyspark.sql import Window as W

    mean = lambda seq: staged(spark, sf, seq).where("stage > 0").groupBy("entity", "stage").agg(F.avg("net").alias("m")).groupBy("stage").agg(F.avg("m").alias(seq))
    both = mean("main").join(mean("mirrored"), "stage")
    # eight rows, one per stage
    return both.withColumns({"ratio": F.try_divide("main", "mirrored"), "main_delta": F.col("main") - F.lag("main").over(W.orderBy("stage"))})


@query("stage_panel_limits", "class stage", "pos neg low high all_low all_high", views=f"{_ST} sse", sql="SELECT *, min(least(neg, low)) OVER () AS all_low, max(greatest(pos, high)) OVER () AS all_high FROM (SELECT class, stage, coalesce(CASE WHEN d > 0 THEN d END, 0) + coalesce(CASE WHEN s > 0 THEN s END, 0) AS pos, coalesce(CASE WHEN d < 0 THEN d END, 0) + coalesce(CASE WHEN s < 0 THEN s END, 0) AS neg, m - coalesce(e, 0) AS low, m + coalesce(e, 0) AS high FROM (SELECT class, stage, avg(phi_dry_avg) AS d, avg(phi_soil_avg) AS s, avg(net_avg) AS m, stddev_samp(net_avg) / sqrt(count(net_avg)) AS e FROM sse GROUP BY ALL) WHERE m IS NOT NULL)")
def _(spark, sf):
    m = entity_stats(spark, sf).groupBy("class", "stage").agg(F.avg("phi_dry_avg").alias("d"), F.avg("phi_soil_avg").alias("s"), F.avg("net_avg").alias("m"), (F.stddev_samp("net_avg") / F.sqrt(F.count("net_avg"))).alias("e")).where("m is not null")
    part = lambda f: sum((F.coalesce(F.when(f(F.col(c)), F.col(c)), F.lit(0.0)) for c in "ds"), F.lit(0.0))
    rows = m.select("class", "stage", part(lambda c: c > 0).alias("pos"), part(lambda c: c < 0).alias("neg"), (F.col("m") - F.coalesce("e", F.lit(0.0))).alias("low"), (F.col("m") + F.coalesce("e", F.lit(0.0))).alias("high"))
    return rows.crossJoin(F.broadcast(rows.agg(F.min(F.least("neg", "low")).alias("all_low"), F.max(F.greatest("pos", "high")).alias("all_high"))))


@query("factorial_summary", "soil_class entities records", "q25 median q75 mean dry0 dry1 dry2 dry3", views="pn z phi fact", sql="WITH e AS (SELECT entity, soil_class, dry_class, count(*) AS n, avg(net) AS m FROM fact GROUP BY ALL) SELECT soil_class, count(DISTINCT entity) AS entities, sum(n)::BIGINT AS records, quantile_cont(m, 0.25) AS q25, median(m) AS median, quantile_cont(m, 0.75) AS q75, avg(m) AS mean, " + ", ".join(f"avg(m) FILTER (dry_class = {k}) AS dry{k}" for k in range(4)) + " FROM e GROUP BY soil_class")
def _(spark, sf):
    e = stages.factorial(attributed(spark, sf)).groupBy("entity", "soil_class", "dry_class").agg(F.count("*").alias("n"), F.avg("net").alias("m"))
    total = e.groupBy("soil_class").agg(F.count_distinct("entity").alias("entities"), F.sum("n").alias("records"), F.avg("m").alias("mean"), *S.quartiles("m"))
    wide = e.groupBy("soil_class").pivot("dry_class", [0, 1, 2, 3]).agg(F.avg("m")).withColumnsRenamed({str(k): f"dry{k}" for k in range(4)})
    return total.join(wide, "soil_class")


VIEWS["s8"] = "SELECT entity, any_value(class) AS class, count(*) AS n_records, avg(net) AS net, avg(phi_dry) AS dry, avg(phi_soil) AS soil FROM stage WHERE stage = 8 GROUP BY entity"


def stage8(spark, sf):
    return staged(spark, sf).where("stage = 8").groupBy("entity").agg(F.first("class").alias("class"), F.count("*").alias("n_records"), F.avg("net").alias("net"), F.avg("phi_dry").alias("dry"), F.avg("phi_soil").alias("soil"))


@query("min_records_sweep", "minimum entities records negatives", "share dry soil ratio median_diff below_pct", views=f"{_ST} s8", sql="SELECT minimum, count(*) AS entities, sum(n_records)::BIGINT AS records, 100.0 * sum(n_records) / (SELECT sum(n_records) FROM s8) AS share, count(*) FILTER (dry < 0) AS negatives, avg(dry) AS dry, avg(soil) AS soil, avg(dry) / avg(soil) AS ratio, median(dry - soil) AS median_diff, 100.0 * count(*) FILTER (dry - soil < 0) / count(*) AS below_pct FROM s8, (VALUES (1), (5), (10), (20), (30), (50), (100)) t(minimum) WHERE n_records >= minimum GROUP BY minimum")
def _(spark, sf):
    s8 = stage8(spark, sf)
    d = F.col("dry") - F.col("soil")
    steps = s8.crossJoin(F.broadcast(s8.agg(F.sum("n_records").alias("all_records")))).withColumn("minimum", F.explode(F.array(*[F.lit(k) for k in (1, 5, 10, 20, 30, 50, 100)]))).where("n_records >= minimum")
    return steps.groupBy("minimum").agg(F.count("*").alias("entities"), F.sum("n_records").alias("records"), (100 * F.sum("n_records") / F.first("all_records")).alias("share"), F.count_if(F.col("dry") < 0).alias("negatives"), F.avg("dry").alias("dry"), F.avg("soil").alias("soil"), F.try_divide(F.avg("dry"), F.avg("soil")).alias("ratio"), F.median(d).alias("median_diff"), (100 * F.avg((d < 0).cast("double"))).alias("below_pct"))


@query("min_records_ratio_ci", "n_rep", "low high", views=f"{_ST} s8", sql="WITH v AS (SELECT dry, soil, row_number() OVER (ORDER BY entity) - 1 AS k, count(*) OVER () AS n FROM s8), d AS (SELECT rep, ((rep * 1000003 + s * 10007 + 7) * 48271) % 2147483647 % n AS k FROM range(10000) r(rep), range(30) q(s), (SELECT any_value(n) AS n FROM v) WHERE s < n) SELECT count(*) AS n_rep, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM (SELECT rep, avg(dry) / avg(soil) AS x FROM d JOIN v USING (k) GROUP BY rep)")
def _(spark, sf):
    s8 = stage8(spark, sf).select(F.lit(1).alias("one"), "entity", F.struct("dry", "soil").alias("v"))
    mean = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + x[f]) / F.size(a)
    reps = bootstrap(s8, "v", ["one"], ["entity"], 10_000, 7, {"x": lambda a: mean(a, "dry") / mean(a, "soil")})
    return reps.agg(F.count("*").alias("n_rep"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


VIEWS["exc"] = "SELECT entity, class, count(dry) AS n, count(*) FILTER (dry > 80000) AS n_above_abs, 100 * avg((dry > 80000)::INT) AS pct_above_abs, count(*) FILTER (dry > own) AS n_above_own, 100 * avg((dry > own)::INT) AS pct_above_own, coalesce(avg(CASE WHEN dry > 80000 THEN dry - 80000 END), 0) AS mean_excess FROM (SELECT *, avg(dry) OVER w + stddev_samp(dry) OVER w AS own FROM p WINDOW w AS (PARTITION BY entity)) WHERE dry IS NOT NULL GROUP BY ALL"


def exceed(spark, sf):
    p = panel(spark, sf)
    own = p.groupBy("entity").agg((F.avg("dry") + F.stddev_samp("dry")).alias("own"))
    return S.exceedance(p.join(own, "entity"), "dry", {"abs": F.lit(80000.0), "own": F.col("own")}, ["entity", "class"])


@query("exceedance_entity", "entity class n n_above_abs n_above_own", "pct_above_abs pct_above_own mean_excess", views="p exc", sql="SELECT * FROM exc", digits=4)
def _(spark, sf):
    return exceed(spark, sf)


@query("exceedance_class", "class n n_above", "pooled_pct median_pct min_pct max_pct", views="p exc", digits=6, sql="SELECT coalesce(class::VARCHAR, 'all') AS class, sum(n)::BIGINT AS n, sum(n_above_abs)::BIGINT AS n_above, 100.0 * sum(n_above_abs) / sum(n) AS pooled_pct, median(pct_above_abs) AS median_pct, min(pct_above_abs) AS min_pct, max(pct_above_abs) AS max_pct FROM exc GROUP BY ROLLUP (class)")
def _(spark, sf):
    out = exceed(spark, sf).rollup("class").agg(F.sum("n").alias("n"), F.sum("n_above_abs").alias("n_above"), (100 * F.sum("n_above_abs") / F.sum("n")).alias("pooled_pct"), F.median("pct_above_abs").alias("median_pct"), F.min("pct_above_abs").alias("min_pct"), F.max("pct_above_abs").alias("max_pct"))
    return out.withColumn("class", F.coalesce(F.col("class").cast("string"), F.lit("all")))


@query("ranked_exceedance", "entity rank", "pct_above_abs", views="p exc", sql="SELECT entity, row_number() OVER (ORDER BY pct_above_abs DESC, entity) AS rank, pct_above_abs FROM exc QUALIFY rank <= 5")
def _(spark, sf):
    from pyspark.sql import Window as W

    top = exceed(spark, sf).orderBy(F.desc("pct_above_abs"), "entity").limit(5)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("pct_above_abs"), "entity")))


_PEAK = "SELECT entity, mon FROM (SELECT entity, mon, row_number() OVER (PARTITION BY entity ORDER BY m DESC, mon) AS rk FROM (SELECT entity, month(ts) AS mon, avg(gpp) AS m FROM p GROUP BY ALL) WHERE m IS NOT NULL) WHERE rk <= 4"
VIEWS["lay"] = _LAYERS
VIEWS["cov"] = f"SELECT entity, v AS variable, n_total, n_total_peak, n_valid, n_valid_peak, 100.0 * n_valid / n_total AS pct, 100.0 * n_valid_peak / nullif(n_total_peak, 0) AS pct_peak, peak_months FROM (SELECT entity, v, count(*) AS n_total, count(x) AS n_valid, count(*) FILTER (pk) AS n_total_peak, count(x) FILTER (pk) AS n_valid_peak FROM (SELECT entity, pk, unnest(['swc_1', 'swc_2', 'swc_3']) AS v, unnest([swc_1, swc_2, swc_3]) AS x FROM (SELECT l.*, (entity, mon) IN (SELECT (entity, mon) FROM ({_PEAK})) AS pk FROM lay l)) GROUP BY ALL) JOIN (SELECT entity, string_agg(mon::VARCHAR, '+' ORDER BY mon) AS peak_months FROM ({_PEAK}) GROUP BY entity) USING (entity)"
VIEWS["rat"] = "SELECT *, n_valid_peak / nullif(max(n_valid_peak) FILTER (variable = 'swc_1') OVER (PARTITION BY entity), 0)::DOUBLE AS ratio FROM cov"
_CV = "p lay cov"


def cover(spark, sf):
    df = layers(spark, sf)
    return S.coverage(df, ["swc_1", "swc_2", "swc_3"], subset.peak_months(df, "gpp"))


def ratios(spark, sf):
    return S.versus_reference(cover(spark, sf), "swc_1")


@query("variable_coverage", "entity variable n_total n_total_peak n_valid n_valid_peak peak_months", "pct pct_peak", views=_CV, sql="SELECT * FROM cov")
def _(spark, sf):
    return cover(spark, sf)


@query("coverage_vs_reference", "entity variable n_valid_peak", "ratio", views=f"{_CV} rat", sql="SELECT * FROM rat")
def _(spark, sf):
    return ratios(spark, sf)


@query("coverage_summary", "variable entities used", "share mean_pct median_pct", views=_CV, sql="SELECT variable, count(*) FILTER (n_valid > 0) AS entities, count(*) FILTER (n_valid > 0 AND entity % 2 = 0) AS used, 100.0 * count(*) FILTER (n_valid > 0) / count(*) AS share, avg(pct) AS mean_pct, median(pct) AS median_pct FROM cov GROUP BY variable")
def _(spark, sf):
    has = F.col("n_valid") > 0
    return cover(spark, sf).groupBy("variable").agg(F.count_if(has).alias("entities"), F.count_if(has & (F.col("entity") % 2 == 0)).alias("used"), (100 * F.avg(has.cast("double"))).alias("share"), F.avg("pct").alias("mean_pct"), F.median("pct").alias("median_pct"))


@query("layer_summary", "variable entities good deeper", "median_pct median_ratio", views=f"{_CV} rat", sql="SELECT variable, count(*) FILTER (n_valid > 0) AS entities, count(*) FILTER (ratio >= 0.9) AS good, (SELECT count(DISTINCT entity) FROM rat WHERE variable <> 'swc_1' AND n_valid > 0) AS deeper, median(pct_peak) AS median_pct, median(ratio) AS median_ratio FROM rat GROUP BY variable")
def _(spark, sf):
    r = ratios(spark, sf)
    out = r.groupBy("variable").agg(F.count_if(F.col("n_valid") > 0).alias("entities"), F.count_if(F.col("ratio") >= 0.9).alias("good"), F.median("pct_peak").alias("median_pct"), F.median("ratio").alias("median_ratio"))
    return out.crossJoin(F.broadcast(r.where("variable <> 'swc_1' and n_valid > 0").agg(F.count_distinct("entity").alias("deeper"))))


@query("deepest_usable_layer", "entity variable layer", views=f"{_CV} rat", sql="SELECT entity, max_by(variable, variable) AS variable, max(right(variable, 1)::INT) AS layer FROM rat WHERE variable <> 'swc_1' AND ratio >= 0.9 GROUP BY entity")
def _(spark, sf):
    return S.deepest_layer(ratios(spark, sf))


_TYPES = {"water": ["swc_1", "swc_2", "swc_3", "soil", "wet"], "air": ["heat", "dry", "light", "light_pot", "gpp"]}
_TYPED = [(t, v) for t, names in _TYPES.items() for v in names]


@query("coverage_top_k", "type variable entities rank", views="p lay", sql="SELECT type, variable, entities, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY entities DESC, variable) AS rank FROM (SELECT type, variable, count(*) FILTER (n > 0) AS entities FROM (SELECT entity, type, variable, count(x) AS n FROM (SELECT entity, unnest([" + ", ".join(f"'{t}'" for t, _ in _TYPED) + "]) AS type, unnest([" + ", ".join(f"'{v}'" for _, v in _TYPED) + "]) AS variable, unnest([" + ", ".join(v for _, v in _TYPED) + "]) AS x FROM (SELECT entity, heat, soil, dry, light, light_pot, gpp, CASE WHEN entity % 4 <> 0 THEN soil END AS swc_1, CASE WHEN l_partkey % 13 <> 0 THEN soil END AS swc_2, CASE WHEN l_partkey % 4 <> 0 THEN soil END AS swc_3, CASE WHEN entity % 10 = 0 THEN soil END AS wet FROM p)) GROUP BY ALL) GROUP BY type, variable)) WHERE rank <= 4")
def _(spark, sf):
    from pyspark.sql import Window as W

    df = layers(spark, sf).withColumn("wet", F.when(F.col("entity") % 10 == 0, F.col("soil")))
    has = df.groupBy("entity").agg(*[F.count(v).alias(v) for _, v in _TYPED]).agg(*[F.count_if(F.col(v) > 0).alias(v) for _, v in _TYPED])
    long = has.select(F.inline(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).alias("variable"), F.col(v).alias("entities")) for t, v in _TYPED])))
    return long.withColumn("rank", F.row_number().over(W.partitionBy("type").orderBy(F.desc("entities"), "variable"))).where("rank <= 4")


@query("daily_coverage", "days", "median_all median_day share full75", sql="WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n, count(*) FILTER (hour(ts) BETWEEN 6 AND 18) AS m FROM events GROUP BY ALL) SELECT count(*) AS days, median(n) AS median_all, median(m) AS median_day, avg(s) AS share, avg((s >= 75)::INT) AS full75 FROM (SELECT *, 100.0 * m / n AS s FROM d)")
def _(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.hour("ts").between(6, 18)).alias("m"))
    s = 100.0 * F.col("m") / F.col("n")
    # a row for each entity and day: as many as the table may have
    middle = lambda c: quantiles(d, [], c, [0.5]).select(F.col("q")[0].alias(f"median_{c}"))
    out = d.agg(F.count("*").alias("days"), F.avg(s).alias("share"), F.avg((s >= 75).cast("double")).alias("full75"))
    return out.crossJoin(middle("n")).crossJoin(middle("m")).withColumnsRenamed({"median_n": "median_all", "median_m": "median_day"})


@query("timescale_sample_size", "scale rows_kept stage8", views="pn", sql=" UNION ALL ".join(f"SELECT '{k}' AS scale, count(*) AS rows_kept, count(*) FILTER (h > 1.2815515655446 AND d > 1.2815515655446 AND s < -1.2815515655446) AS stage8 FROM (SELECT (h - avg(h) OVER w) / nullif(stddev_pop(h) OVER w, 0) AS h, (d - avg(d) OVER w) / nullif(stddev_pop(d) OVER w, 0) AS d, (s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0) AS s FROM (SELECT entity, avg(heat) AS h, avg(dry) AS d, avg(soil) AS s FROM pn WHERE dry IS NOT NULL AND soil IS NOT NULL GROUP BY entity, date_trunc('{k}', ts) {'HAVING count(*) >= 2' if k == 'day' else ''}) WINDOW w AS (PARTITION BY entity))" for k in ("day", "month", "year")))
def _(spark, sf):
    from functools import reduce

    p = panel(spark, sf, "s_nationkey").where("dry is not null and soil is not null")
    parts = []
    for scale, least in (("day", 2), ("month", 1), ("year", 1)):
        g = p.groupBy("entity", F.date_trunc(scale, "ts").alias("t")).agg(F.count("*").alias("k"), *[F.avg(c).alias(c) for c in ("heat", "dry", "soil")]).where(F.col("k") >= least)
        z = subset.zscore(g, ["heat", "dry", "soil"])
        parts.append(z.agg(F.lit(scale).alias("scale"), F.count("*").alias("rows_kept"), F.count_if(stages.rule("main", 8)).alias("stage8")))
    return reduce(lambda a, b: a.union(b), parts)


@query("yearly_climate", "entity n_years", "ta precip", views="p", digits=3, sql="SELECT entity, count(*) AS n_years, avg(ta) AS ta, avg(pr) AS precip FROM (SELECT entity, year(ts - INTERVAL 1 HOUR) AS yr, avg(heat) - 273.15 AS ta, 1000 * sum(light) AS pr FROM p WHERE ts - INTERVAL 1 HOUR >= TIMESTAMP '1996-01-01' AND ts - INTERVAL 1 HOUR < TIMESTAMP '2001-01-01' GROUP BY ALL) GROUP BY entity HAVING count(*) = 5")
def _(spark, sf):
    shifted = panel(spark, sf).withColumn("t", F.col("ts") - F.expr("INTERVAL 1 HOUR")).where("t >= timestamp_ntz'1996-01-01' and t < timestamp_ntz'2001-01-01'")
    yearly = shifted.groupBy("entity", F.year("t").alias("year")).agg((F.avg("heat") - 273.15).alias("ta"), (1000 * F.sum("light")).alias("pr"))
    return yearly.groupBy("entity").agg(F.count("*").alias("n_years"), F.avg("ta").alias("ta"), F.avg("pr").alias("precip")).where("n_years = 5")


VIEWS["clim"] = "SELECT p_partkey AS entity, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS product, p_retailprice * 0.9 + p_size AS alternative, CASE WHEN p_partkey % 5 = 0 THEN -9999.0 WHEN p_partkey % 3 = 0 THEN p_retailprice * 0.6 ELSE p_retailprice * 1.02 END AS manual, p_retailprice * 1.1 AS network, CASE WHEN p_partkey % 11 = 0 THEN -9999 ELSE 1 END AS slope, CASE WHEN p_partkey % 97 = 0 THEN 'hand set' END AS override FROM part"
VIEWS["casc"] = "SELECT *, CASE WHEN reason = '' THEN 'product' ELSE 'alternative' END AS source, CASE WHEN reason = '' THEN product ELSE alternative END AS value FROM (SELECT *, CASE WHEN override IS NOT NULL THEN 'override: ' || override WHEN product IS NULL THEN 'no product value' WHEN slope = -9999 THEN 'not scaled' WHEN abs(product - reported) / reported > 0.25 AND abs(alternative - reported) / reported < abs(product - reported) / reported THEN 'off the reported value' ELSE '' END AS reason FROM (SELECT *, CASE WHEN manual NOT IN (0, -9999) THEN manual ELSE network END AS reported, CASE WHEN manual NOT IN (0, -9999) THEN 'manual' ELSE 'network' END AS reported_from FROM clim))"


def cascade(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    r = F.col("p_retailprice")
    rows = p.select(k.alias("entity"), F.when(k % 7 != 0, r).alias("product"), (r * 0.9 + F.col("p_size")).alias("alternative"), F.when(k % 5 == 0, -9999.0).when(k % 3 == 0, r * 0.6).otherwise(r * 1.02).alias("manual"), (r * 1.1).alias("network"), F.when(k % 11 == 0, -9999).otherwise(1).alias("slope"), F.when(k % 97 == 0, "hand set").alias("override"))
    value, source = S.reported_value("manual", "network")
    return S.climate_cascade(rows.withColumns({"reported": value, "reported_from": source}))


@query("climate_source_cascade", "entity source reason reported_from", "value", views="clim casc", sql="SELECT * FROM casc", digits=4)
def _(spark, sf):
    return cascade(spark, sf)


@query("climate_source_counts", "source reason n", views="clim casc", sql="SELECT source, regexp_replace(reason, ':.*', '') AS reason, count(*) AS n FROM casc GROUP BY ALL")
def _(spark, sf):
    return cascade(spark, sf).groupBy("source", F.regexp_replace("reason", ":.*", "").alias("reason")).agg(F.count("*").alias("n"))


@query("class_counts", "class entities entity_years", views="p", sql="SELECT class, count(*) AS entities, sum(y)::BIGINT AS entity_years FROM (SELECT class, entity, year(max(ts)) - year(min(ts)) + 1 AS y FROM p GROUP BY ALL) GROUP BY class")
def _(spark, sf):
    e = panel(spark, sf).groupBy("class", "entity").agg((F.year(F.max("ts")) - F.year(F.min("ts")) + 1).alias("y"))
    return e.groupBy("class").agg(F.count("*").alias("entities"), F.sum("y").alias("entity_years"))


# Shares of a standard normal at or below the six cut-offs.
_NORMAL = {"-c": (-1.2815515655446, 0.1), "-b": (-0.714367440280187, 0.2375), "-a": (-0.31863936, 0.375), "a": (0.31863936, 0.625), "b": (0.714367440280187, 0.7625), "c": (1.2815515655446, 0.9)}


@query("cutoff_shares", "driver cut", "q25 median q75 minus_normal", views="pn z", sql="SELECT driver, cut, quantile_cont(s, 0.25) AS q25, median(s) AS median, quantile_cont(s, 0.75) AS q75, median(s) - any_value(g) AS minus_normal FROM (SELECT entity, driver, cut, g, avg((v <= x)::INT) AS s FROM (SELECT entity, unnest(['heat', 'dry', 'soil', 'light']) AS driver, unnest([heat_z, dry_z, soil_z, light_z]) AS v FROM z), (VALUES " + ", ".join(f"('{k}', {x}, {g})" for k, (x, g) in _NORMAL.items()) + ") t(cut, x, g) GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    z = zpanel(spark, sf)
    aggs = [F.avg((F.col(f"{d}_z") <= x).cast("double")).alias(f"{d}|{k}") for d in ("heat", "dry", "soil", "light") for k, (x, _) in _NORMAL.items()]
    wide = z.groupBy("entity").agg(*aggs)
    items = [(d, k, g) for d in ("heat", "dry", "soil", "light") for k, (_, g) in _NORMAL.items()]
    long = wide.select(F.expr(f"stack({len(items)}, " + ", ".join(f"'{d}', '{k}', double({g}), `{d}|{k}`" for d, k, g in items) + ") as (driver, cut, g, s)"))
    return long.groupBy("driver", "cut").agg(*S.quartiles("s"), (F.median("s") - F.first("g")).alias("minus_normal"))


VIEWS["prd"] = "SELECT *, target_z AS y, 0.5 * net + 0.1 * heat_z AS pred FROM phi"


def predicted(spark, sf):
    return attributed(spark, sf).withColumns({"y": F.col("target_z"), "pred": 0.5 * F.col("net") + 0.1 * F.col("heat_z")})


_SK = "n, CASE WHEN n >= 10 AND sst > 0 THEN 1 - sse / sst END AS r2, CASE WHEN n >= 10 THEN sqrt(sse / n) END AS rmse, CASE WHEN n >= 10 THEN sae / n END AS mae, CASE WHEN n >= 10 THEN se / n END AS bias"
VIEWS["skl"] = f"SELECT entity, part, {_SK} FROM (SELECT entity, part, count(*) AS n, var_pop(y) * count(*) AS sst, sum((pred - y) * (pred - y)) AS sse, sum(abs(pred - y)) AS sae, sum(pred - y) AS se FROM (SELECT *, 'all' AS part FROM prd UNION ALL SELECT *, 'stage8' FROM prd WHERE heat_z > 1.2815515655446 AND dry_z > 1.2815515655446 AND soil_z < -1.2815515655446 UNION ALL SELECT *, 'tail' FROM prd WHERE dry_z > 1.2815515655446) GROUP BY ALL)"


def skills(spark, sf):
    parts = F.array_compact(F.array(F.lit("all"), F.when(stages.rule("main", 8), "stage8"), F.when(F.col("dry_z") > stages.CUTS["c"], "tail")))
    return predicted(spark, sf).withColumn("part", F.explode(parts)).groupBy("entity", "part").agg(*S.skill("y", "pred"))


@query("skill_metrics", "entity part n", "r2 rmse mae bias", views="pn z phi prd skl", sql="SELECT * FROM skl")
def _(spark, sf):
    return skills(spark, sf)


@query("skill_summary", "part metric count", "q25 median q75", views="pn z phi prd skl", sql="SELECT part, metric, count(v) AS count, quantile_cont(v, 0.25) AS q25, median(v) AS median, quantile_cont(v, 0.75) AS q75 FROM (SELECT part, unnest(['r2', 'rmse', 'mae', 'bias']) AS metric, unnest([r2, rmse, mae, bias]) AS v FROM skl) GROUP BY ALL")
def _(spark, sf):
    long = skills(spark, sf).unpivot(["part"], ["r2", "rmse", "mae", "bias"], "metric", "v")
    return long.groupBy("part", "metric").agg(F.count("v").alias("count"), *S.quartiles("v"))


VIEWS["wue"] = "SELECT w.*, w.g / w.e / (t.g / t.e) AS rel FROM (SELECT entity, floor(dry_z * 10)::BIGINT AS bx, avg(heat) AS g, avg(light) AS e, count(*) AS n FROM z GROUP BY ALL HAVING count(*) >= 10 AND avg(light) > 0.01) w JOIN (SELECT entity, avg(heat) AS g, avg(light) AS e FROM z GROUP BY entity) t USING (entity)"


def wue(spark, sf):
    z = zpanel(spark, sf)
    bins = z.groupBy("entity", F.floor(F.col("dry_z") * 10).alias("bx")).agg(F.avg("heat").alias("g"), F.avg("light").alias("e"), F.count("*").alias("n")).where("n >= 10 and e > 0.01")
    own = z.groupBy("entity").agg((F.avg("heat") / F.avg("light")).alias("own"))
    return bins.join(own, "entity").withColumn("rel", F.col("g") / F.col("e") / F.col("own"))


@query("wue_curve_entity", "entity bx n", "rel", views="pn z wue", sql="SELECT * FROM wue")
def _(spark, sf):
    return wue(spark, sf)


@query("wue_across", "bx entities", "q25 median q75", views="pn z wue", sql="SELECT bx, count(DISTINCT entity) AS entities, quantile_cont(rel, 0.25) AS q25, median(rel) AS median, quantile_cont(rel, 0.75) AS q75 FROM wue GROUP BY bx HAVING count(DISTINCT entity) >= ceil((SELECT count(DISTINCT entity) FROM wue) / 2.0)")
def _(spark, sf):
    w = wue(spark, sf)
    out = w.groupBy("bx").agg(F.count_distinct("entity").alias("entities"), *S.quartiles("rel"))
    return out.crossJoin(F.broadcast(w.agg(F.count_distinct("entity").alias("all")))).where(F.col("entities") >= F.ceil(F.col("all") / 2))


@query("direction_of_effect", "driver up down entities", views="pn z phi", sql="SELECT driver, count(*) FILTER (r > 0) AS up, count(*) FILTER (r < 0) AS down, count(*) AS entities FROM (SELECT entity, driver, corr(bx, m) AS r FROM (SELECT entity, driver, round_even(x * 10, 0) AS bx, avg(v) AS m, count(*) AS n FROM (SELECT entity, unnest(['heat', 'dry', 'soil']) AS driver, unnest([heat_z, dry_z, soil_z]) AS x, unnest([phi_heat, phi_dry, phi_soil]) AS v FROM phi) GROUP BY ALL HAVING count(*) >= 10) GROUP BY ALL HAVING count(*) >= 11) GROUP BY driver")
def _(spark, sf):
    long = attributed(spark, sf).select("entity", F.expr("stack(3, 'heat', heat_z, phi_heat, 'dry', dry_z, phi_dry, 'soil', soil_z, phi_soil) as (driver, x, v)"))
    bins = long.groupBy("entity", "driver", F.rint(F.col("x") * 10).alias("bx")).agg(F.avg("v").alias("m"), F.count("*").alias("n")).where("n >= 10")
    r = bins.groupBy("entity", "driver").agg(F.corr("bx", "m").alias("r"), F.count("*").alias("k")).where("k >= 11")
    return r.groupBy("driver").agg(F.count_if(F.col("r") > 0).alias("up"), F.count_if(F.col("r") < 0).alias("down"), F.count("*").alias("entities"))


@query("region_leave_out", "scenario entities", "median_dry ratio", views=f"{_ST} s8", sql="SELECT scenario, count(*) AS entities, median(dry) AS median_dry, avg(dry) / avg(soil) AS ratio FROM s8, (VALUES ('none', -1), ('no 0', 0), ('no 1', 1), ('no 2', 2), ('no 3', 3), ('no 4', 4)) t(scenario, c) WHERE class <> c GROUP BY scenario")
def _(spark, sf):
    drop = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(c).alias("c")) for n, c in (("none", -1), ("no 0", 0), ("no 1", 1), ("no 2", 2), ("no 3", 3), ("no 4", 4))])
    rows = stage8(spark, sf).withColumn("s", F.explode(drop)).where("class <> s.c")
    return rows.groupBy("s.scenario").agg(F.count("*").alias("entities"), F.median("dry").alias("median_dry"), F.try_divide(F.avg("dry"), F.avg("soil")).alias("ratio"))


@query("min_years_sensitivity", "minimum entities", "pct_records median_net ratio", views="pn z phi", sql="WITH e AS (SELECT entity, count(DISTINCT year(ts)) AS y, count(*) AS n, avg(net) AS net, avg(phi_dry) AS d, avg(phi_soil) AS s FROM phi GROUP BY entity) SELECT minimum, count(*) AS entities, 100.0 * sum(n) / (SELECT sum(n) FROM e) AS pct_records, median(net) AS median_net, avg(d) / avg(net) AS ratio FROM e, (VALUES (1), (2), (3), (5), (10)) t(minimum) WHERE y >= minimum GROUP BY minimum")
def _(spark, sf):
    e = attributed(spark, sf).groupBy("entity").agg(F.count_distinct(F.year("ts")).alias("y"), F.count("*").alias("n"), F.avg("net").alias("net"), F.avg("phi_dry").alias("d"))
    e = e.crossJoin(F.broadcast(e.agg(F.sum("n").alias("total")))).withColumn("minimum", F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 10))))).where("y >= minimum")
    return e.groupBy("minimum").agg(F.count("*").alias("entities"), (100 * F.sum("n") / F.first("total")).alias("pct_records"), F.median("net").alias("median_net"), F.try_divide(F.avg("d"), F.avg("net")).alias("ratio"))


@query("label_conflict_check", "class level flag entities", "median_net mean_net", views="pn z phi", sql="SELECT coalesce(class::VARCHAR, 'all') AS class, grouping(class)::BIGINT AS level, flag, count(*) AS entities, median(net) AS median_net, avg(net) AS mean_net FROM (SELECT entity, class, avg(net) AS net FROM phi GROUP BY ALL) e, (VALUES ('with'), ('without')) t(flag) WHERE flag = 'with' OR entity NOT IN (3, 9, 17) GROUP BY GROUPING SETS ((flag), (flag, class))")
def _(spark, sf):
    e = attributed(spark, sf).groupBy("entity", "class").agg(F.avg("net").alias("net"))
    flags = F.when(F.col("entity").isin(3, 9, 17), F.array(F.lit("with"))).otherwise(F.array(F.lit("with"), F.lit("without")))
    out = S.sets_of(e.withColumn("flag", F.explode(flags)), [["flag"], ["flag", "class"]], [F.count("*").alias("entities"), F.median("net").alias("median_net"), F.avg("net").alias("mean_net")], ["flag", "class"])
    return out.withColumn("class", F.coalesce(F.col("class").cast("string"), F.lit("all")))


VIEWS["mat"] = "SELECT a.entity, a.net, a.dry_z, a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.ts, min(CASE WHEN b.net IS NOT NULL THEN (round((a.heat_z - b.heat_z) ** 2 + (a.soil_z - b.soil_z) ** 2 + (a.light_z - b.light_z) ** 2, 9), b.ts, b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_suppkey, b.net) END) AS m FROM (SELECT * FROM stage WHERE stage = 8) a LEFT JOIN (SELECT * FROM stage WHERE stage = 7) b ON a.entity = b.entity AND abs(a.heat_z - b.heat_z) <= 0.5 AND abs(a.soil_z - b.soil_z) <= 0.5 AND abs(a.light_z - b.light_z) <= 0.5 GROUP BY ALL"
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ts"]
_CALIPERS = ["heat_z", "soil_z", "light_z"]
#: What matched rows are compared by, and what is compared of all rows of the stages.
_SHIFTS, _ALL = ["net", *_CALIPERS, "dry_z", *EFFECTS], ["net", "phi_dry"]


def matched(spark, sf, modes=("plain",)):
    """Stage 8 rows once for each mode, with the nearest stage 7 row's values as *7; strict also asks for the same month and hours at most one apart."""
    st = materialize(staged(spark, sf).where("stage in (7, 8)").select("entity", "stage", *_KEY, *_SHIFTS))
    a, b = st.where("stage = 8"), st.where("stage = 7")
    other = b.select("entity", F.struct("ts", *[k for k in _KEY if k != "ts"]).alias("match"), *[F.col(c).alias(f"{c}7") for c in _SHIFTS])
    found = [joins.caliper_nearest(a, b, _CALIPERS, 0.5, _KEY, strict=mode == "strict").withColumn("mode", F.lit(mode)) for mode in modes]
    return b, reduce(lambda p, q: p.unionByName(q), found).join(other, ["entity", "match"], "left")


VIEWS["mate"] = "SELECT entity, count(*) AS n8, count(m) AS matched, 100.0 * count(m) / count(*) AS share, avg(net - m[7]) AS diff, avg(CASE WHEN m IS NULL THEN net END) AS unmatched_net FROM mat GROUP BY entity"


def _hits():
    return [F.count("*").alias("n8"), F.count("d2").alias("matched"), (100.0 * F.count("d2") / F.count("*")).alias("share"), F.avg(F.col("net") - F.col("net7")).alias("diff"), F.avg(F.when(F.col("d2").isNull(), F.col("net"))).alias("unmatched_net")]


def match_stats(spark, sf):
    """Both modes by entity: counts, balance of the covariates, differences of effects, and both stages' means of all rows."""
    all7, pairs = matched(spark, sf, ("plain", "strict"))
    sums = pairs.groupBy("entity", "mode").agg(*_hits(), *[F.avg(F.col(c) - F.col(f"{c}7")).alias(f"d_{c}") for c in _SHIFTS if c != "net"], *[F.avg(c).alias(f"{c}_8") for c in _ALL])
    of7 = all7.groupBy("entity").agg(F.count("*").alias("n7"), *[F.avg(c).alias(f"{c}_7") for c in _ALL])
    return sums.join(of7, "entity", "left").fillna(0, ["n7"])


_D = ", ".join(f"avg({c} - m[{7 + i}]) AS d_{c}" for i, c in enumerate(_SHIFTS) if c != "net")
VIEWS["mats"] = f"SELECT a.entity, mode, {', '.join(f'a.{c}' for c in [*_SHIFTS, *_KEY])}, min(CASE WHEN b.net IS NOT NULL THEN (round((a.heat_z - b.heat_z) ** 2 + (a.soil_z - b.soil_z) ** 2 + (a.light_z - b.light_z) ** 2, 9), b.ts, b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_suppkey, {', '.join(f'b.{c}' for c in _SHIFTS)}) END) AS m FROM (SELECT * FROM stage WHERE stage = 8) a CROSS JOIN (VALUES ('plain'), ('strict')) v(mode) LEFT JOIN (SELECT * FROM stage WHERE stage = 7) b ON a.entity = b.entity AND abs(a.heat_z - b.heat_z) <= 0.5 AND abs(a.soil_z - b.soil_z) <= 0.5 AND abs(a.light_z - b.light_z) <= 0.5 AND (mode = 'plain' OR (month(a.ts) = month(b.ts) AND abs(hour(a.ts) - hour(b.ts)) <= 1)) GROUP BY ALL"


@query("matching_entity", "entity mode n7 n8 matched", f"share diff unmatched_net {' '.join(f'd_{c}' for c in _SHIFTS if c != 'net')} {' '.join(f'{c}_{k}' for k in (7, 8) for c in _ALL)}", views=f"{_ST} mats", sql=f"SELECT x.*, coalesce(n7, 0) AS n7, {', '.join(f'{c}_7' for c in _ALL)} FROM (SELECT entity, mode, count(*) AS n8, count(m) AS matched, 100.0 * count(m) / count(*) AS share, avg(net - m[7]) AS diff, avg(CASE WHEN m IS NULL THEN net END) AS unmatched_net, {_D}, {', '.join(f'avg({c}) AS {c}_8' for c in _ALL)} FROM mats GROUP BY entity, mode) x LEFT JOIN (SELECT entity, count(*) AS n7, {', '.join(f'avg({c}) AS {c}_7' for c in _ALL)} FROM stage WHERE stage = 7 GROUP BY entity) y USING (entity)")
def _(spark, sf):
    return match_stats(spark, sf)


@query("matching_summary", "entities n8 matched", "median_diff mean_diff below_pct", views=f"{_ST} mat mate", sql="SELECT count(*) AS entities, sum(n8)::BIGINT AS n8, sum(matched)::BIGINT AS matched, median(diff) AS median_diff, avg(diff) AS mean_diff, 100.0 * avg((diff < 0)::INT) AS below_pct FROM mate")
def _(spark, sf):
    return matched(spark, sf)[1].groupBy("entity").agg(*_hits()).agg(F.count("*").alias("entities"), F.sum("n8").alias("n8"), F.sum("matched").alias("matched"), F.median("diff").alias("median_diff"), F.avg("diff").alias("mean_diff"), (100.0 * F.avg((F.col("diff") < 0).cast("double"))).alias("below_pct"))


@query("conditional_quantile_bounds", "entity", "low high", views="p", sql="SELECT entity, quantile_cont(dry, 0.02) AS low, quantile_cont(dry, 0.98) AS high FROM p GROUP BY entity", digits=4)
def _(spark, sf):
    return quantiles(panel(spark, sf), ["entity"], "dry", [0.02, 0.98]).select("entity", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


@query("datetime_heatmap", "entity day", " ".join(f"h{h}" for h in range(24)), sql="SELECT user_id AS entity, ts::DATE AS day, " + ", ".join(f"avg(value) FILTER (hour(ts) = {h}) AS h{h}" for h in range(24)) + " FROM events GROUP BY 1, 2", digits=4)
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "value")
    return ev.groupBy("entity", "day").agg(*[F.avg(F.when(F.col("hour") == h, F.col("value"))).alias(f"h{h}") for h in range(24)])
