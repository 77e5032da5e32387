"""Source merge, time alignment, model input, stages and bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import grid, merge, stages, subset
from ..operators.resample import array_median, bootstrap
from ..sources import materialize
from ..plans.panels import DRIVERS, EFFECTS, attributed, panel, staged, table, zpanel
from .base import VIEWS, query

_EV = "SELECT user_id AS entity, ts, value AS x, event_type AS origin FROM events"


def events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("entity"), "ts", F.col("value").alias("x"), F.col("event_type").alias("origin"))


@query("resample_lower_freq", "entity ts n origin", "x", sql=f"SELECT entity, date_trunc('hour', ts) + INTERVAL 30 MINUTE AS ts, count(*) AS n, avg(x) AS x, max_by(origin, ts) AS origin FROM ({_EV}) GROUP BY entity, date_trunc('hour', ts)")
def _(spark, sf):
    return merge.resample(events(spark, sf), 60, ["x"], ["origin"])


VIEWS["sa"] = "SELECT * FROM p WHERE l_returnflag IN ('A', 'N') AND year(ts) <= 1999"
VIEWS["sb"] = "SELECT * FROM p WHERE l_returnflag IN ('N', 'R') AND year(ts) >= 1998"


def two_sources(spark, sf):
    p = panel(spark, sf)
    return p.where("l_returnflag in ('A', 'N') and year(ts) <= 1999"), p.where("l_returnflag in ('N', 'R') and year(ts) >= 1998")


def _merge_sql(a: str, b: str, prefix: str) -> str:
    """Views of one merge step: prefix_m holds its rows."""
    steps = {
        "u": f"SELECT *, 1 AS src FROM {a} UNION ALL SELECT *, 2 FROM {b}",
        "f": f"SELECT entity, min(year(ts)) FILTER (src = 1) AS y0, count(DISTINCT src) AS k FROM {prefix}_u GROUP BY entity",
        "c": f"SELECT entity, y0, k, count(*) FILTER (src = 1 AND qc = 0 AND year(ts) = y0) AS m1, count(*) FILTER (src = 2 AND qc = 0 AND year(ts) = y0) AS m2 FROM {prefix}_u JOIN {prefix}_f USING (entity) GROUP BY ALL",
        "d": f"SELECT *, CASE WHEN k = 2 AND m1 > m2 THEN 2 WHEN k = 2 AND m2 > m1 THEN 1 ELSE 0 END AS drops FROM {prefix}_c",
        "s": f"SELECT entity, min(ts) FILTER (src = 1) AS lo1, max(ts) FILTER (src = 1) AS hi1, min(ts) FILTER (src = 2) AS lo2, max(ts) FILTER (src = 2) AS hi2 FROM {prefix}_u JOIN {prefix}_d USING (entity) WHERE NOT coalesce(src = drops AND year(ts) = y0, FALSE) GROUP BY entity",
        "p": f"SELECT *, CASE WHEN k < 2 THEN 'single' WHEN lo1 IS NULL OR lo2 IS NULL THEN 'emptied' ELSE 'merged' END AS status, CASE WHEN hi2 > hi1 THEN 2 ELSE 1 END AS leader, CASE WHEN hi2 > hi1 THEN lo2 ELSE lo1 END AS edge FROM {prefix}_d LEFT JOIN {prefix}_s USING (entity)",
        "m": f"SELECT u.* EXCLUDE (src), status FROM {prefix}_u u JOIN {prefix}_p USING (entity) WHERE status <> 'merged' OR (NOT (src = drops AND year(ts) = y0) AND (src = leader OR ts < edge))",
    }
    for k, v in steps.items():
        VIEWS[f"{prefix}_{k}"] = v
    return " ".join(f"{prefix}_{k}" for k in steps)


_M1 = _merge_sql("sa", "sb", "m1")
VIEWS["sc"] = "SELECT * FROM p WHERE l_returnflag = 'R' AND year(ts) <= 1996"


@query("priority_merge", "entity status n first last", "heat", views=f"p sa sb {_M1}", sql="SELECT entity, status, count(*) AS n, min(ts) AS first, max(ts) AS last, sum(heat) AS heat FROM m1_m GROUP BY ALL", digits=2)
def _(spark, sf):
    out = merge.priority_merge(*two_sources(spark, sf))
    return out.groupBy("entity", "status").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("heat").alias("heat"))


# three daily sources with their own variables; the third lacks the first variable for some entities
_DAY = "SELECT entity, date_trunc('day', ts) + INTERVAL 12 HOUR AS ts, avg(qc) AS qc, avg(heat) AS heat, avg(CASE WHEN entity % 3 <> 0 {0} THEN gpp END) AS nee_a, avg(dry) AS nee_b, '{1}' AS origin FROM {2} GROUP BY entity, date_trunc('day', ts)"
VIEWS["da"], VIEWS["db"], VIEWS["dc"] = _DAY.format("", "A", "sa"), _DAY.format("", "B", "sb"), _DAY.format("AND entity % 5 <> 0", "C", "sc")
_K1 = _merge_sql("da", "db", "k1")
VIEWS["k1x"] = "SELECT * EXCLUDE (status) FROM k1_m"
_K2 = _merge_sql("k1x", "dc", "k2")


@query("priority_merge_fold", "entity origin variable status n first segment", "heat lat", views=f"p sa sb sc da db dc {_K1} k1x {_K2}", digits=2, sql="""WITH pres AS (SELECT entity, 1 AS pr, 'A' AS o, count(nee_a) AS a, count(nee_b) AS b FROM da GROUP BY entity UNION ALL SELECT entity, 2, 'B', count(nee_a), count(nee_b) FROM db GROUP BY entity UNION ALL SELECT entity, 3, 'C', count(nee_a), count(nee_b) FROM dc GROUP BY entity),
 vr AS (SELECT entity, string_agg(o, '+' ORDER BY pr) AS origin, CASE WHEN arg_min(a, pr) > 0 THEN 'nee_a' WHEN arg_min(b, pr) > 0 THEN 'nee_b' END AS variable, min_by(CASE WHEN (entity + pr) % 3 = 0 THEN entity::DOUBLE END, pr) FILTER ((entity + pr) % 3 = 0) AS lat, min_by('s' || pr, pr) FILTER ((entity * pr) % 2 = 0) AS segment FROM pres GROUP BY entity),
 ms AS (SELECT entity, bool_or(CASE variable WHEN 'nee_a' THEN a = 0 WHEN 'nee_b' THEN b = 0 ELSE TRUE END) AS missing FROM pres JOIN vr USING (entity) GROUP BY entity),
 em AS (SELECT entity FROM k1_p WHERE status = 'emptied' UNION SELECT entity FROM k2_p WHERE status = 'emptied'),
 ag AS (SELECT entity, count(*) AS n, count(DISTINCT ts) AS d, min(ts) AS first, sum(heat) AS heat FROM k2_m GROUP BY entity)
 SELECT ag.entity, origin, variable, CASE WHEN missing THEN 'variable' WHEN em.entity IS NOT NULL THEN 'emptied' WHEN n <> d THEN 'duplicate' WHEN origin NOT LIKE '%+%' THEN 'single' ELSE 'merged' END AS status, n, first, heat, lat, segment FROM ag JOIN vr USING (entity) JOIN ms USING (entity) LEFT JOIN em ON em.entity = ag.entity""")
def _(spark, sf):
    raw = [*two_sources(spark, sf), panel(spark, sf).where("l_returnflag = 'R' and year(ts) <= 1996")]
    sources, meta = {}, []
    for priority, (name, df) in enumerate(zip("ABC", raw, strict=True), 1):
        has = F.col("entity") % 3 != 0
        df = df.withColumns({"nee_a": F.when(has if name != "C" else has & (F.col("entity") % 5 != 0), F.col("gpp")), "nee_b": F.col("dry")})
        daily = merge.resample(df.select("entity", "ts", "qc", "heat", "nee_a", "nee_b"), 1440, ["qc", "heat", "nee_a", "nee_b"], []).drop("n")
        sources[name] = materialize(daily)
        e = sources[name].select("entity").distinct()
        meta.append(e.select("entity", F.lit(priority).alias("priority"), F.lit(name).alias("origin"), F.when((F.col("entity") + priority) % 3 == 0, F.col("entity").cast("double")).alias("lat"), F.when(F.col("entity") * priority % 2 == 0, F.lit(f"s{priority}")).alias("segment")))
    rows, sites = merge.merge_sources(sources, reduce(lambda a, b: a.unionByName(b), meta), ["lat", "segment"], ["nee_a", "nee_b"])
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.sum("heat").alias("heat")).join(sites, "entity")


_META = "SELECT c_nationkey AS entity, c_custkey AS priority, 'o' || c_custkey AS origin, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS lat, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS segment FROM customer"


def _meta(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_nationkey").alias("entity"), F.col("c_custkey").alias("priority"), F.concat(F.lit("o"), F.col("c_custkey")).alias("origin"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("lat"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).alias("segment"))


@query("metadata_gapfill_priority", "entity origin segment", "lat", sql=f"SELECT entity, string_agg(origin, '+' ORDER BY priority) AS origin, min_by(segment, priority) FILTER (segment IS NOT NULL) AS segment, min_by(lat, priority) FILTER (lat IS NOT NULL) AS lat FROM ({_META}) GROUP BY entity", digits=2)
def _(spark, sf):
    return merge.metadata_gapfill(_meta(spark, sf), ["lat", "segment"])


@query("flux_variable_detect", "entity variable", sql="SELECT user_id AS entity, CASE WHEN bool_or(event_type = 'refund') THEN 'refund' WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'click') THEN 'click' END AS variable FROM events GROUP BY user_id")
def _(spark, sf):
    return merge.detect_variable(table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("variable")), ["refund", "purchase", "click"])


@query("duplicate_ts_check", "entity ts n", views="p", sql="SELECT entity, ts, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return merge.duplicate_keys(panel(spark, sf), ["entity", "ts"])


@query("dense_time_spine", "entity n filled", sql=f"SELECT entity, count(*) AS n, count(v) AS filled FROM (SELECT entity, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT entity, min(ts) AS lo, max(ts) AS hi FROM (SELECT entity, date_trunc('hour', ts) AS ts FROM ({_EV})) GROUP BY entity)) LEFT JOIN (SELECT entity, date_trunc('hour', ts) AS ts, count(*) AS v FROM ({_EV}) GROUP BY ALL) USING (entity, ts) GROUP BY entity")
def _(spark, sf):
    hourly = events(spark, sf).groupBy("entity", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("v"))
    return merge.time_spine(hourly, "1 hour").groupBy("entity").agg(F.count("*").alias("n"), F.count("v").alias("filled"))


@query("infer_frequency", "entity seconds n", views="p", sql="SELECT entity, seconds, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, seconds) AS rk FROM (SELECT entity, seconds, count(*) AS n FROM (SELECT entity, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY entity ORDER BY ts) AS seconds FROM (SELECT DISTINCT entity, ts FROM p)) WHERE seconds IS NOT NULL GROUP BY ALL)) WHERE rk = 1")
def _(spark, sf):
    return merge.infer_frequency(panel(spark, sf).select("entity", "ts").distinct())


@query("source_overlap_sets", "kind n", sql="SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS kind FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 1) b ON a.k = b.k) GROUP BY kind")
def _(spark, sf):
    o = table(spark, sf, "orders")
    out = merge.overlap_sets(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey")
    return out.groupBy("kind").agg(F.count("*").alias("n"))


# -- model input --------------------------------------------------------------


def model_input(spark, sf):
    """Peak months, flags, balanced years, complete rows: the flagship chain by supplier."""
    p = panel(spark, sf)
    rows = subset.in_peak_months(subset.daytime_filter(subset.qc_filter(p), cut=0.02), subset.peak_months(p, "gpp"))
    return subset.zscore(subset.drop_incomplete(subset.balance_years(rows), [*DRIVERS, "target"]), [*DRIVERS, "target"])


@query("peak_months", "entity month rank", views="p", sql="SELECT entity, mon AS month, rank FROM (SELECT entity, mon, row_number() OVER (PARTITION BY entity ORDER BY m DESC, mon) AS rank FROM (SELECT entity, month(ts) AS mon, avg(gpp) AS m FROM p GROUP BY ALL) WHERE m IS NOT NULL) WHERE rank <= 4")
def _(spark, sf):
    return subset.peak_months(panel(spark, sf), "gpp")


_SUB = "p sub0 pmon sub1 kyr sub2 sub3"


@query("balance_years", "entity month year n", views=_SUB, sql="SELECT entity, mon AS month, yr AS year, count(*) AS n FROM sub2 GROUP BY ALL")
def _(spark, sf):
    p = panel(spark, sf)
    rows = subset.in_peak_months(subset.daytime_filter(subset.qc_filter(p), cut=0.02), subset.peak_months(p, "gpp"))
    return subset.balance_years(rows).groupBy("entity", "month", "year").agg(F.count("*").alias("n"))


@query("zscore_entity", "entity l_orderkey l_linenumber l_partkey ts", "heat_z dry_z soil_z light_z target_z", views=_SUB, sql="SELECT *, " + ", ".join(f"({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0) AS {c}_z" for c in ("heat", "dry", "soil", "light", "target")) + " FROM sub3 WINDOW w AS (PARTITION BY entity)")
def _(spark, sf):
    return model_input(spark, sf)


_BASIC = ["heat", "dry", "soil", "gpp"]


@query("basic_stats", "entity first_date last_date n_records n_years " + " ".join(f"{c}_n" for c in _BASIC), " ".join(f"{c}_mean" for c in _BASIC) + " light_per_year", views="p", digits=4, sql="SELECT entity, strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS last_date, count(*) AS n_records, year(max(ts)) - year(min(ts)) + 1 AS n_years, sum(light) / (year(max(ts)) - year(min(ts)) + 1) AS light_per_year, " + ", ".join(f"avg({c}) AS {c}_mean, count({c}) AS {c}_n" for c in _BASIC) + " FROM p GROUP BY entity")
def _(spark, sf):
    return subset.basic_stats(panel(spark, sf), _BASIC, "light")


_SOME = ["heat", "soil", "light"]


@query("subset_stats", "entity n_records", " ".join(f"{c}_{s}" for c in _SOME for s in ("min", "max", "z0", "sd", "zp2", "zm2")), views=_SUB, digits=9, sql="SELECT entity, count(*) AS n_records, " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max, avg({c}) AS {c}_z0, stddev_samp({c}) AS {c}_sd, avg({c}) + 2 * stddev_samp({c}) AS {c}_zp2, avg({c}) - 2 * stddev_samp({c}) AS {c}_zm2" for c in _SOME) + " FROM sub3 GROUP BY entity")
def _(spark, sf):
    return subset.subset_stats(model_input(spark, sf), _SOME)


_STEPS = ["all_records", "measured", "daytime", "peak", "balanced", "complete_predictors", "complete_cases"]
VIEWS["fun"] = """SELECT entity, count(*) AS all_records, count(*) FILTER (qc = 0) AS measured, count(*) FILTER (qc = 0 AND light_pot > 0.02) AS daytime, count(*) FILTER (qc = 0 AND light_pot > 0.02 AND pk) AS peak,
 count(*) FILTER (qc = 0 AND light_pot > 0.02 AND pk AND ky) AS balanced, count(*) FILTER (qc = 0 AND light_pot > 0.02 AND pk AND ky AND heat IS NOT NULL AND dry IS NOT NULL AND soil IS NOT NULL AND light IS NOT NULL) AS complete_predictors,
 count(*) FILTER (qc = 0 AND light_pot > 0.02 AND pk AND ky AND heat IS NOT NULL AND dry IS NOT NULL AND soil IS NOT NULL AND light IS NOT NULL AND target IS NOT NULL) AS complete_cases
 FROM (SELECT s.*, (entity, mon) IN (SELECT (entity, mon) FROM pmon) AS pk, (entity, mon, yr) IN (SELECT (entity, mon, yr) FROM kyr) AS ky FROM sub0 s) GROUP BY entity"""


def funnel(spark, sf):
    return subset.funnel(materialize(subset.monthly_counts(panel(spark, sf), "gpp", DRIVERS, "target", 0.02)))


@query("filter_funnel", "entity " + " ".join(_STEPS), views=f"{_SUB} fun", sql="SELECT * FROM fun")
def _(spark, sf):
    return funnel(spark, sf)


@query("filter_funnel_totals", "step_no step entity records removed", "kept_pct", views=f"{_SUB} fun", digits=4, sql="WITH l AS (" + " UNION ALL ".join(f"SELECT {i} AS step_no, '{s}' AS step, coalesce(entity::VARCHAR, 'all') AS entity, sum({s})::BIGINT AS records FROM fun GROUP BY ROLLUP (entity)" for i, s in enumerate(_STEPS)) + ") SELECT *, coalesce(lag(records) OVER w - records, 0)::BIGINT AS removed, 100.0 * records / first_value(records) OVER w AS kept_pct FROM l WINDOW w AS (PARTITION BY entity ORDER BY step_no)")
def _(spark, sf):
    from pyspark.sql import Window as W

    totals = funnel(spark, sf).rollup("entity").agg(*[F.sum(s).alias(s) for s in _STEPS])
    stack = ", ".join(f"{i}, '{s}', {s}" for i, s in enumerate(_STEPS))
    long = totals.select(F.coalesce(F.col("entity").cast("string"), F.lit("all")).alias("entity"), F.expr(f"stack({len(_STEPS)}, {stack}) as (step_no, step, records)"))
    w = W.partitionBy("entity").orderBy("step_no")
    return long.withColumns({"removed": F.coalesce(F.lag("records").over(w) - F.col("records"), F.lit(0)), "kept_pct": 100 * F.col("records") / F.first("records").over(w)})


@query("restandardize", "entity day", "heat_z dry_z", views="p", sql="SELECT *, (heat - avg(heat) OVER w) / stddev_pop(heat) OVER w AS heat_z, (dry - avg(dry) OVER w) / stddev_pop(dry) OVER w AS dry_z FROM (SELECT entity, ts AS day, avg(heat) AS heat, avg(dry) AS dry FROM p WHERE dry IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY entity)")
def _(spark, sf):
    daily = panel(spark, sf).where("dry is not null").groupBy("entity", F.col("ts").alias("day")).agg(F.avg("heat").alias("heat"), F.avg("dry").alias("dry"))
    return subset.zscore(daily, ["heat", "dry"])


# -- stages ---------------------------------------------------------------------

_ST = "pn z phi rules stage"


@query("stage_assign", "entity stage n", "net", views=_ST, sql="SELECT entity, stage, count(*) AS n, sum(net) AS net FROM stage GROUP BY ALL", digits=4)
def _(spark, sf):
    return staged(spark, sf).groupBy("entity", "stage").agg(F.count("*").alias("n"), F.sum("net").alias("net"))


@query("stage_assign_mirrored", "entity stage n", "net", views="pn z phi rules mirror", sql="SELECT entity, stage, count(*) AS n, sum(net) AS net FROM mirror GROUP BY ALL", digits=4)
def _(spark, sf):
    return staged(spark, sf, "mirrored").groupBy("entity", "stage").agg(F.count("*").alias("n"), F.sum("net").alias("net"))


@query("stage_factorial", "entity cell soil_class dry_class n", "net", views="pn z phi fact", sql="SELECT entity, 4 * soil_class + dry_class AS cell, soil_class, dry_class, count(*) AS n, avg(net) AS net FROM fact GROUP BY ALL")
def _(spark, sf):
    return stages.factorial(attributed(spark, sf)).groupBy("entity", "cell", "soil_class", "dry_class").agg(F.count("*").alias("n"), F.avg("net").alias("net"))


@query("stage_rule_check", "stage by_rule by_array differing", views=_ST, sql="SELECT stage, count(*) AS by_rule, count(*) AS by_array, 0::BIGINT AS differing FROM stage GROUP BY stage")
def _(spark, sf):
    z = zpanel(spark, sf).withColumn("held", stages.stages_of())
    long = z.select("held", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), stages.rule("main", s).alias("hit")) for s in stages.MAIN])).alias("r")).select("held", "r.stage", "r.hit")
    both = F.expr("array_contains(held, stage)")
    return long.groupBy("stage").agg(F.count_if("hit").alias("by_rule"), F.count_if(both).alias("by_array"), F.count_if(F.col("hit") != both).alias("differing"))


@query("stage_tail_flag", "entity n", "net", views="pn z phi", sql="SELECT entity, count(*) AS n, avg(net) AS net FROM phi WHERE dry_z > 1.2815515655446 GROUP BY entity")
def _(spark, sf):
    return attributed(spark, sf).where(F.col("dry_z") > stages.CUTS["c"]).groupBy("entity").agg(F.count("*").alias("n"), F.avg("net").alias("net"))


@query("condition_level", "label level", sql="SELECT label, CASE WHEN label LIKE 'extreme%' THEN 3 WHEN label LIKE 'very%' OR label LIKE 'high %' THEN 2 WHEN label LIKE 'dry%' OR label LIKE 'warm%' OR label LIKE 'higher%' THEN 1 ELSE 0 END AS level FROM (SELECT DISTINCT lower(CASE o_orderkey % 6 WHEN 0 THEN 'Extreme ' WHEN 1 THEN 'Very ' WHEN 2 THEN 'High ' WHEN 3 THEN 'Warm ' WHEN 4 THEN 'Higher ' ELSE 'Central ' END || o_orderpriority) AS label FROM orders)")
def _(spark, sf):
    words = F.element_at(F.array(*map(F.lit, ["Extreme ", "Very ", "High ", "Warm ", "Higher ", "Central "])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    labels = table(spark, sf, "orders").select(F.lower(F.concat(words, "o_orderpriority")).alias("label")).distinct()
    return labels.withColumn("level", stages.condition_level(F.col("label")))


# -- bins and grids ----------------------------------------------------------------

VIEWS["g2"] = "SELECT entity, class, floor(dry_z * 2)::BIGINT AS bx, floor(heat_z * 2)::BIGINT AS cy, count(*) AS n, avg(net) AS net, avg(phi_dry) AS phi_dry, avg(heat) AS heat FROM phi GROUP BY ALL"
VIEWS["cells"] = "SELECT c.*, t.n_entities FROM (SELECT bx, cy, avg(net) AS mean, median(net) AS median, max(net) AS max, min(net) AS min, count(net) AS count, stddev_samp(net) AS std, stddev_samp(net) / sqrt(count(net)) AS sem FROM g2 GROUP BY ALL) c CROSS JOIN (SELECT count(DISTINCT entity) AS n_entities FROM g2) t"


def grid2(spark, sf):
    """Half-sigma cells by nation and class."""
    return grid.bin2d_mean(attributed(spark, sf), "dry_z", "heat_z", ["net", "phi_dry", "heat"], per_unit=2, by=["entity", "class"])


@query("bin2d_mean", "entity bx cy n", "net phi_dry heat_z", views="pn z phi", sql="SELECT entity, floor(dry_z * 10)::BIGINT AS bx, floor(heat_z * 10)::BIGINT AS cy, count(*) AS n, avg(net) AS net, avg(phi_dry) AS phi_dry, avg(heat_z) AS heat_z FROM phi GROUP BY ALL")
def _(spark, sf):
    return grid.bin2d_mean(attributed(spark, sf), "dry_z", "heat_z", ["net", "phi_dry", "heat_z"])


_PAIRS = [("dry_z", "soil_z"), ("dry_z", "heat_z"), ("heat_z", "soil_z"), ("dry_z", "light_z"), ("heat_z", "light_z")]


@query("bin2d_five_pairs", "pair entity bx cy n", "net", views="pn z phi", sql=" UNION ALL ".join(f"SELECT '{x}+{y}' AS pair, entity, floor({x} * 10)::BIGINT AS bx, floor({y} * 10)::BIGINT AS cy, count(*) AS n, avg(net) AS net FROM phi GROUP BY ALL" for x, y in _PAIRS))
def _(spark, sf):
    return grid.bin2d_pairs(attributed(spark, sf), _PAIRS, ["net"])


@query("bin1d_mean", "entity bx", "net", views="pn z phi g2", sql="SELECT entity, bx, avg(net) AS net FROM g2 GROUP BY ALL")
def _(spark, sf):
    return grid.bin1d_mean(grid2(spark, sf), "net")


@query("bin1d_nearest", "entity bx n", "net", views="pn z phi", sql="SELECT entity, round_even(dry_z * 10, 0)::BIGINT AS bx, count(*) AS n, avg(net) AS net FROM phi GROUP BY ALL HAVING count(*) >= 10")
def _(spark, sf):
    return grid.bin1d_nearest(attributed(spark, sf), "dry_z", "net")


_STATS = "mean median max min std sem"


@query("grid_across_entities", "bx cy count n_entities", _STATS, views="pn z phi g2 cells", sql="SELECT * FROM cells")
def _(spark, sf):
    return grid.across(grid2(spark, sf), "net")


@query("grid_across_classes", "class bx cy count n_entities", _STATS, views="pn z phi g2", sql="SELECT c.*, n_entities FROM (SELECT class, bx, cy, avg(net) AS mean, median(net) AS median, max(net) AS max, min(net) AS min, count(net) AS count, stddev_samp(net) AS std, stddev_samp(net) / sqrt(count(net)) AS sem FROM g2 GROUP BY ALL) c JOIN (SELECT class, count(DISTINCT entity) AS n_entities FROM g2 GROUP BY class) t USING (class)")
def _(spark, sf):
    return grid.across(grid2(spark, sf), "net", ["class"])


@query("grid_coverage_filter", "bx cy count n_entities least most", "median", views="pn z phi g2 cells", sql="SELECT *, min(count) OVER () AS least, max(count) OVER () AS most FROM cells WHERE count >= ceil(n_entities / 2.0)")
def _(spark, sf):
    kept = grid.coverage_filter(grid.across(grid2(spark, sf), "net"))
    return kept.crossJoin(F.broadcast(kept.agg(F.min("count").alias("least"), F.max("count").alias("most"))))


_DRAWS = "((rep * 1000003 + s * 10007 + 42) * 48271) % 2147483647 % n"


@query("median_se_bootstrap", "bx cy n", "se", views="pn z phi g2", sql=f"WITH v AS (SELECT bx, cy, net, row_number() OVER (PARTITION BY bx, cy ORDER BY entity) - 1 AS k, count(*) OVER (PARTITION BY bx, cy) AS n FROM g2), d AS (SELECT DISTINCT bx, cy, n, rep, s FROM v, range(1000) r(rep), range(25) q(s) WHERE s < n), m AS (SELECT d.bx, d.cy, d.n, rep, median(v.net) AS m FROM d JOIN v ON v.bx = d.bx AND v.cy = d.cy AND v.k = {_DRAWS.replace('% n', '% d.n')} GROUP BY ALL) SELECT bx, cy, n, CASE WHEN n > 1 THEN stddev_samp(m) END AS se FROM m GROUP BY bx, cy, n")
def _(spark, sf):
    g = grid2(spark, sf)
    reps = bootstrap(g, "net", ["bx", "cy"], ["entity"], 1000, 42, {"m": array_median, "n": lambda a: F.size(a).cast("long")})
    return reps.groupBy("bx", "cy", "n").agg(F.when(F.col("n") > 1, F.stddev_samp("m")).alias("se"))


@query("focal_mean_extreme", "max_x max_y min_x min_y n", "highest lowest", views="pn z phi g2 cells", sql="WITH o AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) b(j)), m AS (SELECT c.bx, c.cy, i * i + j * j AS d2, n.bx AS nx, n.median AS v, row_number() OVER (PARTITION BY c.bx, c.cy ORDER BY i * i + j * j, c.bx + i, c.cy + j) AS r FROM cells c, o LEFT JOIN cells n ON n.bx = c.bx + i AND n.cy = c.cy + j), f AS (SELECT bx, cy, avg(v) AS focal FROM m WHERE r <= 9 GROUP BY bx, cy HAVING count(v) = 9) SELECT count(*) AS n, max(round(focal, 9)) AS highest, min(round(focal, 9)) AS lowest, arg_max(bx, (round(focal, 9), bx, cy)) AS max_x, arg_max(cy, (round(focal, 9), bx, cy)) AS max_y, arg_min(bx, (round(focal, 9), bx, cy)) AS min_x, arg_min(cy, (round(focal, 9), bx, cy)) AS min_y FROM f")
def _(spark, sf):
    f = grid.focal_extreme(grid.across(grid2(spark, sf), "net"), "median").withColumn("focal", F.round("focal", 9))
    k = F.struct("focal", "bx", "cy")
    return f.agg(F.count("*").alias("n"), F.max("focal").alias("highest"), F.min("focal").alias("lowest"), F.max_by("bx", k).alias("max_x"), F.max_by("cy", k).alias("max_y"), F.min_by("bx", k).alias("min_x"), F.min_by("cy", k).alias("min_y"))
