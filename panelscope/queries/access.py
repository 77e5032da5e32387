"""Scans, sinks, metadata, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import sources
from ..operators import binding, curves, joins
from ..operators.resample import draw
from ..plans.panels import DRIVERS, attributed, panel, table, zpanel
from .base import query

# -- scans, sources, sinks ---------------------------------------------------


@query("scan_panel_parquet", sql="SELECT l_suppkey, l_shipdate, l_quantity FROM lineitem")
def _(spark, sf):
    return sources.scan_panel(spark, f"{sf}/lineitem.parquet", ["l_suppkey", "l_shipdate", "l_quantity"])


def _csv(spark, sf):
    """Events as CSV folders ORIGIN_site_DATA, missing values as -9999."""
    root = sources.shared_folder(spark)
    ev = table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.when(F.col("event_id") % 7 == 0, "-9999").otherwise(F.round("value", 4).cast("string")).alias("value"))
    ev = ev.withColumn("folder", F.concat(F.when(F.col("user_id") % 2 == 0, "AMF").otherwise("ICOS"), F.lit("_US-"), F.col("user_id"), F.lit("_FULLSET")))
    ev.repartition("folder").select("folder", "ts", "value").write.partitionBy("folder").option("header", True).csv(root)
    return root


@query("scan_source_csv", "origin site n n_values", "total", views="", sql="SELECT CASE WHEN user_id % 2 = 0 THEN 'AMF' ELSE 'ICOS' END AS origin, 'US-' || user_id AS site, count(*) AS n, count(*) FILTER (event_id % 7 <> 0) AS n_values, sum(round(value, 4)) FILTER (event_id % 7 <> 0) AS total FROM events GROUP BY user_id", digits=3)
def _(spark, sf):
    df = sources.read_csv_sources(spark, _csv(spark, sf), "ts string, value double")
    return df.groupBy(F.regexp_replace("origin", "^folder=", "").alias("origin"), "site").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"))


@query("site_from_path", sql="SELECT DISTINCT 'f/' || CASE WHEN user_id % 2 = 0 THEN 'AMF' ELSE 'ICOS' END || '_US-' || user_id || '_FULLSET/x.csv' AS path, CASE WHEN user_id % 2 = 0 THEN 'AMF' ELSE 'ICOS' END AS origin, 'US-' || user_id AS site, coalesce(n_name, '-') AS looked_up FROM events LEFT JOIN nation ON n_nationkey = user_id")
def _(spark, sf):
    files = table(spark, sf, "events").select(F.concat(F.lit("f/"), F.when(F.col("user_id") % 2 == 0, "AMF").otherwise("ICOS"), F.lit("_US-"), F.col("user_id"), F.lit("_FULLSET/x.csv")).alias("path")).distinct()
    origin, site = sources.site_of_path(F.col("path"))
    names = table(spark, sf, "nation").select(F.concat(F.lit("US-"), F.col("n_nationkey")).alias("site"), "n_name")
    return files.select("path", origin.alias("origin"), site.alias("site")).join(names, "site", "left").select("path", "origin", "site", F.coalesce("n_name", F.lit("-")).alias("looked_up"))


_EAV = """SELECT 'S' || s_suppkey AS site, 'LOCATION' AS variable_group, 'LOCATION_ELEV' AS variable, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE round(s_acctbal, 2)::VARCHAR END AS datavalue FROM supplier
 UNION ALL SELECT 'S' || s_suppkey, 'LOCATION', 'LOCATION_LONG', s_nationkey::VARCHAR FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'LOCATION', 'LOCATION_LAT', (s_suppkey % 90)::VARCHAR FROM supplier WHERE s_suppkey % 7 <> 0
 UNION ALL SELECT 'S' || s_suppkey, 'IGBP', 'IGBP', CASE WHEN s_suppkey % 3 = 0 THEN 'ENF' ELSE 'DBF' END FROM supplier"""


def _eav(spark, sf):
    s = table(spark, sf, "supplier").withColumn("site", F.concat(F.lit("S"), F.col("s_suppkey")))
    row = lambda df, group, var, value: df.select("site", F.lit(group).alias("variable_group"), F.lit(var).alias("variable"), value.alias("datavalue"))
    elev = F.when(F.col("s_suppkey") % 5 != 0, F.round("s_acctbal", 2).cast("decimal(12,2)").cast("double").cast("string"))
    return (
        row(s, "LOCATION", "LOCATION_ELEV", elev).union(row(s, "LOCATION", "LOCATION_LONG", F.col("s_nationkey").cast("string")))
        .union(row(s.where("s_suppkey % 7 <> 0"), "LOCATION", "LOCATION_LAT", (F.col("s_suppkey") % 90).cast("string")))
        .union(row(s, "IGBP", "IGBP", F.when(F.col("s_suppkey") % 3 == 0, "ENF").otherwise("DBF")))
    )


@query("scan_key_value_metadata", "site group_id variable_group variable datavalue", sql=f"SELECT site, 'G1' AS group_id, variable_group, variable, coalesce(datavalue, '') AS datavalue FROM ({_EAV}) WHERE variable <> 'LOCATION_ELEV'")
def _(spark, sf):
    root = sources.shared_folder(spark)
    rows = _eav(spark, sf).where("variable <> 'LOCATION_ELEV'")
    lines = rows.select(F.concat_ws(",", "site", F.lit("G1"), "variable_group", "variable", F.coalesce("datavalue", F.lit(""))).alias("value"))
    lines.union(table(spark, sf, "region").select(F.concat(F.lit("broken,"), F.col("r_name")))).write.option("encoding", "ISO-8859-1").text(root)
    return sources.parse_key_values(spark, root)


@query("kv_pivot_metadata", "site igbp", "elev lat long", sql=f"SELECT site, max(datavalue) FILTER (variable = 'IGBP') AS igbp, try_cast(max(datavalue) FILTER (variable = 'LOCATION_ELEV') AS DOUBLE) AS elev, try_cast(max(datavalue) FILTER (variable = 'LOCATION_LAT') AS DOUBLE) AS lat, try_cast(max(datavalue) FILTER (variable = 'LOCATION_LONG') AS DOUBLE) AS long FROM ({_EAV}) GROUP BY site", digits=4)
def _(spark, sf):
    return joins.kv_pivot(_eav(spark, sf))


@query("metadata_enrich_join", "site class how", "lat elevation", sql="SELECT 'C' || c_custkey AS site, r_name AS class, 'inner' AS how, c_nationkey::DOUBLE AS lat, c_acctbal AS elevation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0 UNION ALL SELECT 'C' || c_custkey, r_name, 'left', CASE WHEN r_name IS NULL THEN NULL ELSE c_nationkey END, c_acctbal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 1", digits=2)
def _(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").cast("double").alias("lat"), F.col("r_name").alias("class"))
    sites = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("site"), F.col("c_nationkey").alias("key"), F.concat(F.col("c_acctbal").cast("string"), F.lit(" m")).alias("elevation"), (F.col("c_custkey") % 2 == 0).alias("even"))
    return joins.enrich(sites.where("even"), places, "key", "inner").unionByName(joins.enrich(sites.where("not even"), places.where("key < 20"), "key", "left"))


@query("union_sources", "site source priority class", sql="SELECT 'S' || s_suppkey AS site, 'supplier' AS source, 1 AS priority, n_regionkey AS class FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (0, 1, 3) UNION ALL SELECT 'S' || c_custkey, 'customer', 2, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 1, 3)")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("class"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("site"), F.col("s_nationkey").alias("nk"), F.col("s_acctbal").alias("lon"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("S"), F.col("c_custkey")).alias("site"), F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("segment"))
    return joins.union_sources({"supplier": s.join(n, "nk"), "customer": c.join(n, "nk")}, {"supplier": 1, "customer": 2}, "class", [0, 1, 3])


@query("sink_partitioned", "variant entity n", "total", views="p", sql="SELECT 'full' AS variant, entity, count(*) AS n, sum(heat) AS total FROM p GROUP BY entity", digits=2)
def _(spark, sf):
    root = sources.shared_folder(spark)
    df = panel(spark, sf).select(F.lit("full").alias("variant"), "entity", "ts", "heat")
    sources.write_partitioned(df, f"{root}/parquet", ["variant", "entity"], f"{root}/csv")
    back = spark.read.parquet(f"{root}/parquet")
    return back.groupBy("variant", F.col("entity").cast("long").alias("entity")).agg(F.count("*").alias("n"), F.sum("heat").alias("total"))


@query("manifest_sha256")
def _(spark, sf):
    root = sources.shared_folder(spark)
    df = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    sources.write_partitioned(df, f"{root}/parquet", ["s_nationkey"], f"{root}/csv")
    return sources.manifest(spark, root).select("path", "stage", "bytes", "sha256", "ok")


@query("schema_conformance", "kind name files", views="pn", sql="SELECT 'unexplained' AS kind, unnest(['class', 'heat_zp2', 'heat_zm2', 'soil_zp2', 'soil_zm2']) AS name, count(DISTINCT entity) AS files FROM pn UNION ALL SELECT 'unmatched', 'unused', 0 FROM pn HAVING count(*) > 0")
def _(spark, sf):
    from ..operators.subset import subset_stats

    # the deliverable: one file of statistics for each entity, whose headers are held against the grammar
    p = panel(spark, sf, "s_nationkey")
    stats = subset_stats(p, ["heat", "soil"]).join(p.groupBy("entity").agg(F.first("class").alias("class")), "entity")
    root = sources.shared_folder(spark)
    stats.select("n_records", *[f"{c}_{s}" for c in ("heat", "soil") for s in ("min", "max", "z0", "sd", "zp2", "zm2")], "class", "entity").repartition("entity").write.partitionBy("entity").option("header", True).csv(root)
    grammar = spark.createDataFrame([("count", "n_[a-z]+"), ("statistic", "(heat|soil)_(min|max|z0|sd)"), ("unused", "zz_.*")], "rule string, pattern string")
    out = sources.schema_conformance(sources.header_columns(spark, root, "n_records"), grammar)
    return out.groupBy("kind", "name").agg(F.count_distinct(F.nullif("file", F.lit(""))).alias("files"))


# -- projections, filters, role binding --------------------------------------

_LAYERS = "SELECT entity, class, ts, heat, mon, yr, l_orderkey, CASE WHEN entity % 4 = 0 THEN NULL ELSE soil END AS swc_1, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE soil END AS swc_2, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE soil END AS swc_3 FROM (SELECT *, month(ts) AS mon, year(ts) AS yr FROM p)"


def layers(spark, sf):
    """The panel with three soil layers; entities divisible by 4 lack the first."""
    return panel(spark, sf).withColumns({"swc_1": F.when(F.col("entity") % 4 != 0, F.col("soil")), "swc_2": F.when(F.col("l_partkey") % 13 != 0, F.col("soil")), "swc_3": F.when(F.col("l_partkey") % 4 != 0, F.col("soil"))})


@query("bind_first_available", "entity swc_var", views="p", sql=f"SELECT entity, CASE WHEN count(swc_1) > 0 THEN 'swc_1' WHEN count(swc_2) > 0 THEN 'swc_2' WHEN count(swc_3) > 0 THEN 'swc_3' END AS swc_var FROM ({_LAYERS}) GROUP BY entity")
def _(spark, sf):
    return binding.bind_first_available(layers(spark, sf), ["swc_1", "swc_2", "swc_3"], "swc_var")


@query("bind_fixed_role", "entity light_var fog_var", views="p", sql="SELECT DISTINCT entity, 'light' AS light_var, NULL::VARCHAR AS fog_var FROM p")
def _(spark, sf):
    df = panel(spark, sf)
    return binding.bind_fixed(df, "light", "light_var").join(binding.bind_fixed(df, "fog", "fog_var"), "entity")


@query("rename_roles", "entity n", "swc", views="p", sql=f"SELECT entity, count(swc) AS n, avg(swc) AS swc FROM (SELECT l.entity, CASE b.v WHEN 'swc_1' THEN swc_1 WHEN 'swc_2' THEN swc_2 ELSE swc_3 END AS swc FROM ({_LAYERS}) l JOIN (SELECT entity, CASE WHEN count(swc_1) > 0 THEN 'swc_1' WHEN count(swc_2) > 0 THEN 'swc_2' ELSE 'swc_3' END AS v FROM ({_LAYERS}) GROUP BY entity) b USING (entity)) GROUP BY entity")
def _(spark, sf):
    df, names = layers(spark, sf), ["swc_1", "swc_2", "swc_3"]
    out = binding.rename_roles(df, binding.bind_first_available(df, names, "swc_var"), {"swc": names})
    return out.groupBy("entity").agg(F.count("swc").alias("n"), F.avg("swc").alias("swc"))


_ROW = "entity l_orderkey l_linenumber l_partkey ts"


@query("qc_filter", _ROW, "heat", views="p", sql="SELECT * FROM p WHERE qc = 0")
def _(spark, sf):
    from ..operators.subset import qc_filter

    return qc_filter(panel(spark, sf))


@query("daytime_filter", _ROW, "light_pot", views="p", sql="SELECT * FROM p WHERE light_pot > 0.02")
def _(spark, sf):
    from ..operators.subset import daytime_filter

    return daytime_filter(panel(spark, sf), cut=0.02)


@query("drop_incomplete", _ROW, "soil dry gpp", views="p", sql="SELECT * FROM p WHERE gpp IS NOT NULL AND dry IS NOT NULL AND soil IS NOT NULL", digits=4)
def _(spark, sf):
    from ..operators.subset import drop_incomplete

    return drop_incomplete(panel(spark, sf), ["gpp", "dry", "soil"])


@query("derive_flip_sign", _ROW, "nep", views="p", sql="SELECT *, -target AS nep FROM p", digits=4)
def _(spark, sf):
    return panel(spark, sf).withColumn("nep", -F.col("target"))


@query("derive_et", _ROW, "et", views="p", sql="SELECT *, heat / ((2.501 - 0.00237 * light * 100) * 1e6) * 3600 AS et FROM p", digits=9)
def _(spark, sf):
    return panel(spark, sf).withColumn("et", binding.evapotranspiration(F.col("heat"), F.col("light") * 100))


@query("derive_vpd_units", _ROW, "vpd", views="p", sql="SELECT *, (CASE WHEN entity IN (3, 7) THEN dry / 100 ELSE dry END) / 10 AS vpd FROM p", digits=8)
def _(spark, sf):
    factor = spark.createDataFrame([(3, 0.01), (7, 0.01)], "entity long, factor double")
    # two rows of constants are all that is broadcast
    df = panel(spark, sf).join(F.broadcast(factor), "entity", "left")
    return df.withColumn("vpd", F.when(F.col("factor").isNotNull(), F.col("dry") / 100).otherwise(F.col("dry")) / 10)


_SITES = "SELECT entity, any_value(class) AS class, year(max(ts)) - year(min(ts)) + 1 AS n_years, count(soil) AS n_soil FROM p WHERE entity % 9 <> 0 OR year(ts) > 2000 GROUP BY entity"


def _sites(spark, sf):
    p = panel(spark, sf).where("entity % 9 <> 0 or year(ts) > 2000")
    return p.groupBy("entity").agg(F.first("class").alias("class"), (F.year(F.max("ts")) - F.year(F.min("ts")) + 1).alias("n_years"), F.count("soil").alias("n_soil"))


@query("inclusion_filter", "entity class n_years total_years", views="p", sql=f"SELECT entity, class, n_years, sum(n_years) OVER ()::BIGINT AS total_years FROM ({_SITES}) WHERE n_soil > 0 AND class <> 4 AND n_years >= 3")
def _(spark, sf):
    kept = _sites(spark, sf).where("n_soil > 0 and class <> 4 and n_years >= 3")
    return kept.crossJoin(F.broadcast(kept.agg(F.sum("n_years").cast("long").alias("total_years"))))


@query("class_exclude", "class n", views="p", sql="SELECT class, count(*) AS n FROM p WHERE class <> 2 GROUP BY class")
def _(spark, sf):
    return panel(spark, sf).where("class <> 2").groupBy("class").agg(F.count("*").alias("n"))


@query("entity_subset_semi", "entity n", views="p", sql="SELECT entity, count(*) AS n FROM p WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY entity")
def _(spark, sf):
    keep = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"))
    return panel(spark, sf).join(keep, "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("n"))


@query("entity_exclude_anti", "entity n", views="p", sql="SELECT entity, count(*) AS n FROM p WHERE entity NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY entity")
def _(spark, sf):
    out = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"))
    return panel(spark, sf).join(out, "entity", "left_anti").groupBy("entity").agg(F.count("*").alias("n"))


@query("columns_by_suffix", "entity", "heat_z dry_z soil_z light_z target_z", views="pn z", sql="SELECT entity, avg(abs(heat_z)) AS heat_z, avg(abs(dry_z)) AS dry_z, avg(abs(soil_z)) AS soil_z, avg(abs(light_z)) AS light_z, avg(abs(target_z)) AS target_z FROM z GROUP BY entity")
def _(spark, sf):
    df = binding.columns_by_suffix(zpanel(spark, sf), suffixes=("_z",), keys=("entity",))
    return df.groupBy("entity").agg(*[F.avg(F.abs(c)).alias(c) for c in df.columns if c != "entity"])


@query("drop_all_null_rows", "l_orderkey n", views="p", sql="SELECT l_orderkey, count(*) AS n FROM p WHERE NOT (soil IS NULL AND gpp IS NULL) GROUP BY l_orderkey")
def _(spark, sf):
    df = panel(spark, sf).select("entity", "l_orderkey", "soil", "gpp")
    return binding.drop_all_null_rows(df, ["entity", "l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("limit_entities", "how entity unknown n", views="p", sql="SELECT 'named' AS how, e AS entity, count(p.entity) = 0 AS unknown, count(p.entity) AS n FROM (VALUES (2), (5), (-1)) v(e) LEFT JOIN p ON p.entity = e GROUP BY e UNION ALL SELECT 'first', entity, FALSE, count(*) FROM p WHERE entity IN (SELECT DISTINCT entity FROM p ORDER BY entity LIMIT 3) GROUP BY entity")
def _(spark, sf):
    p = panel(spark, sf).select("entity", "ts")
    count = lambda df, how: df.groupBy(F.lit(how).alias("how"), "entity", "unknown").agg(F.count("ts").alias("n"))
    return count(binding.limit_entities(p, [2, 5, -1]), "named").union(count(binding.limit_entities(p, first=3), "first"))


_DRAW = "((l_orderkey * 1000003 + l_linenumber * 10007 + l_partkey) * 48271) % 2147483647"


@query("background_sample", "entity l_orderkey l_linenumber l_partkey l_suppkey rank", views="pn z", sql=f"SELECT * FROM (SELECT entity, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY entity ORDER BY {_DRAW}, l_orderkey, l_linenumber, l_partkey, l_suppkey, ts) AS rank FROM z) WHERE rank <= 300")
def _(spark, sf):
    key = draw(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    w = W.partitionBy("entity").orderBy(key, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ts")
    # the planner keeps at most 300 rows of an entity in each task before the shuffle
    return zpanel(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 300")


# -- joins -------------------------------------------------------------------


@query("join_inner_dim", "entity s_name", "thr", views="pn z", sql="SELECT entity, n_name AS s_name, avg(heat) AS thr FROM z JOIN nation ON entity = n_nationkey WHERE entity % 3 <> 0 GROUP BY ALL")
def _(spark, sf):
    thr = zpanel(spark, sf).where("entity % 3 <> 0").groupBy("entity").agg(F.avg("heat").alias("thr"))
    return thr.join(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("entity"), F.col("n_name").alias("s_name")), "entity")


@query("join_left_dim", "entity", "thr", views="pn z", sql="SELECT n_nationkey::BIGINT AS entity, avg(heat) AS thr FROM nation LEFT JOIN (SELECT * FROM z WHERE entity % 3 <> 0) z ON entity = n_nationkey GROUP BY 1")
def _(spark, sf):
    thr = zpanel(spark, sf).where("entity % 3 <> 0").groupBy("entity").agg(F.avg("heat").alias("thr"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("entity")).join(thr, "entity", "left")


# light and soil have two decimals: hundredths are summed, so that a mean does not depend on the order of its rows
@query("join_outer_bins", "bx cy", "x y", views="pn z", digits=9, sql="SELECT bx, cy, x, y FROM (SELECT floor(dry_z * 10)::BIGINT AS bx, floor(heat_z * 10)::BIGINT AS cy, sum(round(light * 100)::BIGINT)::DOUBLE / (100 * count(light)) AS x FROM z WHERE entity % 2 = 0 GROUP BY ALL) a FULL JOIN (SELECT floor(dry_z * 10)::BIGINT AS bx, floor(heat_z * 10)::BIGINT AS cy, sum(round(soil * 100)::BIGINT)::DOUBLE / (100 * count(soil)) AS y FROM z WHERE entity % 3 = 0 GROUP BY ALL) b USING (bx, cy)")
def _(spark, sf):
    z = zpanel(spark, sf).withColumns({"bx": F.floor(F.col("dry_z") * 10), "cy": F.floor(F.col("heat_z") * 10)})
    mean = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / (100 * F.count(c))
    a = z.where("entity % 2 = 0").groupBy("bx", "cy").agg(mean("light").alias("x"))
    return a.join(z.where("entity % 3 = 0").groupBy("bx", "cy").agg(mean("soil").alias("y")), ["bx", "cy"], "full")


@query("join_outer_timestamp", "ts lat", "ta pr", sql="SELECT coalesce(a.ts, b.ts) AS ts, coalesce(a.lat, b.lat) AS lat, ta, pr FROM (SELECT date_trunc('day', o_orderdate) AS ts, min(o_orderkey % 90) AS lat, min_by(o_totalprice, o_orderkey) AS ta FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) a FULL JOIN (SELECT date_trunc('day', o_orderdate) AS ts, min(o_orderkey % 90) AS lat, min_by(o_totalprice, o_orderkey) AS pr FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1) b ON a.ts = b.ts", digits=2)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("ts", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"))
    side = lambda cond, name: o.where(cond).groupBy("ts").agg(F.min(F.col("o_orderkey") % 90).alias("lat"), F.min_by("o_totalprice", "o_orderkey").alias(name))
    return joins.outer_timestamp(side("o_orderkey % 3 <> 0", "ta"), side("o_orderkey % 3 <> 1", "pr"), "ts", ["lat"])


@query("join_cell_whitelist", "entity bx cy n", views="pn z", sql="SELECT entity, bx, cy, count(*) AS n FROM (SELECT *, floor(dry_z * 10)::BIGINT AS bx, floor(heat_z * 10)::BIGINT AS cy FROM z) WHERE (bx, cy) IN (SELECT (floor(dry_z * 10)::BIGINT, floor(heat_z * 10)::BIGINT) FROM z GROUP BY floor(dry_z * 10), floor(heat_z * 10) HAVING count(DISTINCT entity) >= ceil(0.8 * (SELECT count(DISTINCT entity) FROM z))) GROUP BY ALL")
def _(spark, sf):
    z = zpanel(spark, sf).withColumns({"bx": F.floor(F.col("dry_z") * 10), "cy": F.floor(F.col("heat_z") * 10)})
    most = z.agg(F.ceil(0.8 * F.count_distinct("entity")).alias("least"))
    listed = z.groupBy("bx", "cy").agg(F.count_distinct("entity").alias("k")).crossJoin(F.broadcast(most)).where("k >= least")
    return z.join(listed, ["bx", "cy"], "left_semi").groupBy("entity", "bx", "cy").agg(F.count("*").alias("n"))


@query("join_funnel_check", "entity kept summary same", views="p", sql="SELECT entity, count(*) AS kept, count(*) AS summary, TRUE AS same FROM p WHERE qc = 0 GROUP BY entity")
def _(spark, sf):
    p = panel(spark, sf)
    return joins.check_counts(p.where("qc = 0").groupBy("entity").agg(F.count("*").alias("kept")), p.groupBy("entity").agg(F.count_if(F.col("qc") == 0).alias("summary")), "kept", "summary")


@query("join_grid_cross", "entity bx", "mean", views="pn z", sql="SELECT e.entity, b.bx, m.mean FROM (SELECT DISTINCT entity FROM z) e CROSS JOIN (SELECT unnest(range(-20, 20)) AS bx) b LEFT JOIN (SELECT entity, floor(dry_z * 10)::BIGINT AS bx, avg(heat) AS mean FROM z GROUP BY ALL) m USING (entity, bx)")
def _(spark, sf):
    sparse = zpanel(spark, sf).groupBy("entity", F.floor(F.col("dry_z") * 10).alias("bx")).agg(F.avg("heat").alias("mean"))
    return joins.densify(sparse, ["entity"], "bx", -20, 19)


@query("join_shap_background", "entity l_orderkey l_linenumber l_partkey l_suppkey ts n", "mean_diff", views="pn z", sql=f"SELECT z.entity, z.l_orderkey, z.l_linenumber, z.l_partkey, z.l_suppkey, z.ts, count(*) AS n, avg(z.heat_z - b.h) AS mean_diff FROM z JOIN (SELECT entity, heat_z AS h FROM (SELECT entity, heat_z, row_number() OVER (PARTITION BY entity ORDER BY {_DRAW}, l_orderkey, l_linenumber, l_partkey, l_suppkey, ts) AS rank FROM z) WHERE rank <= 300) b ON z.entity = b.entity GROUP BY ALL")
def _(spark, sf):
    z = zpanel(spark, sf)
    key = draw(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    w = W.partitionBy("entity").orderBy(key, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ts")
    sample = z.select("entity", "heat_z", F.row_number().over(w).alias("rank")).where("rank <= 300").groupBy("entity").agg(F.collect_list("heat_z").alias("h"))
    # three hundred values per entity at most travel as one array; no row is multiplied
    mean = F.aggregate("h", F.lit(0.0), lambda s, x: s + (F.col("heat_z") - x)) / F.size("h")
    return z.join(sample, "entity").select(*_ROW.split(), "l_suppkey", F.size("h").cast("long").alias("n"), mean.alias("mean_diff"))


@query("join_caliper_nearest", "mode n matched", "d2", views="pn z phi rules stage", sql="""
SELECT mode, count(*) AS n, count(m) AS matched, avg(m) AS d2 FROM (SELECT mode, a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.ts, min((a.heat_z - b.heat_z) ** 2 + (a.soil_z - b.soil_z) ** 2 + (a.light_z - b.light_z) ** 2) AS m
FROM (SELECT * FROM stage WHERE stage = 8) a CROSS JOIN (VALUES ('plain'), ('strict')) v(mode) LEFT JOIN (SELECT * FROM stage WHERE stage = 7) b ON a.entity = b.entity AND abs(a.heat_z - b.heat_z) <= 0.5 AND abs(a.soil_z - b.soil_z) <= 0.5 AND abs(a.light_z - b.light_z) <= 0.5
 AND (mode = 'plain' OR (month(a.ts) = month(b.ts) AND abs(hour(a.ts) - hour(b.ts)) <= 1)) GROUP BY ALL) GROUP BY mode""")
def _(spark, sf):
    from ..plans.panels import staged

    st = sources.materialize(staged(spark, sf).where("stage in (7, 8)").select("entity", "stage", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ts", "heat_z", "soil_z", "light_z"))
    pairs = [joins.caliper_nearest(st.where("stage = 8"), st.where("stage = 7"), ["heat_z", "soil_z", "light_z"], 0.5, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ts"], strict=s).withColumn("mode", F.lit("strict" if s else "plain")) for s in (False, True)]
    return pairs[0].unionByName(pairs[1]).groupBy("mode").agg(F.count("*").alias("n"), F.count("match").alias("matched"), F.avg("d2").alias("d2"))


@query("interp_asof", "entity grid_ix", "y", views="pn z", sql="""
SELECT entity, grid_ix, CASE WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (g - x0) / (x1 - x0) * (y1 - y0) END AS y FROM (SELECT i AS grid_ix, -1.5 + 0.05 * i AS g FROM range(61) t(i)) CROSS JOIN LATERAL (SELECT entity, x0, y0, x1, y1 FROM (SELECT entity, x AS x0, y AS y0, lead(x) OVER (PARTITION BY entity ORDER BY x) AS x1, lead(y) OVER (PARTITION BY entity ORDER BY x) AS y1 FROM (SELECT entity, round(floor(dry_z * 10) / 10 + 0.05, 2) AS x, avg(heat) AS y FROM z GROUP BY ALL)) WHERE g >= x0 AND g < x1)""")
def _(spark, sf):
    curve = zpanel(spark, sf).groupBy("entity", F.round(F.floor(F.col("dry_z") * 10) / 10 + 0.05, 2).alias("x")).agg(F.avg("heat").alias("y"))
    return curves.interp_grid(curve, ["entity"], -1.5, 0.05, 61)
