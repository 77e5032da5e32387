"""Properties of the panel operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_stage_intervals_match_plain_rules(spark):
    from panelscope.operators import stages

    rng = np.random.default_rng(1)
    rows = [tuple(map(float, r)) for r in rng.normal(0, 1.2, (3000, 3))]
    c = stages.CUTS
    got = spark.createDataFrame(rows, "heat_z double, dry_z double, soil_z double").withColumn("s", stages.stages_of()).collect()
    for r in got:
        h, d, s = r.heat_z, r.dry_z, r.soil_z
        assert (8 in r.s) == (h > c["c"] and d > c["c"] and s < -c["c"])
        assert (2 in r.s) == (c["a"] < h <= c["b"] and d <= c["c"] and -c["a"] <= s <= c["a"])
        assert (5 in r.s) == (c["b"] < h <= c["c"] and d <= c["c"] and -c["c"] <= s < -c["b"])
    mirrored = spark.createDataFrame(rows, "heat_z double, dry_z double, soil_z double").select(stages.stages_of().alias("m"), stages.stages_of("mirrored").alias("n"))
    assert mirrored.where(F.expr("array_contains(m, 8) <> array_contains(n, 8) or array_contains(m, 1) <> array_contains(n, 1)")).count() == 0


def test_polyfit_agrees_with_numpy(spark):
    from panelscope.operators import curves

    rng = np.random.default_rng(2)
    x = np.sort(rng.uniform(3, 9, 60))
    y = 0.4 - 0.3 * (x - 5) - 0.1 * (x - 6) ** 2 + rng.normal(0, 0.05, 60)
    pts = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    for degree in (2, 4, 6):
        grid = curves.on_grid(curves.polyfit(pts, ["k"], degree), 40).select("x", curves.fitted(degree).alias("y"), curves.slope(degree).alias("s")).toPandas()
        want = np.polynomial.Polynomial.fit(x, y, degree)
        assert np.allclose(want(grid.x.to_numpy()), grid.y, atol=1e-8)
        assert np.allclose(want.deriv()(grid.x.to_numpy()), grid.s, atol=1e-6)


def test_crossing_takes_the_highest_and_needs_a_fall(spark):
    from panelscope.operators import curves

    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, -1.0), (1, 2.0, 1.0), (1, 3.0, -3.0), (2, 0.0, -1.0), (2, 1.0, 1.0)], "k int, x double, y double")
    assert {r.k: r.crossing for r in curves.crossings(df, ["k"]).collect()} == {1: 2.25, 2: None}


def test_balance_years_keeps_the_latest(spark):
    from panelscope.operators.subset import balance_years

    days = [f"{y}-{m:02d}-01" for m, ys in ((6, range(2000, 2005)), (7, (2001, 2003))) for y in ys]
    df = spark.createDataFrame([(1, d) for d in days], "entity int, d string").withColumn("ts", F.to_timestamp_ntz("d"))
    got = {(r.month, r.year) for r in balance_years(df).collect()}
    assert got == {(6, 2003), (6, 2004), (7, 2001), (7, 2003)}


def test_priority_merge_reports_an_emptied_side(spark):
    from panelscope.operators.merge import priority_merge

    rows = lambda days, qc: spark.createDataFrame([(1, d, qc) for d in days], "entity int, d string, qc int").withColumn("ts", F.to_timestamp_ntz("d"))
    out = priority_merge(rows(["2000-01-01"], 1), rows(["2000-01-02", "2000-02-01"], 0)).collect()
    assert {r.status for r in out} == {"emptied"} and len(out) == 3
    out = priority_merge(rows(["2000-01-01", "2001-01-01"], 0), rows(["1999-05-01", "2000-01-02"], 0)).collect()
    assert {r.d for r in out} == {"2000-01-01", "2001-01-01", "1999-05-01"}


def test_tails(spark):
    from panelscope.functions import chi2_sf, normal_sf, t_quantile
    from panelscope.functions.tails import t_within

    r = spark.range(1).select(normal_sf(F.lit(1.959964)).alias("n"), chi2_sf(F.lit(11.43), 3).alias("c"), chi2_sf(F.lit(9.488), 4).alias("d")).first()
    assert abs(r.n - 0.025) < 1e-6 and abs(r.c - 0.0096) < 2e-4 and abs(r.d - 0.05) < 1e-4
    # published quantiles
    known = {1: 12.7062047, 2: 4.3026527, 3: 3.1824463, 4: 2.7764451, 5: 2.5705818, 10: 2.2281389, 20: 2.0859634, 30: 2.0422725, 120: 1.9799304, 1000: 1.9623391}
    rows = spark.createDataFrame([(k,) for k in [*known, 0]], "dof long").select("dof", t_quantile(F.col("dof")).alias("t")).collect()
    assert all((r.t is None) if r.dof == 0 else abs(r.t - known[r.dof]) < 1e-6 for r in rows)
    # the series against the density, added up
    for dof in (1, 2, 7, 8):
        x = np.linspace(0, 1.7, 20001)
        density = (1 + x * x / dof) ** (-(dof + 1) / 2)
        whole = np.linspace(-4000, 4000, 8_000_001) if dof == 1 else np.linspace(-900, 900, 3_600_001)
        total = np.trapezoid((1 + whole * whole / dof) ** (-(dof + 1) / 2), whole)
        assert abs(2 * np.trapezoid(density, x) / total - t_within(1.7, dof)) < 5e-4


def test_leave_one_out_medians_against_filtering(spark):
    from panelscope.operators import thresholds

    rng = np.random.default_rng(6)
    pts = [(e, float(x), float(rng.integers(0, 9))) for e in range(9) for x in range(5) if rng.random() < 0.7]
    got = {(r.removed, r.x): (r.y, r.k) for r in thresholds.leave_one_out(spark.createDataFrame(pts, "entity long, x double, y double")).collect()}
    want = {}
    for e in {p[0] for p in pts}:
        for x in {p[1] for p in pts}:
            left = [y for f, z, y in pts if z == x and f != e]
            if left:
                want[e, x] = (float(np.median(left)), len(left))
    assert got == want


def test_lowess_on_a_line_with_an_outlier(spark):
    from panelscope.operators import curves

    x = np.arange(30.0)
    y = 2 + 0.5 * x + np.random.default_rng(5).normal(0, 0.1, 30)
    y[12] += 40
    pts = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y, strict=True)], "key string, x double, y double")
    robust = {r.x: r.fit for r in curves.lowess(pts, ["key"], 0.4, 3).collect()}
    plain = {r.x: r.fit for r in curves.lowess(pts, ["key"], 0.4, 0).collect()}
    line = {a: 2 + 0.5 * a for a in x}
    assert max(abs(robust[a] - line[a]) for a in x) < 0.3 < 1 < max(abs(plain[a] - line[a]) for a in x)


def test_peak_and_splines_against_numpy(spark):
    from panelscope.operators import curves, splines

    rng = np.random.default_rng(7)
    x = np.linspace(-2, 3, 80)
    y = 1.5 - 0.6 * (x - 0.7) ** 2
    pts = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    peak = curves.refine_peak(curves.polyfit(pts, ["k"]), ["k"]).first()
    assert abs(peak.peak_x - 0.7) < 1e-3 and abs(peak.peak_y - 1.5) < 1e-4
    noisy = spark.createDataFrame([(1, float(a), float(np.sin(a) + e)) for a, e in zip(x, rng.normal(0, 0.05, 80), strict=True)], "k int, x double, y double")
    fit = splines.penalized_spline(noisy, ["k"]).toPandas()
    assert np.abs(fit.fit - np.sin(fit.x)).max() < 0.12 and fit.edf.between(3, 12).all() and (fit.se > 0).all()
    rough, smooth = (splines.penalized_spline(noisy, ["k"], residual=r).toPandas() for r in (0.01, 0.5))
    assert rough.penalty[0] < smooth.penalty[0] and rough.edf[0] > smooth.edf[0]


def test_manifest_lists_every_file_once(spark, tmp_path):
    import hashlib

    from panelscope import sources

    df = spark.range(40).selectExpr("id % 3 as part", "id")
    sources.write_partitioned(df, f"{tmp_path}/out/parquet", ["part"], f"{tmp_path}/out/csv")
    (tmp_path / "out/notes").mkdir()
    (tmp_path / "out/notes/read me.txt").write_text("x")
    rows = sources.manifest(spark, f"{tmp_path}/out").collect()
    files = {str(p.relative_to(tmp_path / "out")): p for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}
    # a CSV whose folder has a Parquet twin is left out
    assert {r.path.replace("%20", " ") for r in rows} == {n for n in files if not n.endswith(".csv")}
    for r in rows:
        content = files[r.path.replace("%20", " ")].read_bytes()
        assert r.sha256 == hashlib.sha256(content).hexdigest() and r.bytes == len(content)
    assert {r.stage for r in rows if not r.ok} == {"notes"}


def test_merge_of_sources_tells_what_is_unfit(spark):
    from panelscope.operators.merge import merge_sources

    rows = lambda r: spark.createDataFrame(r, "entity int, d string, qc int, a double, b double").withColumn("ts", F.to_timestamp_ntz("d")).drop("d")
    first = rows([(1, "2000-01-01", 0, 1.0, None), (1, "2001-01-01", 0, 1.0, None), (2, "2000-01-01", 0, None, 2.0), (3, "2000-01-01", 1, 1.0, None), (4, "2000-01-01", 0, 1.0, None), (4, "2000-01-01", 0, 1.0, None)])
    second = rows([(1, "1999-01-01", 0, 1.0, None), (2, "1999-01-01", 0, 1.0, None), (3, "2000-01-02", 0, 1.0, None), (5, "2000-01-02", 0, None, 1.0)])
    meta = spark.createDataFrame([(1, 1, "A", None, "x"), (1, 2, "B", 5.0, "y"), (2, 1, "A", None, None), (5, 2, "B", 1.0, None)], "entity int, priority int, origin string, lat double, seg string")
    merged, sites = merge_sources({"A": first, "B": second}, meta, ["lat", "seg"], ["a", "b"])
    got = {r.entity: (r.origin, r.variable, r.status, r.lat, r.seg) for r in sites.collect()}
    assert got == {1: ("A+B", "a", "merged", 5.0, "x"), 2: ("A", "b", "variable", None, None), 3: (None, "a", "emptied", None, None), 4: (None, "a", "duplicate", None, None), 5: ("B", "b", "single", 1.0, None)}
    assert sorted(r.source for r in merged.where("entity = 1").collect()) == ["A", "A", "B"]


def test_places_number_a_total_order(spark):
    from panelscope.operators.ranks import places

    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("v"))
    got = places(df, [F.desc("v")], parts=7).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 501)) and [r.v for r in got] == sorted((r.v for r in got), reverse=True)


FAST = {"rate": 0.2, "depth": 4, "patience": 10}


def test_forests_and_search(spark):
    from panelscope.operators import models
    from panelscope.queries.modelling import search_grid

    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 2))
    rows = [(1 + i % 2, i, float(a), float(b), float(np.where(i % 2, a, b) ** 2 + rng.normal(0, 0.05))) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "entity long, id int, a double, b double, t double")
    out = models.forest(df, ["a", "b"], "t", ["id"], trees=12, depth=5, colsample=1.0).toPandas()
    assert sorted(out.id) == list(range(500))
    for _, g in out.groupby("entity"):  # each entity has a forest of its own
        assert 1 - ((g.pred - g.y) ** 2).sum() / ((g.y - g.y.mean()) ** 2).sum() > 0.8
    grid = search_grid()
    assert len(grid) == len({tuple(g.items()) for g in grid}) == 25


def test_interventional_attribution_is_additive(spark):
    from panelscope.operators import models

    rng = np.random.default_rng(9)
    f = ["a", "b", "c"]
    model = lambda x: x["a"] * x["b"] + 2 * x["c"]
    rows = [(i % 2, i, *map(float, rng.normal(size=3))) for i in range(60)]
    df = spark.createDataFrame(rows, "entity long, id int, a double, b double, c double")
    back = df.where("id < 40")
    out = models.shapley_interventional(df, f, model, back, ["id"]).toPandas()
    assert np.allclose(out.base + out.phi_a + out.phi_b + out.phi_c, out.a * out.b + 2 * out.c)
    b = {e: np.array([r[2:] for r in rows if r[0] == e and r[1] < 40]) for e in (0, 1)}
    for r in out.itertuples():
        m = b[r.entity]
        assert abs(r.phi_c - 2 * (r.c - m[:, 2].mean())) < 1e-9
        assert abs(r.phi_a - 0.5 * ((r.a * m[:, 1] - m[:, 0] * m[:, 1]).mean() + (r.a * r.b - m[:, 0] * r.b).mean())) < 1e-9


def test_oof_models_are_isolated_and_additive(spark):
    from panelscope.operators import models

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    rows = [(1, i, float(a), float(b), float(a - 0.5 * b * b), i % 5, i % 7 == 0) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "entity long, id int, a double, b double, t double, fold int, inner boolean")
    out = models.oof_predict(df, ["a", "b"], "t", ["id"], attribute=True, trees=40, **FAST).toPandas()
    assert len(out) == 400 and np.allclose(out.base + out.phi_a + out.phi_b, out.pred)
    assert 1 - ((out.pred - out.y) ** 2).sum() / ((out.y - out.y.mean()) ** 2).sum() > 0.7
    again = models.oof_predict(df, ["a", "b"], "t", ["id"], attribute=True, trees=40, **FAST).toPandas()
    assert np.allclose(out.sort_values("id").pred, again.sort_values("id").pred)
    # changing targets of fold 0 must not change that fold's predictions
    changed = df.withColumn("t", F.when(F.col("fold") == 0, F.col("t") + 100).otherwise(F.col("t")))
    other = models.oof_predict(changed, ["a", "b"], "t", ["id"], trees=40, **FAST).toPandas()
    assert np.allclose(out[out.fold == 0].sort_values("id").pred, other[other.fold == 0].sort_values("id").pred)


def test_registry_is_complete():
    from panelscope.queries import ORACLE_SQL, QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 150


def test_a_merge_of_many_sources_is_read_and_not_merged_again(spark):
    from panelscope.operators.merge import merge_sources

    day = lambda i: spark.createDataFrame([(1, f"200{i}-01-01", 0, 1.0)], "entity int, d string, qc int, a double").withColumn("ts", F.to_timestamp_ntz("d")).drop("d")
    meta = spark.createDataFrame([(1, i, c, 1.0) for i, c in enumerate("ABCD")], "entity int, priority int, origin string, lat double")
    merged, sites = merge_sources({c: day(i) for i, c in enumerate("ABCD")}, meta, ["lat"], ["a"])
    for df in (merged, sites):
        # a task holds no state of the merges, however many there were
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(step in plan for step in ("Join", "Aggregate", "Sort", "Exchange")), plan
    assert merged.count() == 4 and [(r.origin, r.status) for r in sites.collect()] == [("A+B+C+D", "merged")]
