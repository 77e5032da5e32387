"""Steps that shuffle no rows, shuffle them once or work a thing out once, as their plans and counts show."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from panelscope.operators import models, ordered, subset

ROOT = "/root/testdata"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_zscores_of_few_entities_shuffle_no_row(spark):
    df = spark.range(2_000_000).select((F.col("id") % 25).alias("entity"), (F.col("id") % 1001).cast("double").alias("x"))
    out = subset.zscore(df, ["x"])
    assert "Exchange hashpartitioning" not in plan(out)
    r = out.agg(F.avg("x_z").alias("m"), F.stddev_pop("x_z").alias("s"), F.count("*").alias("n")).first()
    assert abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 and r.n == 2_000_000


def test_places_shuffle_rows_once(spark):
    df = spark.range(2_000_000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 2_000_003).alias("v"))
    out = ordered.placed(df, ["g"], ["v"], "place", parts=9)
    assert "Exchange hashpartitioning" not in plan(out)  # the range's shuffle is written
    got = out.where("v < 300").toPandas()
    want = df.toPandas()
    want["place"] = want.groupby("g", dropna=False).v.rank(method="first").astype(int)
    want = want[want.v < 300]
    assert sorted(zip(got.g.fillna(-1), got.v, got.place)) == sorted(zip(want.g.fillna(-1), want.v, want.place))


def test_attribution_is_worked_out_once(spark):
    from panelscope.queries import QUERIES

    assert plan(QUERIES["attribution_assemble"](spark, f"{ROOT}/sf0.001")).count("MapInArrow") == 1


def test_coalitions_are_worked_out_once_for_equal_values(spark, tmp_path, monkeypatch):
    marks, f = str(tmp_path), ["a", "b", "c"]

    def model(x):
        size = int(np.prod(np.broadcast_shapes(*(np.shape(v) for v in x.values()))))
        with open(f"{marks}/{os.getpid()}", "a") as out:
            out.write(f"{size}\n")
        return x["a"] * x["b"] + 2 * x["c"] * x["c"]

    rng = np.random.default_rng(4)
    a, b, c = rng.integers(0, 3, 3000), rng.integers(0, 2, 3000), rng.normal(size=3000)
    df = spark.createDataFrame([(i % 2, i, float(a[i]), float(b[i]), float(c[i])) for i in range(3000)], "entity long, id int, a double, b double, c double").coalesce(1)
    back = df.where("id < 600")
    out = models.shapley_interventional(df, f, model, back, ["id"]).toPandas()
    entries = sum(int(line) for name in os.listdir(marks) for line in open(f"{marks}/{name}"))
    # of eight coalitions, three hold c and need the background, all three features need none, the others have few values
    assert len(out) == 3000 and entries < 3.2 * 3000 * 300
    monkeypatch.setattr(models, "MATRIX", 10)
    joined = models.shapley_interventional(df, f, model, back, ["id"]).toPandas()
    one, other = (x.sort_values("id")[["base", "phi_a", "phi_b", "phi_c"]].to_numpy() for x in (out, joined))
    assert np.allclose(one, other, rtol=0, atol=1e-9)
    for r in out.head(20).itertuples():
        at = (np.arange(600) % 2 == r.entity).nonzero()[0]
        assert abs(r.phi_c - (2 * r.c**2 - (2 * c[at] ** 2).mean())) < 1e-9
        assert abs(r.phi_a - 0.5 * ((r.a * b[at] - a[at] * b[at]).mean() + (r.a * r.b - a[at] * r.b).mean())) < 1e-9


def test_small_folders_are_written_by_many_tasks(spark, tmp_path):
    from panelscope.sources import write_partitioned

    df = spark.range(640).select((F.col("id") % 64).alias("entity"), F.col("id").cast("double").alias("x"))
    write_partitioned(df, f"{tmp_path}/parquet", ["entity"], f"{tmp_path}/csv")
    for kind in ("parquet", "csv"):
        files = [f for at, _, names in os.walk(tmp_path / kind) for f in names if f.startswith("part-")]
        assert len(files) == 64 and len({f[:10] for f in files}) >= 8
    assert spark.read.parquet(f"{tmp_path}/parquet").agg(F.sum("x")).first()[0] == 639 * 320
