"""Values that a plan computes more than once, and ties of values."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators import joins, ordered, ranks


@pytest.fixture
def unsteady(tmp_path):
    """Makes a table whose x is larger in its last digits each time it is computed, as sums are that tasks add up in another order."""

    def make(df):
        marks = str(tmp_path)

        def run(batches):
            turn = len(os.listdir(marks))
            open(f"{marks}/{turn}", "w").close()
            for b in batches:
                b["x"] = b["x"] * (1 + turn * 2.0**-50)
                yield b

        return df.coalesce(1).mapInPandas(run, df.schema)

    return make


def test_quartile_strata_see_the_values_that_the_quartiles_are_of(spark, unsteady):
    df = spark.createDataFrame([(i, 1.0 + i / 7) for i in range(25)], "id int, x double")
    got = ranks.quartile_strata(unsteady(df), "x").groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in got} == {1: 7, 2: 6, 3: 6, 4: 6}


def test_matches_are_found_again_whatever_their_last_digits(spark, unsteady):
    a = spark.createDataFrame([(1, i, i, 1.0 + i / 7) for i in range(20)], "entity int, id int, ts int, x double").withColumn("ts", F.timestamp_seconds("ts"))
    b = a.withColumns({"id": F.col("id") + 100, "x": F.col("x") + 0.01})
    got = joins.caliper_nearest(unsteady(a), b, ["x"], 0.1, ["id", "ts"]).collect()
    assert {r.id: r.match and r.match.id for r in got} == {i: i + 100 for i in range(20)}


@pytest.mark.parametrize("held", [50, 10_000])
def test_quantiles_between_equal_values_are_that_value(spark, held):
    values = np.random.default_rng(1).normal(size=30)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values) for _ in range(137)], "g int, x double")
    for r in ordered.quantiles(df, ["g"], "x", [i / 100 for i in range(101)], held=held).collect():
        assert set(r.q) == {values[r.g]}
