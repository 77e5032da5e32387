"""Every panel query against its SQL at sf0.001, those that depend on the number of entities at sf0.01 too (the driver compares all of them there)."""

from __future__ import annotations

import decimal
import glob
import math
import os

import pytest

from panelscope.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
ROOT = "/root/testdata"
LARGER = ["join_outer_bins", "leave_one_entity_out", "response_by_target", "curve_resample_physical", "estimator_sweep", "robustness_table", "group_threshold_ci", "priority_merge_fold", "filter_funnel", "coverage_top_k", "mann_whitney_pairs", "shapley_interventional"]
CASES = [("sf0.001", name) for name in sorted(ORACLE_SQL)] + [("sf0.01", name) for name in LARGER]
#: Queries that may rightly be empty on the small tables.
MAY_BE_EMPTY = {"duplicate_ts_check", "top_movers", "deepest_usable_layer", "entity_exclude_anti"}


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def views():
    made = {}

    def of(sf):
        if sf not in made:
            made[sf] = duckdb.connect()
            for path in glob.glob(f"{ROOT}/{sf}/*.parquet"):
                made[sf].execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
        return made[sf]

    return of


@pytest.mark.parametrize("sf, name", CASES)
def test_query_gives_the_rows_of_its_sql(spark, views, sf, name):
    folder = f"{ROOT}/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("tables are not there")
    con = views(sf)
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    rows = sorted(tuple(value(r[c]) for c in columns) for r in got.collect())
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(value(r[i]) for i in order) for r in cursor.fetchall())
    assert rows or name in MAY_BE_EMPTY
