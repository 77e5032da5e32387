"""Stage 8 records matched to stage 7 records, per entity and mode, against all pairs in NumPy."""

from __future__ import annotations

import os

import numpy as np
import pytest

from panelscope.plans.panels import EFFECTS, staged
from panelscope.queries import QUERIES

SF = "/root/testdata/sf0.01"
KEY = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CALIPERS = ["heat_z", "soil_z", "light_z"]


def test_both_modes_are_reported_with_balance_and_effects(spark):
    if not os.path.isdir(SF):
        pytest.skip("tables are not there")
    got = {(r.entity, r["mode"]): r for r in QUERIES["matching_entity"](spark, SF).collect()}
    rows = staged(spark, SF).where("stage in (7, 8)").select("entity", "stage", "net", "dry_z", *CALIPERS, *KEY, *EFFECTS).toPandas().sort_values(KEY)
    seen = 0
    for entity, g in rows.groupby("entity"):
        s7, s8 = g[g.stage == 7], g[g.stage == 8]
        if s8.empty:
            assert (entity, "plain") not in got
            continue
        for mode in ("plain", "strict"):
            r = got.pop((entity, mode))
            x8, x7 = (s[CALIPERS].to_numpy()[a] for s, a in ((s8, np.s_[:, None]), (s7, np.s_[None, :])))
            ok = (np.abs(x8 - x7) <= 0.5).all(axis=2)
            if mode == "strict":
                m8, m7 = (np.array([t.month for t in s.ts]) for s in (s8, s7))
                ok &= m8[:, None] == m7[None, :]  # all rows are of hour 0
            d = np.where(ok, np.round(((x8 - x7) ** 2).sum(axis=2), 9), np.inf)
            hit = np.isfinite(d).any(axis=1)
            assert (r.n7, r.n8, r.matched) == (len(s7), len(s8), hit.sum())
            assert r.net_8 == pytest.approx(s8.net.mean(), abs=1e-6)
            assert r.phi_dry_7 == pytest.approx(s7.phi_dry.mean(), abs=1e-6) if len(s7) else r.phi_dry_7 is None
            a, b = s8[hit], s7.iloc[d[hit].argmin(axis=1)] if hit.any() else s7[:0]
            for c in ["net", "dry_z", *CALIPERS, *EFFECTS]:
                shift = r["diff" if c == "net" else f"d_{c}"]
                assert shift == pytest.approx((a[c].to_numpy() - b[c].to_numpy()).mean(), abs=1e-6) if hit.any() else shift is None
            seen += mode == "strict" and 0 < hit.sum() < len(s8)
    assert not got
    assert seen  # strict matches fail where plain ones do not
