"""Order inside large groups, rings of cells and exact rank tests against plain Python."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators import joins, merge, models, ordered, ranks


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("held", [3, 50, 10_000])
def test_quantiles_are_exact_whatever_a_task_may_hold(spark, held):
    rng = np.random.default_rng(3)
    values = {1: rng.normal(size=3000), 2: np.repeat([1.0, 2.0, 2.0, 7.0], 500), 3: np.array([5.0]), 4: np.concatenate([rng.normal(size=400), [1e300, -1e300, 0.0, -0.0]]), 5: np.array([4.0, 1.0]), 6: np.full(900, -3.5)}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [(1, None), (7, None), (3, math.nan)]
    random.Random(1).shuffle(rows)
    p = [0.0, 0.02, 0.25, 0.5, 0.9, 0.98, 1.0]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: (r.n, r.q) for r in ordered.quantiles(df, ["g"], "x", p, held=held).collect()}
    assert set(got) == set(values)
    for g, xs in values.items():
        assert got[g][0] == len(xs)
        assert np.allclose(got[g][1], np.quantile(xs, p), rtol=1e-12, atol=0)
    whole = ordered.quantiles(df, [], "x", [0.5], held=held).first()
    assert (whole.n, whole.q[0]) == (sum(map(len, values.values())), np.median(np.concatenate(list(values.values()))))
    assert ordered.quantiles(df.limit(0), ["g"], "x", p, held=held).count() == 0


def test_no_buffer_holds_a_whole_group(spark, monkeypatch):
    """Every value list that is ever collected has `held` values at most."""
    seen = []
    picked = ordered.F.collect_list
    monkeypatch.setattr(ordered.F, "collect_list", lambda c: (seen.append(c), picked(c))[1])
    df = spark.range(200_000).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % 200_003).cast("double").alias("x"))
    assert ordered.quantiles(df, ["g"], "x", [0.5], held=500).first().q[0] == np.median([(i * 7919) % 200_003 for i in range(200_000)])
    # each pass keeps about a sixty-fourth of what it got
    assert 2 <= len(seen) <= 4


def test_running_sums_and_predecessors_cross_ranges(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.choice(["x", "x", "y", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, t int, v string").repartition(5)
    by = {}
    for g, t, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(g, []).append((t, v))
    sums = ordered.running_sum(df, ["g"], ["t"], F.col("t"), "s", parts=7)
    want = {(g, t): s for g, xs in by.items() for (t, _), s in zip(xs, itertools.accumulate(t for t, _ in xs), strict=True)}
    assert {(r.g, r.t): r.s for r in sums.collect()} == want
    got = {(r.g, r.t): None if r._first else (r._last.t, r._last.v) for r in ordered.previous(df, ["g"], ["t"], ["t", "v"], parts=7).collect()}
    assert got == {(g, t): (xs[i - 1] if i else None) for g, xs in by.items() for i, (t, _) in enumerate(xs)}
    # one entity has most rows, and its rows are in several ranges
    parts = ordered.ranged(df, ["g"], ["t"], 7).where("g = 'hot'").groupBy("_part").count().collect()
    assert len(parts) >= 4
    assert max(r["count"] for r in parts) < 200


def test_label_runs_and_steps_of_a_hot_entity(spark):
    rng = random.Random(5)
    rows = [(1 if i % 10 else 2, i * rng.choice([1, 1, 1]), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "entity int, s int, label string")
    want = []
    for e in (1, 2):
        mine = sorted((s, x) for g, s, x in rows if g == e)
        for k, (x, run) in enumerate(itertools.groupby(mine, key=lambda r: r[1])):
            run = list(run)
            want.append((e, k + 1, x, run[0][0], run[-1][0], len(run)))
    got = ranks.label_runs(df, "label", "s", ["entity"])
    assert sorted(tuple(r[c] for c in ("entity", "run", "label", "first", "last", "n")) for r in got.collect()) == sorted(want)
    times = df.select("entity", F.timestamp_seconds("s").alias("ts"))
    assert sorted(map(tuple, merge.infer_frequency(times).collect())) == [(1, 1, 400), (2, 10, 49)]


def test_ranks_need_no_single_task(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.choice([None, *range(40)]), i) for i in range(400)], "x int, i int")
    out = ranks.average_rank(df, "x", "r")
    # the one exchange to a single task carries one row for each range
    lines = plan(out).split("Physical Plan")[1].split("\n")
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert single
    assert all("HashAggregate(keys=[_part" in lines[i + 1] for i in single)
    values = sorted(r.x for r in df.collect() if r.x is not None)
    mid = {v: (2 * values.index(v) + 1 + values.count(v)) / 2 for v in set(values)}
    assert all(r.r == mid.get(r.x) for r in out.collect())


def nearest(a, b, caliper, strict):
    near = lambda p, q: all(abs(p[k] - q[k]) <= caliper for k in (3, 4)) and p[0] == q[0] and (not strict or abs(p[5] - q[5]) <= 1)
    out = {}
    for p in a:
        found = [(round(sum((p[k] - q[k]) * (p[k] - q[k]) for k in (3, 4)), 9), q[1], q[2]) for q in b if None not in (*p[3:5], *q[3:5]) and near(p, q)]
        out[p[2]] = min(found, default=None)
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("crowd", [1, 1000])
def test_caliper_matches_are_those_of_all_pairs(spark, strict, crowd):
    rng = random.Random(7)
    spot = lambda: rng.choice([rng.gauss(0, 0.2), rng.uniform(-3, 3), 0.25])
    # entity, day, id, x, y, hour
    make = lambda n, first: [(rng.randint(1, 2), rng.randint(1, 20), first + i, spot(), spot() if i % 30 else None, rng.randint(0, 23)) for i in range(n)]
    a, b = make(150, 0), make(400, 1000)
    frame = lambda rows: spark.createDataFrame(rows, "entity int, d int, id int, x double, y double, h int").withColumn("ts", F.expr("timestamp_ntz'2020-03-01 00:00:00' + make_dt_interval(d, h)"))
    out = joins.caliper_nearest(frame(a), frame(b), ["x", "y"], 0.5, ["id", "ts"], strict=strict, crowd=crowd).collect()
    assert len(out) == len(a)
    want = nearest(a, [(*q[:1], q[1] * 24 + q[5], *q[2:]) for q in b], 0.5, strict)
    for r in out:
        w = want[r.id]
        assert (r.match is None) == (w is None)
        if w is not None:
            assert (r.d2, r.match.id) == (w[0], w[2])


def test_ring_search_bounds_pairs_as_rows_get_denser(spark, monkeypatch):
    """Three times as many rows on both sides make about three times as many pairs, not nine."""
    made = []
    rings = joins._rings

    def counted(left, right, groups, on, width, caliper):
        near = left.count() and left.crossJoin(right.select(*[F.col(c).alias(f"o_{c}") for c in on])).where(" AND ".join(f"abs(floor({c} / {width}) - floor(o_{c} / {width})) <= 1" for c in on)).count()
        made[-1] += near
        return rings(left, right, groups, on, width, caliper)

    monkeypatch.setattr(joins, "_rings", counted)
    rng = random.Random(8)
    for n in (300, 900):
        made.append(0)
        frame = lambda first: spark.createDataFrame([(1, first + i, rng.random(), rng.random()) for i in range(n)], "entity int, id int, x double, y double").withColumn("ts", F.current_timestamp())  # noqa: B023, E731
        assert joins.caliper_nearest(frame(0), frame(10_000), ["x", "y"], 1.0, ["id"]).where("match is null").count() == 0
    assert made[1] < 4.5 * made[0]
    assert made[1] < 60 * 900


def test_exact_tail_of_u_by_counting_orders():
    for m, n in ((1, 1), (2, 3), (3, 4), (4, 4), (2, 7)):
        us = [sum(sum(1 for j in range(m + n) if j not in pick and j < i) for i in pick) for pick in itertools.combinations(range(m + n), m)]
        for u in range(m * n + 1):
            assert abs(ranks.u_tail(u, m, n) - sum(x <= u for x in us) / len(us)) < 1e-12
    # a large group beside a small one
    assert abs(ranks.u_tail(8 * 5000 // 2, 8, 5000) - 0.5) < 0.01


def test_rank_tests_choose_their_distribution(spark):
    rng = random.Random(9)
    rows = [("a", rng.random()) for _ in range(6)] + [("b", rng.random() + 0.3) for _ in range(30)] + [("c", rng.random()) for _ in range(12)] + [("d", 0.5), ("d", 0.5)]
    got = {(r.a, r.b): r for r in ranks.mann_whitney_pairs(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    a, b = ([x for g, x in rows if g == k] for k in "ab")
    u = sum(x > y for x in a for y in b)
    assert got["a", "b"].u == u
    assert abs(got["a", "b"].p - min(1, 2 * ranks.u_tail(min(u, 180 - u), 6, 30))) < 1e-12
    for pair in (("b", "c"), ("a", "d")):  # no small group; ties
        r = got[pair]
        n_a, n_b, ties = r.n_a, r.n_b, 6 if "d" in pair else 0
        n = n_a + n_b
        sd = math.sqrt(n_a * n_b / 12 * (n + 1 - ties / (n * (n - 1))))
        z = (abs(r.u - n_a * n_b / 2) - 0.5) / sd
        assert abs(r.p - min(1.0, math.erfc(z / math.sqrt(2)))) < 1e-6


def test_effects_use_exact_edges(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(rng.normal(size=500))], "entity int, a double")
    out = models.ale(df, "a", [], lambda x: 2 * x["a"], bins=10).collect()
    xs = np.array([r.a for r in df.where("entity = 1").collect()])
    assert np.allclose(sorted(r.x for r in out if r.entity == 1), np.quantile(xs, np.linspace(0, 1, 11))[1:])


def plain_smooth(x, y, share):
    """The smoothing spline in powers: 1, x, x^2, x^3 and (x - knot)^3 right of each knot."""
    target = share * ((y - y.mean()) ** 2).sum()
    u = (x - x[0]) / (x[-1] - x[0])

    def matrix(knots):
        return np.column_stack([np.ones_like(u), u, u**2, u**3, *(np.maximum(u - k, 0) ** 3 for k in knots)])

    def fit(knots, weight):
        a = matrix(knots)
        penalty = np.zeros((len(knots), a.shape[1]))
        penalty[:, 4:] = weight * np.eye(len(knots))
        c = np.linalg.lstsq(np.vstack([a, penalty]), np.concatenate([y, np.zeros(len(knots))]), rcond=1e-15)[0]
        return a @ c

    knots = []
    while ((y - fit(knots, 0)) ** 2).sum() > target:
        off = (y - fit(knots, 0)) ** 2
        edges = [-1.0, *sorted(knots), 2.0]
        worst = None
        for a, b in itertools.pairwise(edges):
            inside = [i for i in range(len(u)) if a <= u[i] < b]
            free = [i for i in inside if u[i] not in knots and 0 < i < len(u) - 1]
            if free and (worst is None or sum(off[i] for i in inside) > worst[0]):
                worst = (sum(off[i] for i in inside), u[free[len(free) // 2]])
        knots.append(worst[1])
    knots.sort()
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2 if low else high / 4 if high > 1e-9 else 0
        low, high = (middle, high) if ((y - fit(knots, middle)) ** 2).sum() <= target else (low, middle)
    return knots, fit(knots, low)


@pytest.mark.parametrize("share", [0.001, 0.01, 0.05, 0.1])
def test_smoothing_splines_against_powers(spark, share):
    from panelscope.operators import splines

    rng = np.random.default_rng(12)
    x = np.sort(rng.uniform(-2, 3, 45))
    y = np.sin(2 * x) + 0.3 * x + rng.normal(0, 0.02, 45)
    knots, c = splines.smooth(x, y, share)
    fit = splines._basis(knots, x) @ c
    want_knots, want = plain_smooth(x, y, share)
    assert np.allclose((knots[4:-4] - x[0]) / (x[-1] - x[0]), want_knots)
    assert np.abs(fit - want).max() < 1e-6
    assert abs(((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum() / share - 1) < 1e-6
    # points of one x count by their mean, in any order, with groups side by side
    rows = [(g, float(a), float(b) + d) for g in ("p", "q") for a, b in zip(x, y, strict=True) for d in (-1.0, 1.0)] + [("few", 0.0, 1.0), ("p", None, 1.0)]
    out = splines.smoothing_spline(spark.createDataFrame(rows, "g string, x double, y double").repartition(3), ["g"], share, n_grid=50).toPandas()
    assert sorted(set(out.g)) == ["p", "q"]
    assert np.allclose(out[out.g == "p"].fit, splines._basis(knots, np.linspace(x[0], x[-1], 50)) @ c, atol=1e-8)


def test_leaving_one_out_holds_no_list_of_entities(spark):
    from panelscope.operators import thresholds

    out = thresholds.leave_one_out(spark.createDataFrame([(e, float(x), float(e * x % 5)) for e in range(20) for x in range(4)], "entity long, x double, y double"))
    assert "collect_" not in plan(out)
    assert out.count() == 80


def test_balanced_folds_differ_by_one_row(spark):
    from panelscope.operators import resample

    df = spark.createDataFrame([(1 if i % 9 else 2, i) for i in range(1003)], "entity int, i int")
    out = resample.balanced_kfold(df, [F.col("i"), F.lit(3)], ["i"]).groupBy("entity", "fold").count().collect()
    for e in (1, 2):
        sizes = [r["count"] for r in out if r.entity == e]
        assert len(sizes) == 5
        assert max(sizes) - min(sizes) <= 1
    # neighbours do not share folds by rule
    folds = [r.fold for r in resample.balanced_kfold(df, [F.col("i"), F.lit(3)], ["i"]).where("entity = 1").orderBy("i").collect()]
    assert len({b - a for a, b in itertools.pairwise(folds)}) == 9


def test_resampled_draws_every_slot_without_an_array_of_entities(spark):
    from collections import Counter

    from panelscope.operators.thresholds import resampled

    names = [f"s{i}" for i in range(23)]
    curves = spark.createDataFrame([(e, float(x), i + x / 10) for i, e in enumerate(names) for x in range(2)], "entity string, x double, y double")
    got = resampled(curves, 40, 9)
    ordered = sorted(names)
    want = Counter()
    for rep in range(40):
        for slot in range(len(names)):
            place = (rep * 1000003 + slot * 10007 + 9) * 48271 % 2147483647 % len(names)
            want[rep, ordered[place]] += 1
    assert {(r.rep, r.entity, r.x): r.times for r in got.collect()} == {(rep, e, float(x)): n for (rep, e), n in want.items() for x in range(2)}
    assert "collect_set" not in got._jdf.queryExecution().toString()
    assert resampled(curves.limit(0), 40, 9).count() == 0
