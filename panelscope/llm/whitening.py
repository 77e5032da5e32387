"""Whitening of embeddings by a bidiagonal qd solver.

Tasks centre their rows and reduce them block by block to one triangular factor
R (blockwise QR); factors are stacked and reduced again in groups until one is
left for each vector length.  Householder reflections make R bidiagonal, dqds
finds its squared singular values to high relative accuracy, and twisted
factorisations give the singular vectors, which the reflections carry back to
whitening directions.  V = R'R / n is never formed.  Rows are then projected in
a last pass.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

COMPONENTS = 8
#: Factors that one task reduces to one; matrix entries of the vector lengths that are fitted together.
FAN, ENTRIES = 16, 1 << 22
#: Rows that are stacked below a factor before it is reduced.
ROWS = 1024
#: Entries become whole numbers by this factor and offset.
SCALE, OFFSET = 1024, 100_000
#: Entries are held to this size, so that they fit a long.
LARGEST = 2.0**62
_EPS = float(np.finfo(float).eps)
_LONG = 1 << 63


# -- rows ------------------------------------------------------------------
def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have a vector of finite entries, their lengths, all their entries as whole numbers)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    begin = column.offsets.to_numpy()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(begin), 0)
    values = column.values.to_numpy(zero_copy_only=False).astype(float)  # null entries become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ok = (size > 0) & (bad[begin[1:]] == bad[begin[:-1]])
    rows = np.flatnonzero(ok)
    at = np.repeat(begin[:-1][rows] - np.concatenate(([0], np.cumsum(size[rows])))[:-1], size[rows]) + np.arange(size[rows].sum())
    return rows, size[rows], np.clip(np.floor(values[at] * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _by_length(column: pa.Array, lengths=None):
    """(rows, matrix of whole numbers) for each vector length of a batch."""
    rows, size, flat = _whole(column)
    begin = np.concatenate(([0], np.cumsum(size)))
    for d in np.unique(size).tolist():
        if lengths is None or d in lengths:
            some = np.flatnonzero(size == d)
            yield d, rows[some], flat[begin[some][:, None] + np.arange(d)]


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """x as int64 where `factor` times an entry fits, else as Python integers."""
    return x.astype(object) if x.dtype != object and int(np.abs(x).max(initial=0)) * factor >= _LONG else x


def _sums(batches):
    """(dim, n, at, total): the rows of a task, and their sums, by vector length."""
    n, total = {}, {}
    for batch in batches:
        for d, rows, x in _by_length(batch.column(0)):
            part = _exact(x, len(x)).sum(axis=0)
            n[d] = n.get(d, 0) + len(rows)
            total[d] = [a + int(b) for a, b in zip(total.get(d, [0] * d), part.tolist(), strict=True)]
    for d in n:
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array([n[d]] * d), pa.array(range(d), pa.int32()), pa.array([Decimal(v) for v in total[d]], pa.decimal128(38, 0))], ["dim", "n", "at", "total"])


def _deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly."""
    if max(int(np.abs(x).max(initial=0)) * n, *map(abs, total)) >= _LONG // 2:
        return x.astype(object) * n - np.array(total, object)
    return x * n - np.array(total, np.int64)


def triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of a matrix, square even where rows are few."""
    d = rows.shape[1]
    r = np.linalg.qr(np.vstack([rows, np.zeros((max(0, d - len(rows)), d))]), mode="r")
    return r[:d]


_FACTOR = "dim int, part long, factor array<double>"


def _packed(d: int, part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part]), pa.array([r[np.triu_indices(d)]], pa.list_(pa.float64()))], ["dim", "part", "factor"])


def _unpacked(d: int, flat: np.ndarray) -> np.ndarray:
    r = np.zeros((d, d))
    r[np.triu_indices(d)] = flat
    return r


def _factors(fit: dict):
    """Each task's rows as one triangular factor by vector length; fit: n and sums by vector length."""

    def run(batches):
        factor, held = {}, {}
        for batch in batches:
            for d, _, x in _by_length(batch.column(0), fit):
                n, total = fit[d]
                held.setdefault(d, []).append(_deviations(x, n, total).astype(float) / n)
                if sum(map(len, held[d])) >= max(ROWS, 2 * d):
                    factor[d] = triangle(np.vstack([*([factor[d]] if d in factor else []), *held.pop(d)]))
        for d in [*factor, *(d for d in held if d not in factor)]:
            yield _packed(d, TaskContext.get().partitionId(), triangle(np.vstack([*([factor[d]] if d in factor else []), *held.get(d, [])])))

    return run


def _reduced(batches):
    """Factors in order of (dim, part) to one factor each; one is held at a time."""
    key, r = None, None
    for batch in batches:
        for d, part, flat in zip(batch.column("dim").to_pylist(), batch.column("part").to_pylist(), batch.column("factor"), strict=True):
            more = _unpacked(d, flat.values.to_numpy(zero_copy_only=False))
            if key is not None and key != (d, part):
                yield _packed(*key, r)
                r = None
            key, r = (d, part), more if r is None else triangle(np.vstack([r, more]))
    if key is not None:
        yield _packed(*key, r)


# -- the solver ------------------------------------------------------------
def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, reflections from the right) of U'RP by Householder reflections."""
    a, n, right = r.copy(), len(r), []

    def reflection(x):
        """Unit v for which (I - 2vv')x has zeros below its first entry; None if it has already."""
        if not np.abs(x[1:]).max(initial=0):
            return None
        v = x / np.abs(x).max()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflection(a[k:, k])
        if v is not None:
            a[k:, k:] -= np.outer(2 * v, v @ a[k:, k:])
        if k + 2 < n:
            v = reflection(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, 2 * v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def carried(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """A right singular vector of the bidiagonal matrix as one of R."""
    out = z.copy()
    for k in range(len(right) - 1, -1, -1):
        if right[k] is not None:
            out[k + 1 :] -= 2 * right[k] * (right[k] @ out[k + 1 :])
    return out


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, int]:
    """One differential qd step with a shift: (q, e, the last remainder, places of negative remainders before it)."""
    d, out_q, out_e, early = q[0] - shift, [], [], 0
    for i in range(len(e)):
        if d < 0:
            early += 1
        t = d + e[i]
        ratio = q[i + 1] / t if t else 0.0
        out_q.append(t)
        out_e.append(e[i] * ratio)
        d = d * ratio - shift if t else q[i + 1] - shift
    out_q.append(d)
    return out_q, out_e, d, early


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling, by the differential qd algorithm with shifts."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if not scale:
        return np.zeros(len(diagonal))
    tiny = (100 * _EPS) ** 2
    work, found = [(((diagonal / scale) ** 2).tolist(), ((upper / scale) ** 2).tolist(), 0.0)], []
    while work:
        q, e, gone = work.pop()
        turns = 0
        while q:
            n = len(q)
            if n == 1 or e[-1] <= tiny * (gone + q[-1]) or e[-1] <= tiny * q[-2] * (q[-1] / (q[-1] + e[-1]) if q[-1] else 0.0):
                found.append(gone + q.pop())
                if n > 1:
                    e.pop()
                turns = 0
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tiny * gone or e[i] == 0), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], gone))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q.reverse()
                e.reverse()
            turns += 1
            if turns > 500:
                raise ArithmeticError("dqds does not converge")
            # the smaller eigenvalue of the last two rows is above the smallest of all, and close to it in the end
            a, c, b2 = q[-2] + (e[-2] if n > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            root = np.hypot((a - c) / 2, np.sqrt(b2))
            shift = max(0.0, (a * c - b2) / ((a + c) / 2 + root)) if turns > 1 else 0.0
            for attempt in range(4):
                shift = 0.0 if attempt == 3 else float(shift)
                new_q, new_e, last, early = _transform(q, e, shift)
                if early == 0 and last >= 0 or shift == 0:
                    break
                shift = max(0.0, shift + last) if early == 0 else shift / 4  # a remainder that fails last tells how far the shift was off
            q, e, gone = new_q, new_e, gone + shift
    return np.sort(np.maximum(found, 0))[::-1] * scale * scale


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """Unit vector z with B'Bz = value * z, from the factorisations from above and from below that meet at the twist with the smallest remainder."""
    n = len(diagonal)
    floor = _EPS * max(np.abs(diagonal).max(), np.abs(upper).max(initial=0))
    a = np.where(np.abs(diagonal) < floor, floor, diagonal)
    d, low = (a * a).tolist(), (upper / a[:-1]).tolist()
    safe = lambda x: x if x else _EPS * _EPS * value
    s, down, s_at = -value, [], []
    for i in range(n):
        s_at.append(s)
        if i < n - 1:
            pivot = safe(s + d[i])
            down.append(d[i] * low[i] / pivot)
            s = down[i] * low[i] * s - value
    p, up, p_at = d[-1] - value, [0.0] * (n - 1), [0.0] * n
    p_at[-1] = p
    for i in range(n - 2, -1, -1):
        pivot = safe(d[i] * low[i] * low[i] + p)
        t = d[i] / pivot
        up[i] = low[i] * t
        p = p * t - value
        p_at[i] = p
    gamma = np.abs(np.array(s_at) + np.array(p_at) + value)
    k = int(np.nanargmin(gamma))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _inverse_step(main: np.ndarray, off: np.ndarray, value: float, rhs: np.ndarray) -> np.ndarray:
    """Solve (T - value) x = rhs for tridiagonal T by elimination with row exchanges."""
    n, least = len(main), _EPS * max(np.abs(main).max(), np.abs(off).max(initial=0))
    rows = [[main[i] - value, off[i] if i < n - 1 else 0.0, 0.0] for i in range(n)]
    x = rhs.tolist()
    for i in range(n - 1):
        below = [off[i], rows[i + 1][0], rows[i + 1][1]]
        if abs(below[0]) > abs(rows[i][0]):
            rows[i], below = below, rows[i]
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(rows[i][0]) < least:
            rows[i][0] = least
        f = below[0] / rows[i][0]
        rows[i + 1] = [below[1] - f * rows[i][1], below[2] - f * rows[i][2], 0.0]
        x[i + 1] -= f * x[i]
    if abs(rows[-1][0]) < least:
        rows[-1][0] = least
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (rows[i][1] * x[i + 1] if i + 1 < n else 0) - (rows[i][2] * x[i + 2] if i + 2 < n else 0)) / rows[i][0]
    return np.array(x)


def directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all eigenvalues of r'r, falling; the unit eigenvectors of the first k as rows, their largest entry positive)."""
    diagonal, upper, right = bidiagonal(r)
    values = dqds(diagonal, upper)
    if not values.any():  # no spread at all: any directions do
        return values, np.eye(len(values))[:k]
    main, off = diagonal**2 + np.concatenate(([0.0], upper**2)), diagonal[:-1] * upper
    rng, z = np.random.default_rng(7), []
    for i in range(min(k, len(values))):
        vector = twisted(diagonal, upper, values[i]) if values[i] > 0 else rng.standard_normal(len(values))
        # values that lie close share a plane; their vectors are made orthogonal and refined there
        close = [j for j in range(i) if values[j] - values[i] <= 1e-3 * values[j]]
        for turn in range(3 if close or values[i] <= 0 else 0):
            for j in close:
                vector -= z[j] * (z[j] @ vector)
            if np.linalg.norm(vector) < 1e-3:
                vector = rng.standard_normal(len(values))
            vector /= np.linalg.norm(vector)
            if turn < 2:
                vector = _inverse_step(main, off, values[i], vector)
                vector /= np.linalg.norm(vector)
        z.append(vector)
    out = np.array([carried(v, right) for v in z]).reshape(len(z), len(values))
    largest = np.abs(out).argmax(axis=1)
    return values, out * np.sign(out[np.arange(len(out)), largest])[:, None]


def _solved(k: int):
    def run(batches):
        for batch in _reduced(batches):
            d = batch.column("dim")[0].as_py()
            r = _unpacked(d, batch.column("factor")[0].values.to_numpy(zero_copy_only=False))
            values, vectors = directions(r, k)
            trace = float((r * r).sum())
            # a value that stands for no spread but that of rounding
            values = np.where(values > (d * _EPS) ** 2 * values[0], values, 0.0) if len(values) else values
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([values[:k]], pa.list_(pa.float64())), pa.array([trace]), pa.array([vectors.ravel()], pa.list_(pa.float64()))], ["dim", "sums", "trace", "vectors"])

    return run


def _project(fit: dict, solved: dict, k: int):
    def run(batches):
        for batch in batches:
            for d, rows, x in _by_length(batch.column(1), fit):
                n, total = fit[d]
                sums, vectors = solved[d]
                t = _deviations(x, n, total)
                exact = _exact(t, int(np.abs(t).max(initial=0)) * d)
                squares = [v if v < _LONG else None for v in (exact * exact).sum(axis=1).tolist()]
                scale = np.sqrt(np.maximum(sums / n, 0))
                flat = (t.astype(float) / n) @ vectors.T / np.where(scale > 0, scale, 1)
                w = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(sums), pa.int32()), pa.array(flat.ravel(), mask=np.tile(scale <= 0, len(rows))))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([d] * len(rows), pa.int32()), pa.array(squares, pa.int64()), w], ["vec_id", "dim", "deviation", "w"])

    return run


def _waves(lengths: list[int]):
    wave, size = [], 0
    for d in lengths:
        if wave and size + d * d > ENTRIES:
            yield wave
            wave, size = [], 0
        wave.append(d)
        size += d * d
    if wave:
        yield wave


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and its first components.

    Null vectors, those without entries and those with null or non-finite
    entries are left out.  Vectors of unlike lengths are lists of their own,
    each fitted on all vectors of its length (n of them); shorter vectors than
    `components` have as many components as entries.  A component without spread
    (one vector alone, equal vectors, dependent dimensions) has whitened null
    and does not count for identity_error, which is one value for the whole
    result.  deviation is null where it does not fit a long; entries beyond LARGEST / SCALE
    count as that.  Equal vectors get
    equal rows, rows of one id are separate rows, other columns are ignored, and
    an empty table gives an empty result.
    """
    ws = Workspace(vectors.sparkSession)
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    # tasks' sums: a row for each place of a vector
    sums = ws.save(rows.select("v").mapInArrow(_sums, "dim int, n long, at int, total decimal(38, 0)").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38, 0)").alias("total")), "sums")
    lengths = {r.dim: r.n for r in sums.where("at = 0").select("dim", "n").collect()}  # at most as many as the longest vector has entries
    done = []
    for wave in _waves(sorted(lengths)):
        # ENTRIES bounds what a wave's lengths bring to the driver and to tasks
        total = {d: [0] * d for d in wave}
        for r in sums.where(F.col("dim").isin(wave)).collect():
            total[r.dim][r["at"]] = int(r.total)
        fit = {d: (lengths[d], total[d]) for d in wave}
        factors = ws.save(rows.select("v").mapInArrow(_factors(fit), _FACTOR), "factors")
        while factors.groupBy("dim").count().where(F.col("count") > FAN).count():
            grouped = factors.withColumn("part", F.expr(f"part div {FAN}")).repartition("dim", "part").sortWithinPartitions("dim", "part")
            factors = ws.save(grouped.mapInArrow(_reduced, _FACTOR), "factors")
        last = factors.withColumn("part", F.lit(0).cast("long")).repartition("dim").sortWithinPartitions("dim")
        solved = ws.save(last.mapInArrow(_solved(components), "dim int, sums array<double>, trace double, vectors array<double>"), "solved")
        found = {r.dim: (np.array(r.sums), np.array(r.vectors).reshape(-1, r.dim)) for r in solved.collect()}
        projected = ws.save(rows.mapInArrow(_project(fit, found, components), f"vec_id {kind}, dim int, deviation long, w array<double>"), "projected")
        explained = solved.select("dim", F.transform("sums", lambda s: F.when(F.col("trace") > 0, s / F.col("trace")).otherwise(0.0)).alias("explained"))
        n = F.create_map(*[F.lit(x) for d in wave for x in (d, lengths[d])])
        done.append(projected.join(F.broadcast(explained), "dim").withColumn("n", n[F.col("dim")].cast("long")))
    if not done:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    w = lambda i: F.get("w", F.lit(i))
    off = [F.abs(F.covar_pop(w(i), w(j)) - (1.0 if i == j else 0.0)) for i in range(components) for j in range(i + 1)]
    error = every.groupBy("dim").agg(*[x.alias(f"c{i}") for i, x in enumerate(off)]).agg(F.greatest(F.lit(0.0), F.max(F.greatest(*[F.coalesce(f"c{i}", F.lit(0.0)) for i in range(len(off))]))).alias("identity_error"))
    out = every.select("vec_id", "n", "deviation", "explained", F.posexplode("w").alias("at", "whitened")).crossJoin(F.broadcast(error))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
