"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter direction joins one code word from each of two random codebooks, one
for either half of the rotated coordinates.  A vector is listed under every
filter whose direction it exceeds by a threshold; the sorted scores of one half
turn the search for them into a few binary searches per vector.  Vectors that
share a filter are compared in double precision.  A pair is counted in the least
filter that both share, so links need no distinct().
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import across, least_joined, paired_blocks, pieces
from .common import Workspace
from .components import components

MIN_COSINE = 0.95
#: Vectors that share a filter by chance, on average; sets the cap's size.
CROWD = 128
#: Independent product codes at first; one code's filters are too alike to find every pair alone.
CODES = 4
#: Code words of a codebook; codes that need more of them are joined by further codes instead.
MOST_WORDS = 4096
#: Share of random pairs just at the threshold that must share a filter; the codes grow until they do.
RECALL, TRIALS = 0.999, 1000
#: Members of a filter that are compared in one task at once.
BLOCK = 1024
SEED = 20240502


@dataclass(frozen=True)
class Code:
    """Random product codes for vectors of dimension d: codes times words * words filter directions."""

    d: int
    threshold: float
    words: int
    codes: int = CODES

    @property
    def filters(self) -> int:
        return self.codes * self.words * self.words

    @staticmethod
    def fit(n: int, d: int) -> Code:
        """Codes for n vectors: caps by CROWD, and as many directions as random pairs need to meet with probability RECALL.

        The pairs are simulated, so what is fitted depends on n and d alone.
        """
        p = min(0.05, max(1e-7, CROWD / max(n, 1)))
        rng = np.random.default_rng(SEED)
        # the cap's edge on the sphere itself; for tiny shares from the normal tail, shrunk to its fourth moment
        z = NormalDist().inv_cdf(1 - p)
        threshold = min(0.9, z / sqrt(d + z * z / 2))
        a, b = rng.standard_normal((TRIALS, d)), rng.standard_normal((TRIALS, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        if d > 1:
            b -= (a * b).sum(axis=1, keepdims=True) * a
            b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
            b = MIN_COSINE * a + sqrt(1 - MIN_COSINE**2) * b
        else:
            b = a
        words, codes = min(MOST_WORDS, max(2, ceil(sqrt(6 / (CODES * p))))), CODES
        while True:
            code = Code(d, threshold, words, codes)
            books = code.books()
            met = [bool(np.intersect1d(x, y, assume_unique=True).size) for x, y in zip(code.decode(a, books), code.decode(b, books), strict=True)]
            if np.mean(met) >= RECALL:
                return code
            if words < MOST_WORDS:
                words = min(MOST_WORDS, ceil(words * 1.2))
            else:
                codes += 1

    def books(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rotation, first codebook, second codebook) of each code; the same everywhere for one seed."""
        rng = np.random.default_rng(SEED + self.d)
        half = (self.d + 1) // 2
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True) / sqrt(2)
        return [(np.linalg.qr(rng.standard_normal((self.d, self.d)))[0], unit(rng.standard_normal((self.words, half))), unit(rng.standard_normal((self.words, max(1, self.d - half))))) for _ in range(self.codes)]

    def decode(self, unit: np.ndarray, books) -> list[np.ndarray]:
        """Sorted filter numbers that each unit vector exceeds; the best filter of each code at least."""
        parts = [self._decode(unit, book, k * self.words * self.words) for k, book in enumerate(books)]
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def _decode(self, unit: np.ndarray, book, base: int) -> list[np.ndarray]:
        turn, a, b = book
        x = unit @ turn
        half = a.shape[1]
        one, two = x[:, :half] @ a.T, (x[:, half:] if self.d > half else np.zeros((len(x), 1))) @ b.T
        out = []
        for s, t in zip(one, two, strict=True):
            order = np.argsort(-t)
            ranked = -t[order]
            first = np.flatnonzero(s + t[order[0]] >= self.threshold)
            if not len(first):
                out.append(np.array([base + int(np.argmax(s)) * self.words + int(order[0])]))
                continue
            count = np.searchsorted(ranked, s[first] - self.threshold, side="right")
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out.append(base + np.sort(np.repeat(first, count) * self.words + order[within]))
        return out


def _units(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    # scaled first: squares of very large or small components must not leave the range of doubles
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _code_rows(codes: dict[int, Code]):
    """Lists the filters of vectors of several lengths; each length has numbers of its own."""
    base = dict(zip(codes, np.cumsum([0, *(c.filters for c in codes.values())]).tolist(), strict=False))

    def run(batches):
        books = {d: code.books() for d, code in codes.items()}
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                lists = [x + base[d] for x in codes[d].decode(_units(part.column(2)), books[d])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lists, pa.list_(pa.int64()))], ["node", "copies", "vec", "filters"])

    return run


def _compare(filter_no: int, ids, copies, unit, lists, block) -> tuple | None:
    """(members with links, links by copies, smallest member joined) among the rows of one filter and pair of blocks."""
    near = unit @ unit.T >= MIN_COSINE
    np.fill_diagonal(near, False)
    if (pairs := across(block)) is not None:
        near &= pairs
    if not near.any():
        return None
    some = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(some, some)]
    # pairs that already share a filter of a lower number are counted there
    low = [x[x < filter_no] for x in (lists[i] for i in some)]
    flat = np.concatenate(low)
    if len(flat):
        names, code = np.unique(flat, return_inverse=True)
        has = np.zeros((len(some), len(names)), np.float32)
        has[np.repeat(np.arange(len(some)), [len(x) for x in low]), code] = 1
        near &= (has @ has.T) == 0
    links = near @ copies[some]
    label = least_joined(ids[some], near)
    own = links > 0
    return (ids[some][own], links[own], label[own]) if own.any() else None


def _link_rows(batches):
    """Rows sorted by filter and blocks in, (vec_id, links, joined) out."""
    for tab, spans in pieces(batches, "filter"):
        number, ids, copies, block = (tab.column(c).to_numpy() for c in ("filter", "node", "copies", "block"))
        vectors, col = tab.column("vec").combine_chunks(), tab.column("filters").combine_chunks()
        flat, offsets = col.flatten().to_numpy(), col.offsets.to_numpy()
        offsets = offsets - offsets[0]
        found = []
        for a, b in spans:
            if b - a > 1 and (got := _compare(int(number[a]), ids[a:b], copies[a:b], _units(vectors.slice(a, b - a)), [flat[offsets[i] : offsets[i + 1]] for i in range(a, b)], block[a:b])):
                found.append(got)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["node", "links", "joined"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors are linked at a cosine of 0.95 or more with others of their length.
    Null, empty and zero vectors, those with null or non-finite components or
    without id link with nothing (component: the row's own id).  Equal vectors
    are one class; each of its rows counts the others.  Rows of one id and
    different vectors are linked each for itself.  Components hold the smallest id
    reachable, which stays.  Extra columns are ignored; an empty table gives an
    empty result.

    A filter that very many vectors share is cut into blocks, and each pair of
    blocks is a piece of work of bounded size.  The driver fits one code for each
    length that occurs twice, from the number of its vectors.
    """
    ws = Workspace(vectors.sparkSession)
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    heads = sound.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    heads = ws.save(heads.select(F.monotonically_increasing_id().alias("node"), "vec_id", "copies", "vec"), "heads")
    lengths = {r.d: r["count"] for r in heads.groupBy(F.size("vec").alias("d")).count().collect()}
    codes = {d: Code.fit(n, d) for d, n in sorted(lengths.items()) if n > 1}
    kind = dict(rows.dtypes)["vec"]
    coded = heads.where(F.size("vec").isin(*codes)).select("node", "copies", "vec")
    listed = ws.save(coded.mapInArrow(_code_rows(codes), f"node long, copies long, vec {kind}, filters array<long>"), "listed")
    light = paired_blocks(ws, listed.select("node", F.explode("filters").alias("filter")), "filter", "node", BLOCK)
    work = light.join(listed, "node").select("filter", "p", "q", "block", "node", "copies", "vec", "filters")
    work = work.repartition("filter", "p", "q").sortWithinPartitions("filter", "p", "q")
    found = ws.save(work.mapInArrow(_link_rows, "node long, links long, joined long"), "links")
    parts = components(ws, found.select(F.col("node").alias("a"), F.col("joined").alias("b")))
    parts = parts.join(heads.select("node", "vec_id"), "node")
    least = parts.groupBy("component").agg(F.min("vec_id").alias("least"))
    parts = ws.save(parts.join(least, "component").select("node", "least"), "parts")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = heads.join(counts, "node", "left").join(parts, "node", "left")
    of = ws.save(of.select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "vec_id").alias("component")), "classes")
    sound_id = F.when(F.col("vec_id").isNotNull(), v)
    out = rows.withColumn("vec", sound_id).join(of, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
