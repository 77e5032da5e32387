"""Near-duplicate documents: HyperMinHash sketches, banding, corrected estimates, exact verification.

One hash of each shingle deals it to one of REGISTERS buckets; a register holds,
for the least hash of its bucket, the leading-zero count (6 bits) and the
MANTISSA bits that follow the first one bit.  A bucket without shingles takes
the register of another one, by an order of its own, so that small sets are
found as surely as large ones.  Equal registers of different hashes happen with
a small known probability, for which estimates are corrected.

Documents of one word sequence (by SHA-256) are one class from the start.  In a
band's bucket all members are compared with one pivot, chosen at random for each
bucket, so that candidates grow with the members and not with their square.
Links are verified on the words of both documents, those with the best estimates
of each document first, and contracted to components.  Members of one bucket
whose components still differ are then compared with each other, in pieces of
bounded size and inside tasks: first by sketches, to find the documents that may
have a link left, then by their words.  Tasks return what each document is joined
to, not pairs.  No link rests on hashes alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textscan
from .blocks import across, least_joined, paired_blocks, pieces
from .common import Workspace, ascii_lower, drop_rows
from .components import components

SHINGLE_WORDS = 5
REGISTERS, BAND_ROWS, MANTISSA = 128, 4, 10
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Estimates below the threshold by more than five standard errors are not verified.
LEAST_ESTIMATE = THRESHOLD / 100 - 5.2 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Pairs of each document that are verified before its bucket's other members are looked at.
FIRST_PAIRS = 2
#: Members of a bucket that are compared in one task at once.
BLOCK = 1024
#: Narrow rows that a text counts for in the size of a file.
TEXT_ROWS = 20
#: Up to this number of ids are broadcast to find their texts; more are joined.
BROADCAST_IDS = 200_000

_BUCKET_BITS = np.uint64(64 - REGISTERS.bit_length() + 1)
#: For each register, the order in which it looks for a bucket to borrow from.
_BORROW = np.random.default_rng(20240501).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)


def shingle_sets(words: textscan.Words) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; fewer words make one shingle, none an empty set."""
    h = words.hashes()
    g = textscan.grams(h, SHINGLE_WORDS)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE_WORDS:
            out.append(np.unique(g[a : b - SHINGLE_WORDS + 1]))
        else:
            out.append(textscan.grams(h[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def exact_sets(bodies: list[bytes]) -> list[np.ndarray]:
    """The shingles of word sequences as numbers that stand for the words themselves (comparable within one call), after the number of words of each."""
    words = textscan.scan(bodies)
    code = words.codes()
    g, short = textscan.exact_grams(code, SHINGLE_WORDS), {}
    out = []
    for body, a, b in zip(bodies, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE_WORDS:
            out.append(np.unique(g[a : b - SHINGLE_WORDS + 1]))
        else:
            out.append(np.array([short.setdefault(body, len(short))] if b > a else [], np.uint64))
    # the first number tells short sequences and shingles apart
    return [np.concatenate(([np.uint64(min(n, SHINGLE_WORDS))], s)) if len(s) else s for n, s in zip(words.counts.tolist(), out, strict=True)]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (uint16), one row per set of sorted hashes; rows of empty sets mean nothing."""
    owner, g = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.empty(0, np.uint64)])
    bucket = (g >> _BUCKET_BITS).astype(np.int64)
    at = owner * REGISTERS + bucket
    least = np.flatnonzero(np.concatenate((at[:1] >= 0, at[1:] != at[:-1])))  # the first of a bucket is its least
    value = g[least] << (np.uint64(64) - _BUCKET_BITS)
    zeros = np.clip(63 - np.floor(np.log2(np.maximum(value, 1).astype(np.float64))), 0, 63).astype(np.uint64)
    tail = (value << zeros) << np.uint64(1)
    out, filled = np.zeros((len(sets), REGISTERS), np.uint16), np.zeros((len(sets), REGISTERS), bool)
    out.reshape(-1)[at[least]] = ((zeros << np.uint64(MANTISSA)) | (tail >> np.uint64(64 - MANTISSA))).astype(np.uint16)
    filled.reshape(-1)[at[least]] = True
    row, register = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for k in range(REGISTERS):
        if not len(row):
            break
        source = _BORROW[register, k]
        has = filled[row, source]
        out[row[has], register[has]] = out[row[has], source[has]]
        row, register = row[~has], register[~has]
    return out


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, less the chance collisions of sets of n and m."""
    chance = 0.72 * 2.0**-MANTISSA * n * m / (n + m) ** 2
    return (equal - chance) / (1 - chance)


def _sketch_rows(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for first, raw in textscan.blocks(texts):
            words = textscan.scan(raw, lower=True)
            sets = shingle_sets(words)
            digests = [hashlib.sha256(x).digest() for x in words.sequences()]
            registers = [r.tobytes() if len(s) else None for r, s in zip(sketches(sets), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n_shingles", "seq", "registers"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _band_rows(batches):
    for batch in batches:
        if not len(batch):
            continue
        r = _matrix(batch.column(1)).astype(np.uint64).reshape(len(batch), -1, BAND_ROWS)
        packed = r[:, :, 0]
        for k in range(1, BAND_ROWS):
            packed = (packed << np.uint64(16)) | r[:, :, k]
        with np.errstate(over="ignore"):
            key = textscan.mix(packed + textscan.mix(np.arange(packed.shape[1], dtype=np.uint64) + np.uint64(7)))
        ids = np.repeat(batch.column(0).to_numpy(), key.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], ["bucket", "node"])


def _estimate_rows(batches):
    for batch in batches:
        if not len(batch):
            continue
        equal = (_matrix(batch.column(4)) == _matrix(batch.column(5))).mean(axis=1)
        got = estimate(equal, batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], ["a", "b", "score"])


def _sequence_rows(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for first, raw in textscan.blocks(texts):
            bodies = textscan.scan(raw, lower=True).sequences()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary()), pa.array(bodies, pa.binary())], ["doc_id", "seq", "body"])


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x[1:], y[1:], assume_unique=True)) if x[0] == y[0] else 0
    return 100 * both >= THRESHOLD * (len(x) + len(y) - 2 - both)


def _verify_rows(batches):
    """(a, b, linked) by the shingle sets of both documents' words, for as many pairs at once as share a block of text."""
    for batch in batches:
        pairs, place, size, ok = [], {}, 0, []

        def settle():
            sets = exact_sets(list(place))
            ok.extend(_linked(sets[i], sets[j]) for i, j in pairs)
            pairs.clear()
            place.clear()

        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            ends = []
            for v in (x.as_py(), y.as_py()):
                if v not in place:
                    size += len(v)
                ends.append(place.setdefault(v, len(place)))
            pairs.append(ends)
            if size > textscan.BLOCK_BYTES:
                settle()
                size = 0
        settle()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "linked"])
    textscan.release()


def _hopeful_rows(batches):
    """The rows of each piece that may be linked to one of another component, by sizes and estimates.

    A pair counts in the least bucket that both documents share, so that few
    buckets need a document's full set.
    """
    for tab, spans in pieces(batches, "bucket"):
        part, n, block = (tab.column(c).to_numpy() for c in ("part", "n_shingles", "block"))
        r, keep = _matrix(tab.column("registers")), np.zeros(len(tab), bool)
        number, col = tab.column("bucket").to_numpy(), tab.column("buckets").combine_chunks()
        flat, offsets = col.flatten().to_numpy(), col.offsets.to_numpy()
        offsets = offsets - offsets[0]
        for a, b in spans:
            open_ = part[a:b, None] != part[None, a:b]
            if (pairs := across(block[a:b])) is not None:
                open_ &= pairs
            size = n[a:b].astype(float)
            open_ &= 100 * np.minimum(size[:, None], size) >= THRESHOLD * np.maximum(size[:, None], size)
            low = [x[x < number[a]] for x in (flat[offsets[i] : offsets[i + 1]] for i in range(a, b))]
            names, code, count = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
            if (count > 1).any():
                row, use = np.repeat(np.arange(b - a), [len(x) for x in low]), count[code] > 1
                row, code = row[use], (np.cumsum(count > 1) - 1)[code[use]]
                order = np.argsort(code, kind="stable")
                row, code = row[order], code[order]
                for at in range(0, int(code[-1]) + 1, 2048):
                    lo, hi = np.searchsorted(code, (at, at + 2048))
                    has = np.zeros((b - a, 2048), np.float32)
                    has[row[lo:hi], code[lo:hi] - at] = 1
                    open_ &= (has @ has.T) == 0
            for i in np.flatnonzero(open_.any(axis=1)):
                j = np.flatnonzero(open_[i])
                equal = (r[a + j] == r[a + i]).mean(axis=1)
                keep[a + i] = bool((estimate(equal, size[i], size[j]) >= LEAST_ESTIMATE).any())
        yield from tab.select(["bucket", "p", "q", "block", "node", "part"]).filter(pa.array(keep)).to_batches()


def _joined_rows(batches):
    """(a, b): documents of each piece with the smallest one that their words join them to across components."""
    for tab, spans in pieces(batches, "bucket"):
        ids, part, block = (tab.column(c).to_numpy() for c in ("node", "part", "block"))
        raw = tab.column("body").to_pylist()
        left, right = [], []
        for a, b in spans:
            open_ = part[a:b, None] != part[None, a:b]
            if (pairs := across(block[a:b])) is not None:
                open_ &= pairs
            if not open_.any():
                continue
            sets = exact_sets(raw[a:b])
            kind, sets = np.array([s[0] for s in sets]), [s[1:] for s in sets]
            open_ &= kind[:, None] == kind[None, :]
            size = np.array([len(x) for x in sets])
            row = np.repeat(np.arange(b - a), size)
            names, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            use = count[code] > 1
            row, code = row[use], (np.cumsum(count > 1) - 1)[code[use]]
            order = np.argsort(code, kind="stable")
            row, code = row[order], code[order]
            both = np.zeros((b - a, b - a), np.float32)
            for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
                lo, hi = np.searchsorted(code, (at, at + 4096))
                has = np.zeros((b - a, 4096), np.float32)
                has[row[lo:hi], code[lo:hi] - at] = 1
                both += has @ has.T
            inner = both.astype(np.int64)
            near = open_ & (100 * inner >= THRESHOLD * (size[:, None] + size - inner))
            if near.any():
                some = np.flatnonzero(near.any(axis=1))
                left.append(ids[a:b][some])
                right.append(least_joined(ids[a:b][some], near[np.ix_(some, some)]))
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def _score(ws: Workspace, pairs: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) whose corrected estimate and sizes leave a link possible, with the estimate."""
    side = lambda end, n, r: nodes.select(F.col("node").alias(end), F.col("n_shingles").alias(n), F.col("registers").alias(r))
    both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").where(100 * F.least("n", "m") >= THRESHOLD * F.greatest("n", "m"))
    return ws.save(both.select("a", "b", "n", "m", "x", "y").mapInArrow(_estimate_rows, "a long, b long, score double").where(F.col("score") >= LEAST_ESTIMATE), "scored", rows=rows)


def _bodies_of(ws: Workspace, texts: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """(node, body): the word sequences of the listed nodes (node, head, seq); texts are shuffled only if the list is too long to broadcast."""
    nodes = ws.save(nodes.select("node", F.col("head").alias("doc_id"), "seq"), "listed", rows=rows)
    listed = nodes.count()
    list_ = F.broadcast(nodes) if listed <= BROADCAST_IDS else nodes
    found = texts.join(list_.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sequence_rows, "doc_id long, seq binary, body binary")
    return ws.save(found.join(list_, ["doc_id", "seq"]).select("node", "body").dropDuplicates(["node"]), "bodies", rows=listed * TEXT_ROWS)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, seq (SHA-256 of its word sequence).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; documents are linked
    when 100 * intersection >= 75 * union of their sets of 5-word shingles.  Null
    and empty texts are linked with nothing.  Of each component the smallest id
    stays.  Rows of one id with unlike texts are told apart and linked, or not,
    each by its own text; rows without id stay alone, with a null component, and
    are not kept.  Extra columns are ignored; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = ws.save(texts.mapInArrow(_sketch_rows, "doc_id long, n_shingles long, seq binary, registers binary"), "sketches")
    filled = every.where("doc_id is not null and n_shingles > 0")
    # a node is a word sequence; sets and sketches of its documents are the same
    alike = filled.groupBy("seq").agg(F.min("doc_id").alias("head"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    nodes = ws.save(alike.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()  # of the written files
    bands = nodes.select("node", "registers").mapInArrow(_band_rows, "bucket long, node long")
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "bucket")).alias("pivot")).where("n > 1")
    members = ws.save(bands.join(buckets, "bucket"), "members", rows=n * REGISTERS // BAND_ROWS)
    n_members = members.count()
    pairs = members.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()

    scored = _score(ws, pairs, nodes, n_members)
    ends = scored.select("a", "b", "score", F.explode(F.array("a", "b")).alias("end"))
    # ranks are cut off before rows are dealt, so a pivot of very many pairs sends few
    rank = F.row_number().over(W.partitionBy("end").orderBy(F.desc("score"), "a", "b"))
    best = ws.save(ends.withColumn("rank", rank).where(F.col("rank") <= FIRST_PAIRS).select("a", "b").distinct(), "best", rows=FIRST_PAIRS * n)
    bodies = _bodies_of(ws, texts, nodes.join(best.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), n)
    side = lambda end, s: bodies.select(F.col("node").alias(end), F.col("body").alias(s))
    done = ws.save(best.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_verify_rows, "a long, b long, linked boolean"), "verified", rows=best.count() * TEXT_ROWS)
    ws.drop(bodies)
    parts = components(ws, done.where("linked"))

    # every pair of one bucket whose components still differ and that was not verified yet
    with_part = members.join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
    split = with_part.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("bucket")
    rest = ws.save(with_part.join(split, "bucket"), "rest", rows=n_members)
    sorted_ = lambda df: df.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    listed = nodes.join(rest.groupBy("node").agg(F.collect_list("bucket").alias("buckets")), "node")
    placed = paired_blocks(ws, rest, "bucket", "node", BLOCK).join(listed, "node").select("bucket", "p", "q", "block", "node", "part", "n_shingles", "registers", "buckets")
    hopeful = ws.save(sorted_(placed).mapInArrow(_hopeful_rows, "bucket long, p long, q long, block long, node long, part long"), "hopeful")
    bodies = _bodies_of(ws, texts, nodes.join(hopeful.select("node").distinct(), "node", "left_semi"), n)
    late = ws.save(sorted_(hopeful.join(bodies, "node")).select("bucket", "p", "q", "block", "node", "part", "body").mapInArrow(_joined_rows, "a long, b long"), "late")
    ws.drop(bodies)
    # the components found before are stars, so that they contract at once
    parts = components(ws, parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late.select("a", "b")))

    least = nodes.join(parts, "node").groupBy("component").agg(F.min("head").alias("least"))
    linked = ws.save(nodes.join(parts, "node").join(least, "component").select("seq", "least"), "linked", rows=n)
    of = nodes.join(linked, "seq", "left").select("seq", F.coalesce("least", "head").alias("of"))
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("seq"))
    out = every.withColumn("own", own).join(ws.save(of.withColumnRenamed("seq", "own"), "components", rows=n), "own", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("of", "doc_id").alias("component_id"), "seq")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "seq")


def sequence_digest(text_col: str = "text") -> Column:
    """seq of near_groups, of a column."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(ascii_lower(text_col), r"[\x20\x09-\x0D]+", " ")), 256))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group; all columns stay.

    Where rows of one id have unlike texts, each row is kept or dropped by its own text.
    Rows without id stay, as nothing tells which of them to drop.
    """
    marks = near_groups(docs, id_col, text_col).where("doc_id is not null").select("doc_id", F.col("seq").alias("text_key"), "kept")
    return drop_rows(docs, marks, id_col, sequence_digest(text_col))
