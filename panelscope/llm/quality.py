"""Text quality: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Each word gives a surface token (its bytes, A-Z lower-cased) and a form token
(case, length class, symbols at its end, whether it repeats the word before).
Features are the surface tokens' 1- and 2-grams and the form tokens' 1-, 2- and
3-grams, hashed to DIMENSIONS; a feature's value is its share of the document's
n-grams of its family, times SCALE.  A score is the sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import small_batches

DIMENSIONS = 1 << 18
SCALE = 8.0
#: Bound on the labelled rows that the model is fitted on, chosen by a hash of the id.
TRAIN_ROWS = 8000
PASSES = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
CUT = 0.3

_UP, _LOW, _DIGIT, _HIGH, _SYMBOL = (np.zeros(256, np.int32) for _ in range(5))
_UP[65:91] = 1
_LOW[97:123] = 1
_DIGIT[48:58] = 1
_HIGH[128:] = 1
_SYMBOL[[i for i in range(33, 127) if not chr(i).isalnum()]] = 1


def _forms(words: textscan.Words, raw: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A small number for the form of each word."""
    start, end = words.start, words.end
    size = end - start
    count = lambda table: (lambda c: c[end] - c[start])(np.concatenate(([0], np.cumsum(table[raw], dtype=np.int64))))
    up, low, digit, high, symbol = (count(t) for t in (_UP, _LOW, _DIGIT, _HIGH, _SYMBOL))
    kind = np.select([(up > 0) & (low == 0) & (size > 1), (up > 0) & (low > 0), low + high > 0, digit > 0], [1, 2, 3, 4], 5)
    # in scripts with letters of two bytes and more, case is told from the ASCII letters alone
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (np.diff(words.owner()) == 0)
    last = np.where(symbol > 0, raw[np.maximum(end - 1, 0)], 0) * (_SYMBOL[raw[np.maximum(end - 1, 0)]] > 0)
    length = np.minimum(size // 6, 4)
    return ((((kind * 5 + length) * 4 + np.minimum(symbol, 3)) * 3 + (digit > 0) + (digit == size)) * 2 + same) * 256 + last


def features(raw_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of every n-gram occurrence of encoded texts; texts in order."""
    raw = textscan.scan(raw_texts)
    lower = textscan.Words(textscan._LOWER[raw.data], raw.start, raw.end, raw.first, raw.text_start)
    h = lower.hashes()
    form = textscan.mix(_forms(raw, raw.data, h).astype(np.uint64) + np.uint64(1 << 40)) if len(h) else h
    owners, names, values = [], [], []
    for stream, n in ((h, 1), (h, 2), (form, 1), (form, 2), (form, 3)):
        at, owner = textscan.gram_owner(raw, n)
        if not len(at):
            continue
        g = textscan.grams(stream, n, 0xB492B66FBE98F273 if stream is form else 0x9FB21C651E98DF25)[at]
        owners.append(owner)
        names.append((g >> np.uint64(64 - 18)).astype(np.int64))
        values.append(SCALE / np.bincount(owner, minlength=len(raw_texts))[owner])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(owners), np.concatenate(names), np.concatenate(values)


def _sparse_rows(batches):
    """(place, label, features, values) of training documents."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for first, raw in textscan.blocks(texts):
            owner, name, value = features(raw)
            key, inverse = np.unique(owner * DIMENSIONS + name, return_inverse=True)
            total = np.bincount(inverse, value, len(key)) if len(key) else np.empty(0)
            cut = np.searchsorted(key // DIMENSIONS, np.arange(1, len(raw)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(raw)), batch.column(2).slice(first, len(raw)), pa.array([x.astype("<i4").tobytes() for x in np.split(key % DIMENSIONS, cut)], pa.binary()), pa.array([x.astype("<f4").tobytes() for x in np.split(total, cut)], pa.binary())],
                ["place", "label", "names", "counts"],
            )


def _ftrl(batches):
    """One pass over the batches collects the bounded sample; PASSES passes fit it. One row out: bias and weights."""
    rows = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    data = [(y, np.append(np.frombuffer(i, "<i4"), DIMENSIONS), np.append(np.frombuffer(v, "<f4"), np.float32(1))) for y, i, v in rows]
    for _ in range(PASSES):
        for y, i, v in data:
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            new = ni + g * g
            z[i] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / ALPHA * w
            n[i] = new
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    yield pa.RecordBatch.from_arrays([pa.array([float(w[-1])]), pa.array([w[:-1].astype("<f4").tobytes()], pa.binary())], ["bias", "weights"])


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that no model learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, text, label) of about `rows` labelled documents outside the held-out fifth, drawn by a hash of the id.

    Ids with two labels take the larger one; null labels and ids are skipped.  Of
    rows of one id, one is taken, by a hash of its text.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).dropna().where(~held_out("_id")).groupBy("_id").agg(F.max("label").alias("label"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col("_id")), 2)
    total = known.count()
    if total > rows:
        known = known.where(place < int(2**62 * rows / total))
    # bounded: about `rows` rows of two numbers
    drawn = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "_id")
    return drawn.groupBy(place.alias("place"), "label").agg(F.max_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("place", "text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, **columns) -> tuple[float, np.ndarray]:
    """(bias, weights) fitted on a bounded sample: its features are made in parallel, the learner runs over them in one task."""
    sparse = train_sample(docs, labels, label, rows, **columns).mapInArrow(_sparse_rows, "place long, label int, names binary, counts binary")
    got = sparse.repartition(1).sortWithinPartitions("place", "names").mapInArrow(_ftrl, "bias double, weights binary").first()
    if got is None:
        return 0.0, np.zeros(DIMENSIONS, np.float32)
    return got.bias, np.frombuffer(got.weights, "<f4")


def score(docs: DataFrame, model: tuple[float, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row of docs.

    Null and empty texts have no features: their score is that of the bias.  A
    null id is not held out.  Rows of one id are scored one by one.
    """
    small_batches(docs.sparkSession)
    bias, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # DIMENSIONS numbers, whatever the input

    def run(batches):
        w = shared.value.astype(np.float64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, raw in textscan.blocks(texts):
                owner, name, value = features(raw)
                total = np.bincount(owner, w[name] * value, len(raw)) if len(owner) else np.zeros(len(raw))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), pa.array(1 / (1 + np.exp(-np.clip(total + bias, -35, 35))))], ["doc_id", "score"])

    kind = docs.select(F.col(id_col)).dtypes[0][1]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: tuple[float, np.ndarray], id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs without the rows that score below cut; all columns stay, no row is shuffled."""
    small_batches(docs.sparkSession)
    bias, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text_col)

    def run(batches):
        w = shared.value.astype(np.float64)
        for batch in batches:
            keep = []
            for _, raw in textscan.blocks(batch.column(place).to_pylist()):
                owner, name, value = features(raw)
                total = np.bincount(owner, w[name] * value, len(raw)) if len(owner) else np.zeros(len(raw))
                keep.append(1 / (1 + np.exp(-np.clip(total + bias, -35, 35))) >= cut)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
