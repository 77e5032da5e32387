"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Lexicons of words and of word beginnings are learnt from one part of a bounded
labelled sample, the trees (MLlib) from a second part and the calibration
(isotonic regression, MLlib) from a third.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import Workspace, small_batches
from .quality import held_out, train_sample

#: Bounds on the labelled sample, drawn by a hash of the id, and on the lexicons.
TRAIN_ROWS = 10_000
LEXICON_ENTRIES = 1500
MIN_DOCS, MIN_LOG_ODDS = 3, 2.5
TREES, DEPTH, STEP = 15, 3, 0.3
PREFIX_BYTES = 4
NEAR_WORDS = 6
CUT = 0.5

#: Pronouns of the second person in the languages of the corpus.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "deinen", "ihr", "euch", "usted", "ustedes", "ti", "tus", "su", "sus", "vosotros"]
FEATURES = ["word_density", "word_hits", "word_best", "word_sum", "start_density", "start_hits", "start_best", "second_person", "near_second_person", "capitals", "punctuation", "exclaims", "obfuscated", "digits", "log_words"]

#: Bytes of a token: letters, digits, bytes of other scripts and the signs that stand in for letters.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b"@$*"]] = True
_CLASS = {name: np.zeros(256, np.int64) for name in ("up", "letter", "sign", "digit", "mark", "shout")}
_CLASS["up"][65:91] = 1
_CLASS["letter"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS["digit"][48:58] = 1
_CLASS["sign"][[*range(48, 58), *b"@$*"]] = 1
_CLASS["mark"][[i for i in range(33, 127) if not chr(i).isalnum()]] = 1
_CLASS["shout"][33] = 1


def _tokens(raw: list[bytes]):
    """(words, hashes, hashes of the beginnings, or 0 for short tokens, original bytes)."""
    words = textscan.scan(raw, table=_TOKEN)
    original = words.data
    words.data = textscan._LOWER[original]
    h = words.hashes()
    size = words.end - words.start
    start = np.zeros(len(h), np.uint64)
    for k in range(PREFIX_BYTES):
        start = (start << np.uint64(8)) | words.data[np.minimum(words.start + k, len(words.data) - 1)].astype(np.uint64)
    start = np.where(size > PREFIX_BYTES, textscan.mix(start + np.uint64(1 << 60)), np.uint64(0))
    return words, h, start, original


_YOU = np.sort(np.array([textscan.scan([w.encode()]).hashes()[0] for w in SECOND_PERSON], np.uint64))


def _lexicon_rows(batches):
    """Distinct (label, kind, hash) of each labelled text; kind 0 is a word, 1 a beginning."""
    for batch in batches:
        labels = batch.column(2).to_numpy()
        for first, raw in textscan.blocks(batch.column(1).to_pylist()):
            words, h, start, _ = _tokens(raw)
            owner = words.owner()
            for kind, values in ((0, h), (1, start)):
                use = values != 0
                o, v = owner[use], values[use]
                order = np.lexsort((v, o))
                o, v = o[order], v[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
                o, v = o[new], v[new]
                yield pa.RecordBatch.from_arrays([pa.array(labels[first + o].astype(np.int32)), pa.array(np.full(len(o), kind, np.int32)), pa.array(v.view(np.int64))], ["label", "kind", "entry"])


@dataclass
class Lexicon:
    """Sorted hashes with their log odds, for words and for beginnings."""

    words: np.ndarray
    word_odds: np.ndarray
    starts: np.ndarray
    start_odds: np.ndarray


def learn_lexicon(sample: DataFrame, entries: int = LEXICON_ENTRIES) -> Lexicon:
    """The words and beginnings that tell toxic from other documents best, at most `entries` of either kind."""
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}  # two rows
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    seen = sample.mapInArrow(_lexicon_rows, "label int, kind int, entry long").groupBy("kind", "entry").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    best = seen.where(F.col("t") >= MIN_DOCS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    out = []
    for kind in (0, 1):
        rows = best.where(F.col("kind") == kind).orderBy(F.desc(F.col("t") * F.col("odds")), "entry").limit(entries).collect()
        got = sorted((r.entry & 0xFFFFFFFFFFFFFFFF, r.odds) for r in rows)
        out += [np.array([e for e, _ in got], np.uint64), np.array([o for _, o in got], np.float64)]
    return Lexicon(*out)


def _lookup(values: np.ndarray, known: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Log odds of each value, 0 if it is not in the lexicon."""
    if not len(known) or not len(values):
        return np.zeros(len(values))
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, odds[at], 0.0)


def dense(raw: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per encoded text."""
    words, h, start, original = _tokens(raw)
    n = len(raw)
    owner, count = words.owner(), words.counts
    per_word = 1 / np.maximum(count, 1)
    total = lambda x: np.bincount(owner, x, n)

    def most(x):
        out = np.zeros(n)
        np.maximum.at(out, owner, x)
        return out

    w, s = _lookup(h, lexicon.words, lexicon.word_odds), _lookup(start, lexicon.starts, lexicon.start_odds)
    you = np.isin(h, _YOU)
    # words of the same text within NEAR_WORDS of a pronoun
    run = np.concatenate(([0], np.cumsum(you)))
    place = np.arange(len(h))
    low, high = np.maximum(place - NEAR_WORDS, words.first[owner]), np.minimum(place + NEAR_WORDS + 1, words.first[owner + 1])
    near = (run[high] - run[low]) > 0
    byte_counts = {k: np.concatenate(([0], np.cumsum(t[original]))) for k, t in _CLASS.items()}
    of_text = lambda k: (byte_counts[k][words.text_start[1:] - 1] - byte_counts[k][words.text_start[:-1]]).astype(float)
    of_word = lambda k: byte_counts[k][words.end] - byte_counts[k][words.start]
    size = np.maximum(np.diff(words.text_start) - 1, 1)
    # signs or digits between letters
    inner = (of_word("sign") > 0) & (of_word("letter") > 1) & (_CLASS["letter"][original[words.start]] > 0) if len(h) else np.zeros(0, bool)
    hits, starts = (w > 0).astype(float), (s > 0).astype(float)
    return np.column_stack([
        total(hits) * per_word, total(hits), most(w), total(w), total(starts) * per_word, total(starts), most(s), total(you) * per_word, total((hits + starts > 0) & near),
        of_text("up") / np.maximum(of_text("letter"), 1), of_text("mark") / size, of_text("shout") / size, total(inner) * per_word, of_text("digit") / size, np.log1p(count),
    ])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    prior: float


def _dense_frame(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns `keep` and `features`, a vector, of docs (text, ...)."""
    # bounded by LEXICON_ENTRIES; plain arrays, as broadcasts are not pickled by value
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.word_odds, lexicon.starts, lexicon.start_odds))

    def run(batches):
        for batch in batches:
            for first, raw in textscan.blocks(batch.column(0).to_pylist()):
                x = dense(raw, Lexicon(*shared.value))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(first, len(raw)) for k in range(len(keep))), flat], [*keep, "dense"])

    kinds = dict(docs.dtypes)
    out = docs.select("text", *keep).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "dense array<double>"]))
    return out.select(*keep, array_to_vector("dense").alias("features"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, **columns) -> ToxicityModel:
    """Fit lexicons, trees and calibration on a bounded labelled sample; one label alone gives its constant share."""
    ws = Workspace(docs.sparkSession)
    sample = ws.save(train_sample(docs, labels, label, rows, **columns).withColumn("part", F.col("place") % 10), "sample")
    share = {(r.label, r.third): r["count"] for r in sample.groupBy("label", F.when(F.col("part") < 4, 0).when(F.col("part") < 8, 1).otherwise(2).alias("third")).count().collect()}
    whole = sum(share.values())
    prior = sum(v for (y, _), v in share.items() if y == 1) / whole if whole else 0.0
    lexicon = learn_lexicon(sample.where("part < 4"))
    if not all(share.get((y, 1)) for y in (0, 1)):
        return ToxicityModel(lexicon, None, None, prior)
    dense_rows = ws.save(_dense_frame(sample.where("part >= 4").withColumn("y", F.col("label").cast("double")), lexicon, ["place", "part", "y"]), "dense")
    fitted = dense_rows.where("part < 8").orderBy("place").coalesce(2)
    trees = GBTClassifier(labelCol="y", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=7, cacheNodeIds=False, checkpointInterval=-1).fit(fitted)
    held = trees.transform(dense_rows.where("part >= 8")).select("y", vector_to_array("probability")[1].alias("p"))
    steps = None
    if all(share.get((y, 2)) for y in (0, 1)):
        steps = IsotonicRegression(labelCol="y", featuresCol="p").fit(held)
    return ToxicityModel(lexicon, trees, steps, prior)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row of docs.

    The score is the calibrated probability with a thousandth of the raw one, so
    that documents on one calibration step keep the trees' order.  Null and
    empty texts are scored by features of zero; a null id is not held out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model.trees is None:
        out = rows.select("doc_id", F.lit(float(model.prior)).alias("score"))
    else:
        raw = model.trees.transform(_dense_frame(rows, model.lexicon, ["doc_id"])).select("doc_id", vector_to_array("probability")[1].alias("p"))
        if model.steps is None:
            out = raw.select("doc_id", F.col("p").alias("score"))
        else:
            out = model.steps.transform(raw).select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("prediction") + 0.001 * F.col("p"))).alias("score"))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
