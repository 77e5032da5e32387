"""Substring deduplication by a log-structured fingerprint index.

Two texts that share WINDOW words in a row share the least of the hashes of the
ANCHOR-word sequences inside that window, its anchor.  The index keeps sorted,
immutable runs on the shared folder, in three levels:

* document runs: 128 bits of the SHA-256 of a whole word sequence, with the first
  document that has it; a copy of an earlier document is removed whole;
* anchor runs: anchor, least and greatest print of the documents it stands in;
* window runs: 128-bit fingerprint of each whole window whose anchor stands in
  documents that differ, with the first document it starts in.

Runs are bucketed by hash and sorted within their buckets, one file each, so Spark
merge-joins a new batch with them bucket by bucket: only the batch is shuffled and
sorted, never the history.  The windows of documents that share an anchor, in the
batch or before it, are then verified by their whole window fingerprints.  Runs are
compacted when there are more than MAX_RUNS; that alone shuffles them.  A manifest
in the index's folder lists the runs, so that a later session can go on.

Words enter fingerprints as two values of a keyed pseudo-random function of their
bytes (SipHash, two secret keys per index, drawn when it is made), which a window
adds up with odd weights.  For whatever windows, the chance that any two unlike
ones of n are taken for equal is therefore below n * n / 2**120, so windows are
verified by these 128 bits and their words need not be shipped.
"""

from __future__ import annotations

import hashlib
import json
import secrets
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .common import Workspace, children, shared_folder

WINDOW, ANCHOR = 13, 5
MAX_RUNS = 2
BATCHES = 3
Keys = tuple[tuple[int, int], tuple[int, int]]


def new_keys() -> Keys:
    one, two, three, four = (secrets.randbits(64) for _ in range(4))
    return (one, two), (three, four)


def _window_anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of each WINDOW-word window of a row of word hashes."""
    g = textscan.grams(h, ANCHOR, 0x8EBC6AF09C88C6E3)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = g[:n].copy()
    for k in range(1, WINDOW - ANCHOR + 1):
        np.minimum(least, g[k : k + n], out=least)
    return least


def _windows(raw: list[bytes], keys: Keys):
    """(words, their first keyed hashes, window positions, their texts, their anchors) of encoded texts."""
    words = textscan.scan(raw)
    h = words.prf(keys[0])
    at, owner = textscan.gram_owner(words, WINDOW)
    least = _window_anchors(h)
    return words, h, at, owner, least[at] if len(at) else np.empty(0, np.uint64)


def _prints(words: textscan.Words) -> np.ndarray:
    """Two 64-bit halves of a digest of the whole word sequence of each text."""
    return np.frombuffer(b"".join(hashlib.sha256(x).digest()[:16] for x in words.sequences()), np.int64).reshape(-1, 2)


def _fingerprints(words: textscan.Words, h: np.ndarray, at: np.ndarray, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the fingerprints of the windows that start at the given words."""
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return textscan.grams(h, WINDOW)[at], textscan.grams(words.prf(keys[1]), WINDOW, 0xC6BC279692B5C323)[at]


def _anchor_rows(keys: Keys):
    """Two kinds of rows: (anchor, print) without id, and (second print, print, doc_id) of each text of WINDOW words at least."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for first, raw in textscan.blocks(texts):
                words, _, _, owner, least = _windows(raw, keys)
                prints = _prints(words)
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                full = np.flatnonzero(words.counts >= WINDOW)
                anchors = np.concatenate((least[new].view(np.int64), prints[full, 1]))
                docs = np.concatenate((np.zeros(int(new.sum()), np.int64), ids[first + full].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(np.concatenate((prints[owner[new], 0], prints[full, 0]))), pa.array(docs, mask=np.arange(len(docs)) < new.sum())], ["anchor", "print", "doc_id"])

    return run


def _pair_key(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return value + textscan.mix(owner.astype(np.uint64) + np.uint64(1))


def _lists(column, first: int, n: int) -> tuple[np.ndarray, pa.Array]:
    """(text of each entry, entries) of the lists of rows first .. first + n - 1; nulls are empty."""
    part = column.slice(first, n)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(n), sizes), part.flatten()


def _listed(owner: np.ndarray, one: np.ndarray, two: np.ndarray | None, own: np.ndarray, listed: np.ndarray, listed_two: np.ndarray | None) -> np.ndarray:
    """Which (text, value) stand in the text's own list; values may have a second half."""
    if not len(own) or not len(one):
        return np.zeros(len(one), bool)
    key = _pair_key(own, listed)
    order = np.argsort(key, kind="stable")
    key = key[order]
    want = _pair_key(owner, one)
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    hit = key[at] == want
    at = order[at]
    hit &= (own[at] == owner) & (listed[at] == one)
    return hit if two is None else hit & (listed_two[at] == two)


def _window_rows(keys: Keys):
    """Fingerprints of the windows whose anchor is listed, once per document."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for first, raw in textscan.blocks(texts):
                words, h, at, owner, least = _windows(raw, keys)
                own, anchors = _lists(batch.column(2), first, len(raw))
                hit = np.flatnonzero(_listed(owner, least, None, own, anchors.to_numpy(zero_copy_only=False).view(np.uint64), None))
                one, two = _fingerprints(words, h, at[hit], keys)
                _, pick = np.unique(_pair_key(owner[hit], one), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(one[pick].view(np.int64)), pa.array(two[pick].view(np.int64)), pa.array(ids[first + owner[hit[pick]]].astype(np.int64))], ["h1", "h2", "doc_id"])

    return run


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


def _cut_rows(keys: Keys):
    """Counts, kept text and removed word spans of each text, given its document's repeated windows and copied prints."""

    def run(batches):
        for batch in batches:
            ids, texts, windows, copies = batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            for first, raw in textscan.blocks(texts):
                own, listed = _lists(windows, first, len(raw))
                whole = np.zeros(len(raw), bool)
                if some := [i for i in range(len(raw)) if copies[first + i]]:
                    for i, two in zip(some, _prints(textscan.scan([raw[i] for i in some])).tolist(), strict=True):
                        whole[i] = any([c["print"], c["second"]] == two for c in copies[first + i])
                masks: dict[int, np.ndarray] = {}
                if len(own):
                    some = np.unique(own)
                    words, h, at, owner, _ = _windows([raw[i] for i in some], keys)
                    one, two = _fingerprints(words, h, at, keys)
                    h1, h2 = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in listed.flatten())
                    hit = at[_listed(owner, one, two, np.searchsorted(some, own), h1, h2)]
                    cover = np.zeros(len(h) + 1, np.int64)
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + WINDOW, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    masks = {int(i): gone[words.first[k] : words.first[k + 1]] for k, i in enumerate(some)}
                n_words, n_removed, kept, spans = [], [], [], []
                for i, text in enumerate(raw):
                    parts = text.split()  # the same six bytes of white space
                    mask = np.ones(len(parts), bool) if whole[i] else masks.get(i)
                    n_words.append(len(parts))
                    n_removed.append(0 if mask is None else int(mask.sum()))
                    if mask is not None:
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                        spans.append([{"first": int(s), "last": int(e) - 1} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                        parts = [w for w, g in zip(parts, mask.tolist(), strict=True) if not g]
                    else:
                        spans.append([])
                    kept.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(raw)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, _CUT.field(4).type)], schema=_CUT)

    return run


#: The columns that bucket and sort the runs of each level, and all its columns.
LEVELS = {
    "document": (("print",), "print long, second long, head long"),
    "anchor": (("anchor",), "anchor long, low long, high long"),
    "window": (("h1", "h2"), "h1 long, h2 long, first_doc long"),
}


class FingerprintIndex:
    """The index of all batches so far.  Batches come in ascending order of doc_id.

    root is the index's folder, which must be one that all executors share.  An
    index that it holds is opened, else a new one is begun.  Runs and manifests
    are never changed: a batch adds runs and then a manifest, so an index whose
    writer died is opened as it was before that batch.

    buckets is the number of buckets of each run of a new index, by default the
    session's number of shuffle partitions; an index that is opened keeps its own.
    The session takes the order of bucketed files as it is, which Spark does not
    unless told to.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        self.spark, self.root, self.ws = spark, root or f"{shared_folder(spark)}-index", Workspace(spark)
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        made = [n for n in children(spark, self.root) if n.startswith("manifest-")]
        state = json.loads(spark.read.text(f"{self.root}/{max(made)}").first()[0]) if made else None
        self.generation = int(max(made).split("-")[1]) if made else 0
        self.keys: Keys = tuple(map(tuple, state["keys"])) if state else new_keys()
        self.buckets: int = state["buckets"] if state else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, list[DataFrame]] = {level: [self._opened(p, *LEVELS[level]) for p in state["runs"][level]] if state else [] for level in LEVELS}

    def _named(self, path: str, keys: tuple[str, ...], schema: str) -> str:
        """A catalogue name for the bucketed files of a folder, to be dropped when it has been used; the files stay then."""
        name, by, at = f"panelscope_{uuid.uuid4().hex}", ", ".join(keys), path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        return name

    def _opened(self, path: str, keys: tuple[str, ...], schema: str) -> DataFrame:
        name = self._named(path, keys, schema)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        run._panelscope_path = path
        return run

    def _write(self, kind: str, run: DataFrame, keys: tuple[str, ...], schema: str) -> DataFrame:
        """A new table of the index, one sorted file for each bucket."""
        path = f"{self.root}/{kind}-{uuid.uuid4().hex}"
        name = self._named(path, keys, schema)
        try:
            self.ws.insert(run.repartition(self.buckets, *keys), name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")
        return self._opened(path, keys, schema)

    def commit(self) -> None:
        """List the runs in a new manifest."""
        self.generation += 1
        state = {"keys": self.keys, "buckets": self.buckets, "runs": {level: [r._panelscope_path for r in runs] for level, runs in self.runs.items()}}
        self.spark.range(1).select(F.lit(json.dumps(state)).alias("value")).coalesce(1).write.text(f"{self.root}/manifest-{self.generation:06d}")

    def merged(self, level: str) -> DataFrame:
        """The rows of all runs of a level, one for each key.

        The files of all runs are read as one table without buckets.  A union of
        the runs would not do: Spark 4.1 takes a union of bucketed scans for
        bucketed, although it puts their buckets one after another.
        """
        runs = self.spark.read.schema(LEVELS[level][1]).parquet(*(run._panelscope_path for run in self.runs[level]))
        if level == "document":
            return runs.groupBy("print", "second").agg(F.min("head").alias("head"))
        if level == "anchor":
            ends = runs.groupBy("anchor").agg(F.min("low").alias("low"), F.max(F.coalesce("high", "low")).alias("high"))
            return ends.select("anchor", "low", _other("low", "high"))
        return runs.groupBy("h1", "h2").agg(F.min("first_doc").alias("first_doc"))

    def compact(self) -> None:
        """Merge the runs of each level into one."""
        for level in LEVELS:
            old, self.runs[level] = self.runs[level], [self._write(level, self.merged(level), *LEVELS[level])]
            for run in old:
                self.ws.drop(run)

    def _with_past(self, rows: DataFrame, level: str, on, *values: str) -> DataFrame:
        """rows, one for each key, and as past_<value>_<n> what run n of a level has for it (null: nothing)."""
        for n, run in enumerate(self.runs[level]):
            names = {c: f"past_{c}_{n}" for c in run.columns}
            run = run.select(*(F.col(c).alias(name) for c, name in names.items()))
            rows = rows.join(run, on(lambda c, names=names: F.col(names[c])), "left").drop(*(name for c, name in names.items() if c not in values))
        return rows

    def _past(self, how, level: str, value: str):
        """One column of those of _with_past()."""
        columns = [F.col(f"past_{value}_{n}") for n in range(len(self.runs[level]))]
        return columns[0] if len(columns) == 1 else how(*columns)

    def add(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """Take in a batch (doc_id, text); returns doc_id, windows (fingerprints of those repeated) and copies (prints of its texts that an earlier document has).

        corpus holds the texts of all batches so far, this one included; only
        documents that share an anchor are expanded from it again.
        """
        ws, later = self.ws, bool(self.runs["document"])
        rows = ws.save(batch.where("doc_id is not null").mapInArrow(_anchor_rows(self.keys), "anchor long, print long, doc_id long"), "anchors")
        own = rows.where("doc_id is not null").select("doc_id", "print", F.col("anchor").alias("second"))
        heads = own.groupBy("print", "second").agg(F.min("doc_id").alias("head"))
        if later:
            # the second half is compared, but no key of the join: runs are bucketed by the first
            heads = self._with_past(heads, "document", lambda past: (F.col("print") == past("print")) & (F.col("second").bitwiseXOR(past("second")) == 0), "head")
            old = self._past(F.least, "document", "head")
            heads = heads.select("print", "second", F.coalesce(old, "head").alias("head"), old.isNull().alias("new"))
        else:
            heads = heads.withColumn("new", F.lit(True))
        heads = ws.save(heads, "heads")
        none = F.lit(None).cast("array<struct<h1: long, h2: long>>")
        copies = own.join(heads, ["print", "second"]).where("head < doc_id").select("doc_id", none.alias("windows"), F.struct("print", "second").alias("copy"))

        met = rows.where("doc_id is null").select("anchor", "print")
        run = met.groupBy("anchor").agg(F.min("print").alias("low"), F.max("print").alias("high"))
        run = self._write("anchor", run.select("anchor", "low", _other("low", "high")), *LEVELS["anchor"])
        if later:
            both = self._with_past(run, "anchor", lambda past: F.col("anchor") == past("anchor"), "low", "high")
            for n in range(len(self.runs["anchor"])):
                both = both.withColumn(f"past_high_{n}", F.coalesce(f"past_high_{n}", f"past_low_{n}"))
            both = both.select("anchor", "low", "high", self._past(F.least, "anchor", "low").alias("old_low"), self._past(F.greatest, "anchor", "high").alias("old_high"))
            both = ws.save(both.where("least(low, coalesce(old_low, low)) < greatest(coalesce(high, low), coalesce(old_high, low))"), "shared")
            # an anchor that documents of one print had in the past: their windows are not in the window runs yet
            alone = both.where("old_low = old_high").select(F.col("old_low").alias("print"), "anchor")
            # copies of documents of the past have no windows of their own
            need = met.join(both.select("anchor"), "anchor").join(heads.where("not new").select("print"), "print", "left_anti").select("print", "anchor").union(alone)
        else:
            shared = ws.save(run.where("high is not null").select("anchor"), "shared")
            need = met.join(shared, "anchor").select("print", "anchor")
        need = need.groupBy("print").agg(F.collect_set("anchor").alias("anchors"))
        known_heads = [*self.runs["document"], heads.where("new")]
        need = ws.save(reduce(DataFrame.unionByName, [need.join(h.select("print", F.col("head").alias("doc_id")), "print").select("doc_id", "anchors") for h in known_heads]), "need")
        windows = ws.save(corpus.select("doc_id", "text").join(need, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_window_rows(self.keys), "h1 long, h2 long, doc_id long"), "windows")
        keys, schema = LEVELS["window"]
        fresh = self._write("fresh", windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")), keys, f"{schema}, last_doc long")
        known = fresh
        if later:
            known = self._with_past(fresh, "window", lambda past: (F.col("h1") == past("h1")) & (F.col("h2") == past("h2")), "first_doc")
            known = known.select("h1", "h2", F.least("first_doc", self._past(F.least, "window", "first_doc")).alias("first_doc"), "last_doc")
        known = known.where("first_doc < last_doc").select("h1", "h2", "first_doc")
        repeated = windows.join(known, ["h1", "h2"]).where("first_doc < doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("windows"))
        repeated = repeated.withColumn("copy", F.lit(None).cast("struct<print: long, second: long>"))
        # one row per document, however many rows have its id
        found = repeated.unionByName(copies).groupBy("doc_id").agg(F.first("windows", ignorenulls=True).alias("windows"), F.collect_set("copy").alias("copies"))
        found = ws.save(found, "found")
        self.runs["document"].append(self._write("document", heads.where("new").select("print", "second", "head"), *LEVELS["document"]))
        self.runs["anchor"].append(run)
        self.runs["window"].append(self._write("window", fresh.select("h1", "h2", "first_doc"), keys, schema))
        for done in (windows, rows, heads, need, fresh):
            ws.drop(done)
        if len(self.runs["anchor"]) > MAX_RUNS:
            self.compact()
        self.commit()
        return found


def _other(low: str, high: str):
    """high where it is not low, else null: most anchors stand in one document."""
    return F.when(F.col(low) != F.col(high), F.col(high)).alias(high)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text, removed (spans of word numbers).

    A word goes if a window of WINDOW words that covers it also starts in a
    document with a smaller id.  Windows are judged on the input.  Null texts
    have no words.  A row without id neither loses words nor costs others any;
    rows of one id are one document, and each of them gives one row.  Extra
    columns are ignored; an empty table gives an empty result.  The table is
    taken in as `batches` ranges of ids, as it would be when documents arrive
    over time; the result does not depend on their number.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    index, found = FingerprintIndex(docs.sparkSession), None
    if low is not None:
        edges = [low + (high + 1 - low) * k // batches for k in range(batches + 1)]
        for a, b in dict.fromkeys(zip(edges, edges[1:], strict=False)):
            if a < b:
                part = index.add(rows.where(F.col("doc_id").between(a, b - 1)), rows.where(F.col("doc_id") < b))
                found = part if found is None else found.unionByName(part)
    out = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first: long, last: long>>"
    if found is None:
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("windows", "array<struct<h1: long, h2: long>>"), ("copies", "array<struct<print: long, second: long>>"))]
        return rows.select("doc_id", "text", *nothing).mapInArrow(_cut_rows(index.keys), out)
    return rows.join(found, "doc_id", "left").select("doc_id", "text", "windows", "copies").mapInArrow(_cut_rows(index.keys), out)
