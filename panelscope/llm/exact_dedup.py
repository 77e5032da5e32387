"""Exact deduplication by an extendible-hash index on shared files (DataFrame functions only)."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace, ascii_lower, drop_rows

#: Rows that a bucket of the index may hold before it is split.
CAPACITY = 8192
#: Keys (24 bytes each with bucket and count) that are broadcast: all repeated ones or, of more, the most frequent.
BROADCAST_KEYS = 500_000


def key_of(body: Column) -> Column:
    """The 64-bit key of a normalised text."""
    return F.xxhash64(body)


def _bucket(key: Column, depth: Column | int) -> Column:
    """The first `depth` bits of a 64-bit key."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, (64 - depth).cast("int")))


def _split_buckets(ws: Workspace, keys: DataFrame, rows: int, capacity: int) -> DataFrame:
    """Directory of the index: keys (key, n) with the local depth and bucket that own them.

    The directory starts at the depth at which an average bucket is full.  Each
    round doubles it: buckets over capacity with more than one key take one more
    bit, all others are closed.  A bucket that one repeated key overfills is
    left whole, for no further bit can split it.
    """
    depth = max(0, ceil(log2(max(1, rows / capacity))))
    open_, closed = keys.withColumns({"depth": F.lit(depth), "bucket": _bucket(F.col("key"), depth)}), []
    while depth < 63:
        load = open_.groupBy("bucket").agg(F.sum("n").alias("rows"), F.count("*").alias("keys"))
        over = ws.save(load.where((F.col("rows") > capacity) & (F.col("keys") > 1)).select("bucket"), "overfull", rows=rows // capacity)
        if over.isEmpty():
            break
        depth += 1
        closed.append(open_.join(over, "bucket", "left_anti"))
        open_ = ws.save(open_.join(over, "bucket", "left_semi").withColumns({"depth": F.lit(depth), "bucket": _bucket(F.col("key"), depth)}), "doubled", rows=rows)
    out = open_
    for part in closed:
        out = out.unionByName(part)
    return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> tuple[Workspace, DataFrame, DataFrame]:
    """(workspace, entries, directory) of the index over docs, as tables on shared files.

    entries: doc_id, key (64-bit hash of the normalised text), sha; the directory
    has one row per key: n, depth, bucket.  Its files are dealt to owners by
    ranges of buckets.
    """
    ws = Workspace(docs.sparkSession)
    body = ascii_lower(text_col)
    entries = ws.save(docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).select("doc_id", key_of(F.col("body")).alias("key"), F.sha2("body", 256).alias("sha")), "entries")
    rows = entries.count()  # of the written files
    keys = ws.save(entries.groupBy("key").agg(F.count("*").alias("n")), "keys", rows=rows)
    directory = ws.save(_split_buckets(ws, keys, rows, capacity).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "directory")
    return ws, entries, directory


def chains_of(ws: Workspace, docs: DataFrame, directory: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The bucket chains of repeated keys, as a table: bucket, key, chain (place among the key's texts), sha, keep_id, group_size.

    Copies of the texts of the most frequent keys are counted within tasks before
    anything is shuffled, all texts of repeated keys if these are few.  The
    owner of a range of (bucket, key) then holds what is left in order of bytes:
    texts that share a key without being equal follow each other as its chain.
    """
    repeated = directory.where("n > 1").select("key", "bucket", "n")
    body = ascii_lower(text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).withColumn("key", key_of(F.col("body")))
    # both ways give the same rows: the broadcast spares a shuffle of texts that occur once
    if repeated.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        owned_texts = texts.join(F.broadcast(repeated), "key")
    else:  # only the most frequent keys are broadcast; none of the others has more than a BROADCAST_KEYS-th of all rows
        often = ws.save(repeated.orderBy(F.desc("n"), "key").limit(BROADCAST_KEYS), "often", rows=BROADCAST_KEYS)
        hot, rest = F.broadcast(often), F.broadcast(often.select("key"))
        owned_texts = texts.join(hot, "key").unionByName(texts.join(rest, "key", "left_anti").join(repeated.join(rest, "key", "left_anti"), "key"))
    counted = owned_texts.groupBy("bucket", "key", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = counted.repartitionByRange("bucket", "key")
    chain = F.row_number().over(W.partitionBy("bucket", "key").orderBy("body"))
    return ws.save(owned.select("bucket", "key", chain.alias("chain"), F.sha2("body", 256).alias("sha"), "keep_id", "group_size"), "chains")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal after lower-casing A-Z; null
    counts as empty.  Of equal texts the row with the largest id stays; rows of
    that text with the same id stay with it.  A row without id is not
    kept where its text has one with an id, and kept is null where it has none.
    An empty table gives an empty result; extra columns are ignored.

    A key that occurs once in the directory is a group of one; all other rows
    find their group in the chains of their bucket.
    """
    ws, entries, directory = build_index(docs, id_col, text_col, capacity)
    chains = chains_of(ws, docs, directory, id_col, text_col)
    return (
        entries.join(chains.select("key", "sha", "keep_id", "group_size"), ["key", "sha"], "left")
        .select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("sha").alias("text_sha256"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay.

    Where rows of one id have unlike texts, each row is kept or dropped by its own text.
    Rows without id stay, as nothing tells which of them to drop.
    """
    marks = exact_groups(docs, id_col, text_col).where("doc_id is not null").select("doc_id", F.col("text_sha256").alias("text_key"), "kept")
    return drop_rows(docs, marks, id_col, F.sha2(ascii_lower(text_col), 256))
