"""URL lists over time: dated entries become validity intervals, joined as of each capture (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace

FOREVER = "9999-12-31 00:00:00"
#: Captures meet only the intervals of their time's bucket, so entries that come and go often do not multiply them.
BUCKET_DAYS = 30
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def lookup_keys(url: Column) -> Column:
    """All keys under which an entry can name the URL: each domain that holds its host, and each path prefix that ends at a slash or the end."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.concat_ws(".", F.slice(labels, i, F.size(labels)))))
    steps = F.split(path_of(url), "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda i: F.concat(F.lit("prefix:"), host, F.concat_ws("/", F.slice(steps, 1, i))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals [valid_from, valid_to) of list entries.

    entries: list_name, kind ('domain' or 'prefix'), pattern, event_at, action
    ('add' or 'remove').  An entry holds from an add to its next event; at one
    instant an add counts after a remove.  Rows with a null in any of these
    columns or an unknown action are ignored, repeated rows change nothing.
    """
    e = entries.where(F.col("action").isin("add", "remove")).select("list_name", F.concat_ws(":", "kind", "pattern").alias("key"), "event_at", "action", "kind", "pattern").dropna().distinct()
    w = W.partitionBy("key", "list_name").orderBy("event_at", F.col("action").desc())
    e = e.withColumn("valid_to", F.coalesce(F.lead("event_at").over(w), F.lit(FOREVER).cast("timestamp_ntz")))
    return e.where("action = 'add' and event_at < valid_to").select("key", "list_name", F.col("event_at").alias("valid_from"), "valid_to")


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_date(F.to_date(at)) / BUCKET_DAYS)


def match(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", allow_lists: tuple[str, ...] = ("allow",)) -> DataFrame:
    """One row per capture: id, url, host, fetch time, n_active, lists (comma-joined, sorted) and verdict.

    n_active counts list entries that hold at fetch time and name the URL.  The
    verdict is 'allow' if any of them is on an allow list or none is found,
    'block' otherwise.  Captures without a URL, a host or a time match nothing.
    Captures are told apart by id, URL and time: repeated rows give one row each.
    Very long URLs have as many keys as labels and path steps.  Extra columns are
    ignored; an empty table gives an empty result.

    Keys and time buckets are matched by an equi-join on written tables, so Spark
    can split keys that very many captures share; an entry side is never assumed
    small.
    """
    ws = Workspace(captures.sparkSession)
    valid = ws.save(intervals(entries), "intervals")
    span = captures.agg(F.min(time_col), F.max(time_col)).first()
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_at"))
    keyed = rows.dropna(subset=["_url", "_at"]).distinct().withColumn("key", F.explode(lookup_keys(F.col("_url"))))
    # an interval goes to the buckets that it shares with the captures' span
    low, high = F.lit(span[0]).cast("timestamp_ntz"), F.lit(span[1]).cast("timestamp_ntz")
    valid = valid.where((F.col("valid_from") <= high) & (F.col("valid_to") > low))
    valid = valid.withColumn("bucket", F.explode(F.sequence(_bucket(F.greatest("valid_from", low)), _bucket(F.least("valid_to", high)))))
    hits = keyed.withColumn("bucket", _bucket(F.col("_at"))).join(valid, ["key", "bucket"]).where("valid_from <= _at and _at < valid_to")
    found = hits.groupBy(F.col("_id").alias("f_id"), F.col("_url").alias("f_url"), F.col("_at").alias("f_at")).agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"), F.max(F.col("list_name").isin(*allow_lists)).alias("allowed")
    )
    out = rows.join(found, F.col("_id").eqNullSafe(F.col("f_id")) & (F.col("_url") == F.col("f_url")) & (F.col("_at") == F.col("f_at")), "left")
    return out.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), host_of(F.col("_url")).alias("host"), F.col("_at").alias(time_col),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"),
        F.when(F.coalesce("allowed", F.lit(True)), "allow").otherwise("block").alias("verdict"),
    )
