"""Comparing the members of a group with each other in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def paired_blocks(ws: Workspace, members: DataFrame, key: str, id_col: str, size: int) -> DataFrame:
    """members (key, id, ...) with p, q and block: a group of more than `size` is dealt to blocks, and each pair of blocks (p, q) is one piece.

    Each block meets every other block once.  Small groups are one piece.  Only
    the given columns are multiplied, so pass ids and join their data later.
    """
    zero = F.lit(0).cast("long")
    crowded = ws.save(members.groupBy(key).count().where(F.col("count") > size).select(key, F.ceil(F.col("count") / size).alias("_blocks")), "crowded", rows=members.count() // size)
    if crowded.isEmpty():
        return members.withColumns({"p": zero, "q": zero, "block": zero})
    dealt = members.join(crowded, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("long"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(zero, F.col("_blocks").cast("long") - 1)))
    return dealt.withColumns({"p": F.least("block", "_other"), "q": F.greatest("block", "_other")}).drop("_blocks", "_other")


def pieces(batches, key: str) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """(table, [(first, last + 1) of each whole piece]) from batches sorted by key, p, q; a piece may span batches."""
    kept: list[pa.RecordBatch] = []

    def bounds(tab: pa.Table):
        k = np.stack([tab.column(c).to_numpy() for c in (key, "p", "q")])
        edge = np.flatnonzero(np.concatenate(([True], (k[:, 1:] != k[:, :-1]).any(axis=0), [True])))
        return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))

    for batch in batches:
        if not len(batch):
            continue
        tab = pa.Table.from_batches([*kept, batch])
        spans = bounds(tab)
        cut = spans[-1][0]  # the last piece may go on in the next batch
        if cut:
            yield tab.slice(0, cut).combine_chunks(), spans[:-1]
        kept = tab.slice(cut).combine_chunks().to_batches()
    if kept:
        tab = pa.Table.from_batches(kept).combine_chunks()
        yield tab, bounds(tab)


def across(block: np.ndarray) -> np.ndarray | None:
    """Which pairs of a piece's rows count: those of different blocks, or all if there is one block."""
    return None if block.min() == block.max() else block[:, None] != block[None, :]


def least_joined(ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches in a symmetric matrix of links."""
    label = ids.copy()
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == label).all():
            return label
        label = lower
