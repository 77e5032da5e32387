"""Merkle manifest of a dataset: incremental witnesses over 8-ary trees.

Every row is a leaf; the leaves of one tree (a language, say) ascend by id.  A
task streams one aligned block of leaves in order and appends them one by one:
each open subtree carries the partial witnesses of its leaves, and whenever eight
siblings are complete, each of them is extended by the digests of the others.
Block roots, found by Spark tasks side by side, are then appended in the same
way to the tree above, until one root is left.  Witnesses of a block's leaves end
with the witness of their block, so they are never redone.

A Log keeps digests and block roots in the shared folder.  A later batch whose
ids all follow costs the batch and, for each of its trees, one open block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower

#: Children of a node; levels of a block, which has ARITY ** BLOCK_LEVELS leaves.
ARITY, BLOCK_LEVELS = 8, 4

Witness = list[tuple[str, str]]


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(c: Column) -> Column:
    """A value's UTF-8 byte count, a colon and the value; `-` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of a row's values."""
    return F.sha2(F.concat(*map(_field, values)).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Stream:
    """An append-only tree of `levels` levels: open runs of subtrees, each with the extensions of its leaves' witnesses.

    A subtree is [digest, its parent subtree, (siblings to the left, to the right)];
    the latter two are set when the run of siblings around it is complete.
    """

    def __init__(self, levels: int):
        self.open: list[list[list]] = [[] for _ in range(levels + 1)]

    def append(self, digest: str, level: int = 0) -> list:
        node = [digest, None, None]
        self.open[level].append(node)
        if level + 1 < len(self.open) and len(self.open[level]) == ARITY:
            self._complete(level)
        return node

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [node[0] for node in run]
        parent = self.append(_hash("".join(digests)), level + 1)
        for i, node in enumerate(run):
            node[1], node[2] = parent, ("".join(digests[:i]), "".join(digests[i + 1 :]))

    def close(self) -> str:
        """Complete the last, shorter runs; the root."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._complete(level)
        return self.open[-1][0][0]


def witness(node: list) -> Witness:
    """(left, right) siblings of a leaf and of all nodes above it, from below."""
    out = []
    while node[1] is not None:
        out.append(node[2])
        node = node[1]
    return out


def proof(path: Witness) -> str:
    return _hash("".join(left + right for left, right in path))


def fold(digest: str, path: Witness) -> str:
    """The root that a leaf and its witness give."""
    for left, right in path:
        digest = _hash(left + digest + right)
    return digest


def _blocks(batches, block_levels: int):
    """(head, rows, their subtrees, root) of each block in a task's sorted rows; a block may span Arrow batches.

    Rows of a block may be led by a head, of place -1, with what holds for all of them.
    """

    def grown(parts):
        rows = pa.Table.from_batches(parts)
        n, head = rows.column("n")[0].as_py(), None
        if rows.column("place")[0].as_py() < 0:
            head, rows = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        # a tree of one block is only as high as it needs to be
        stream = Stream(block_levels if n > ARITY**block_levels else height(n))
        return head, rows, [stream.append(d) for d in rows.column("digest").to_pylist()], stream.close()

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "block"))
        edge = np.concatenate(([0], np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1, [len(tree)])).tolist()
        for a, b in zip(edge, edge[1:], strict=False):
            if held and key != (tree[a], block[a]):
                yield grown(held)
                held = []
            key = (tree[a], block[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield grown(held)


def _roots(block_levels: int):
    def run(batches):
        for _, rows, _, root in _blocks(batches, block_levels):
            yield pa.RecordBatch.from_arrays([rows.column(c).slice(0, 1).combine_chunks() for c in ("tree", "block")] + [pa.array([root])], ["tree", "place", "digest"])

    return run


_PATH = "array<struct<left: string, right: string>>"
_PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
#: Rows of witnesses that leave a task together.
_OUT = 512


def _ends(head: dict | None, root: str) -> tuple[Witness, str]:
    """The block's own witness, and the root it leads to."""
    return ([(p["left"], p["right"]) for p in head["above"]], head["top"]) if head else ([], root)


def _witnesses(block_levels: int, keep: list[str]):
    def run(batches):
        for head, rows, nodes, root in _blocks(batches, block_levels):
            above, top = _ends(head, root)
            for a in range(0, len(nodes), _OUT):
                part = rows.slice(a, _OUT)
                paths = [[{"left": x, "right": y} for x, y in [*witness(node), *above]] for node in nodes[a : a + _OUT]]
                yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in keep), pa.array(paths, _PATH_ARROW), pa.array([top] * len(paths))], [*keep, "path", "root"])

    return run


def _folds(block_levels: int, keep: list[str]):
    """Proof digests and folded roots; siblings stay inside the task."""

    def run(batches):
        for head, rows, nodes, root in _blocks(batches, block_levels):
            above, top = _ends(head, root)
            for a in range(0, len(nodes), _OUT):
                part, found = rows.slice(a, _OUT), []
                for node, seen in zip(nodes[a : a + _OUT], part.column("seen").to_pylist(), strict=True):
                    path = [*witness(node), *above]
                    found.append((proof(path), fold(node[0] if seen is None else seen, path)))
                columns = [pa.array(c) for c in zip(*found, strict=True)]
                same = [pa.array([x] * len(found)) for x in (head["subroot"], top)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in keep), *columns, *same], [*keep, "proof", "folded", "subroot", "root"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (tree, block, place, ...), whole blocks in order within each task."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    return rows.unionByName(heads.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)


class Log:
    """A Merkle log of many trees, with its tables in the shared folder.

    append() takes rows (tree, key, digest, ...) whose keys all follow, within
    their tree, those that are in the log already; digests order rows of one key.
    Trees are named by strings; null is a tree of its own.
    """

    def __init__(self, spark: SparkSession, block_levels: int = BLOCK_LEVELS):
        self.ws, self.levels, self.block = Workspace(spark), block_levels, ARITY**block_levels
        self.runs, self.roots, self.size, self.tails = [], [], None, None

    def append(self, rows: DataFrame) -> None:
        """Number new leaves from their trees' sizes on, and find the roots of the blocks that they complete or leave open."""
        ws = self.ws
        named = ws.save(rows.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))).drop("tree"), "named")
        # ranges of (tree, key) cut a large tree into many; rows are numbered within each
        order = ["name", F.col("key").asc_nulls_first(), "digest"]
        parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = ws.save(named.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "dealt")
        per = dealt.groupBy("name", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"), F.min("key").alias("low"), F.max("key").alias("high"), F.max(F.col("key").isNull()).alias("nulls"))
        w = W.partitionBy("name").orderBy("part")  # as many rows as ranges
        spans = ws.save(per.withColumn("before", F.sum("c").over(w) - F.col("c")), "spans")
        whole = spans.groupBy("name").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("nulls").alias("nulls"))
        if self.size is None:
            size = whole.select("name", F.col("c").alias("n"), "high", F.lit(0).cast("long").alias("old"))
        else:
            both = self.size.select("name", F.col("n").alias("old"), F.col("high").alias("old_high")).join(whole, "name", "full")
            if not both.where("nulls and old is not null or low <= old_high").isEmpty():
                raise ValueError("an appended row does not follow the rows of its tree")
            size = both.select("name", (F.coalesce("old", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("n"), F.coalesce("high", "old_high").alias("high"), F.coalesce("old", F.lit(0)).cast("long").alias("old"))
        self.size = ws.save(size.withColumn("tree", F.xxhash64("name")), "size")
        if self.size.count() != self.size.select("tree").distinct().count():
            raise ValueError("two names of trees share a 64-bit hash")
        at = spans.select("name", "part", "first", "before").join(self.size.select("name", "tree", "old", "n"), "name")
        run = dealt.join(at, ["name", "part"]).withColumn("place", F.col("old") + F.col("before") + F.col("at") - F.col("first"))
        run = ws.save(run.withColumn("block", F.expr(f"place div {self.block}")).drop("name", "part", "at", "first", "before", "old"), "leaves")
        fresh = run.select("tree", "block", "place", "digest", "n")
        last = F.col("block") == F.expr(f"n div {self.block}")
        tails = fresh.where(last)
        if self.tails is not None:
            # the open block of each tree, at most, is read again
            grown = self.tails.drop("n").join(self.size.select("tree", "n", "old"), "tree")
            fresh = fresh.unionByName(grown.where("n > old").drop("old"))
            tails = tails.unionByName(grown.where(last).drop("old"))
        self.tails = ws.save(tails, "tails")
        self.runs.append(run)
        self.roots.append(ws.save(_dealt(fresh).mapInArrow(_roots(self.levels), "tree long, place long, digest string").withColumn("turn", F.lit(len(self.runs))), "roots"))

    def leaves(self) -> DataFrame:
        out = self.runs[0]
        for more in self.runs[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def _heads(self) -> DataFrame:
        """(tree, block, n, above, top): each block's witness and its tree's root, by appending block roots to the trees above."""
        roots = self.roots[0]
        for more in self.roots[1:]:
            roots = roots.unionByName(more)
        if len(self.roots) > 1:  # a block that was open has an older root too
            roots = roots.groupBy("tree", "place").agg(F.max_by("digest", "turn").alias("digest"))
        size = self.size.select("tree", F.col("n").alias("leaves"), F.expr(f"(n + {self.block - 1}) div {self.block}").alias("n"))
        nodes = roots.select("tree", "place", "digest").join(size, "tree")
        out = _paths(self.ws, nodes, self.levels, ["tree", "place", "leaves"])
        return out.select("tree", F.col("place").alias("block"), F.col("leaves").alias("n"), F.col("path").alias("above"), F.col("root").alias("top"))

    def subroots(self) -> DataFrame:
        """(tree, name, subroot) of every tree; name is `=` and the tree's, or empty for null."""
        return self._heads().where("block = 0").select("tree", F.col("top").alias("subroot")).join(self.size.select("tree", "name"), "tree")

    def witnesses(self, keep: list[str]) -> DataFrame:
        """(keep, path, root): every leaf's siblings, (left, right) from below, up to the root of its tree."""
        leaves = self.leaves()
        rows = _with_heads(leaves.select(*dict.fromkeys(["tree", "block", "place", "n", "digest", *keep])), self._heads())
        kinds = dict(leaves.dtypes)
        return _dealt(rows).mapInArrow(_witnesses(self.levels, keep), ", ".join([*(f"{c} {kinds[c]}" for c in keep), f"path {_PATH}", "root string"]))

    def check(self, keep: list[str]) -> DataFrame:
        """(keep, proof, folded, subroot, root): each leaf's column `seen` (null: the leaf) folded through its witness up to the root of all trees.

        The trees' roots, in order of their names, are the leaves of one tree more.
        """
        heads = self.ws.save(self._heads(), "heads")
        crown = Log(self.ws.spark, self.levels)
        crown.append(heads.where("block = 0").join(self.size.select("tree", "name"), "tree").select(F.lit("").alias("tree"), F.col("name").alias("key"), F.col("top").alias("digest"), F.col("tree").alias("of")))
        over = crown.witnesses(["of", "digest"]).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "path", "root")
        heads = heads.drop("top").join(over, "tree").select("tree", "block", "n", F.concat("above", "path").alias("above"), F.col("root").alias("top"), "subroot")
        leaves = self.leaves()
        rows = _with_heads(leaves.select(*dict.fromkeys(["tree", "block", "place", "n", "digest", "seen", *keep])), heads)
        kinds = dict(leaves.dtypes)
        return _dealt(rows).mapInArrow(_folds(self.levels, keep), ", ".join([*(f"{c} {kinds[c]}" for c in keep), "proof string, folded string, subroot string, root string"]))


def _paths(ws: Workspace, nodes: DataFrame, levels: int, keep: list[str]) -> DataFrame:
    """(keep, path, root) of nodes (tree, place, digest, n, ...): blocks are streamed, then their roots, and so on."""
    size = ARITY**levels
    nodes = ws.save(nodes.withColumn("block", F.expr(f"place div {size}")), "nodes")
    rows, kinds = nodes, dict(nodes.dtypes)
    if not nodes.where(F.col("n") > size).isEmpty():
        roots = _dealt(nodes).mapInArrow(_roots(levels), "tree long, place long, digest string")
        sizes = nodes.groupBy("tree").agg(F.max("n").alias("below"))
        upper = roots.join(sizes, "tree").withColumn("n", F.expr(f"(below + {size - 1}) div {size}"))
        heads = _paths(ws, upper, levels, ["tree", "place", "below"])
        rows = _with_heads(nodes, heads.select("tree", F.col("place").alias("block"), F.col("below").alias("n"), F.col("path").alias("above"), F.col("root").alias("top")))
    return _dealt(rows).mapInArrow(_witnesses(levels, keep), ", ".join([*(f"{c} {kinds[c]}" for c in keep), f"path {_PATH}", "root string"]))


def leaf_rows(docs: DataFrame, columns: list[str], tree: str, key: str, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(tree, key, digest, seen): leaves of docs by the columns named; `seen` is the digest of a row that is found changed, else null.

    changed: what a later reader finds instead of some columns in the rows where `where` holds.
    """
    leaf = leaf_digest(*(F.col(c) for c in columns))
    found = F.when(where, leaf_digest(*(changed.get(c, F.col(c)) for c in columns))) if changed else F.lit(None).cast("string")
    return docs.select(F.col(tree).alias("tree"), F.col(key).alias("key"), leaf.alias("digest"), found.alias("seen"))


def verify(docs: DataFrame, block_levels: int = BLOCK_LEVELS, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs (doc_id, source, lang, n_chars, text).

    Rows where `tampered` holds are read again with their text's A-Z lowered.
    Null values of any column are `-`; a null lang is a tree of its own and the
    first, rows of null ids come first in theirs, rows of one id and lang are
    ordered by their leaves, and equal rows stand side by side with different
    proofs.  An empty table gives an empty result.  Other columns are ignored.
    """
    log = Log(docs.sparkSession, block_levels)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False)) if tampered is None else tampered
    lowered = F.when(F.col("text").isNotNull(), ascii_lower("text"))
    log.append(leaf_rows(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": lowered}, tampered))
    out = log.check(["key", "digest"])
    return out.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
