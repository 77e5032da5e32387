"""Shared-folder tables, hashing and column helpers for the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a few numbers that one file of an intermediate table holds, and rows of texts that one Arrow batch hands to Python.
FILE_ROWS, BATCH_ROWS = 100_000, 1000
#: Shuffle files of a finished write are of no further use; Spark then deletes them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; a temporary one where that is unset and Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panelscope-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, as rows here hold whole texts; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Workspace:
    """Tables of one operator call, written to the shared folder to cut lineage.

    A lost executor costs only the tasks of the table being written: whatever
    was written before is read again from the shared folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_folder(spark), 0
        small_batches(spark)

    def save(self, df: DataFrame, name: str = "t", root: str | None = None, rows: int | None = None) -> DataFrame:
        """Write df as Parquet, to this call's folder or a folder of its own below root, and return a DataFrame that reads it.

        rows: a bound on its narrow rows; the table then gets one task and file for every FILE_ROWS.
        """
        self.n += 1
        if rows is not None:
            df = df.coalesce(1 + rows // FILE_ROWS)
        path = f"{root}/{name}-{uuid.uuid4().hex}" if root else f"{self.root}/{self.n:03d}-{name}"
        self._cleaned(lambda: df.write.parquet(path))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._panelscope_path = path
        return out

    def insert(self, df: DataFrame, name: str) -> None:
        """Write df to a table of the catalogue, column by column."""
        self._cleaned(lambda: df.write.insertInto(name))

    def _cleaned(self, write) -> None:
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            write()
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)

    def drop(self, df: DataFrame) -> None:
        """Delete a table of save() that nothing reads any more."""
        path, files = _files(self.spark, df._panelscope_path)
        files.delete(path, True)


def _files(spark: SparkSession, at: str):
    """(path, its file system) for whatever store Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of the finished outputs in a folder, in order; none if it does not exist."""
    path, files = _files(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(n for n in names if files.exists(_files(spark, f"{folder}/{n}/_SUCCESS")[0]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: str | Column) -> Column:
    """A-Z to a-z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, UPPER.lower())


def unused(df: DataFrame, name: str) -> str:
    """A column name that df (compared without case) does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_rows(docs: DataFrame, marks: DataFrame, id_col: str, text_key: Column) -> DataFrame:
    """docs without the rows that marks (doc_id, text_key, kept) do not keep; all columns stay.

    Rows are told apart by id, and by text_key only where an id is kept for one
    text and dropped for another, so that normally no text is hashed again.
    """
    ws = Workspace(docs.sparkSession)
    # as many rows as ids, of which most are kept: only others are written
    ids = marks.groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("all")).where("not all")
    ids = ws.save(ids.select(F.col("doc_id").alias(id_col), F.col("some").alias("mixed")), "dropped")
    out = docs.join(ids.select(id_col), id_col, "left_anti")
    mixed = ids.where("mixed").select(id_col)
    if not mixed.isEmpty():
        key = unused(docs, "text_key")
        gone = marks.where("not kept").select(F.col("doc_id").alias(id_col), F.col("text_key").alias(key)).distinct()
        rows = docs.join(mixed, id_col, "left_semi").withColumn(key, text_key)
        out = out.unionByName(rows.join(gone, [id_col, key], "left_anti").drop(key))
    return out.select(*docs.columns)
