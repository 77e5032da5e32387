"""Writers, file manifests and schema checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; a temporary one where that is unset and Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panelscope-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """df as a written table, for plans that start from it several times."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], csv_twin: str | None = None) -> None:
    """Parquet below path, one folder per value of `by`; the same rows as CSV at csv_twin.

    Rows of one folder are brought together first, so that a folder gets few files.
    Most time goes into opening files, so the number of tasks is given: Spark would
    choose fewer by bytes, which fill its cores unevenly.
    """
    spark = df.sparkSession
    dealt = df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
    dealt.write.partitionBy(*by).parquet(path)
    if csv_twin:
        dealt.write.partitionBy(*by).option("header", True).csv(csv_twin)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, stage (first folder), bytes, sha256 and rule checks of all files below root; a CSV with a Parquet twin in its folder is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_extract("path", r".*?" + root.rstrip("/").split("/")[-1] + r"/(.*)$", 1)
    files = files.select(rel.alias("path"), F.col("length").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")).withColumn("folder", F.regexp_replace("path", r"/?[^/]*$", ""))
    twins = files.where(F.col("path").endswith(".parquet")).select(F.regexp_replace("folder", "^parquet", "csv").alias("folder")).distinct()
    kept = files.join(twins, "folder", "left_anti").unionByName(files.join(twins, "folder", "left_semi").where(~F.col("path").endswith(".csv")))
    ok = F.col("path").rlike(r"^[A-Za-z0-9_.=/\-]+$") & (F.length("path") <= 200) & (F.col("bytes") <= 10 * 1024**3)
    return kept.select("path", F.split("path", "/")[0].alias("stage"), "bytes", "sha256", ok.alias("ok"))


def header_columns(spark: SparkSession, root: str, first: str) -> DataFrame:
    """(file, column) of all CSV files below root, read from their header lines, which begin with the column `first`."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.where(F.split("value", ",")[0] == first).distinct()
    return heads.select("file", F.explode(F.split("value", ",")).alias("column"))


def schema_conformance(columns: DataFrame, grammar: DataFrame) -> DataFrame:
    """One row per unexplained (file, column), and per grammar rule that explains no column.

    columns: file, column; grammar: rule, pattern (a regular expression that must match a whole name), a list made by hand.
    """
    hit = columns.select("column").distinct().join(F.broadcast(grammar), F.expr("column RLIKE concat('^(?:', pattern, ')$')"))
    unexplained = columns.join(hit.select("column"), "column", "left_anti").select(F.lit("unexplained").alias("kind"), "file", F.col("column").alias("name"))
    unmatched = grammar.join(hit.select("rule").distinct(), "rule", "left_anti").select(F.lit("unmatched").alias("kind"), F.lit("").alias("file"), F.col("rule").alias("name"))
    return unexplained.unionByName(unmatched)
