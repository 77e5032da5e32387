"""Readers.  Column lists are passed on to the scan; missing values become NULL there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "-9999"


def scan_panel(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a panel table."""
    return spark.read.parquet(path).select(*columns)


def site_of_path(path: Column) -> tuple[Column, Column]:
    """(origin, site): first and second `_` token of the folder that holds a file."""
    folder = F.element_at(F.split(path, "/"), -2)
    tokens = F.split(folder, "_")
    return tokens[0], tokens[1]


def read_csv_sources(spark: SparkSession, root: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """All CSV files below root whose name matches, with origin and site of their folders; -9999 becomes NULL."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", MISSING).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    origin, site = site_of_path(F.col("_metadata.file_path"))
    return df.select("*", origin.alias("origin"), site.alias("site"))


def parse_key_values(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines of five comma fields or more: site, group_id, variable_group, variable, datavalue; the last one keeps its commas."""
    lines = spark.read.option("encoding", encoding).text(path) if encoding == "UTF-8" else spark.read.format("csv").option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("value string").load(path)
    parts = F.split("value", ",", 5)
    return lines.where(F.size(F.split("value", ",")) >= 5).select(parts[0].alias("site"), parts[1].alias("group_id"), parts[2].alias("variable_group"), parts[3].alias("variable"), parts[4].alias("datavalue"))
