"""The supplied tables seen as panels: entity, class, ts, quality flag, drivers and target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import assign_stages
from ..operators.subset import drop_incomplete, zscore

DRIVERS = ["heat", "dry", "soil", "light"]
EFFECTS = ["phi_dry", "phi_heat", "phi_soil", "phi_light"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, entity: str = "l_suppkey") -> DataFrame:
    """Line items as a daily panel; entity is l_suppkey or s_nationkey.  NULLs are planted by order key."""
    suppliers, nations = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # one after the other, as Spark knows the size of each table but not that of their join
    rows = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    gap = lambda n, c: F.when(F.col("l_orderkey") % n == 0, None).otherwise(F.col(c))
    return rows.select(
        F.col(entity).cast("long").alias("entity"), F.col("n_regionkey").alias("class"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("qc"),
        F.col("l_tax").alias("light_pot"), gap(17, "l_extendedprice").alias("gpp"), F.col("l_quantity").alias("heat"), gap(97, "l_extendedprice").alias("dry"), gap(11, "l_discount").alias("soil"),
        F.col("l_tax").alias("light"), (-(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("target"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
    )


def zpanel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows by nation with z-scores of drivers and target."""
    rows = drop_incomplete(panel(spark, sf_dir, "s_nationkey"), [*DRIVERS, "target"])
    return zscore(rows, [*DRIVERS, "target"])


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zpanel with the surrogate model's effects phi_* and their sum, net."""
    z = zpanel(spark, sf_dir)
    phi = z.withColumns({
        "phi_dry": 0.30 - 0.45 * F.col("dry_z") - 0.15 * F.col("dry_z") * F.col("dry_z") + 0.02 * (F.col("entity") % 5 - 2),
        "phi_heat": 0.20 * F.col("heat_z"), "phi_soil": 0.10 * F.col("soil_z"), "phi_light": 0.15 * F.col("light_z"),
    })
    return phi.withColumn("net", F.col("phi_dry") + F.col("phi_heat") + F.col("phi_soil") + F.col("phi_light"))


def staged(spark: SparkSession, sf_dir: str, sequence: str = "main") -> DataFrame:
    """One row per record and stage that holds it."""
    return assign_stages(attributed(spark, sf_dir), sequence)
