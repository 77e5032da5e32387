"""Variable roles: which source column fills which role of an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind_first_available(df: DataFrame, candidates: list[str], role: str, by: str = "entity") -> DataFrame:
    """(entity, role): the first candidate column of an entity that holds a value; NULL if none does."""
    counts = df.groupBy(by).agg(*[F.count(c).alias(c) for c in candidates])
    return counts.select(by, F.coalesce(*[F.when(F.col(c) > 0, F.lit(c)) for c in candidates]).alias(role))


def bind_fixed(df: DataFrame, column: str, role: str, by: str = "entity") -> DataFrame:
    """(entity, role): the column's name if the table has it, whatever it holds."""
    return df.select(by).distinct().withColumn(role, F.lit(column if column in df.columns else None).cast("string"))


def rename_roles(df: DataFrame, binding: DataFrame, roles: dict[str, list[str]], by: str = "entity") -> DataFrame:
    """Canonical columns: each role takes the value of the column its entity is bound to."""
    joined = df.join(binding, by)
    pick = lambda role, cands: F.coalesce(*[F.when(F.col(f"{role}_var") == c, F.col(c)) for c in cands])
    return joined.withColumns({role: pick(role, cands) for role, cands in roles.items()})


def columns_by_suffix(df: DataFrame, suffixes: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """Key columns and those that start or end with one of the tokens."""
    return df.select(*[c for c in df.columns if c in keys or (suffixes and c.endswith(suffixes)) or (prefixes and c.startswith(prefixes))])


def drop_all_null_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(how="all", subset=[c for c in df.columns if c not in keys])


def limit_entities(df: DataFrame, names: list | None = None, first: int | None = None, by: str = "entity") -> DataFrame:
    """Rows of the named entities, or of the first n by order; names without rows give one row with `unknown` set."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[by]
    if names is None:
        chosen = df.select(by).distinct().orderBy(by).limit(first or 0)
        return df.join(chosen, by, "left_semi").withColumn("unknown", F.lit(False))
    wanted = spark.createDataFrame([(n,) for n in names], f"{by} {kind}")
    found = df.join(F.broadcast(wanted), by, "left_semi").withColumn("unknown", F.lit(False))
    missing = wanted.join(df.select(by).distinct(), by, "left_anti").withColumn("unknown", F.lit(True))
    return found.unionByName(missing, allowMissingColumns=True)


def evapotranspiration(latent_heat, temperature):
    """mm per hour from latent heat (W m-2) and temperature (deg C), with the latent heat of vaporisation (2.501 - 0.00237 T) MJ kg-1."""
    return latent_heat / ((2.501 - 0.00237 * temperature) * 1e6) * 3600
