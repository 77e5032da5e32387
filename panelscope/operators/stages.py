"""Rule-based record subsets: stages, mirrored stages, factorial cells.

A rule gives each driver an interval of its z-score; a record may be in several
stages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cut-offs of z-scores (middle 25 %, next 13.75 %, upper 10 %).
CUTS = {"a": 0.31863936, "b": 0.714367440280187, "c": 1.2815515655446}
# Stage -> intervals of heat, dry and soil; an empty string leaves a driver free.
MAIN = {
    0: ("", "", ""),
    1: ("[-a,a]", "[-a,a]", "[-a,a]"),
    2: ("(a,b]", "(,c]", "[-a,a]"),
    3: ("(a,b]", "(,c]", "[-b,-a)"),
    4: ("(b,c]", "(,c]", "[-b,-a)"),
    5: ("(b,c]", "(,c]", "[-c,-b)"),
    6: ("(c,)", "(,c]", "[-c,-b)"),
    7: ("(c,)", "(,c]", "(,-c)"),
    8: ("(c,)", "(c,)", "(,-c)"),
}
# The sequence with the roles of dry and soil swapped.
MIRRORED = {
    1: ("[-a,a]", "[-a,a]", "[-a,a]"),
    2: ("(a,b]", "[-a,a]", "[-c,)"),
    3: ("(a,b]", "(a,b]", "[-c,)"),
    4: ("(b,c]", "(a,b]", "[-c,)"),
    5: ("(b,c]", "(b,c]", "[-c,)"),
    6: ("(c,)", "(b,c]", "[-c,)"),
    7: ("(c,)", "(c,)", "[-c,)"),
    8: ("(c,)", "(c,)", "(,-c)"),
}
SEQUENCES = {"main": MAIN, "mirrored": MIRRORED}


def _bound(text: str, cuts: dict[str, float]) -> float:
    return -cuts[text[1:]] if text.startswith("-") else cuts[text]


def within(x: Column, interval: str, cuts: dict[str, float] = CUTS) -> Column:
    """x lies in an interval such as '(a,b]'; an empty interval holds every x, NULL too."""
    if not interval:
        return F.lit(True)
    low, high = interval[1:-1].split(",")
    out = F.lit(True)
    if low:
        out = out & ((x >= _bound(low, cuts)) if interval[0] == "[" else (x > _bound(low, cuts)))
    if high:
        out = out & ((x <= _bound(high, cuts)) if interval[-1] == "]" else (x < _bound(high, cuts)))
    return out


def rule(sequence: str, stage: int, drivers: tuple[str, str, str] = ("heat_z", "dry_z", "soil_z")) -> Column:
    return reduce(lambda p, q: p & q, [within(F.col(d), i) for d, i in zip(drivers, SEQUENCES[sequence][stage], strict=True)])


def stages_of(sequence: str = "main", drivers: tuple[str, str, str] = ("heat_z", "dry_z", "soil_z")) -> Column:
    """Array of the stages that hold a record."""
    return F.array_compact(F.array(*[F.when(rule(sequence, s, drivers), F.lit(s)) for s in SEQUENCES[sequence]]))


def assign_stages(df: DataFrame, sequence: str = "main", drivers: tuple[str, str, str] = ("heat_z", "dry_z", "soil_z")) -> DataFrame:
    """One row per record and stage: a narrow explode, no join with a rule table."""
    return df.withColumn("stage", F.explode(stages_of(sequence, drivers)))


def stress_class(z: Column) -> Column:
    """0 to 3 by the cut-offs for a z-score whose stress is positive; NULL below the central class."""
    return F.when(within(z, "[-a,a]"), 0).when(within(z, "(a,b]"), 1).when(within(z, "(b,c]"), 2).when(within(z, "(c,)"), 3)


def factorial(df: DataFrame, soil: str = "soil_z", dry: str = "dry_z") -> DataFrame:
    """soil_class, dry_class and cell = 4 * soil + dry; records outside fall in no cell."""
    out = df.withColumns({"soil_class": stress_class(-F.col(soil)), "dry_class": stress_class(F.col(dry))})
    return out.dropna(subset=["soil_class", "dry_class"]).withColumn("cell", 4 * F.col("soil_class") + F.col("dry_class"))


def condition_level(label: Column) -> Column:
    """Degree 0 to 3 of a condition's text."""
    text = F.lower(label)
    return F.when(text.startswith("extreme"), 3).when(text.startswith("very") | text.startswith("high "), 2).when(text.startswith("dry") | text.startswith("warm") | text.startswith("higher"), 1).otherwise(0)
