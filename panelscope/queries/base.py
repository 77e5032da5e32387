"""Registry of queries and the SQL views that their oracles share."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

PANEL = """SELECT {entity} AS entity, n_regionkey AS class, l_shipdate AS ts, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS qc, l_tax AS light_pot,
 CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_extendedprice END AS gpp, l_quantity AS heat, CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_extendedprice END AS dry,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS soil, l_tax AS light, -(l_extendedprice * (1 - l_discount)) AS target,
 l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
_A, _B, _C = 0.31863936, 0.714367440280187, 1.2815515655446



def _t_sql(steps: int = 14, parts: int = 400) -> str:
    """(dof, t): 0.975 quantiles of Student's t."""
    sql = "SELECT v::DOUBLE AS dof, 2.0 AS t FROM range(1, 201) r(v)"
    for _ in range(steps):
        area = f"list_sum(list_transform(range(0, {parts + 1}), lambda k: (CASE WHEN k IN (0, {parts}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + (t * k / {parts}) ** 2 / dof, -(dof + 1) / 2))) * t / {3 * parts}"
        scale = "exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi())"
        sql = f"SELECT dof, t - (0.5 + {scale} * {area} - 0.975) / ({scale} * pow(1 + t * t / dof, -(dof + 1) / 2)) AS t FROM ({sql})"
    return sql


#: Views by name; each may use those before it.
VIEWS = {
    "p": PANEL.format(entity="l_suppkey"),
    "pn": PANEL.format(entity="s_nationkey::BIGINT"),
    "z": "SELECT *, " + ", ".join(f"({v} - avg({v}) OVER w) / stddev_pop({v}) OVER w AS {v}_z" for v in ("heat", "dry", "soil", "light", "target")) + " FROM pn WHERE heat IS NOT NULL AND dry IS NOT NULL AND soil IS NOT NULL AND light IS NOT NULL AND target IS NOT NULL WINDOW w AS (PARTITION BY entity)",
    "phi": "SELECT *, 0.30 - 0.45 * dry_z - 0.15 * dry_z * dry_z + 0.02 * (entity % 5 - 2) AS phi_dry, 0.20 * heat_z AS phi_heat, 0.10 * soil_z AS phi_soil, 0.15 * light_z AS phi_light, 0.30 - 0.45 * dry_z - 0.15 * dry_z * dry_z + 0.02 * (entity % 5 - 2) + 0.20 * heat_z + 0.10 * soil_z + 0.15 * light_z AS net FROM z",
    "tq": _t_sql(),
    "rules": f"""SELECT * FROM (VALUES (0, NULL), (1, NULL), (2, NULL), (3, NULL), (4, NULL), (5, NULL), (6, NULL), (7, NULL), (8, NULL)) r(stage, x)""",
    "stage": f"""SELECT phi.*, r.stage FROM phi, rules r WHERE CASE r.stage WHEN 0 THEN TRUE
 WHEN 1 THEN heat_z BETWEEN -{_A} AND {_A} AND dry_z BETWEEN -{_A} AND {_A} AND soil_z BETWEEN -{_A} AND {_A}
 WHEN 2 THEN heat_z > {_A} AND heat_z <= {_B} AND soil_z BETWEEN -{_A} AND {_A} AND dry_z <= {_C}
 WHEN 3 THEN heat_z > {_A} AND heat_z <= {_B} AND soil_z >= -{_B} AND soil_z < -{_A} AND dry_z <= {_C}
 WHEN 4 THEN heat_z > {_B} AND heat_z <= {_C} AND soil_z >= -{_B} AND soil_z < -{_A} AND dry_z <= {_C}
 WHEN 5 THEN heat_z > {_B} AND heat_z <= {_C} AND soil_z >= -{_C} AND soil_z < -{_B} AND dry_z <= {_C}
 WHEN 6 THEN heat_z > {_C} AND soil_z >= -{_C} AND soil_z < -{_B} AND dry_z <= {_C}
 WHEN 7 THEN heat_z > {_C} AND soil_z < -{_C} AND dry_z <= {_C}
 WHEN 8 THEN heat_z > {_C} AND soil_z < -{_C} AND dry_z > {_C} END""",
    "mirror": f"""SELECT phi.*, r.stage FROM phi, rules r WHERE CASE r.stage
 WHEN 1 THEN heat_z BETWEEN -{_A} AND {_A} AND dry_z BETWEEN -{_A} AND {_A} AND soil_z BETWEEN -{_A} AND {_A}
 WHEN 2 THEN heat_z > {_A} AND heat_z <= {_B} AND dry_z BETWEEN -{_A} AND {_A} AND soil_z >= -{_C}
 WHEN 3 THEN heat_z > {_A} AND heat_z <= {_B} AND dry_z > {_A} AND dry_z <= {_B} AND soil_z >= -{_C}
 WHEN 4 THEN heat_z > {_B} AND heat_z <= {_C} AND dry_z > {_A} AND dry_z <= {_B} AND soil_z >= -{_C}
 WHEN 5 THEN heat_z > {_B} AND heat_z <= {_C} AND dry_z > {_B} AND dry_z <= {_C} AND soil_z >= -{_C}
 WHEN 6 THEN heat_z > {_C} AND dry_z > {_B} AND dry_z <= {_C} AND soil_z >= -{_C}
 WHEN 7 THEN heat_z > {_C} AND dry_z > {_C} AND soil_z >= -{_C}
 WHEN 8 THEN heat_z > {_C} AND dry_z > {_C} AND soil_z < -{_C} ELSE FALSE END""",
    "fact": f"""SELECT * FROM (SELECT *, CASE WHEN -soil_z BETWEEN -{_A} AND {_A} THEN 0 WHEN -soil_z > {_A} AND -soil_z <= {_B} THEN 1 WHEN -soil_z > {_B} AND -soil_z <= {_C} THEN 2 WHEN -soil_z > {_C} THEN 3 END AS soil_class,
 CASE WHEN dry_z BETWEEN -{_A} AND {_A} THEN 0 WHEN dry_z > {_A} AND dry_z <= {_B} THEN 1 WHEN dry_z > {_B} AND dry_z <= {_C} THEN 2 WHEN dry_z > {_C} THEN 3 END AS dry_class FROM phi) WHERE soil_class IS NOT NULL AND dry_class IS NOT NULL""",
    "sub0": "SELECT *, month(ts) AS mon, year(ts) AS yr FROM p",
    "pmon": "SELECT entity, mon FROM (SELECT entity, mon, row_number() OVER (PARTITION BY entity ORDER BY m DESC, mon) AS rk FROM (SELECT entity, mon, avg(gpp) AS m FROM sub0 GROUP BY ALL) WHERE m IS NOT NULL) WHERE rk <= 4",
    "sub1": "SELECT sub0.* FROM sub0 JOIN pmon USING (entity, mon) WHERE qc = 0 AND light_pot > 0.02",
    "kyr": "SELECT entity, mon, yr FROM (SELECT *, min(n) OVER (PARTITION BY entity) AS m FROM (SELECT *, row_number() OVER (PARTITION BY entity, mon ORDER BY yr DESC) AS rk, count(*) OVER (PARTITION BY entity, mon) AS n FROM (SELECT DISTINCT entity, mon, yr FROM sub1))) WHERE rk <= m",
    "sub2": "SELECT sub1.* FROM sub1 JOIN kyr USING (entity, mon, yr)",
    "sub3": "SELECT * FROM sub2 WHERE heat IS NOT NULL AND dry IS NOT NULL AND soil IS NOT NULL AND light IS NOT NULL AND target IS NOT NULL",
}


def with_(views: str, body: str) -> str:
    names, body = views.split(), body.strip()
    own = body.removeprefix("WITH ") if body.startswith("WITH ") else None
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in names) + (f", {own}" if own else f" {body}")


def query(name: str, keys: str = "", doubles: str = "", sql: str | None = None, views: str = "", digits: int = 6):
    """Register fn(spark, sf_dir); doubles are rounded alike in both engines, and a negative zero loses its sign."""

    def wrap(fn):
        def run(spark, sf_dir):
            df = fn(spark, sf_dir)
            return df.select(*keys.split(), *((F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in doubles.split())) if keys or doubles else df

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = sql
            if keys or doubles:
                cols = [*keys.split(), *(f"round(({c})::DOUBLE, {digits}) + 0.0 AS {c}" for c in doubles.split())]
                body = f"SELECT {', '.join(cols)} FROM ({with_(views, sql) if views else sql})"
            elif views:
                body = with_(views, sql)
            ORACLE_SQL[name] = body
        return fn

    return wrap
