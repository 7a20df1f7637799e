"""DuckDB SQL for the grid queries.

Sweeps are written as left joins of a grid with its shifted self, so they share no plan with the
window, scatter and brick forms they check; some are written by hand as window functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from ..functions.frontend import Stencil
from ..operators.boundary import BoundarySpec
from . import catalogue as cat
from .queries import BOUNDARIES, GAPPED, GRIDS, LIVE, MARCHED, MOST_STEPS, PASS_DIGITS, SPECIES, STILL, SWEEPS
from .sql import sweep_sql

L3 = """SELECT CAST(l_quantity AS INTEGER) - 1 AS i, CAST(round(l_discount * 100) AS INTEGER) AS j,
 CAST(round(l_tax * 100) AS INTEGER) AS k, CAST(count(*) AS DOUBLE) AS u, max(l_extendedprice) AS v, min(l_extendedprice) AS w
 FROM lineitem GROUP BY ALL"""
V2S = """SELECT user_id AS i, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS j, CAST(count(*) AS DOUBLE) AS u,
 CAST(max(value) AS DOUBLE) AS v FROM events GROUP BY ALL"""
V2 = f"""SELECT a.i, b.j, coalesce(g.u, 0.0) AS u, coalesce(g.v, 0.0) AS v FROM
 (SELECT unnest(range(min(i), max(i) + 1)) AS i FROM ({V2S})) a CROSS JOIN
 (SELECT CAST(unnest(range(min(j), max(j) + 1)) AS INTEGER) AS j FROM ({V2S})) b LEFT JOIN ({V2S}) g ON g.i = a.i AND g.j = b.j"""
E2 = "SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j, CAST(unnest(embedding) AS {0}) AS u FROM embeddings"
SOURCES = {
    "O1": "SELECT o_orderkey AS i, o_totalprice AS u FROM orders",
    "C1": "SELECT c_custkey AS i, c_acctbal AS u FROM customer",
    "E2": E2.format("DOUBLE"),
    "E2f": E2.format("FLOAT"),
    "L3": L3,
    "L8": f"SELECT i, j, k, u AS a, v AS b, w AS c, u + 1 AS d, v * 0.5::DOUBLE AS e, w * 0.25::DOUBLE AS f, v - w AS g, u * 2 AS h FROM ({L3})",
    "V2": V2,
    "V2s": V2S,
    "S2": f"SELECT i, j, u + 1 AS h, v AS p, v * 0.5::DOUBLE AS q FROM ({V2})",
    "B1": "SELECT CAST(l_linenumber AS INTEGER) AS b, CAST(l_quantity AS INTEGER) AS i, max(l_extendedprice) AS u FROM lineitem GROUP BY ALL",
}


def chain(source: str, steps: list[str]) -> str:
    """A query of steps: step n is a SELECT over {0}, the step before it; g0 is the source."""
    parts = [f"g0 AS MATERIALIZED ({source})"]
    for n, s in enumerate(steps, 1):
        parts.append(f"g{n} AS MATERIALIZED ({s.replace('{0}', f'g{n - 1}')})")
    return f"WITH {', '.join(parts)} SELECT * FROM g{len(steps)}"


def exact_sum(x: str, bits: int) -> str:
    """The sum of doubles that are whole numbers of 2^-bits, rounded once: integers in between."""
    whole, half = f"sum(CAST(({x}) * {float(1 << bits)!r}::DOUBLE AS HUGEINT))", 1 << 48
    return f"(CAST({whole} // {half} AS DOUBLE) * {float(half)!r}::DOUBLE + CAST({whole} % {half} AS DOUBLE)) / {float(1 << bits)!r}::DOUBLE"


def sweep_step(of: str, outputs: Mapping[str, Stencil], halo: str = "keep", keep_fields: bool = True) -> str:
    dims, fields, batch = GRIDS[of]
    return sweep_sql("{0}", dims, fields, batch, outputs, halo, keep_fields)


def boundary_step(dims: tuple[str, ...], fields: tuple[str, ...], spec: BoundarySpec, halo: tuple[int, ...]) -> str:
    """Axis by axis, as the conditions are defined: each step reads the one before it."""
    sql = "{0}"
    for x, (d, h, pair) in enumerate(zip(dims, halo, spec.sides, strict=True)):
        if not h or pair is None:
            continue
        ext = f"(SELECT min({d}) AS lo, max({d}) AS hi FROM {sql if sql == '{0}' else sql + ' q' + str(x)}) e"
        target = [f"c.{d}"]
        fixed = "CASE"
        for high, side in enumerate(pair):
            if side is None:
                continue
            inside = f"c.{d} > e.hi - {h}" if high else f"c.{d} < e.lo + {h}"
            n = f"(e.hi - e.lo + 1 - 2 * {h})"
            to = {
                "dirichlet": f"c.{d}",
                "neumann": f"e.hi - {h}" if high else f"e.lo + {h}",
                "periodic": f"c.{d} - {n}" if high else f"c.{d} + {n}",
                "reflecting": f"2 * (e.hi - {h}) + 1 - c.{d}" if high else f"2 * (e.lo + {h}) - 1 - c.{d}",
            }[side.kind]
            target.append(f"WHEN {inside} THEN {to}")
            if side.kind == "dirichlet":
                fixed += f" WHEN {inside} THEN CAST({side.value!r} AS DOUBLE)"
        where = f"CASE {' '.join(target[1:])} ELSE c.{d} END"
        others = " AND ".join([f"s.{o} = c.{o}" for o in dims if o != d] + [f"s.{d} = {where}"])
        values = ", ".join(f"{fixed} ELSE s.{f} END AS {f}" if fixed != "CASE" else f"s.{f} AS {f}" for f in fields)
        keys = ", ".join(f"c.{o}" for o in dims)
        base = sql if sql == "{0}" else f"{sql}"
        sql = f"(SELECT {keys}, {values} FROM {base} c CROSS JOIN {ext} LEFT JOIN {base} s ON {others})"
    return f"SELECT * FROM {sql}" if sql == "{0}" else sql[1:-1]


def _rk(method: str, dt: float = 0.1, steps: int = 2) -> str:
    """Runge-Kutta steps written as chained SELECTs over (i, u, k's)."""
    lap = "CASE WHEN c.i >= e.lo + 1 AND c.i <= e.hi - 1 THEN a.{0} - 2.0::DOUBLE * c.{0} + b.{0} ELSE 0.0 END"

    def k(name: str, of: str) -> str:
        return (
            f"SELECT c.*, CAST({lap.format(of)} AS DOUBLE) AS {name} FROM {{0}} c CROSS JOIN (SELECT min(i) AS lo, max(i) AS hi FROM {{0}}) e "
            "LEFT JOIN {0} a ON a.i = c.i - 1 LEFT JOIN {0} b ON b.i = c.i + 1"
        )

    def d(x: float) -> str:
        return f"CAST({x!r} AS DOUBLE)"

    def put(name: str, value: str, replace: bool = False) -> str:
        return f"SELECT * REPLACE ({value} AS {name}) FROM {{0}}" if replace else f"SELECT *, {value} AS {name} FROM {{0}}"

    if method == "euler":
        step = [k("k1", "u"), put("u", f"u + {d(dt)} * k1", True)]
    elif method == "rk2":
        step = [k("k1", "u"), put("s", f"u + {d(0.5 * dt)} * k1"), k("k2", "s"), put("u", f"u + {d(dt)} * k2", True)]
    elif method == "rk4":
        step = [
            k("k1", "u"), put("s", f"u + {d(0.5 * dt)} * k1"), k("k2", "s"), put("s", f"u + {d(0.5 * dt)} * k2", True),
            k("k3", "s"), put("s", f"u + {d(dt)} * k3", True), k("k4", "s"),
            put("u", f"u + {d(dt / 6.0)} * (((k1 + {d(2.0)} * k2) + {d(2.0)} * k3) + k4)", True),
        ]
    else:
        step = [
            k("k1", "u"), put("s", f"u + {d(dt)} * k1"), k("k2", "s"),
            put("s", f"{d(0.75)} * u + {d(0.25)} * (s + {d(dt)} * k2)", True), k("k3", "s"),
            put("u", f"{d(1.0 / 3.0)} * u + {d(2.0 / 3.0)} * (s + {d(dt)} * k3)", True),
        ]
    return chain(SOURCES["C1"], [*step, "SELECT i, u FROM {0}"] * steps)


#: Counted by hand: halo, fields, operations, distinct reads and offsets; operations over bytes of
#: the distinct offsets and the result.
DESCRIBED = """
SELECT * FROM (VALUES
 ('heat_1d', 1, 2, 'double', '1', 'u', 5, 3, 3, 0.15625::DOUBLE, 'memory', 'narrow'),
 ('laplacian_2d_9pt', 2, 4, 'double', '2,2', 'u', 16, 9, 9, 0.2::DOUBLE, 'memory', 'narrow'),
 ('cond_3d', 3, 2, 'double', '1,1,1', 'u', 7, 6, 6, 0.125::DOUBLE, 'memory', 'narrow'),
 ('box27_3d', 3, 2, 'double', '1,1,1', 'u', 53, 27, 27, 0.236607::DOUBLE, 'memory', 'wide'),
 ('box125_3d', 3, 4, 'double', '2,2,2', 'u', 249, 125, 125, 0.247024::DOUBLE, 'memory', 'very wide'),
 ('float_heat', 2, 2, 'float', '1,0', 'u', 5, 3, 3, 0.3125::DOUBLE, 'memory', 'narrow')
) AS t(name, ndim, "order", dtype, halo, fields, flops, unique_loads, unique_offsets, intensity, bound, tier)"""

HAND: dict[str, str] = {
    "heat_1d": """
SELECT i, CASE WHEN row_number() OVER w = 1 OR lead(u) OVER w IS NULL THEN u
  ELSE 0.25::DOUBLE * lag(u) OVER w + 0.5::DOUBLE * u + 0.25::DOUBLE * lead(u) OVER w END AS u
FROM (SELECT o_orderkey AS i, o_totalprice AS u FROM orders) WINDOW w AS (ORDER BY i)""",
    "advection_1d": """
SELECT i, CASE WHEN lag(u) OVER w IS NULL OR lead(u) OVER w IS NULL THEN u ELSE u - 0.5::DOUBLE * (u - lag(u) OVER w) END AS u
FROM (SELECT o_orderkey AS i, o_totalprice AS u FROM orders) WINDOW w AS (ORDER BY i)""",
    "heat_2d": f"""
SELECT i, j, CASE WHEN x1 IS NULL OR x2 IS NULL OR y1 IS NULL OR y2 IS NULL THEN u ELSE 0.25::DOUBLE * (x1 + x2 + y1 + y2) END AS u
FROM (SELECT *, lag(u) OVER a AS x1, lead(u) OVER a AS x2, lag(u) OVER b AS y1, lead(u) OVER b AS y2 FROM ({SOURCES["E2"]})
WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j))""",
    "clip_1d": "SELECT c_custkey AS i, CASE WHEN c_acctbal > 5000 THEN 5000.0::DOUBLE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS u FROM customer",
    "divide_by_zero_flags": """
SELECT i, q = 'inf'::DOUBLE AS plus, q = '-inf'::DOUBLE AS minus, isnan(q) AS nan FROM (
 SELECT i, CASE WHEN u = 3 THEN 'nan'::DOUBLE WHEN u > 3 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS q, i > min(i) OVER () AND i < max(i) OVER () AS inside
 FROM (SELECT c_custkey AS i, c_acctbal AS u FROM customer)) WHERE inside""",
    "domain_restricted": f"SELECT * FROM ({sweep_sql('g', ('i',), ('u',), (), {'u': cat.lap_1d_4th})}) WHERE i BETWEEN 100 AND 900",
    "brick_layout": f"""
WITH g AS ({V2}), e AS (SELECT min(i) AS lo_i, min(j) AS lo_j FROM g),
bricks AS (SELECT DISTINCT (i - lo_i) // 8 AS b_i, (j - lo_j) // 8 AS b_j FROM g, e),
slots AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS pos)
SELECT CAST(b_i AS BIGINT) AS b_i, CAST(b_j AS BIGINT) AS b_j, pos, coalesce(g.u, 0.0) AS u FROM bricks CROSS JOIN slots CROSS JOIN e
LEFT JOIN g ON g.i = lo_i + b_i * 8 + pos // 8 AND g.j = lo_j + b_j * 8 + pos % 8""",
    "brick_round_trip": SOURCES["E2"],
    "gather_parts": SOURCES["E2"],
    "densify_2d": V2,
    "densify_3d": f"""
WITH g AS ({L3}) SELECT a.i, b.j, c.k, coalesce(u, -1.0) AS u, coalesce(v, -1.0) AS v, coalesce(w, -1.0) AS w FROM
 (SELECT CAST(unnest(range(min(i), max(i) + 1)) AS INTEGER) AS i FROM g) a CROSS JOIN
 (SELECT CAST(unnest(range(min(j), max(j) + 1)) AS INTEGER) AS j FROM g) b CROSS JOIN
 (SELECT CAST(unnest(range(min(k), max(k) + 1)) AS INTEGER) AS k FROM g) c LEFT JOIN g ON g.i = a.i AND g.j = b.j AND g.k = c.k""",
    "diagnostics_batch": f"""
SELECT b, {exact_sum("u", 50)} AS mass, {exact_sum("u * u", 40)} AS energy, max(abs(u)) AS max_abs, min(u) AS least, max(u) AS most,
 count(u) AS n_cells, count(*) FILTER (WHERE u IS NULL) AS n_null FROM ({SOURCES["B1"]}) GROUP BY b""",
    "max_difference_plans": "SELECT 0.0::DOUBLE AS max_difference, 0::BIGINT AS n_unmatched",
    "decompose_halo": """
WITH g AS (SELECT c_custkey AS i, c_acctbal AS u FROM customer), e AS (SELECT min(i) + 2 AS lo, max(i) - 2 AS hi FROM g),
r AS (SELECT p, lo + p * ((hi - lo + 1) // 7) + least(p, (hi - lo + 1) % 7) AS a,
  lo + (p + 1) * ((hi - lo + 1) // 7) + least(p + 1, (hi - lo + 1) % 7) - 1 AS z FROM e, (SELECT unnest(range(7)) AS p))
SELECT CAST(p AS INTEGER) AS part, i, u, i BETWEEN a AND z AS owned FROM g JOIN r ON i BETWEEN a - 2 AND z + 2""",
    "exchange_halos_step": """
WITH g AS (SELECT c_custkey AS i, c_acctbal AS u FROM customer), e AS (SELECT min(i) + 1 AS lo, max(i) - 1 AS hi FROM g),
r AS (SELECT p, lo + p * ((hi - lo + 1) // 5) + least(p, (hi - lo + 1) % 5) AS a,
  lo + (p + 1) * ((hi - lo + 1) // 5) + least(p + 1, (hi - lo + 1) % 5) - 1 AS z FROM e, (SELECT unnest(range(5)) AS p))
SELECT CAST(p AS INTEGER) AS part, i, CASE WHEN i BETWEEN lo AND hi THEN u + 1.0::DOUBLE ELSE u END AS u, i BETWEEN a AND z AS owned
FROM g JOIN r ON i BETWEEN a - 1 AND z + 1 CROSS JOIN e""",
    "describe_stencils": f"""
SELECT d.*, cells, cells * flops AS work FROM ({DESCRIBED}) d JOIN (
 SELECT 1 AS ndim, count(*) AS cells FROM ({SOURCES["O1"]}) UNION ALL SELECT 2, count(*) FROM ({SOURCES["E2"]}) UNION ALL SELECT 3, count(*) FROM ({L3})) USING (ndim)""",
    "sided_1d": """
SELECT i, CASE WHEN b IS NULL OR a IS NULL THEN u ELSE u - 0.3::DOUBLE * (CASE WHEN a >= b THEN u - b ELSE a - u END) END AS u
FROM (SELECT c_custkey AS i, c_acctbal AS u, lag(c_acctbal) OVER w AS b, lead(c_acctbal) OVER w AS a FROM customer WINDOW w AS (ORDER BY c_custkey))""",
    "extended_1d": """
SELECT i, CASE WHEN a IS NULL OR i = min(i) OVER () THEN u
  ELSE sqrt(abs(u)) + 0.5::DOUBLE * i::DOUBLE - a / (1.0::DOUBLE + i::DOUBLE) END AS u
FROM (SELECT c_custkey AS i, c_acctbal AS u, lead(c_acctbal) OVER (ORDER BY c_custkey) AS a FROM customer)""",
}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, of, outputs, halo, _ in SWEEPS:
        dims, fields, batch = GRIDS[of]
        out[name] = f"WITH g AS MATERIALIZED ({SOURCES[of]}) {sweep_sql('g', dims, fields, batch, outputs, halo)}"
    out |= HAND
    out["domain_restricted"] = f"WITH g AS ({SOURCES['O1']}) {HAND['domain_restricted']}"
    for name, (of, spec, halo) in BOUNDARIES.items():
        dims, fields, _ = GRIDS[of]
        out[name] = f"WITH g AS MATERIALIZED ({SOURCES[of]}) " + boundary_step(dims, fields, spec, halo).replace("{0}", "g")
    heat = sweep_step("C1", {"u": cat.heat_1d})
    out["march_last"] = chain(SOURCES["C1"], [heat] * 5)
    three = chain(SOURCES["C1"], [heat] * 3).rsplit(" SELECT * FROM", 1)[0]
    out["march_history"] = three + " " + " UNION ALL ".join(f"SELECT {n}::INTEGER AS step, i, u FROM g{n}" for n in range(4))
    periodic = boundary_step(("i",), ("u",), BoundarySpec.periodic(1), (1,))
    out["march_periodic"] = chain(SOURCES["C1"], [sweep_step("C1", {"u": cat.advection_upwind}), periodic] * 4)
    out["march_blocked_3"] = chain(SOURCES["V2"], [sweep_step("V2", {"u": cat.heat_2d})] * 3 + ["SELECT i, j, u FROM {0}"])
    from ..functions.frontend import from_text

    edge = (
        "SELECT c.i, c.j, CASE WHEN c.i > e.a AND c.i < e.b AND c.j > e.c AND c.j < e.d THEN c.u ELSE 0.0 END AS u, c.v FROM {0} c "
        "CROSS JOIN (SELECT min(i) AS a, max(i) AS b, min(j) AS c, max(j) AS d FROM {0}) e"
    )
    out["leapfrog_wave"] = chain(SOURCES["V2"], [sweep_step("V2", {"u": cat.leapfrog, "v": from_text("old", "u[i, j]")}), edge] * 2)
    two = "SELECT i, u AS e, u * 0.5::DOUBLE AS h FROM (" + SOURCES["C1"] + ")"
    stages = []
    for n in (1, 2):
        for upd in ({"h": cat.update_h}, {"e": cat.update_e}):
            stages.append(sweep_sql("{0}", ("i",), ("e", "h"), (), upd, "keep", True))
        stages.append(f"SELECT i, CASE WHEN i = 40 THEN e + {10.0 * n!r}::DOUBLE ELSE e END AS e, h FROM {{0}}")
    out["fdtd_staggered"] = chain(two, stages)
    for name, method in {"rk_euler": "euler", "rk2": "rk2", "rk4": "rk4", "rk_ssprk3": "ssprk3"}.items():
        out[name] = _rk(method)
    cube = (
        "SELECT i, j, k, CAST(i * 100 + j * 10 + k AS DOUBLE) AS u FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS i) CROSS JOIN "
        "(SELECT unnest(range(9)) AS j) CROSS JOIN (SELECT unnest(range(7)) AS k)"
    )
    out["made_grid"] = f"WITH g AS MATERIALIZED ({cube}) {sweep_sql('g', ('i', 'j', 'k'), ('u',), (), {'u': cat.mean_3d})}"
    marched = boundary_step(("i", "j"), ("u", "v"), MARCHED, (1, 1))
    out["march_neumann_2d"] = chain(SOURCES["V2"], [sweep_step("V2", {"u": cat.heat_2d}), marched] * 3)
    out["march_blocked_fused"] = out["compiled_fused_steps"] = chain(SOURCES["V2"], [sweep_step("V2", SPECIES)] * 3)
    out["march_bricks_2d"] = chain(SOURCES["E2"], [sweep_step("E2", {"u": cat.heat_2d})] * 5)
    out["march_bricks_periodic"] = chain(SOURCES["V2"], [sweep_step("V2", SPECIES), marched] * 4)
    gapped = boundary_step(("i", "j"), ("u", "v"), GAPPED, (1, 1))
    out["march_bricks_gaps"] = chain(SOURCES["V2s"], [sweep_step("V2s", {"u": cat.heat_2d}), gapped] * 3)
    near = " AND ".join(f"k.{d} BETWEEN e.{d} + (g.{d} - e.{d}) // 32 * 32 - {r} AND e.{d} + (g.{d} - e.{d}) // 32 * 32 + 31 + {r}" for d, r in (("i", 0), ("j", 2)))
    smooth = sweep_sql("{0}", ("i", "j"), ("n", "u"), (), LIVE, "keep", True)
    out["streaming_events"] = (
        chain(f"SELECT i, j, u AS n, u FROM ({V2})", [smooth] * 2)
        + f" g WHERE EXISTS (SELECT 1 FROM ({V2S}) k CROSS JOIN (SELECT min(i) AS i, min(j) AS j FROM g0) e WHERE {near})"
    )
    bell = sweep_sql("g", ("i", "j", "k"), ("u", "v", "w"), (), {"u": cat.bell(2, 3)}, "drop")
    out["bell_in_passes_3d"] = f"WITH g AS MATERIALIZED ({L3}) SELECT i, j, k, round(u, {PASS_DIGITS}) AS u FROM ({bell})"
    nine = {"u": cat.laplacian_2d_9pt}
    swept = chain(SOURCES["E2"], [sweep_step("E2", nine)])
    out["sql_sweep"] = f"SELECT j, max(u) AS most, min(u) AS least, count(*) AS n FROM ({swept}) WHERE u <> 0 GROUP BY j"
    out["stored_box"] = f"WITH g AS MATERIALIZED ({SOURCES['E2']}) SELECT * FROM ({sweep_sql('g', ('i', 'j'), ('u',), (), nine)}) WHERE i BETWEEN 100 AND 180 AND j BETWEEN 5 AND 40"
    mirrored = boundary_step(("i", "j"), ("u", "v"), BoundarySpec.reflecting(2), (1, 1))
    out["stored_march"] = chain(SOURCES["V2"], [sweep_step("V2", SPECIES), mirrored] * 3)
    changed = f"SELECT i, CASE WHEN i % 5000 BETWEEN 100 AND 103 THEN u + 1000.0::DOUBLE ELSE u END AS u FROM ({SOURCES['O1']})"
    out["incremental_resweep"] = chain(changed, [sweep_step("O1", {"u": cat.heat_1d})] * 3)
    # Each step is a sweep and a boundary condition: step n is g2n.
    still = boundary_step(("i",), ("u",), BoundarySpec.reflecting(1), (1,))
    inner = "SELECT {0} FROM g{1} a JOIN g{2} b ON b.i = a.i WHERE a.i > (SELECT min(i) FROM g0) AND a.i < (SELECT max(i) FROM g0)"
    measure = f"{{0}}::INTEGER AS step, 'u' AS field, {exact_sum('a.u', 50)} AS mass, {exact_sum('a.u * a.u', 40)} AS energy, max(abs(a.u - b.u)) AS change, count(*) AS n_cells"
    flat = boundary_step(("i",), ("u",), BoundarySpec.neumann(1), (1,))
    steps = chain(SOURCES["O1"], [sweep_step("O1", {"u": cat.heat_1d}), flat] * 4).rsplit(" SELECT * FROM", 1)[0]
    out["march_measures"] = steps + " " + " UNION ALL ".join(inner.format(measure.format(n), 2 * n, 2 * n - 2) for n in range(1, 5))
    steps = chain(SOURCES["C1"], [heat, still] * MOST_STEPS).rsplit(" SELECT * FROM", 1)[0]
    changes = " UNION ALL ".join(inner.format(f"{n} AS step, max(abs(a.u - b.u)) AS change", 2 * n, 2 * n - 2) for n in range(1, MOST_STEPS + 1))
    states = " UNION ALL ".join(f"SELECT {n}::INTEGER AS step, i, u FROM g{2 * n}" for n in range(1, MOST_STEPS + 1))
    out["march_until_still"] = f"{steps}, c AS ({changes}) SELECT * FROM ({states}) WHERE step = (SELECT coalesce(min(step), {MOST_STEPS}) FROM c WHERE change <= {STILL!r}::DOUBLE)"
    out["march_parts_2d"] = chain(SOURCES["E2"], [sweep_step("E2", {"u": cat.heat_2d})] * 3)
    out["stored_grid"] = chain(SOURCES["O1"], [sweep_step("O1", {"u": cat.heat_1d}), sweep_step("O1", {"u": cat.advection_upwind})])
    swept = chain(SOURCES["C1"], [heat])
    out["sql_over_view"] = f"SELECT i % 10 AS digit, max(u) AS most, count(*) AS n FROM ({swept}) WHERE u > 0 GROUP BY 1"
    drawn = (
        "SELECT i, j, CAST('0x' || substr(md5('7:u:' || i || ',' || j), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u "
        "FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS i) CROSS JOIN (SELECT unnest(range(15)) AS j)"
    )
    out["random_field"] = chain(drawn, [sweep_step("E2", {"u": cat.heat_2d})])
    unique = "SELECT CAST(l_quantity AS INTEGER) AS i, max(l_extendedprice) AS u FROM lineitem GROUP BY 1"
    out["unique_cells"] = chain(unique, [heat])
    out["streaming_march"] = chain(SOURCES["C1"], [heat] * 3)
    return out


__all__ = ["oracle_sql"]
