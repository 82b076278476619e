import random

import numpy as np
import pytest

from sumtrace.operators import interchange, reconstruct
from sumtrace.operators.components import connected_components
from sumtrace.operators.determined import determined, determined_after, exact_lengths, scaled, shrunk
from sumtrace.operators.jacobian import candidates, jacobian
from sumtrace.operators.provenance import render
from sumtrace.operators.scaling import measure_descent, random_equations, random_terms
from sumtrace.operators.terms import value
from tests.conftest import term_rows

EPS = 1e-4


def row_reduced_leaks(matrix):
    """Dense elimination: columns that end up alone in a row."""
    m = matrix.astype(float).copy()
    rank = 0
    for column in range(m.shape[1]):
        if rank == len(m):
            break
        best = rank + int(np.argmax(np.abs(m[rank:, column])))
        if abs(m[best, column]) < EPS:
            continue
        m[[rank, best]] = m[[best, rank]]
        m[rank] /= m[rank, column]
        for other in range(len(m)):
            if other != rank:
                m[other] -= m[rank] * m[other, column]
        rank += 1
    return {int(np.argmax(np.abs(r))) for r in m[:rank] if (np.abs(r) > EPS).sum() == 1}


def random_systems(cases, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    for case in range(cases):
        shape = rng.randint(1, 6), rng.randint(1, 8)
        m = np.array([[rng.choice([0, 0, 0, 1, 1, 2, -1, 3]) for _ in range(shape[1])] for _ in range(shape[0])])
        want |= {f"c{case}_{j}" for j in row_reduced_leaks(m)}
        for i, j in zip(*np.nonzero(m)):
            rows.append((f"c{case}.f{i}", f"c{case}_{j}", float(m[i, j])))
    return rows, want


JAC = "fn string, var string, d double"


@pytest.mark.parametrize("dense_cells", [4_000_000, 0])
def test_determined_equals_dense_elimination(spark, dense_cells):
    rows, want = random_systems(120, seed=5)
    jac = spark.createDataFrame(rows, JAC)
    found = determined(jac, dense_cells=dense_cells).collect()
    assert len(found) == len(want) and {r["var"] for r in found} == want
    assert want <= {r["var"] for r in candidates(jac).collect()} | want


LINEAR = {
    "none": [["a", "b"]],
    "a b": [["a", "b"], ["a"]],
    "a": [["a", "b", "c"], ["b", "c"]],
    "a b c": [["a", "b"], ["b", "c"], ["a", "c"]],
    "none again": [["a", "b"], ["c", "d"], ["a", "b", "c", "d"]],
}


@pytest.mark.parametrize("dense_cells", [4_000_000, 0])
@pytest.mark.parametrize("share, wide", [(0.0, 6), (2e-5, 0), (2e-5, 6), (5e-4, 0), (5e-4, 6), (1.0, 6)])
def test_near_the_threshold(spark, dense_cells, wide, share):
    """f1 = a + share * b, f2 = b + c: the verdict on ``a`` is the same whatever solves it, and however
    many more variables hang on ``c``."""
    rows = [("f1", "a", 1.0), ("f2", "b", 1.0), ("f2", "c", 1.0)] + ([("f1", "b", share)] if share else [])
    rows += [(f"g{i}", v, 1.0) for i in range(wide) for v in ("c" if i == 0 else f"v{i}", f"v{i + 1}")]
    found = {r["var"] for r in determined(spark.createDataFrame(rows, JAC), dense_cells=dense_cells).collect()}
    assert found == ({"a"} if share < EPS else set())


@pytest.mark.parametrize("dense_cells", [4_000_000, 0])
def test_many_copies_at_the_threshold(spark, dense_cells):
    """f = a + share * b, g = b + c with null parts from 0.71e-4 to 1.27e-4: all copies get the exact verdict."""
    rows, want = [], set()
    for null in (0.71e-4, 0.85e-4, 0.95e-4, 0.99e-4, 1.01e-4, 1.06e-4, 1.27e-4):
        for i in range(40 if null in (0.85e-4, 1.06e-4) else 5):
            # columns have unit length: b's is about 1, so the null vector is (share, -1, 1)
            share, name = null * 2**0.5, f"{null:.2e}.{i}"
            rows += [(f"{name}.f", f"{name}.a", 1.0), (f"{name}.f", f"{name}.b", share), (f"{name}.g", f"{name}.b", 1.0), (f"{name}.g", f"{name}.c", 1.0)]
            want |= {f"{name}.a"} if null < EPS else set()
    found = {r["var"] for r in determined(spark.createDataFrame(rows, JAC), dense_cells=dense_cells).collect()}
    assert found == want


@pytest.mark.parametrize("dense_cells", [4_000_000, 0])
@pytest.mark.parametrize("share, own, want", [(5e-5, 1, True), (5e-5, 2, True), (5e-5, 30, True), (1.2e-4, 1, True), (1.2e-4, 2, True), (1.2e-4, 3, False), (1.5e-4, 30, False)])
def test_taking_functions_out_leaves_the_verdict(spark, dense_cells, share, own, want):
    """f1 = a + share * b, f2 = b + c1 + c2 + ...: the null part is share * sqrt(n / (n + 1))."""
    rows = [("f1", "a", 1.0), ("f1", "b", share), ("f2", "b", 1.0)] + [("f2", f"c{i}", 1.0) for i in range(own)]
    assert (share * (own / (own + 1)) ** 0.5 < EPS) == want
    found = {r["var"] for r in determined(spark.createDataFrame(rows, JAC), dense_cells=dense_cells).collect()}
    assert found == ({"a"} if want else set())


def test_exact_lengths(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(5, 9)) * (rng.random((5, 9)) < 0.6)
    rows = [(f"f{i}", f"v{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    jac = scaled(spark.createDataFrame(rows, JAC))
    got = {r["var"]: r["length"] for r in exact_lengths(jac, jac.select("var").distinct()).collect()}
    m /= np.linalg.norm(m, axis=0)
    null = np.eye(9) - np.linalg.pinv(m) @ m
    assert all(abs(got[f"v{j}"] - np.linalg.norm(null[j])) < 1e-8 for j in range(9))


def test_shrinking_keeps_what_can_be_determined(spark):
    """Two sums over many rows, one row of which is also in a third function."""
    rows = [(f, f"x{i}", d) for i in range(50) for f, d in (("f", 1.0), ("g", 1.0 + i % 7), ("h", 2.0))]
    rows += [("k", "x1", 1.0), ("k", "y", 1.0), ("l", "y", 1.0), ("l", "x1", -1.0)]
    jac = spark.createDataFrame(rows, JAC)
    assert {r["fn"] for r in shrunk(jac).collect()} == {"k", "l"}
    assert {r["var"] for r in determined(jac).collect()} == {"x1", "y"}


def test_hand_made_releases(spark):
    rows = []
    for name, functions in LINEAR.items():
        for i, variables in enumerate(functions):
            rows += [(f"{name}.{i}", v, "1*v", 1, [(f"{name}_{v}", 2)]) for v in variables]
    rows += [("ab.0", "r", "1*a*b", 1, [("ab_a", 2), ("ab_b", 3)])]
    rows += [("aba.0", "r", "1*a*b", 1, [("aba_a", 2), ("aba_b", 3)])]
    rows += [("aba.1", "r", "1*a", 1, [("aba_a", 2)])]
    found = {r["var"] for r in determined(jacobian(term_rows(spark, rows))).collect()}
    want = {f"{n}_{v}" for n in LINEAR if not n.startswith("none") for v in n.split()}
    assert found == want | {"aba_a", "aba_b"}


def test_incremental_equals_all_at_once(spark):
    rows, want = random_systems(60, seed=9)
    rng = random.Random(3)
    functions = sorted({r[0] for r in rows})
    first = {f for f in functions if rng.random() < 0.5}
    stored = spark.createDataFrame([r for r in rows if r[0] in first], JAC)
    late = spark.createDataFrame([r for r in rows if r[0] not in first], JAC)
    known = determined(stored)
    after = determined_after(known, stored, late).collect()
    assert {r["var"] for r in after} == want
    assert {r["var"] for r in after if not r["is_new"]} == {r["var"] for r in known.collect()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    edges += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    parent = {n: n for n in range(420)}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes = spark.createDataFrame([(n,) for n in parent], "node long")
    got = connected_components(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in parent}


def safe(spark, rows, **kw):
    df = interchange.exchangeable(term_rows(spark, rows), **kw)
    return {r["var"] for r in df.collect() if r["safe"]}


def test_sums_and_products_exchange(spark):
    # a + b*c : b and c only
    rows = [("f", "a", "1*a", 1, [("a", 1)]), ("f", "bc", "1*b*c", 1, [("b", 1), ("c", 1)])]
    assert safe(spark, rows) == {"b", "c"}
    # x + y*z*w
    rows = [("f", "x", "1*x", 1, [("x", 1)])]
    rows += [("f", "yzw", "1*y*z*w", 1, [("y", 1), ("z", 1), ("w", 1)])]
    assert safe(spark, rows) == {"y", "z", "w"}
    # x*(1-y) : neither
    assert safe(spark, [("f", "r", "1*x*(1-y)", 1, [("x", 1), ("y", 1, 1, -1)])]) == set()
    # sum of a*b*c and d*e*f beside x+y+z
    rows = [("f", v, "1*v", 1, [(v, 1)]) for v in "xyz"]
    rows += [("f", "abc", "1*a*b*c", 1, [(v, 1) for v in "abc"])]
    rows += [("f", "def", "1*a*b*c", 1, [(v, 1) for v in "def"])]
    assert safe(spark, rows) == set("xyzabcdef")
    # x^2 + y^3 + z^3
    rows = [("f", v, f"1*v^{p}", 1, [(v, 1, 0, 1, p)]) for v, p in (("x", 2), ("y", 3), ("z", 3))]
    assert safe(spark, rows) == {"y", "z"}


def test_exchange_has_to_hold_in_every_function(spark):
    both = [("f", "a", "1*v", 1, [("a", 1)]), ("f", "b", "1*v", 1, [("b", 1)])]
    assert safe(spark, both) == {"a", "b"}
    one = [("g", "a", "1*v", 1, [("a", 1)])]
    assert safe(spark, both + one) == set()
    apart = [("g", v, "1*v", 1, [(v, 1)]) for v in ("c", "d")]
    assert safe(spark, both + apart) == {"a", "b", "c", "d"}


def test_rows_around_a_shared_variable(spark):
    def line(fn, row, shared):
        return (fn, row, "1*x*p", 1, [(f"x_{row}", 1), (f"p_{shared}", 1)])

    # two lines around p_1, two around p_2, three around p_3
    rows = [line("f", f"{p}{i}", p) for p, n in ((1, 2), (2, 2), (3, 3)) for i in range(n)]
    want = {f"x_{p}{i}" for p, n in ((1, 2), (2, 2), (3, 3)) for i in range(n)}
    assert safe(spark, rows) == want | {"p_1", "p_2"}
    shapes = interchange.join_groups(term_rows(spark, rows)).collect()
    assert {(r["shape"], r["groups"]) for r in shapes} == {("1x1 2x1", 2), ("1x1 3x1", 1)}


def test_render_splits_large_functions(spark):
    rows = [("big", str(i), "1*v", 1, [(f"v_{i}", 1)]) for i in range(500)]
    rows += [("twice", "1", "1*v*(100-w)", 1, [("v_1", 1), ("w_1", 1, 100, -1)])] * 2
    out = render(term_rows(spark, rows), size=50).collect()
    assert [r.formula for r in out if r.fn == "twice"] == ["(2*(v_1*(100-w_1)))"]
    pieces = [r for r in out if r.fn == "big"]
    assert len(pieces) == pieces[0].pieces == 10
    names = [t for r in pieces for t in r.formula[1:-1].split("+")]
    assert sorted(names) == sorted(f"(v_{i})" for i in range(500))
    assert max(len(r.formula.split("+")) for r in pieces) < 100


def test_gradient_descent_equals_numpy(spark):
    # x1 + x2 = 3, 3*x1^2 + x2^2 = 13, x1*x2 = 2
    rows = [
        ("e1", "1", "s", 1, [("x_1", 0)]),
        ("e1", "2", "s", 1, [("x_2", 0)]),
        ("e2", "1", "s", 3, [("x_1", 0, 0, 1, 2)]),
        ("e2", "2", "s", 1, [("x_2", 0, 0, 1, 2)]),
        ("e3", "1", "s", 1, [("x_1", 0), ("x_2", 0)]),
    ]
    terms = term_rows(spark, rows)
    targets = spark.createDataFrame([("e1", 3.0), ("e2", 13.0), ("e3", 2.0)], "fn string, target double")
    start = {r["var"]: r["x"] for r in reconstruct.start_values(terms).collect()}
    assert all(abs(x) <= 0.1 for x in start.values())
    x = np.array([start["x_1"], start["x_2"]])
    losses = []
    for _ in range(6):
        f = np.array([x[0] + x[1] - 3, 3 * x[0] ** 2 + x[1] ** 2 - 13, x[0] * x[1] - 2])
        grads = np.array([[1, 1], [6 * x[0], 2 * x[1]], [x[1], x[0]]])
        g = 2 * f @ grads
        losses.append(f @ f)
        norm = np.linalg.norm(g)
        x = np.clip(x - 0.5 * g * min(1, 1 / norm), -10, 10)
    state, history = reconstruct.descend(terms, targets, rounds=6, rate=0.5)
    assert np.allclose([h[1] for h in history], losses)
    got = {r["var"]: r["x"] for r in state.collect()}
    assert np.allclose([got["x_1"], got["x_2"]], x)


EQUATIONS = [
    ("e1", "1", "s", 1, [("x_1", 0)]),
    ("e1", "2", "s", 1, [("x_2", 0)]),
    ("e2", "1", "s", 3, [("x_1", 0, 0, 1, 2)]),
    ("e2", "2", "s", 1, [("x_2", 0, 0, 1, 2)]),
    ("e3", "1", "s", 1, [("x_1", 0), ("x_2", 0)]),
]


def test_equations_are_solved_to_the_end(spark):
    terms = term_rows(spark, EQUATIONS)
    targets = spark.createDataFrame([("e1", 3.0), ("e2", 7.0), ("e3", 2.0)], "fn string, target double")
    found = reconstruct.solve(terms, targets, tol=1e-12)
    x = {r["var"]: r["x"] for r in found.state.collect()}
    assert abs(x["x_1"] - 1) < 1e-5 and abs(x["x_2"] - 2) < 1e-5
    losses = [loss for _, loss in found.history]
    assert losses[-1] < 1e-12 and losses == sorted(losses, reverse=True) and len(losses) < 30
    assert all(abs(r["f"]) < 1e-6 for r in found.residuals.collect())


def test_what_cannot_be_solved_ends_at_the_least_loss(spark):
    # x1 + x2 = 3, 3*x1^2 + x2^2 = 30, x1*x2 = 2 contradict one another
    terms = term_rows(spark, EQUATIONS)
    targets = spark.createDataFrame([("e1", 3.0), ("e2", 30.0), ("e3", 2.0)], "fn string, target double")
    found = reconstruct.solve(terms, targets)
    losses = [loss for _, loss in found.history]
    assert losses[-1] > 1e-6 and losses == sorted(losses, reverse=True)
    assert np.isclose(sum(r["f"] ** 2 for r in found.residuals.collect()), losses[-1])


def test_a_broken_off_run_goes_on_from_its_last_round(spark, tmp_path):
    terms = term_rows(spark, EQUATIONS)
    targets = spark.createDataFrame([("e1", 3.0), ("e2", 7.0), ("e3", 2.0)], "fn string, target double")
    folder = str(tmp_path / "rounds")
    first = reconstruct.solve(terms, targets, tol=1e-1, folder=folder)
    (tmp_path / "rounds" / "round=99").mkdir()  # begun, not finished
    second = reconstruct.solve(terms, targets, tol=1e-10, folder=folder)
    assert second.history[0] == first.history[-1] and second.history[-1][1] < 1e-10


def test_the_shortest_step_equals_numpy(spark):
    r = np.random.Generator(np.random.PCG64(4))
    d = np.where(r.random((6, 15)) < 0.4, r.normal(size=(6, 15)), 0)
    d[:, 0] = 1.0
    f = r.normal(size=6)
    jac = spark.createDataFrame([(f"f{i}", f"v{j}", float(d[i, j])) for i in range(6) for j in range(15) if d[i, j]], "fn string, var string, d double")
    off = spark.createDataFrame([(f"f{i}", float(f[i])) for i in range(6)], "fn string, f double")
    got = {x["var"]: x["w"] for x in reconstruct.shortest_step(jac, off).collect()}
    w = np.array([got.get(f"v{j}", 0.0) for j in range(15)])
    assert np.linalg.norm(d.T @ (d @ w + f)) <= 0.011 * np.linalg.norm(d.T @ f)
    assert np.linalg.norm(w + np.linalg.pinv(d) @ f) < 0.1 * np.linalg.norm(w)


def test_random_functions_derivatives(spark):
    terms = random_terms(spark, 40, 3)
    assert terms.count() == 120
    jac = jacobian(terms)
    x = {}
    pdf = terms.withColumn("value", value()).toPandas()
    for i in (1, 2, 3):
        used = pdf.dropna(subset=[f"var_{i}"])
        x |= dict(zip(used[f"var_{i}"], used[f"x_{i}"]))

    def evaluate(at):
        out = {}
        for r in pdf.to_dict("records"):
            v = r["coef"]
            for i in (1, 2, 3):
                if isinstance(r[f"var_{i}"], str):
                    v *= (r[f"shift_{i}"] + at[r[f"var_{i}"]]) ** r[f"pow_{i}"]
            out[r["fn"]] = out.get(r["fn"], 0.0) + v
        return out

    assert np.isclose(sum(evaluate(x).values()), pdf["value"].sum())
    got = {(r["fn"], r["var"]): r["d"] for r in jac.collect()}
    for var in sorted(x)[:5]:
        up, down = dict(x), dict(x)
        up[var] += 1e-6
        down[var] -= 1e-6
        hi, lo = evaluate(up), evaluate(down)
        for fn in hi:
            assert np.isclose((hi[fn] - lo[fn]) / 2e-6, got.get((fn, var), 0.0), atol=1e-4)


def test_random_equations(spark):
    rows = random_equations(spark, 12, 4).collect()
    assert len([r for r in rows if r["shape"] == "linear"]) == 48
    assert all(abs(r["coef"]) <= 0.1 for r in rows)
    assert all(r["var_1"] != r["var_2"] for r in rows if r["shape"] == "cross")
    assert {r["pow_1"] for r in rows if r["shape"] == "power"} <= {2, 3}
    result = measure_descent(spark, 12, 4, 2)
    assert result["rounds"] <= 2 and result["loss"] >= 0
