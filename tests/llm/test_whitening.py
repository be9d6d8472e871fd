from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from gridtide.llm import queries, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("x", "string").add("n", "string")


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "extra", "n") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def brute_force(vectors, components=4):
    """{(vec_id, component): (n, deviation, whitened, explained)} in plain float64 and exact integers."""
    usable = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}), dtype=np.float64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    found = []
    for i, x in usable:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        for k in range(min(components, len(values))):
            if values[k] > 1e-9 * values.sum():
                found.append((i, k + 1, n, deviation, (x - sums / n) @ directions[:, k] / np.sqrt(values[k]), values[k] / values.sum()))
    return found


def compare(rows, wanted):
    assert [tuple(r)[:4] for r in rows] == [w[:4] for w in wanted]
    found, right = np.array([r.whitened for r in rows]), np.array([w[4] for w in wanted])
    component = np.array([w[1] for w in wanted])
    for k in set(component.tolist()):  # either sign, the same for all rows
        a, b = found[component == k], right[component == k]
        assert np.abs(a - np.sign(a @ b) * b).max() < 1e-9 * max(1, np.abs(b).max())
    assert np.allclose([r.explained for r in rows], [w[5] for w in wanted], rtol=1e-10)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_awkward_rows_equal_brute_force(spark):
    draw = np.random.default_rng(1)
    vectors = [(i, (draw.normal(size=6) * [3, 2, 1, 1, 0.5, 0.1] + 40).astype(np.float32).tolist()) for i in range(200)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(100)] + [vectors[5], vectors[5], (None, vectors[7][1])]
    vectors += [(2000, None), (2001, []), (2002, [1.0, None, 1, 1, 1, 1]), (2003, [float("nan")] + [1] * 5), (2004, [float("inf")] + [1] * 5), (2005, [-0.0] * 6)]
    rows = whitening.whitened(frame(spark, vectors + [(3000, [1.0, 2.0])]).repartition(5)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    compare(sorted(rows, key=key), sorted(brute_force(vectors), key=key))


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, 0.25, 1.0]) for i in range(9)]])
def test_tables_without_variance_give_no_rows(spark, vectors):
    found = whitening.whitened(frame(spark, vectors))
    assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_few_directions(spark):
    draw = np.random.default_rng(2)
    vectors = [(i, [a, 2 * a, b, 0.0]) for i, (a, b) in enumerate(draw.integers(-9, 9, size=(60, 2)).tolist())]
    rows = whitening.whitened(frame(spark, vectors)).collect()
    assert {r.component for r in rows} == {1, 2}
    compare(sorted(rows), sorted(brute_force(vectors)))


def test_large_entries_are_exact(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, v.tolist()) for i, v in enumerate((draw.normal(size=(50, 3)) * 3e5 + 1e6).astype(np.float32))]
    fit = whitening.distinct_vectors(whitening.integer_vectors(frame(spark, vectors)))
    n, sums, centre, products = whitening.moments(fit)
    rows = [tuple(int(np.floor(256 * np.float64(np.float32(c)))) for c in v) for _, v in vectors]
    assert (n, sums) == (50, [sum(column) for column in zip(*rows)])
    covariance = whitening.exact_covariance(n, sums, centre, products)
    for i in range(3):
        for j in range(3):
            exact = sum((r[i] - Fraction(sums[i], n)) * (r[j] - Fraction(sums[j], n)) for r in rows) / n
            assert abs(Fraction(float(covariance[i, j])) - exact) <= abs(exact) * Fraction(1, 2**52)


def _spread(values, seed=0):
    draw = np.random.default_rng(seed)
    basis = np.linalg.qr(draw.normal(size=(len(values), len(values))))[0]
    matrix = basis @ np.diag(values) @ basis.T
    return (matrix + matrix.T) / 2, basis


@pytest.mark.parametrize(
    "values",
    [
        np.geomspace(1, 1e-3, 40), [5, 5 - 1e-7, 5 - 2e-7, 4, 3, 3 - 1e-9, 1, 0.5], [2, 2, 2, 1, 1, 0.1, 0, 0], [1.0], [1e-30, 1e-31, 3e-32],
        np.concatenate([1 + np.arange(10) * 1e-8, 2 + np.arange(10) * 1e-10, np.arange(3, 20)])[::-1],
    ],
)
def test_refinement_reaches_double_precision(values):
    values = np.sort(np.array(values, dtype=float))[::-1]
    matrix, _ = _spread(values)
    found, vectors = whitening.refined_eigenvectors(matrix)
    scale = np.abs(values).max()
    assert np.abs(found - values).max() < 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * scale


def test_float32_alone_would_not_do():
    matrix, _ = _spread([5, 5 - 1e-7, 5 - 2e-7, 4, 3, 3 - 1e-9, 1, 0.5])
    rough = np.linalg.eigh(matrix.astype(np.float32))[1].astype(np.float64)
    assert np.abs(matrix @ rough - rough * np.diag(rough.T @ matrix @ rough)).max() > 1e-8


def test_extended_correction_improves_close_vectors():
    values = np.array([3.0, 3 - 1e-5, 2, 1])
    matrix, _ = _spread(values)
    wide = matrix.astype(np.longdouble)
    rough, vectors = whitening.refined_eigenvectors(matrix)
    found, head = whitening.extended_correction(wide, rough, vectors, 3)
    assert np.abs(wide @ head - head * found).max() < 1e-18
    assert np.abs(head.T @ head - np.eye(3)).max() < 1e-17


def test_query_equals_brute_force(spark):
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    rows = queries.QUERIES["op12_embedding_whitening"](spark, SF).collect()
    compare(sorted(rows, key=lambda r: r[:2]), sorted(brute_force(vectors), key=lambda r: r[:2]))
