"""Whitening of embeddings: exact distributed covariance, eigenvectors by mixed-precision refinement.

Entries become integers (floor of 256 times the entry), and every distinct vector counts once. Tasks centre vectors
by the integers nearest to the means, multiply, and add up integers; the remainder of the centring, under half a
unit, is taken off in integers as well, so that the covariance is exact before it is rounded once.

Eigenvectors come from a float32 solver and are corrected by Ogita-Aishima iterations, which are a few products of
matrices in float64: from X'X and X'AX follow better eigenvalues and a first-order correction of X, and the error
is squared each time. Where eigenvalues lie closer together than the iteration can tell apart, the block of their
vectors is solved by itself after shifting the matrix by their mean, which makes the small differences large. The
wanted vectors get a last correction in extended precision. All of this takes place on one matrix with as many rows
as a vector has entries, whatever the number of vectors is.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridtide.functions.sizes import cut_lineage

SCALE = 256.0
COMPONENTS = 4
#: Components whose eigenvalue is below this share of the trace count as directions without variance.
LEAST_SHARE = 1e-12
STEPS = 20


# ---- eigenvectors -------------------------------------------------------------------------------------------


def _runs(values, width):
    """(start, end) of runs of at least two values, sorted falling, whose neighbours differ by at most `width`."""
    breaks = np.flatnonzero(-np.diff(values) > width) + 1
    edges = [0, *breaks.tolist(), len(values)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1]


def _orthonormal(vectors):
    """Nearly orthonormal columns with the square of their error."""
    return vectors + vectors @ (np.eye(len(vectors)) - vectors.T @ vectors) / 2


def _improved(matrix, vectors):
    """(eigenvalues, corrected vectors, distance below which eigenvalues count as one cluster)."""
    lack = np.eye(len(matrix)) - vectors.T @ vectors
    image = vectors.T @ matrix @ vectors
    image = (image + image.T) / 2  # a rounding error over a small gap must turn vectors, not skew them
    values = np.diag(image) / (1 - np.diag(lack))
    size = np.linalg.norm(matrix)
    close = 2 * (np.linalg.norm(image - np.diag(values)) + size * np.linalg.norm(lack)) + 8 * np.finfo(float).eps * len(matrix) * size
    gaps = values[None, :] - values[:, None]
    near = np.abs(gaps) <= close
    change = np.where(near, lack / 2, (image + values[None, :] * lack) / np.where(near, 1.0, gaps))
    vectors = vectors + vectors @ change
    return values, _orthonormal(vectors), close


def _sub_solved(matrix, values, vectors, close):
    """Vectors sorted by falling eigenvalue, those of every cluster rotated by the solution of their shifted block."""
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order].copy()
    for a, b in _runs(values, close):
        block, middle = vectors[:, a:b], values[a:b].mean()
        small = block.T @ (matrix @ block - middle * block)
        inner = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
        vectors[:, a:b] = block @ inner
    return vectors


def refined_eigenvectors(matrix, steps=STEPS):
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric float64 matrix, from a float32 solution.

    Iterations end when the corrections stop to shrink. Among equal eigenvalues any orthonormal basis is right.
    """
    size = np.abs(matrix).max(initial=0.0)
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    scaled = matrix / size
    values, vectors = np.linalg.eigh(scaled.astype(np.float32))
    vectors, least, idle = vectors[:, ::-1].astype(np.float64), np.inf, 0
    for _ in range(steps):
        values, vectors, close = _improved(scaled, vectors)
        vectors = _orthonormal(_sub_solved(scaled, values, vectors, close))
        least, idle = min(least, close), 0 if close < least / 2 else idle + 1
        if idle == 2:
            break
    return np.diag(vectors.T @ scaled @ vectors) * size, vectors / np.linalg.norm(vectors, axis=0)


def extended_correction(matrix, rough, vectors, wanted):
    """The first `wanted` vectors after one correction in extended precision, as (eigenvalues, vectors) in it.

    `matrix` is in extended precision, `rough` are the eigenvalues known so far. Only products with the wanted columns are needed. Directions that the
    correction would turn by more than a millionth belong to the same eigenvalue and are left to the sub-solve.
    """
    wide = vectors.astype(np.longdouble)
    head = wide[:, :wanted]
    images = matrix @ head
    lack = np.eye(len(matrix), wanted, dtype=np.longdouble) - wide.T @ head
    image = wide.T @ images
    image[:wanted] = (image[:wanted] + image[:wanted].T) / 2
    values = np.diag(image) / (1 - np.diag(lack))
    every = np.concatenate([values, rough[wanted:]])
    gaps = values[None, :] - every[:, None]
    same = gaps == 0
    change = (image + values[None, :] * lack) / np.where(same, 1, gaps)
    change = np.where(same | (np.abs(change) > 1e-6), lack / 2, change)
    head = head + wide @ change
    head = head / np.sqrt((head * head).sum(axis=0))
    return np.einsum("ij,ij->j", head, matrix @ head), head


# ---- distributed moments ------------------------------------------------------------------------------------


def integer_vectors(embeddings):
    """(vec_id, x) of rows whose vector has entries and none that is null or not finite; x are whole numbers."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(F.lit(SCALE) * c.cast("double")))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite
    return embeddings.where(usable).select("vec_id", whole.alias("x"))


def distinct_vectors(vectors):
    """Each distinct vector once, of the length that most rows have (the larger one on a tie)."""
    lengths = vectors.groupBy(F.size("x").alias("d")).count()
    most = lengths.agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    return vectors.where(F.size("x") == (most["d"] if most else 0)).select("x").distinct()


def _blocks(batches, most=4096):
    """Integer matrices of the vectors of a task."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            column = batch.column("x").slice(start, most)
            yield column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(batches):
    total, n = 0, 0
    for block in _blocks(batches):
        total, n = total + block.astype(object).sum(axis=0), n + len(block)
    if n:
        arrays = [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total.tolist(), pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(arrays, ["i", "n", "s"])


def _product(block):
    """block' block in exact integers."""
    largest = int(np.abs(block).max(initial=0))
    if largest * largest * len(block) < 1 << 53:  # every sum is a whole number that float64 holds
        return (block.astype(np.float64).T @ block.astype(np.float64)).astype(np.int64).astype(object)
    return block.T.astype(object) @ block.astype(object)


def _multiplied(centre):
    def multiply(batches):
        total = 0
        for block in _blocks(batches):
            total = total + _product(block - centre)
        if isinstance(total, np.ndarray):
            for i, row in enumerate(total):
                arrays = [pa.array([i], pa.int32()), pa.array([row[: i + 1].tolist()], pa.list_(pa.decimal128(38, 0)))]
                yield pa.RecordBatch.from_arrays(arrays, ["i", "products"])

    return multiply


def moments(fit_list):
    """(n, sums, centre, products) of stored integer vectors, all exact.

    `products` are the sums over the vectors of (x - centre) (x - centre)' for whole numbers nearest to the means.
    Partial sums are added per entry by Spark; the driver gets one row per entry of a vector.
    """
    sums = fit_list.mapInArrow(_summed, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = sorted((row["i"], row["n"], int(row["s"])) for row in sums.collect())
    if not rows:
        return 0, [], [], None
    n, sums = rows[0][1], [s for _, _, s in rows]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    partial = fit_list.mapInArrow(_multiplied(centre), "i int, products array<decimal(38,0)>")
    cells = partial.select("i", F.posexplode("products").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    lines = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("line"))
    products = np.zeros((len(sums), len(sums)), dtype=object)
    for row in lines.toLocalIterator():
        for j, v in row["line"]:
            products[row["i"], j] = products[j, row["i"]] = int(v)
    return n, sums, centre, products


def exact_covariance(n, sums, centre, products):
    """The covariance with divisor n in extended precision, rounded once per entry."""
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], dtype=object)
    scaled = n * products - np.outer(rest, rest)
    d = len(sums)
    return np.array([np.longdouble(str(v)) for v in scaled.ravel()]).reshape(d, d) / np.longdouble(n) / np.longdouble(n)


# ---- model --------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What projects vectors: n and sums of the fit list, components as columns, their eigenvalues, the trace."""

    n: int
    sums: list
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, block):
        """The sum of squares of n x - S of every vector, as whole numbers; beyond 63 bits this raises."""
        reach = self.n * int(np.abs(block).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if reach * reach * len(self.sums) < 1 << 63 else object
        moved = block.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return moved, (moved * moved).sum(axis=1)

    def project(self, block):
        """(deviations, whitened components) of integer vectors."""
        moved, deviations = self.deviations(block)
        return deviations, (moved.astype(np.float64) / self.n) @ (self.directions / np.sqrt(self.values))


def fit_whitening(fit_list, components=COMPONENTS):
    """The model of stored distinct vectors; it has fewer components where the vectors span fewer directions."""
    n, sums, centre, products = moments(fit_list)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    covariance = exact_covariance(n, sums, centre, products)
    trace = float(np.trace(covariance))
    rough, vectors = refined_eigenvectors(covariance.astype(np.float64))
    wanted = min(components, len(sums))
    values, head = extended_correction(covariance, rough, vectors, wanted)
    used = int((values > LEAST_SHARE * trace).sum()) if trace > 0 else 0
    values, head = values[:used].astype(np.float64), head[:, :used].astype(np.float64)
    if used:  # the entry with the largest size is positive
        head = head * np.sign(head[np.abs(head).argmax(axis=0), np.arange(used)])
    return Whitening(n, sums, head, values, trace)


def identity_error(fit_list, model):
    """Largest entry of the whitened fit list's covariance minus the identity, by size."""
    used = len(model.values)

    def project(batches):
        for block in _blocks(batches):
            whitened = model.project(block)[1]
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in whitened.T], [f"w{i}" for i in range(used)])

    rows = fit_list.mapInArrow(project, ", ".join(f"w{i} double" for i in range(used)))
    pairs = [(i, j) for i in range(used) for j in range(i + 1)]
    found = rows.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def whitened(embeddings, components=COMPONENTS):
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows are dropped whose vector is null or empty, holds a null or non-finite entry, or has another length than
    most rows. A null vec_id stays. Repeated rows are fitted once and returned as often as they occur; extra columns
    are ignored. Directions without variance give no component, so a table of equal vectors, as an empty one,
    gives no rows. Entries too large for exact deviations in 64 bits raise an error.
    """
    vectors = integer_vectors(embeddings.select("vec_id", "embedding"))
    fit_list = cut_lineage(distinct_vectors(vectors))
    model = fit_whitening(fit_list, components)
    used, d = len(model.values), len(model.sums)
    schema = vectors.select(
        "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
        *[F.lit(0.0).alias(name) for name in ("whitened", "explained", "identity_error")],
    ).schema
    if not used:
        return embeddings.sparkSession.createDataFrame([], schema)
    error, explained = identity_error(fit_list, model), model.values / model.trace
    arrow = to_arrow_schema(schema)

    def emit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            deviations, values = model.project(block)
            size = batch.num_rows * used
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(batch.num_rows), used))), np.tile(np.arange(1, used + 1), batch.num_rows),
                np.full(size, model.n), np.repeat(deviations, used).tolist(), values.ravel(), np.tile(explained, batch.num_rows), np.full(size, error),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return vectors.where(F.size("x") == d).mapInArrow(emit, schema)
