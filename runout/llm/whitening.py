"""Whitening of embeddings: covariance over all vectors, its eigenvectors, and every vector's projections.

A number ``c`` of a vector becomes the long ``x = floor(SCALE * c) + OFFSET``. Count and sums of the x are
exact longs. The scatter matrix is summed from centred products, a block of rows at a time in the tasks and
then by Spark per entry of the matrix, so that what reaches the driver is one matrix, whatever the rows.

The matrix is taken apart on the driver. A Cholesky factorisation, at each step on the largest diagonal entry
left, gives a triangular factor G with as many columns as the scatter has rank. One-sided Jacobi rotations
turn pairs of columns of G until all are orthogonal; the squared norms of the columns are then the eigenvalues
and the normalised columns the eigenvectors. Pairs are taken by a round-robin, so that the pairs of one round
share no column and are rotated at once.

Defined results: vectors that are null, hold a null or a number that is not finite, or whose x would not fit
a long exactly, are dropped; of vectors of several lengths those of the most frequent length (of equally
frequent ones the longest) are kept, the others lack numbers or have too many; repeated rows and ids count as
often as they occur; components without variance are not returned, so a table of equal vectors, of one
vector or of none gives no rows; equal eigenvalues are numbered by the first dimension of largest weight; extra
columns are not read. A deviation that a long cannot hold is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runout.llm.common import arrow_schema, ship

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Jacobi stops when no two columns' cosine exceeds this, or after so many rounds over all pairs.
TOLERANCE = 1e-15
SWEEPS = 60

Block = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Model:
    n: int
    sums: np.ndarray  # longs, per dimension
    values: np.ndarray  # eigenvalues of the covariance, falling; as many as it has rank
    vectors: np.ndarray  # dimensions x eigenvalues
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return x * self.n - self.sums

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        shown = min(components, len(self.values))
        return (self.centred(x) / self.n) @ (self.vectors[:, :shown] / np.sqrt(self.values[:shown]))


def usable(vectors: DataFrame, column: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, vector) of the vectors that count, all of one length."""
    most = float(2**52 // SCALE)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    # no null, NaN or infinity is less than a number
    rows = rows.where(F.forall("vector", lambda c: F.abs(c) < most))
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count()
    best = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("vector") == (best["size"] if best else -1))


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    """The x of a batch of usable vectors."""
    column = batch.column(batch.schema.names.index("vector"))
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.floor(flat * SCALE).astype(np.int64) + OFFSET


def _sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums of the x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for batch in batches:
            if batch.num_rows:
                total, n = total + _numbers(batch).sum(axis=0), n + batch.num_rows
        if n:
            places = pa.array(np.arange(len(total), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [places, pa.array(total), pa.array(np.full(len(total), n))], names=["place", "total", "n"]
            )

    parts = rows.select("vector").mapInArrow(run, "place int, total long, n long")
    found = parts.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: r.place)
    return (found[0].n if found else 0), np.array([r.total for r in found], np.int64)


def _products(rows: DataFrame, block: Block, size: int, products: bool = True) -> np.ndarray:
    """Sums over all rows of what ``block`` makes of their x, or of its products with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size) if products else (1, size))
        for batch in batches:
            if batch.num_rows:
                found = block(_numbers(batch))
                total += found.T @ found if products else found.sum(axis=0)
        places = pa.array(np.arange(total.size))
        yield pa.RecordBatch.from_arrays([places, pa.array(total.ravel())], names=["place", "total"])

    parts = rows.select("vector").mapInArrow(run, "place long, total double")
    found = parts.groupBy("place").agg(F.sum("total").alias("total")).collect()
    out = np.zeros((size, size) if products else (1, size))
    out.ravel()[[r.place for r in found]] = [r.total for r in found]
    return out


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """G with G G' = scatter, a lower triangle but for the order of its rows; one column per rank."""
    rest = scatter.astype(np.float64).copy()
    d = len(rest)
    least = d * np.finfo(np.float64).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    left = np.ones(d, bool)
    for _ in range(d):
        pivots = np.where(left, rest.diagonal(), -np.inf)
        p = int(pivots.argmax())
        if not pivots[p] > least:
            break
        column = np.where(left, rest[:, p], 0.0) / np.sqrt(rest[p, p])
        columns.append(column)
        rest -= np.outer(column, column)
        left[p] = False
    return np.stack(columns, axis=1) if columns else np.zeros((d, 0))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns, in rounds of pairs that share none."""
    places = list(range(n + n % 2))
    for _ in range(len(places) - 1):
        half = len(places) // 2
        pairs = [(a, b) for a, b in zip(places[:half], places[: half - 1 : -1], strict=True) if max(a, b) < n]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        places = [places[0], places[-1], *places[1:-1]]


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of ``factor @ factor.T``."""
    g = factor.copy()
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in _rounds(g.shape[1]):
            a, b = g[:, i], g[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            cosine = np.abs(ab) / np.sqrt(aa * bb)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > TOLERANCE
            zeta = (bb - aa) / np.where(turn, 2 * ab, 1.0)
            sign = np.where(zeta >= 0, 1.0, -1.0)
            t = np.where(turn, sign / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, i], g[:, j] = c * a - c * t * b, c * t * a + c * b
        if worst <= TOLERANCE:
            break
    norms = np.sqrt((g * g).sum(axis=0))
    vectors = g / norms if g.size else g
    order = np.lexsort((np.abs(vectors).argmax(axis=0), -norms)) if g.size else np.zeros(0, int)
    return norms[order] ** 2, vectors[:, order]


def fit(rows: DataFrame) -> Model:
    """The model of usable vectors."""
    ship(rows.sparkSession)
    n, sums = _sums(rows)
    if not n:
        return Model(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    scatter = _products(rows, lambda x: (x * n - sums) / n, len(sums))
    values, vectors = jacobi(pivoted_cholesky((scatter + scatter.T) / 2))
    return Model(n, sums, values / n, vectors, float(np.trace(scatter)) / n)


def identity_error(rows: DataFrame, model: Model, components: int = COMPONENTS) -> float:
    """The largest entry of the whitened rows' covariance, measured over all of them, less the identity."""
    shown = min(components, len(model.values))
    if not shown:
        return 0.0
    mean = _products(rows, lambda x: model.whiten(x, components), shown, products=False)[0] / model.n
    covariance = _products(rows, lambda x: model.whiten(x, components) - mean, shown) / model.n
    return float(np.abs(covariance - np.eye(shown)).max())


def whiten(rows: DataFrame, model: Model, components: int = COMPONENTS) -> DataFrame:
    """Per usable vector: vec_id, deviation (sum of squares of n * x - S) and whitened, an array by component."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    ddl = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch)
            apart = m.centred(x)
            if (apart.astype(np.float64) ** 2).sum(axis=1).max() >= 2.0**63:
                raise OverflowError("deviation exceeds a long")
            white = m.whiten(x, components)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * white.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(white.ravel()))
            columns = [batch.column(0), pa.array((apart * apart).sum(axis=1)), lists]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return rows.mapInArrow(run, ddl)


def whiten_table(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(vectors)
    model = fit(rows)
    error = identity_error(rows, model, components)
    shares = [float(v / model.trace) for v in model.values[:components]]
    explained = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    return whiten(rows, model, components).select(
        "vec_id",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.lit(error).alias("identity_error"),
        explained.alias("shares"),
        F.posexplode("whitened").alias("place", "whitened"),
    ).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("shares", F.col("place")).alias("explained"),
        "identity_error",
    )
