"""Whitening of embeddings by the leading eigenvectors of their covariance.

Spark makes the whole numbers, the list of distinct vectors, their sums and their
covariance, a matrix of the number of dimensions. The eigenpairs of that small matrix are
found by FEAST: the resolvent, integrated over a circle around an interval, projects onto
the eigenvectors inside; the Rayleigh-Ritz step takes them from the projection; and the
inertia of the shifted matrix tells how many there must be, so none can be missed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesselflow.llm.common import stored, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Nodes of the quadrature on a half circle, passes of the iteration, eigenvalues of an interval at most.
NODES, PASSES, CROWD = 8, 40, 8
#: An eigenvalue below this share of the largest one is taken for zero: in double precision
#: its own error would be as large as a ten thousandth of it.
ZERO = 1e-12
#: Entries beyond would not fit a long after scaling.
MOST_ENTRY = float(2**62 // SCALE)


def inertia(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, by its block LDL' factors.

    Pivots are single entries or blocks of two, the larger of both (complete pivoting), so
    by Sylvester's law the signs of the pivots are those of the eigenvalues."""
    a, positive = np.array(matrix, dtype=float), 0
    bound = (1 + 17**0.5) / 8
    while len(a):
        i = int(np.argmax(np.abs(np.diag(a))))
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = np.unravel_index(int(np.argmax(off)), off.shape)
        if abs(a[i, i]) == 0 and off[r, s] == 0:
            break
        if abs(a[i, i]) >= bound * off[r, s]:
            chosen, block = [i], a[i : i + 1, i : i + 1]
            positive += int(a[i, i] > 0)
        else:
            chosen = [int(r), int(s)]
            block = a[np.ix_(chosen, chosen)]
            # A block of two is chosen only where its determinant is negative: one of each sign.
            positive += 1
        rest = np.setdiff1d(np.arange(len(a)), chosen)
        column = a[np.ix_(rest, chosen)]
        a = a[np.ix_(rest, rest)] - column @ np.linalg.solve(block, column.T)
        a = (a + a.T) / 2
    return positive


def above(matrix: np.ndarray, border: float) -> int:
    """Number of eigenvalues above a border."""
    return inertia(matrix - border * np.eye(len(matrix)))


def _intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that hold the ``wanted`` largest eigenvalues.

    An interval is halved, the upper half first, until it has at most :data:`CROWD`
    eigenvalues by inertia or is so narrow that double precision does not part them.
    """
    reach = float(np.max(np.sum(np.abs(matrix), axis=1))) * (1 + 1e-9) + 1e-300
    floor = reach * 1e-14
    found: list[tuple[float, float, int]] = []
    waiting = [(-floor, reach, len(matrix), 0)]
    taken = 0
    while waiting and taken < wanted:
        low, high, over_low, over_high = waiting.pop()
        inside = over_low - over_high
        if not inside:
            continue
        if found and high <= ZERO * found[0][0]:
            break  # all that is left counts as zero, be it a thousand eigenvalues
        if inside <= CROWD and (over_low <= wanted + CROWD) or high - low <= 4 * floor:
            found.append((low, high, inside))
            taken += inside
            continue
        middle = (low + high) / 2
        over = above(matrix, middle)
        # The upper half is looked at first.
        waiting += [(low, middle, over_low, over), (middle, high, over, over_high)]
    return found


def feast(matrix: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenpairs between two borders, by contour integration.

    The quadrature of (zI - V)^-1 Y over the circle through both borders filters a random
    block Y; its orthonormal basis is projected (Rayleigh-Ritz) and filtered again until
    the residuals stand still at rounding. ``inside`` comes from the inertia counts: a
    basis that holds fewer values between the borders is widened and filtered anew."""
    size, scale = len(matrix), float(np.linalg.norm(matrix, 2 if len(matrix) <= 64 else "fro")) or 1.0
    random = np.random.default_rng(11)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    # An eigenvalue at a border still lies inside a circle a little wider than the interval.
    centre, radius = (low + high) / 2, (high - low) / 2 * 1.02
    angles = np.pi / 2 * (1 - points)
    shifts = [centre + radius * np.exp(1j * angle) for angle in angles]
    width = min(size, max(inside + 4, 3 * inside // 2))
    while True:
        basis = random.standard_normal((size, width))
        last, values, vectors = np.inf, np.zeros(0), np.zeros((size, 0))
        for _ in range(PASSES):
            filtered = np.zeros((size, width))
            for angle, weight, shift in zip(angles, weights, shifts, strict=True):
                solved = np.linalg.solve(shift * np.eye(size) - matrix, basis.astype(complex))
                filtered += weight / 2 * np.real(radius * np.exp(1j * angle) * solved)
            basis = np.linalg.qr(filtered)[0]
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            basis = basis @ turn
            chosen = (values > low) & (values <= high)
            vectors = basis[:, chosen]
            residual = np.linalg.norm(matrix @ vectors - vectors * values[chosen], axis=0).max(initial=0) / scale
            if chosen.sum() == inside and (residual <= 4e-16 * size or residual >= last / 2 and residual <= 1e-12):
                return values[chosen], vectors
            last = residual if chosen.sum() == inside else np.inf
        if width == size:
            # Values within rounding of a border may stand on its other side.
            nearest = np.argsort(np.maximum(np.maximum(low - values, values - high), 0), kind="stable")[:inside]
            return values[nearest], basis[:, nearest]
        width = min(size, 2 * width)


def leading(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns.

    At most ``wanted``, without those that are zero. The vectors of all intervals are made
    orthogonal by one more Rayleigh-Ritz step over them. Equal eigenvalues come in any
    order with any basis of their space."""
    if not len(matrix) or not np.any(matrix):
        return np.zeros(0), np.zeros((len(matrix), 0))
    pairs = [feast(matrix, *interval) for interval in _intervals(matrix, min(wanted, len(matrix)))]
    basis = np.linalg.qr(np.concatenate([v for _, v in pairs], axis=1))[0]
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], basis @ turn[:, order]
    kept = values > ZERO * values[0]
    if above(matrix, float(values[-1]) * (1 - 1e-9) - 1e-12 * float(values[0])) < len(values):
        raise ArithmeticError("the inertia counts fewer eigenvalues than were found")
    if above(matrix, float(values[-1]) + 1e-9 * float(values[0])) >= len(values):
        raise ArithmeticError("the inertia counts more eigenvalues than were found")
    return values[kept], vectors[:, kept]


def usable(vector: Column) -> Column:
    """No null vector, and no null, infinite or undefined entry."""
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    finite = F.forall(vector, lambda c: c.isNotNull() & (c.cast("double") > low) & (c.cast("double") < high))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1,000,000 of each entry; an error beyond the range of a long."""

    def one(c):
        entry = c.cast("double")
        fits = F.abs(entry) < MOST_ENTRY
        message = F.lit("an entry of an embedding does not fit a long after scaling")
        return F.when(fits, F.floor(entry * SCALE).cast("long") + SHIFT).otherwise(F.raise_error(message).cast("long"))

    return F.transform(vector, one)


@dataclass
class Whitening:
    """What was learned: number of distinct vectors, their sums, eigenpairs and trace."""

    dimensions: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly; the numbers stay small because whole means go off first."""
        means, rest = self._means()
        return self.n * (x - means) - rest

    def _means(self) -> tuple[np.ndarray, np.ndarray]:
        means = [s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, means, strict=True)]
        return np.array(means, dtype=np.int64), np.array(rest, dtype=np.int64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 over the dimensions, exactly; an error beyond a long."""
        moved = self.centred(x)
        rough = np.square(moved.astype(float)).sum(axis=1)
        if rough.max(initial=0) < 2.0**62:
            return np.square(moved).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in moved]
        if max(exact) >= 2**63:
            raise OverflowError("a deviation does not fit a long")
        return exact

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.vectors / np.sqrt(self.values)


def _matrices(batches, at: int, dimensions: int):
    for batch in batches:
        if batch.num_rows:
            yield batch, np.asarray(batch.column(at).flatten(), dtype=np.int64).reshape(-1, dimensions)


def _sum_of(rows: DataFrame, column: str, per_task) -> list:
    """The sum over all tasks of a matrix that each makes of its rows, as (i, j, value).

    A task adds its rows up by itself; Spark adds the tasks up by entry, so the driver gets
    one matrix, however many tasks there are."""

    def run(batches):
        import pyarrow as pa

        total = per_task(batches)
        if total is not None:
            i, j = np.nonzero(np.ones(total.shape, dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"]
            )

    parts = rows.select(column).mapInArrow(run, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()


def _moments(rows: DataFrame, column: str, dimensions: int, centre, width: int) -> np.ndarray:
    """Sums of z and of z z' over all rows, as one matrix (width + 1, width), z = centre(x)."""

    def per_task(batches):
        total = None
        for _, x in _matrices(batches, 0, dimensions):
            z = centre(x)
            part = np.concatenate([z.T @ z, z.sum(axis=0, keepdims=True)])
            total = part if total is None else total + part
        return total

    matrix = np.zeros((width + 1, width))
    for i, j, value in _sum_of(rows, column, per_task):
        matrix[i, j] = value
    return matrix


def _covariance(rows: DataFrame, column: str, dimensions: int, n: int, centre, width: int) -> np.ndarray:
    """Covariance (divisor n) of centre(x), whose own mean, a rounding error, goes off, too."""
    moments = _moments(rows, column, dimensions, centre, width)
    mean = moments[-1] / n
    matrix = moments[:-1] / n - np.outer(mean, mean)
    return (matrix + matrix.T) / 2


def prepared(rows: DataFrame, vector: str, into: str = "x") -> tuple[DataFrame, int]:
    """Rows with a usable vector, as whole numbers in ``into``, and the number of dimensions.

    That is the most frequent length (of equally frequent ones the longest); vectors of
    another length have no place in one covariance and are left out. A column named like
    ``into`` is replaced."""
    kept = rows.where(usable(F.col(vector)))
    lengths = kept.groupBy(F.size(vector).alias("length")).count()
    first = lengths.orderBy(F.col("count").desc(), F.col("length").desc()).first()
    dimensions = first.length if first else 0
    return kept.where(F.size(vector) == dimensions).withColumn(into, whole_numbers(F.col(vector))), dimensions


def learn(x: DataFrame, dimensions: int, wanted: int = COMPONENTS, column: str = "x") -> Whitening:
    """Fit on each distinct vector once.

    Repeated vectors are reduced where they are read, then by one shuffle of the distinct
    ones, which are written; sums and covariances are further reads of that table. The
    driver holds matrices of dimensions by dimensions. No rows, or one distinct vector,
    leave no component."""
    distinct = stored(x.select(column).distinct(), "vectors")
    entries = distinct.select(F.posexplode(column).alias("i", "value")).groupBy("i").agg(F.sum("value").alias("sum"), F.count("*").alias("n"))
    found = sorted(entries.collect())
    nothing = Whitening(dimensions, 0, [], np.zeros(0), np.zeros((dimensions, 0)), 0.0)
    if not found:
        return nothing
    model = Whitening(dimensions, found[0]["n"], [row["sum"] for row in found], nothing.values, nothing.vectors, 0.0)
    n = model.n
    matrix = _covariance(distinct, column, dimensions, n, lambda x: model.centred(x) / n, dimensions)
    model.trace = float(np.trace(matrix))
    values, vectors = leading(matrix, wanted)
    fitted = Whitening(dimensions, n, model.sums, values, vectors, model.trace)
    if len(values):
        after = _covariance(distinct, column, dimensions, n, fitted.whitened, len(values))
        fitted.identity_error = float(np.abs(after - np.eye(len(values))).max())
    return fitted


def apply(rows: DataFrame, model: Whitening, key: str, column: str = "x") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per row and component.

    Repeated rows give repeated results, a null key stays null."""
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = T.StructType(
        [
            T.StructField(key, rows.schema[key].dataType),
            T.StructField("component", T.IntegerType()),
            *[T.StructField(c, T.LongType()) for c in names[2:4]],
            *[T.StructField(c, T.DoubleType()) for c in names[4:]],
        ]
    )
    count = len(model.values)
    if not count:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches):
        import pyarrow as pa

        for batch, x in _matrices(batches, 1, model.dimensions):
            rows = len(x)
            each = np.repeat(np.arange(rows), count)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * count, model.n)),
                pa.array(np.repeat(np.array(model.deviations(x), dtype=np.int64), count)),
                pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(model.values / model.trace, rows)),
                pa.array(np.full(rows * count, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select(key, column).mapInArrow(run, schema)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all rows with a usable vector.

    Rows whose vector is null or has a null, infinite or undefined entry are left out, and
    so are those of another length than most have. An empty table, and one whose vectors
    are all alike, give no rows; fewer than ``wanted`` eigenvalues above zero give so many
    components. Other columns are not read."""
    x, dimensions = prepared(rows.select(key, vector), vector, "_x")
    return apply(x, learn(x, dimensions, wanted, "_x"), key, "_x")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given embeddings, whitened to 16 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
