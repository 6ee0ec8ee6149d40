"""Whitening of embeddings, with eigenvectors refined in mixed precision.

Entries become whole numbers, so moments are exact. One pass sums the columns, a
second sums products of vectors centred to the nearest whole number; both add up
small partial sums per task. From these the covariance follows exactly, as fractions,
and is rounded once.

Eigenvectors start from float32. Ogita-Aishima iterations then correct all of them
at once by matrix products in extended precision: R = I - X'X and S = X'AX say how
far the vectors are from orthonormal and A-orthogonal, and X + XE is right to twice
the digits. For eigenvalues closer to each other than the error bound the correction
would divide by nothing: the vectors of such a cluster are only made orthogonal, and
the small matrix that A, shifted to the cluster's middle, is on their span is solved
by itself; its vectors turn those of the cluster. Equal eigenvalues have no
eigenvectors of their own: any orthonormal basis of their space will do.

Defined results: vectors that are null, or hold null or non-finite entries, are left
out, as are vectors of another length than most have (the longest of equally frequent
ones counts); entries whose whole number exceeds 2^52 in size count as 2^52; repeated
rows and null ids are kept; a component without variance has null `whitened`, and
only the others enter `identity_error`, which is null without any; an empty table, or
one without such vectors, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leakloom.llm.common import on_workers, stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Largest whole number of an entry.
LARGEST = 1 << 52
#: Iterations end when corrections are below the precision, or after so many.
ITERATIONS = 40

_X = np.longdouble
_EXACT = 1 << 53


def whole_numbers(embedding: Column) -> Column:
    """floor(SCALE * entry) + SHIFT of each entry as double."""
    def whole(c):
        scaled = F.least(F.greatest(F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-9e15)), F.lit(9e15))) + SHIFT,
                                    F.lit(-LARGEST)), F.lit(LARGEST))
        return scaled.cast("long")
    return F.transform(embedding, whole)


def _usable(embedding: Column) -> Column:
    """No entry is null or non-finite."""
    def unusable(c):
        return c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(embedding, unusable), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centre(sums: list[int], n: int) -> np.ndarray:
    """Nearest whole numbers to the means."""
    return np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)


def _sums_of(cells: DataFrame) -> dict[int, int]:
    """Totals of partial sums (cell, value)."""
    return {r["cell"]: int(r["value"]) for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect()}


def _cells(values: list[int]) -> pa.RecordBatch:
    kept = [(i, Decimal(v)) for i, v in enumerate(values) if v]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int32()), pa.array([v for _, v in kept], pa.decimal128(38, 0))],
                                      ["cell", "value"])


_CELLS = "cell int, value decimal(38,0)"


def _column_sums(width: int):
    """Sums of the columns of x, then the number of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * width, 0
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for at in range(0, len(x), 1024):  # 1024 numbers of 2^52 stay below 2^63
                sums = [a + b for a, b in zip(sums, x[at:at + 1024].sum(axis=0).tolist())]
            n += len(x)
        yield _cells([*sums, n])
    return run


def products(y: np.ndarray) -> list[int]:
    """Sums of products of the columns of y (whole numbers): exact, row by row of the upper triangle."""
    upper = np.triu_indices(y.shape[1])
    largest = int(np.abs(y).max(initial=0))
    step = _EXACT // max(largest * largest, 1)
    if step == 0:  # a product alone needs more than 53 bits: Python's whole numbers
        wide = y.astype(object)
        return [int(v) for v in (wide.T @ wide)[upper]]
    total = np.zeros(len(upper[0]), object)
    for at in range(0, len(y), step):
        part = y[at:at + step].astype(np.float64)
        total = total + (part.T @ part)[upper].astype(np.int64).astype(object)
    return total.tolist()


def _column_products(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (len(centre) * (len(centre) + 1) // 2)
        for batch in batches:
            total = [a + b for a, b in zip(total, products(_matrix(batch.column(0), len(centre)) - centre))]
        yield _cells(total)
    return run


def _wide(numerator: int, denominator: int) -> np.longdouble:
    """A fraction in extended precision."""
    high = numerator / denominator
    return _X(high) + _X(float(Fraction(numerator, denominator) - Fraction(high)))


def covariance(n: int, sums: list[int], total: list[int]) -> np.ndarray:
    """Covariance, divisor n, from sums and products of columns; rounded once."""
    width = len(sums)
    out = np.zeros((width, width), _X)
    for (i, j), p in zip(zip(*(k.tolist() for k in np.triu_indices(width))), total):
        out[i, j] = out[j, i] = _wide(n * p - sums[i] * sums[j], n * n)
    return out


# --- eigenvectors --------------------------------------------------------------------------

def _clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """Places of runs of neighbouring values, in order, that are no further apart than `bound`."""
    order = np.argsort(values, kind="stable")
    breaks = np.flatnonzero(np.diff(values[order]) > bound) + 1
    return [own for own in np.split(order, breaks) if len(own) > 1]


def _norm(m: np.ndarray) -> float:
    return float(np.sqrt((m.astype(np.float64) ** 2).sum()))


def _seen(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """I - X'X and X'AX, symmetric to the last digit."""
    s = x.T @ (a @ x)
    r = np.eye(len(a), dtype=_X) - x.T @ x
    return (r + r.T) / 2, (s + s.T) / 2


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: better vectors, their values, the sizes of the correction and of I - X'X."""
    r, s = _seen(a, x)
    values = np.diag(s) / (1 - np.diag(r))
    bound = 2 * (_norm(s - np.diag(values)) + _norm(a) * _norm(r))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= bound
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    return x + x @ e, values, _norm(e), _norm(r)


def solve_cluster(a: np.ndarray, x: np.ndarray, own: np.ndarray, middle: np.longdouble) -> np.ndarray:
    """Vectors of a cluster, turned to the eigenvectors of what `a` is on their span."""
    part = x[:, own]
    small = part.T @ (a @ part - middle * part)
    size = np.abs(small).max()
    if not size:
        return part
    return part @ np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1].astype(_X)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision."""
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_X)
    floor = len(a) * float(np.finfo(_X).eps)
    last = np.inf
    for _ in range(ITERATIONS):
        x, values, moved, skew = refine(a, x)
        if moved <= floor or (skew < 1e-15 and moved >= last / 2):
            break
        last = moved
        r, s = _seen(a, x)
        bound = 2 * (_norm(s - np.diag(np.diag(s))) + _norm(r))
        for own in _clusters(values, max(bound, floor)):
            x[:, own] = solve_cluster(a, x, own, values[own].mean())
    x = x + x @ (_seen(a, x)[0] / 2)
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values * scale)[order].astype(np.float64), x[:, order].astype(np.float64)


# --- whitening -----------------------------------------------------------------------------

@dataclass
class Whitener:
    """The fit: number of vectors, exact column sums, covariance's eigenvalues and vectors, its trace."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components with variance: above what rounding leaves of none."""
        return self.values > 1e-15 * max(self.trace, 0.0) if self.trace else np.zeros(len(self.values), bool)


def usable_vectors(embeddings: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the vectors that count, and their length (0: there are none)."""
    rows = embeddings.where(_usable(F.col(vector)))
    lengths = rows.groupBy(F.size(vector).alias("width")).count().where("width > 0")
    first = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    width = first["width"] if first else 0
    return (rows.where(F.size(vector) == width)
            .select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col(vector)).alias("x")), width)


def fit(vectors: DataFrame, width: int) -> Whitener:
    """Fit to all `vectors` (x) of length `width`."""
    found = _sums_of(vectors.select("x").mapInArrow(_column_sums(width), _CELLS))
    n, sums = found.get(width, 0), [found.get(i, 0) for i in range(width)]
    centre = _centre(sums, n)
    total = _sums_of(vectors.select("x").mapInArrow(_column_products(centre), _CELLS))
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    v = covariance(n, rest, [total.get(i, 0) for i in range(width * (width + 1) // 2)])
    values, x = eigen(v)
    return Whitener(n, sums, values, x, float(np.trace(v)))


def _deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """Sums over dimensions of (n * y - rest)^2, exact."""
    largest, own = int(np.abs(y).max(initial=0)), max(map(abs, rest), default=0)
    if y.shape[1] * largest * max(largest, own) < 1 << 62:
        squares, crossed = (y * y).sum(axis=1).tolist(), (y @ np.array(rest, np.int64)).tolist()
    else:
        wide = y.astype(object)
        squares, crossed = (wide * wide).sum(axis=1).tolist(), (wide @ np.array(rest, object)).tolist()
    constant = sum(s * s for s in rest)
    return [n * n * a - 2 * n * b + constant for a, b in zip(squares, crossed)]


def whitened(vectors: DataFrame, model: Whitener, components: int = COMPONENTS) -> DataFrame:
    """Per vector (vec_id, x): vec_id, deviation (null beyond 38 digits), values (null where a component has no variance)."""
    centre = _centre(model.sums, model.n)
    rest = [s - model.n * int(c) for s, c in zip(model.sums, centre)]
    usable = model.usable[:components]
    fraction = np.array([_wide(s, model.n) for s in rest], _X).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        factors = np.where(usable, model.vectors[:, :components] / np.sqrt(np.where(usable, model.values[:components], 1)), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1), len(centre)) - centre
            out = (y.astype(np.float64) - fraction) @ np.where(usable, factors, 0)
            flat = pa.array(out.reshape(-1), mask=np.tile(~usable, len(out)))
            lists = pa.FixedSizeListArray.from_arrays(flat, out.shape[1]).cast(pa.list_(pa.float64()))
            deviations = [Decimal(d) if d < 10 ** 38 else None for d in _deviations(y, model.n, rest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations, pa.decimal128(38, 0)), lists],
                                             ["vec_id", "deviation", "values"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), values array<double>")


def identity_error(found: DataFrame, model: Whitener, components: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the covariance of `values` minus the identity, over components with variance."""
    chosen = np.flatnonzero(model.usable[:components])
    if not len(chosen):
        return None
    upper = np.triu_indices(len(chosen))

    def read(column):
        return _matrix(column, min(components, len(model.values)))[:, chosen]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _double_cells(sum((read(b.column(0)).sum(axis=0) for b in batches), np.zeros(len(chosen))))

    def total(means: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(len(upper[0]))
            for batch in batches:
                y = read(batch.column(0)) - means
                held += (y.T @ y)[upper]
            yield _double_cells(held)
        return run

    def collected(run) -> np.ndarray:
        rows = found.select("values").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        cells = {r["cell"]: r["value"] for r in rows.collect()}
        return np.array([cells[i] for i in range(len(cells))])

    moments = np.zeros((len(chosen), len(chosen)))
    moments[upper] = collected(total(collected(sums) / model.n)) / model.n
    return float(np.abs(moments - np.eye(len(chosen)))[upper].max())


def _double_cells(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["cell", "value"])


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Per row (vec_id, vector) that counts and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    vectors, width = usable_vectors(embeddings, vector)
    if not width:
        return spark.createDataFrame([], ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
                                          "explained double, identity_error double"))
    model = fit(vectors, width)
    found = stored(whitened(vectors, model, components), "whitened")
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace else None).cast("double")
                          for v in model.values[:components]])
    return (found.select("vec_id", "deviation", F.posexplode("values").alias("place", "whitened"))
            .select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(explained, F.col("place")).alias("explained"),
                    F.lit(identity_error(found, model, components)).cast("double").alias("identity_error")))


def op13_refined_whitening(spark, sf_dir: str) -> DataFrame:
    on_workers(spark)
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
