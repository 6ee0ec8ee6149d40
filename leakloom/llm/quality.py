"""Quality by a regularised quadratic discriminant over document statistics.

A text's statistics are counts and shares (words, letters, marks, repetitions of
words and lines, how well it compresses), on logarithmic scales so that they are
closer to normal. Each class of labelled documents has a mean and a covariance of
them; the score is the difference of the classes' log-densities, that is of squared
Mahalanobis distances and log-determinants, put through a logistic function.

Statistics are computed once, in one narrow pass over the whole texts, and stored:
learning and scoring read those few numbers, and the join with the labels moves no
text. Sums of products are added up per class and fold; nothing else reaches the
driver. A covariance is shrunk twice: towards that of all classes, and towards its
own diagonal. How far, and by how much log-density differences are tempered, is what
gives the least log-loss when each fold is scored by a fit to the others. The Cholesky
factors of the shrunk covariances are computed once and kept with the model.

The learner's rows are all labelled ones that are not held out: there is no sample.

Defined results: null and empty texts have the statistics of no words and are scored
like others; labels other than 0 and 1, and null ids, are not learnt from; of several
labels of a document the larger counts; with fewer than `LEAST_ROWS` rows of a class
the share of label 1 is everyone's score (0.5 without labels); repeated rows are
scored alike; null ids are never held out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from leakloom.llm.common import on_workers, stored

THRESHOLD = 0.5
#: Folds of the labelled rows, and the amounts of shrinkage and tempering to choose from.
FOLDS = 3
TOWARDS_ALL, TOWARDS_DIAGONAL, TEMPER = (0.0, 0.02, 0.1, 0.3), (0.01, 0.05, 0.2, 0.5), (0.1, 0.25, 0.5, 1.0)
#: Least rows of a class in every fit.
LEAST_ROWS = 5
#: Least standard deviation of a statistic, on its logarithmic scale.
LEAST_SPREAD = 0.02

#: Kinds of bytes: letters A-Z, a-z, digits, sentence marks, white space, other ASCII, the rest.
_KINDS = np.full(256, 6)
_KINDS[:128] = 5
_KINDS[ord("A"):ord("Z") + 1], _KINDS[ord("a"):ord("z") + 1], _KINDS[ord("0"):ord("9") + 1] = 0, 1, 2
_KINDS[[ord(c) for c in ".,;:'-()\""]] = 3
_KINDS[[0x20, *range(9, 14)]] = 4
_PIECE = 1 << 20

STATISTICS = ("words", "length", "upper", "digits", "marks", "space", "symbols", "beyond_ascii", "repeated", "run",
              "distinct", "commonest", "unlettered", "lines", "repeated_lines", "packed")


def _share(part: float, whole: float) -> float:
    """Log of a share, half a count standing for none."""
    return float(np.log((part + 0.5) / (whole + 1)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of STATISTICS."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds, packed, packer = np.zeros(7, np.int64), 0, zlib.compressobj(1)
    for at in range(0, len(data), _PIECE):
        piece = data[at:at + _PIECE]
        kinds += np.bincount(_KINDS, np.bincount(np.frombuffer(piece, np.uint8), minlength=256), 7).astype(np.int64)
        packed += len(packer.compress(piece))
    packed += len(packer.flush())
    upper, lower, digits, marks, space, symbols, beyond = kinds.tolist()
    size, solid = len(data), len(data) - space
    words = data.lower().split()
    n = len(words)
    names, number, counts = {}, [], []
    for word in words:
        k = names.setdefault(word, len(names))
        number.append(k)
    number = np.array(number, np.int64)
    counts = np.bincount(number) if n else np.zeros(1, np.int64)
    changes = np.flatnonzero(np.diff(number)) + 1 if n else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate(([0], changes, [n])))
    lettered = np.array([any(97 <= c <= 122 or c > 127 for c in word) for word in names], bool)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [np.log1p(n), np.log((solid + 1) / (n + 1)), _share(upper, upper + lower), _share(digits, solid), _share(marks, solid),
            _share(space, size), _share(symbols, solid), _share(beyond, solid), _share(n - 1 - len(changes) if n else 0, n),
            np.log1p(runs.max()), _share(len(names), n), _share(int(counts.max()), n),
            _share(int(counts[~lettered].sum()) if n else 0, n), np.log((n + 1) / (len(lines) + 1)),
            _share(len(lines) - len(set(lines)), len(lines)), np.log((packed + 1) / (size + 9))]


def with_statistics(documents: DataFrame) -> DataFrame:
    """Stored (doc_id, x): the statistics of each row of `documents` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, x array<double>"), "quality-statistics")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


# --- moments -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Moments:
    """Number of rows, their mean and the sum of products of deviations from it."""
    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n),
                       self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))


def moments_of(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    return Moments(len(x), mean, (x - mean).T @ (x - mean))


def _none() -> Moments:
    return moments_of(np.empty((0, len(STATISTICS))))


_MOMENTS = "label int, fold int, n double, mean array<double>, products array<double>"


def _moment_rows(held: dict) -> pd.DataFrame:
    rows = [(label, fold, m.n, m.mean.tolist(), m.products.reshape(-1).tolist()) for (label, fold), m in sorted(held.items())]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _MOMENTS.split(", ")])


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}
    for batch in batches:
        for key, own in batch.groupby(["label", "fold"]):
            held[key] = held.get(key, _none()) + moments_of(np.stack(own["x"].to_numpy()))
    yield _moment_rows(held)


def _parsed(rows: pd.DataFrame) -> Moments:
    total, width = _none(), len(STATISTICS)
    order = rows.sort_values("n", kind="stable", key=lambda n: -n) if len(rows) else rows
    for n, mean, products in zip(order["n"], order["mean"], order["products"]):
        total = total + Moments(n, np.array(mean), np.array(products).reshape(width, width))
    return total


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per class and fold."""
    return _moment_rows({(int(frame["label"].iloc[0]), int(frame["fold"].iloc[0])): _parsed(frame)})


def labelled(rows: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """Stored (label, fold, x) of the rows (doc_id, x) to learn from; folds follow a hash of the id."""
    chosen = (labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label")))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    return stored(rows.join(chosen, "doc_id").select("label", fold.alias("fold"), "x"), "quality-labelled")


# --- discriminant --------------------------------------------------------------------------

@dataclass(frozen=True)
class Gaussian:
    """Mean and Cholesky factor of a class, inverted once, and the log of the factor's determinant and the prior."""
    mean: np.ndarray
    inverse: np.ndarray
    offset: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return self.offset - 0.5 * (z * z).sum(axis=1)


def gaussian(own: Moments, everyone: Moments, towards_all: float, towards_diagonal: float) -> Gaussian:
    """A class's density with its covariance shrunk towards the pooled one, then towards its own diagonal."""
    covariance = (1 - towards_all) * own.products / own.n + towards_all * everyone.products / everyone.n
    diagonal = np.maximum(np.diag(covariance), LEAST_SPREAD ** 2)
    covariance = (1 - towards_diagonal) * covariance + towards_diagonal * np.diag(diagonal)
    covariance[np.diag_indices_from(covariance)] = diagonal
    factor = np.linalg.cholesky(covariance)
    return Gaussian(own.mean, np.linalg.inv(factor), float(np.log(own.n / everyone.n) - np.log(np.diag(factor)).sum()))


@dataclass(frozen=True)
class Model:
    """Densities of the classes 0 and 1 and the tempering; without them, one score for all."""
    classes: tuple[Gaussian, Gaussian] | None
    temper: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        margin = self.classes[1].log_density(x) - self.classes[0].log_density(x)
        return 1 / (1 + np.exp(-np.clip(self.temper * margin, -500, 500)))


def model_of(classes: tuple[Moments, Moments], towards_all: float, towards_diagonal: float, temper: float) -> Model:
    n = classes[0].n + classes[1].n
    prior = classes[1].n / n if n else 0.5
    if min(c.n for c in classes) < LEAST_ROWS:
        return Model(None, temper, prior)
    pooled = Moments(n, classes[0].mean, classes[0].products + classes[1].products)
    return Model(tuple(gaussian(c, pooled, towards_all, towards_diagonal) for c in classes), temper, prior)


def _losses(fits: dict[int, list[Model]]):
    """Log-losses of each choice of parameters, over rows scored by the fit that left out their fold."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(fits[0]))
        for batch in batches:
            for fold, own in batch.groupby("fold"):
                x, y = np.stack(own["x"].to_numpy()), own["label"].to_numpy()
                for i, model in enumerate(fits[fold]):
                    p = np.clip(model.scores(x), 1e-9, 1 - 1e-9)
                    total[i] -= np.where(y == 1, np.log(p), np.log(1 - p)).sum()
        yield pd.DataFrame({"choice": range(len(total)), "loss": total})
    return run


def learn(rows: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """Model from the statistics (doc_id, x) and the labels (doc_id, 0 or 1)."""
    data = labelled(rows, labels, column)
    found = data.mapInPandas(_partial, _MOMENTS).groupBy("label", "fold").applyInPandas(_merged, _MOMENTS).toPandas()
    parts = {(k, f): _parsed(found[(found["label"] == k) & (found["fold"] == f)]) for k in (0, 1) for f in range(FOLDS)}

    def classes(without: int | None) -> tuple[Moments, Moments]:
        return tuple(sum((parts[k, f] for f in range(FOLDS) if f != without), _none()) for k in (0, 1))

    choices = list(product(TOWARDS_ALL, TOWARDS_DIAGONAL, TEMPER))
    if any(m.n < LEAST_ROWS for fold in (None, *range(FOLDS)) for m in classes(fold)):
        return model_of(classes(None), 0.3, 0.5, 0.5)
    fits = {f: [model_of(classes(f), *choice) for choice in choices] for f in range(FOLDS)}
    losses = (data.mapInPandas(_losses(fits), "choice int, loss double")
              .groupBy("choice").agg(F.round(F.sum("loss"), 6).alias("loss")).orderBy("loss", "choice").first())
    return model_of(classes(None), *choices[losses["choice"]])


def quality(model: Model):
    """Function from a column of statistics to the score."""
    @F.pandas_udf(DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else np.zeros(0))
    return score


def op12_quadratic_quality(spark, sf_dir: str) -> DataFrame:
    on_workers(spark)
    rows = with_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = learn(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (rows.withColumn("score", quality(model)("x"))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
