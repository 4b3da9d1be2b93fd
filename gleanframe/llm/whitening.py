"""Whitening of embeddings by the principal components of their covariance.

Entries become whole numbers first (``SCALE`` steps to one, shifted by ``SHIFT``), so sums and the covariance are exact:
each task sums its vectors, then the products of its vectors centred at the rounded mean, as whole
numbers; Spark adds a bounded number of rows per task, and the small rest of the mean is taken off exactly. The
result does not depend on how the rows are dealt out or which task is repeated. The d x d covariance alone
reaches the driver, which splits it into components (:mod:`gleanframe.llm.spectral`: QDWH spectral
divide-and-conquer). The d x k whitening matrix is broadcast; its size depends on the width of the vectors only.

The input is read four times: sums, products, a check of the whitened covariance, result. Write an
expensive input first.

Defined results: a vector that is null, empty or holds a null or non-finite entry is left out, and so is one of another
length than most have (ties: the longer). Entries beyond +-2^62 steps count as that. Components whose eigenvalue is
zero to working precision are left out, so equal vectors alone give no rows, as an empty table does. Repeated
rows count as often as they stand. ``deviation`` is null beyond 64 bits. Other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gleanframe.llm.common import written
from gleanframe.llm.spectral import EPS, eigen

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LARGEST = 2.0**62
#: Bits of a digit of a whole number, and rows whose products of digits a double adds exactly.
DIGIT = 21
EXACT_ROWS = 1 << 13
#: Rows after which a task hands its sums on.
HANDED_ON = 1 << 20

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whole(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and their entries as whole numbers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    entries = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    finite = np.isfinite(entries).all(axis=1)
    counts = np.flatnonzero(fits.to_numpy(zero_copy_only=False))[finite]
    steps = np.clip(np.floor(SCALE * entries[finite]), -LARGEST, LARGEST)
    return counts, steps.astype(np.int64) + SHIFT


def _digits(x: np.ndarray) -> list[np.ndarray]:
    """Signed digits, lowest first, as doubles: ``x = sum(digit[k] << DIGIT * k)``."""
    half, digits = 1 << (DIGIT - 1), []
    while not digits or x.any():
        low = ((x + half) & ((1 << DIGIT) - 1)) - half
        digits.append(low.astype(float))
        x = (x - low) >> DIGIT
    return digits


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.decimal128(38, 0) if name == "total" else pa.int64() for name in names]
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _sums(batches):
    """Per width of vectors and dimension: number and sum of the whole entries."""
    found: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        vectors = batch.column(0)
        for width in pc.unique(pc.drop_null(pc.list_value_length(vectors))).to_pylist():
            if not width:
                continue
            rows, x = _whole(vectors, width)
            if not len(rows):
                continue
            own = [0] * width
            for power, digit in enumerate(_digits(x)):
                for at in range(0, len(digit), EXACT_ROWS):
                    part = digit[at : at + EXACT_ROWS].sum(axis=0)
                    own = [a + (int(b) << DIGIT * power) for a, b in zip(own, part.tolist())]
            n, before = found.get(width, (0, [0] * width))
            found[width] = n + len(rows), [a + b for a, b in zip(own, before)]
    for width, (n, totals) in found.items():
        yield _table([(width, i, n, Decimal(t)) for i, t in enumerate(totals)], ["width", "i", "n", "total"])


@dataclass
class Mean:
    """The exact mean ``(n * whole + rest) / n`` of ``n`` vectors."""

    n: int
    whole: np.ndarray
    rest: list[int]

    @property
    def width(self) -> int:
        return len(self.rest)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - self.whole


def fit_mean(vectors: DataFrame) -> Mean | None:
    """The mean of the vectors that count; None where there are none."""
    sums = vectors.mapInArrow(_sums, "width long, i long, n long, total decimal(38,0)")
    added = written(sums.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "whitening-sums")
    most = added.where("i = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return None
    # one row per dimension
    totals = [int(r.total) for r in added.where(F.col("width") == most.width).orderBy("i").collect()]
    whole = [(2 * t + most.n) // (2 * most.n) for t in totals]
    return Mean(most.n, np.array(whole, np.int64), [t - most.n * w for t, w in zip(totals, whole)])


def _upper(pairs: tuple[np.ndarray, np.ndarray], sums: np.ndarray, power: int) -> pa.RecordBatch:
    i, j = pairs
    totals = [Decimal(int(t)) for t in sums[i, j].tolist()]
    return _table(list(zip(i.tolist(), j.tolist(), [power] * len(totals), totals)), ["i", "j", "power", "total"])


def fit_covariance(vectors: DataFrame, mean: Mean) -> np.ndarray:
    """The covariance, each entry the exact one rounded once."""
    width, pairs = mean.width, np.triu_indices(mean.width)

    def products(batches):
        held, rows = {}, 0
        for batch in batches:
            _, x = _whole(batch.column(0), width)
            for at in range(0, len(x), EXACT_ROWS):
                digits = _digits(mean.centred(x[at : at + EXACT_ROWS]))
                for a, left in enumerate(digits):
                    for b, right in enumerate(digits):
                        own = (left.T @ right).astype(np.int64)
                        held[a + b] = held[a + b] + own if a + b in held else own
            rows += len(x)
            if rows >= HANDED_ON:
                yield from (_upper(pairs, sums, power) for power, sums in held.items())
                held, rows = {}, 0
        yield from (_upper(pairs, sums, power) for power, sums in held.items())

    rows = vectors.mapInArrow(products, "i long, j long, power long, total decimal(38,0)")
    added = rows.groupBy("i", "j", "power").agg(F.sum("total").alias("total"))
    exact = [[0] * width for _ in range(width)]
    # at most five rows per pair of dimensions
    for r in added.collect():
        exact[r.i][r.j] += int(r.total) << DIGIT * r.power
    n, covariance = mean.n, np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            value = float(Fraction(exact[i][j] * n - mean.rest[i] * mean.rest[j], n * n))
            covariance[i, j] = covariance[j, i] = value
    return covariance


@dataclass
class Whitening:
    """Mean, the projection onto the components over the roots of their eigenvalues, and the share of each."""

    mean: Mean
    projection: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([r / self.mean.n for r in self.mean.rest])
        return (self.mean.centred(x) - rest) @ self.projection

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """``sum((n * x - S)^2)`` of each vector; in 64 bits where they suffice, else in longer numbers."""
        n, y, rest = self.mean.n, self.mean.centred(x), self.mean.rest
        most = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
        if len(rest) * most * most < 1 << 63:
            return ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        sums = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from all vectors that count, in the column ``vector`` of doubles; None where there are none."""
    mean = fit_mean(vectors)
    if mean is None:
        return None
    covariance = fit_covariance(vectors, mean)
    values, axes = eigen(covariance)
    kept = np.flatnonzero(values > len(values) * EPS * max(values[0], 0))[:components]
    return Whitening(mean, axes[:, kept] / np.sqrt(values[kept]), values[kept] / np.trace(covariance))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance, less the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    width, k = model.mean.width, len(model.explained)
    i, j = np.triu_indices(k)

    def products(batches):
        sums, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = shared.value.whiten(_whole(batch.column(0), width)[1])
            sums, squares = sums + z.sum(axis=0), squares + z.T @ z
        columns = [np.r_[i, np.full(k, -1)], np.r_[j, np.arange(k)], np.r_[squares[i, j], sums]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "total"])

    rows = vectors.mapInArrow(products, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    found = {(r.i, r.j): r.total / model.mean.n for r in rows.collect()}
    return max(abs(found[a, b] - found[-1, a] * found[-1, b] - (a == b)) for a, b in zip(i.tolist(), j.tolist()))


def whitened(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that counts and component, numbered from 1 by falling eigenvalue."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    vectors = rows.select("vector")
    model = fit(vectors, components)
    if model is None or not len(model.explained):
        return table.sparkSession.createDataFrame([], RESULT)
    error = identity_error(vectors, model)
    shared = table.sparkSession.sparkContext.broadcast(model)
    width, k = model.mean.width, len(model.explained)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def project(batches):
        for batch in batches:
            counts, x = _whole(batch.column(1), width)
            if not len(counts):
                continue
            ids = batch.column(0).take(pa.array(np.repeat(counts, k)))
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, shared.value.mean.n)),
                    pa.array(shared.value.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(shared.value.whiten(x).ravel()),
                    pa.array(np.tile(shared.value.explained, n)),
                    pa.array(np.full(n * k, error)),
                ],
                names=names,
            )

    return rows.mapInArrow(project, RESULT)
