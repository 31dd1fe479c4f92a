"""Embedding whitening: rows projected on the leading eigenvectors of their covariance, over the roots of the eigenvalues.

Entries become whole numbers, so sums and products are exact and the same in any order: one pass adds up the entries, a second
one the products of rows that were shifted by the whole part of the means, and the covariance follows without rounding but
for the last one. The eigenpairs of the matrix, which is as small as a row is short, come from ``spectrum``. A third pass measures
the covariance of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageknow.llm.spectrum import leading
from pageknow.llm.vectors import matrix

#: Entries of this absolute size and beyond have no exact place.
LIMIT = 2.0**40
ROWS = 4_096


@dataclass(frozen=True)
class Params:
    components: int = 32
    scale: int = 64
    shift: int = 1_000_000
    rank: float = 1e-12  # eigenvalues up to this part of the trace count as zero


def complete(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite entries."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _whole(b: pa.RecordBatch, p: Params) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for k in range(0, b.num_rows, ROWS):
        part = b.slice(k, ROWS)
        v = np.floor(matrix(part.column("v")) * p.scale)
        if np.abs(v).max() >= LIMIT:
            raise ValueError("an entry is too large to be counted exactly")
        yield part, v


def _row_sums(p: Params, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, n, s): rows and the sum of dimension i, without the shift."""
    n, s = 0, 0
    for b in batches:
        for part, v in _whole(b, p):
            n, s = n + part.num_rows, s + v.astype(np.int64).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(np.full(len(s), n)), pa.array(s)], ["i", "n", "s"])


def _products(p: Params, middle: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, row): row i of the sum of products of the shifted rows; in floats while that is exact."""
    g: np.ndarray | int = 0
    for b in batches:
        for part, v in _whole(b, p):
            u = v - middle
            exact = float(np.abs(u).max()) ** 2 * part.num_rows < 2**53
            g = g + ((u.T @ u).astype(np.int64) if exact else (u.astype(object).T @ u.astype(object)))
    if not isinstance(g, int):
        yield _matrix_rows([[int(x) for x in row] for row in g], pa.decimal128(38, 0))


def _matrix_rows(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows, pa.list_(kind))], ["i", "row"])


def _add_rows(kind: pa.DataType, t: pa.Table) -> pa.Table:
    rows = np.array(t.column("row").to_pylist(), dtype=object)
    return pa.table({"i": t.column("i")[:1], "row": pa.array([list(rows.sum(axis=0))], pa.list_(kind))})


def _sum_of_rows(parts: DataFrame, kind: str, arrow: pa.DataType) -> np.ndarray:
    """The matrix whose rows were added up; as large as a row of the table is long, squared."""
    got = parts.groupBy("i").applyInArrow(lambda t: _add_rows(arrow, t), f"i long, row array<{kind}>").collect()
    return np.array([r.row for r in sorted(got, key=lambda r: r.i)], dtype=object)


def exact_covariance(g: np.ndarray, rest: list[int], n: int) -> np.ndarray:
    """From products of rows that are shifted by the whole part of their means, and the rests of the means (times n): the
    covariance with divisor n, each entry rounded once."""
    d = len(rest)
    return np.array([[float(Fraction(n * int(g[i, j]) - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])


@dataclass
class Fit:
    n: int
    middle: np.ndarray  # whole parts of the means
    rest: np.ndarray  # rests of the means, times n
    e: np.ndarray
    q: np.ndarray
    trace: float

    def whitened(self, v: np.ndarray) -> np.ndarray:
        return ((v - self.middle) - self.rest.astype(float) / self.n) @ self.q / np.sqrt(self.e)

    def deviations(self, v: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; null beyond the range of a long."""
        u = (v - self.middle).astype(np.int64)
        safe = float(np.abs(u).max(initial=1)) ** 2 * u.shape[1] < 2**62 and float(np.abs(u).max(initial=1)) * self.n * u.shape[1] < 2**62
        squares = (u * u).sum(axis=1).tolist() if safe else (u.astype(object) ** 2).sum(axis=1).tolist()
        cross = (u @ self.rest).tolist() if safe else (u.astype(object) @ self.rest.astype(object)).tolist()
        last = sum(int(r) ** 2 for r in self.rest)
        all_ = [self.n * self.n * int(a) - 2 * self.n * int(b) + last for a, b in zip(squares, cross, strict=True)]
        return [x if x < 2**63 else None for x in all_]


def _white_products(p: Params, fit: Fit, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of the whitened rows with a last entry of 1, so that the last row of the sum holds their sums."""
    g: np.ndarray | float = 0.0
    for b in batches:
        for _, v in _whole(b, p):
            z = np.hstack([fit.whitened(v), np.ones((len(v), 1))])
            g = g + z.T @ z
    if not isinstance(g, float):
        yield _matrix_rows(g.tolist(), pa.float64())


def _rows_out(p: Params, fit: Fit, held: list[str], error: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(fit.e)
    for b in batches:
        for part, v in _whole(b, p):
            m = part.num_rows
            at = pa.array(np.repeat(np.arange(m), k))
            cols = [part.column(c).take(at) for c in held] + [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                pa.array(fit.deviations(v), pa.int64()).take(at), pa.array(fit.whitened(v).ravel()), pa.array(np.tile(fit.e / fit.trace, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, [*held, *NEW])


NEW = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def whiten(vectors: DataFrame, embedding: str = "embedding", keep: tuple[str, ...] = ("vec_id",), p: Params = Params()) -> DataFrame:
    """For each row with a usable vector and each component up to ``components``: the columns ``keep``, component, n, deviation,
    whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; of vectors of several lengths those of
    the commonest length (of equally common ones the longest) remain. All remaining rows count, repeated ones and those of zeros too,
    whatever their ids; null ids pass through. There are fewer components than asked for if rows are shorter or the covariance
    has a smaller rank, none for one row or equal rows, so then, as for an empty table, the result is empty. ``deviation`` is null
    beyond the range of a long. Entries of 2^40 / ``scale`` and more raise ValueError. Columns named like a result are replaced.
    """
    keep = tuple(c for c in keep if c not in NEW)
    held = {c: f"k{i}" for i, c in enumerate(keep)}
    rows = vectors.where(complete(vectors[embedding])).select(*[vectors[c].alias(h) for c, h in held.items()], vectors[embedding].cast("array<double>").alias("v"))
    kinds = "".join(f"{h} {rows.schema[h].dataType.simpleString()}, " for h in held.values())
    ddl = f"{kinds}component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession

    def out(rows_: DataFrame) -> DataFrame:
        return rows_.select(*[F.col(h).alias(c) for c, h in held.items()], *NEW)

    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).limit(1).collect()
    if not lengths:
        return out(spark.createDataFrame([], ddl))
    rows = rows.where(F.size("v") == lengths[0].d)
    x = rows.select("v")
    sums = x.mapInArrow(lambda it: _row_sums(p, it), "i long, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    n, s = sums[0].n, [r.s for r in sums]
    middle = np.array([t // n for t in s], dtype=np.float64)
    rest = [t % n for t in s]
    g = _sum_of_rows(x.mapInArrow(lambda it: _products(p, middle, it), "i long, row array<decimal(38,0)>"), "decimal(38,0)", pa.decimal128(38, 0))
    v = exact_covariance(g, rest, n)
    e, q = leading(v, p.components)
    trace = float(np.trace(v))
    some = int((e > p.rank * trace).sum())
    if not some:
        return out(spark.createDataFrame([], ddl))
    fit = Fit(n, middle, np.array(rest, dtype=np.int64), e[:some], q[:, :some], trace)
    w = _sum_of_rows(x.mapInArrow(lambda it: _white_products(p, fit, it), "i long, row array<double>"), "double", pa.float64()).astype(float)
    mean = w[-1, :-1] / n
    error = float(np.abs(w[:-1, :-1] / n - np.outer(mean, mean) - np.eye(some)).max())
    return out(rows.mapInArrow(lambda it: _rows_out(p, fit, list(held.values()), error, it), ddl))
