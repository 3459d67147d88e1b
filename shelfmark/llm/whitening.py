"""Whitening of embeddings: covariance by one aggregation over all pairs of dimensions, eigenvectors by LAPACK.

Each entry becomes a whole number, so that equal vectors are equal exactly, and each distinct vector counts once. A
first aggregation sums every dimension. A second one sums the products of centred entries: its expressions, one for
each pair of the upper triangle, are generated, and partial sums of d * (d + 1) / 2 numbers are all that is shuffled
or reaches the driver. There the matrix is assembled and decomposed (``numpy.linalg.eigh``). Vectors meet the
components in Arrow batches, as matrix products; the covariance of what comes out is summed by Spark again, the
same way, over the list that was fitted.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of
another length than most (of lengths equally frequent, the longest counts); ids may be null or repeat, each row has its
own results; a component without variance (its eigenvalue is not above the rounding error of the largest) is left out,
so that fewer rows than components can come, and none where all vectors are equal; a deviation beyond 64 bits is null;
entries beyond 2**46, whose whole numbers double precision cannot tell apart, are an error; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from shelfmark.llm import common

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Sums of pairs are generated in one aggregation for vectors of up to so many dimensions: 32,896 expressions.
MOST_DIMENSIONS = 256


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: whole numbers of the vectors that count, as arrays of longs."""
    entries = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), entries.alias("c"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    whole = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", finite))
    x = F.transform("c", lambda e: F.floor(F.when(F.abs(e) < 2.0**46, e * SCALE).otherwise(F.raise_error(F.lit("an entry is beyond 2**46")).cast("double"))) + SHIFT)
    dims = whole.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return whole.where(F.size("c") == (dims["d"] if dims else 1)).select("vec_id", x.alias("x"))


def _centred(i: int, n: int, sums: list[int]) -> str:
    """``x - S / n`` with one rounding: the numerator is a whole number, taken from the nearest whole mean."""
    mean, rest = divmod(sums[i], n)
    return f"double(x[{i}] - {mean}L) - {rest / n!r}D"


def covariance(columns: list[str], rows: DataFrame, n: int) -> np.ndarray:
    """The matrix of mean products of centred columns, given as SQL: an expression for each pair, all in one aggregation.

    No entry is null; saying so halves the code that Spark generates for the sums.
    """
    d = len(columns)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"at most {MOST_DIMENSIONS} dimensions")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    centred = rows.selectExpr(*(f"coalesce({c}, 0D) AS c{i}" for i, c in enumerate(columns)))
    found = centred.selectExpr(*(f"sum(c{i} * c{j})" for i, j in pairs)).collect()[0]
    matrix = np.zeros((d, d))
    for (i, j), total in zip(pairs, found):
        matrix[i, j] = matrix[j, i] = total / n
    return matrix


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums of every dimension; unit eigenvectors as rows, with their eigenvalues; the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @classmethod
    def fit(cls, distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
        """Of a table of distinct vectors ``x``; None where there are none."""
        d = distinct.select(F.max(F.size("x")).alias("d")).first()["d"]
        if d is None:
            return None
        n, *sums = distinct.agg(F.count("*"), *(F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(d))).first()
        sums = [int(s) for s in sums]
        v = covariance([_centred(i, n, sums) for i in range(d)], distinct, n)
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors.T[::-1]
        positive = values > max(values[0], 0.0) * d * np.finfo(float).eps
        return cls(n, sums, vectors[positive][:components], values[positive][:components], float(np.trace(v)))

    def whitened(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` with ``deviation`` and ``whitened``, an array of one number for each component."""
        n, d = self.n, len(self.sums)
        mean = [divmod(s, n) for s in self.sums]
        whole, part = np.array([m for m, _ in mean], np.int64), np.array([r for _, r in mean], np.int64)
        into = (self.vectors / np.sqrt(self.values)[:, None]).T
        k = into.shape[1]
        schema = StructType([rows.schema[c] for c in keep] + [StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            out = to_arrow_schema(schema)
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                near = x - whole
                deviations = [_deviation(r, n, part) for r in near] if _may_overflow(near, n) else (near * n - part).__pow__(2).sum(1)
                projected = (near - part / n) @ into
                offsets = pa.array(np.arange(len(projected) + 1, dtype=np.int32) * k)
                arrays = pa.ListArray.from_arrays(offsets, pa.array(projected.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(f.type) for c, f in zip(keep, out)] + [pa.array(deviations, pa.int64()), arrays.cast(out.field("whitened").type)], schema=out)

        return rows.mapInArrow(run, schema)


def _may_overflow(near: np.ndarray, n: int) -> bool:
    return bool(near.size) and (float(np.abs(near).max()) + 1) ** 2 * float(n) ** 2 * near.shape[1] >= 2.0**62


def _deviation(near: np.ndarray, n: int, part: np.ndarray) -> int | None:
    total = sum((int(a) * n - int(b)) ** 2 for a, b in zip(near, part))
    return total if total < 1 << 63 else None


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component."""
    spark = vectors.sparkSession
    rows = quantised(vectors, key, vector)
    kind = vectors.schema[key].dataType
    distinct = common.stored(rows.select("x").distinct())
    fitted = Whitening.fit(distinct, components)
    if fitted is None or not len(fitted.values):
        schema = [("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()), ("explained", DoubleType()), ("identity_error", DoubleType())]
        return spark.createDataFrame([], StructType([StructField("vec_id", kind), *(StructField(n, t) for n, t in schema)]))
    k = len(fitted.values)
    projected = fitted.whitened(distinct, [])
    means = projected.agg(*(F.sum(F.col("whitened")[i]) for i in range(k))).first()
    over = covariance([f"whitened[{i}] - ({means[i] / fitted.n!r}D)" for i in range(k)], projected, fitted.n)
    error = float(np.abs(over - np.eye(k)).max())
    shares = F.array(*(F.lit(float(v)) for v in fitted.values / fitted.trace))
    scored = fitted.whitened(rows, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return scored.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
