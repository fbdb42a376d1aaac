"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Entries become whole numbers by a fixed scale, so that equal vectors are equal, and sums exact. The fit list holds each distinct vector once. Each task
keeps of its vectors their number, exact sums, all singular values and right vectors of the centred rows; two such summaries are merged
by decomposing both sets of scaled vectors below one another with one more row, the difference of the means times sqrt(n1 n2 / (n1 + n2)), which makes up for
the two centres. Nothing is cut off, so the last summary is that of all rows to double precision. Summaries have the size of dimensions squared, whatever the number of rows;
they are merged some MERGED by a task, in rounds that are written.

The driver sees the last summary and the covariance of the components shown. The distinct takes a map-side part, so a vector that many rows share is one row of a task.

Defined results: rows are left out whose vector is null or holds null or non-finite entries; the dimension is the longest length of the rest, and shorter vectors (empty ones too) are left out as if
entries were null; repeated rows and ids are rows of their own; a component without variance (of fewer distinct vectors or dimensions than components) has no
whitened value (null) and does not count in identity_error; an empty table, or one without such a vector, gives no rows; an entry whose scaled value is beyond 2^53, or a deviation beyond 63 bits, raises an error,
as no long holds it exactly; ids may be of any type; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, materialize, read_table, scratch_scope

SCALE = 256
COMPONENTS = 4
#: Summaries that a task merges, on average.
MERGED = 8
#: Rows that are decomposed at a time, in multiples of the dimension.
AT_A_TIME = 32

_SUMMARY = "part bigint, n bigint, sums array<bigint>, singular array<double>, vectors array<double>"


@dataclass
class Summary:
    """n rows with these exact column sums, whose centred rows have these singular values and right vectors (as rows)."""

    n: int
    sums: np.ndarray
    singular: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        sums = x.sum(0)
        return cls(len(x), sums, *_decomposed(x - sums / len(x)))

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        correction = np.sqrt(self.n / n * other.n) * (self.sums / self.n - other.sums / other.n)
        rows = np.vstack([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, correction[None]])
        return Summary(n, self.sums + other.sums, *_decomposed(rows))

    @property
    def eigenvalues(self) -> np.ndarray:
        """Of the covariance with divisor n, falling; as many as there are dimensions."""
        e = np.zeros(len(self.sums))
        e[: len(self.singular)] = self.singular**2 / self.n
        return e

    def shown(self, most: int) -> list[int]:
        """Places of the components up to `most`, those with variance only."""
        if not len(self.singular):
            return []
        least = self.singular[0] * max(self.n, len(self.sums)) * np.finfo(float).eps
        return [k for k in range(min(most, len(self.singular))) if self.singular[k] > least]

    def whitened(self, x: np.ndarray, places: list[int]) -> np.ndarray:
        return (x - self.sums / self.n) @ self.vectors[places].T / np.sqrt(self.eigenvalues[places])

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n * x - sums)^2, exact."""
        far = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        if len(self.sums) * far**2 < 1 << 63:
            return ((self.n * x - self.sums) ** 2).sum(1)
        return ((self.n * x.astype(object) - self.sums.astype(object)) ** 2).sum(1)

    def row(self, part: int) -> pa.RecordBatch:
        cols = [([part], pa.int64()), ([self.n], pa.int64()), ([self.sums], pa.list_(pa.int64())), ([self.singular], pa.list_(pa.float64())), ([self.vectors.ravel()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols], ["part", "n", "sums", "singular", "vectors"])

    @classmethod
    def from_row(cls, row) -> Summary:
        sums = np.asarray(row["sums"], np.int64)
        return cls(int(row["n"]), sums, np.asarray(row["singular"], float), np.asarray(row["vectors"], float).reshape(-1, len(sums)))


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, singular, vectors = np.linalg.svd(np.linalg.qr(rows, mode="r"), full_matrices=False)
    return singular, vectors


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Whole numbers of a vector's entries; null where the vector or an entry is null or not finite."""
    entry = lambda e: e.cast("double")
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(entry(e)) & (F.abs(entry(e)) != float("inf")))
    exact = lambda e: F.when(F.abs(e) < float(1 << 53), F.floor(e)).otherwise(F.raise_error(F.lit("an entry has no exact whole number")).cast("long"))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda e: exact(entry(e) * scale)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summaries(x: DataFrame, width: int) -> DataFrame:
    """A row of _SUMMARY for each task that has rows."""

    def run(batches):
        so_far, held, size = None, [], 0

        def added():
            own = Summary.of(np.vstack(held))
            return own if so_far is None else so_far.merge(own)

        for batch in batches:
            held.append(_matrix(batch.column("x"), width))
            size += batch.num_rows
            if size >= AT_A_TIME * width:
                so_far, held, size = added(), [], 0
        if size:
            so_far = added()
        if so_far is not None:
            yield so_far.row(TaskContext.get().partitionId())

    return x.select("x").mapInArrow(run, _SUMMARY)


def merged(parts: DataFrame, at_once: int = MERGED) -> Summary:
    """All summaries merged in rounds, some at_once neighbours by one task, which holds two of them at a time."""

    def merge(batches):
        out, part = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                own = Summary.from_row(row)
                out, part = (own, row["part"]) if out is None else (out.merge(own), min(part, row["part"]))
        if out is not None:
            yield out.row(part)

    parts, level = materialize(parts, "svd-0"), 0
    while (n := parts.count()) > 1:
        level += 1
        parts = materialize(parts.coalesce(-(-n // at_once)).mapInArrow(merge, _SUMMARY), f"svd-{level}")
    return Summary.from_row(parts.first())


def fit(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS, scale: int = SCALE) -> tuple[Summary, float] | None:
    """The summary of all distinct vectors, and the largest absolute entry of the covariance of their first `most` whitened components minus the identity. None without a vector."""
    byte_batches(vectors.sparkSession)
    with scratch_scope(vectors.sparkSession):
        x = materialize(vectors.select(scaled(F.col(column), scale).alias("x")).filter("x IS NOT NULL").distinct(), "fit-list")
        width = x.agg(F.max(F.size("x"))).first()[0]
        if not width:
            return None
        x = x.filter(F.size("x") == width)
        model = merged(summaries(x, width))
        return model, identity_error(x, model, width, most)


def identity_error(x: DataFrame, model: Summary, width: int, most: int) -> float:
    """Taken from the whitened rows themselves, by Spark's centred covariance aggregates."""
    places = model.shown(most)
    if not places:
        return 0.0
    names = [f"z{k}" for k in places]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in model.whitened(_matrix(batch.column("x"), width), places).T.copy()], names)

    z = x.mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    found = z.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(rows: DataFrame, model: Summary, column: str = "embedding", id_col: str = "vec_id", most: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained of each row with a vector and each component up to `most`."""
    byte_batches(rows.sparkSession)
    width, n = len(model.sums), model.n
    k = min(most, width)
    places = model.shown(k)
    trace = float(model.eigenvalues.sum())
    explained = model.eigenvalues[:k] / trace if trace else np.zeros(k)
    source = rows.select(F.col(id_col).alias("vec_id"), scaled(F.col(column), scale).alias("x")).filter(F.size("x") == width)

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column("x"), width)
            z = np.full((m, k), np.nan)
            z[:, places] = model.whitened(x, places)
            whole = np.repeat(np.arange(m), k)
            cols = [
                batch.column("vec_id").take(pa.array(whole)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array([int(d) for d in model.deviations(x)], pa.int64()).take(pa.array(whole)),
                pa.array(z.ravel(), from_pandas=True), pa.array(np.tile(explained, m)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    kind = source.schema["vec_id"].dataType.simpleString()
    return source.mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    found = fit(rows)
    if not found:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    model, error = found
    return whiten(rows, model).withColumn("identity_error", F.lit(error))
