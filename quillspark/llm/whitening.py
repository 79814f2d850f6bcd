"""Whitening of embeddings from singular value decompositions that are merged in a tree.

Every block of rows of a task becomes a summary: its number of rows, exact sums, all singular values and right vectors of
its centred rows. Two summaries merge by stacking their scaled vectors and one more row, the difference of their means
times sqrt(n1 n2 / (n1 + n2)), and decomposing that again; the Gram matrix is the one of all rows together, so nothing is
lost and every dimension stays. A task merges its own blocks, then FAN_IN summaries at a time meet until one is left, so
no task reads more than FAN_IN of them, whose size depends on the dimensions alone.

Components are integers floor(scale * c) + shift, so sums are exact; rows are centred at whole numbers before the rest
of the mean is taken off, so a large shift costs no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written

SCALE, SHIFT, FAN_IN, BLOCK = 1024, 100_000, 16, 4096
SUMMARY = "id long, n long, sums array<decimal(38,0)>, sv array<double>, vt array<double>"


class Summary(NamedTuple):
    """n rows, exact sums (Python integers), singular values and right vectors (a row each) of the centred rows."""

    n: int
    sums: list[int]
    sv: np.ndarray
    vt: np.ndarray


class Model(NamedTuple):
    """Sums, falling eigenvalues and their unit vectors (a row each) of the covariance with divisor n."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def rank(self) -> int:
        """Components whose variance can be told from zero."""
        return int((self.values > self.values[:1].max(initial=0) * len(self.sums) * 1e-13).sum())


def usable(df: DataFrame, scale: int = SCALE, shift: int = SHIFT, vector_col: str = "embedding") -> DataFrame:
    """All columns of df as a struct `row`, and x: floor(scale * component) + shift as longs.

    Rows whose vector is null, empty or holds null or non-finite components go. Of vectors of several lengths only
    those of the most frequent length stay (of equally frequent ones the greater).
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))
    return rows.select("row", F.transform("v", lambda c: F.floor(c * scale).cast("long") + shift).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summary(x: np.ndarray) -> Summary:
    """Of the integer rows x."""
    n, around = len(x), np.rint(x.mean(0)).astype(np.int64)
    rest = x - around  # small whole numbers
    sums = rest.sum(0)
    _, sv, vt = np.linalg.svd(rest - sums / n, full_matrices=False)
    return Summary(n, [int(s) + n * int(a) for s, a in zip(sums, around, strict=True)], sv, vt)


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of the rows of both."""
    step = np.array([(p * b.n - q * a.n) / (a.n * b.n) for p, q in zip(a.sums, b.sums, strict=True)])  # whole numbers up to the division
    rows = np.vstack([a.sv[:, None] * a.vt, b.sv[:, None] * b.vt, np.sqrt(a.n / (a.n + b.n) * b.n) * step])
    _, sv, vt = np.linalg.svd(rows, full_matrices=False)
    return Summary(a.n + b.n, [p + q for p, q in zip(a.sums, b.sums, strict=True)], sv[: len(a.sums)], vt[: len(a.sums)])


def _frame(found: Summary | None, at: int) -> pd.DataFrame:
    from decimal import Decimal

    rows = [] if found is None else [(at, found.n, [Decimal(s) for s in found.sums], found.sv.tolist(), found.vt.ravel().tolist())]
    return pd.DataFrame(rows, columns=["id", "n", "sums", "sv", "vt"])


def _summary(r) -> Summary:
    return Summary(int(r.n), [int(s) for s in r.sums], np.array(r.sv, float), np.array(r.vt, float).reshape(len(r.sv), -1))


def fit(vectors: DataFrame, fan_in: int = FAN_IN) -> Model | None:
    """The model of usable() rows; None if there are none. What comes to the driver is one summary: d * d numbers."""

    def of_task(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        found = None
        for b in batches:
            for first in range(0, b.num_rows, BLOCK):
                part = summary(_matrix(b.column(0).slice(first, BLOCK)))
                found = part if found is None else merged(found, part)
        yield pa.RecordBatch.from_pandas(_frame(found, TaskContext.get().partitionId()), ARROW, preserve_index=False)

    def of_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = None
        for r in rows.sort_values("id").itertuples():
            found = _summary(r) if found is None else merged(found, _summary(r))
        return _frame(found, int(key[0]))

    level = written(vectors.select("x").mapInArrow(of_task, SUMMARY), "summaries")
    most = level.agg(F.max("id")).first()[0]
    if most is None:
        return None
    while most > 0:
        level = written(level.groupBy(F.floor(F.col("id") / fan_in).cast("long").alias("at")).applyInPandas(of_group, SUMMARY), "summaries")
        most //= fan_in
    whole = _summary(level.first())
    return Model(whole.n, whole.sums, whole.sv**2 / whole.n, whole.vt)


ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("sv", pa.list_(pa.float64())), ("vt", pa.list_(pa.float64()))])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n with the difference taken in whole numbers first."""
    around = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * int(a) for s, a in zip(sums, around, strict=True)], float) / n
    return (x - around) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over the components of (n * x - sums) ** 2: squares are taken of 31-bit halves, so nothing overflows."""
    low = int(x.min(initial=0)) * n - max(sums)
    high = int(x.max(initial=0)) * n - min(sums)
    if max(abs(low), abs(high)) >= 2**62:
        return [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    d = np.abs(n * x - np.array(sums, np.int64))
    hi, lo = d >> 31, d & (2**31 - 1)
    wide = lambda a: [int(p) + (int(q) << 31) for p, q in zip((a & (2**31 - 1)).sum(1), (a >> 31).sum(1), strict=True)]
    return [(p << 62) + (q << 32) + r for p, q, r in zip(wide(hi * hi), wide(hi * lo), wide(lo * lo), strict=True)]


def whiten(vectors: DataFrame, model: Model, components: int | None = None) -> DataFrame:
    """row, deviation decimal(38,0) (exact), whitened array<double>: of usable() rows, `components` at most (all if None).

    Components of no variance are left out, so whitened rows have unit covariance.
    """
    from decimal import Decimal

    k = min(model.rank(), components or len(model.sums))
    turn = (model.vectors[:k] / np.sqrt(model.values[:k])[:, None]).T
    n, sums = model.n, model.sums
    kind = vectors.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for first in range(0, b.num_rows, BLOCK):
                part = b.slice(first, BLOCK)
                x = _matrix(part.column(1))
                done = (centred(x, n, sums) @ turn).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(done) + 1, k) if k else [0] * (len(x) + 1), pa.int32()), pa.array(done, pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([Decimal(d) for d in deviations(x, n, sums)], pa.decimal128(38, 0)), lists], names=["row", "deviation", "whitened"])

    return vectors.mapInArrow(run, f"row {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance (divisor n, centred) of the arrays `whitened` of k numbers minus the identity."""

    def sums(batches: Iterator[pa.RecordBatch]):
        n, one, two = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = _matrix(b.column(0))
            n, one, two = n + len(w), one + w.sum(0), two + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([one.tolist()], pa.list_(pa.float64())), pa.array([two.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "one", "two"])

    if not k:
        return 0.0
    parts = whitened.select("whitened").mapInArrow(sums, "n long, one array<double>, two array<double>")
    cells = parts.select(F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(k * k + k)), F.concat(F.array(F.col("n").cast("double")), "one", "two")).alias("at")).alias("c")).select("c.*")
    total = [r[1] for r in cells.toDF("i", "x").groupBy("i").agg(F.sum("x")).orderBy("i").collect()]  # k * k + k + 1 numbers
    mean = np.array(total[1 : k + 1]) / total[0]
    return float(np.abs(np.array(total[k + 1 :]).reshape(k, k) / total[0] - np.outer(mean, mean) - np.eye(k)).max())


def long_or_null(c: Column) -> Column:
    """An exact decimal as a long where it fits, else null."""
    return F.when(F.abs(c) <= F.lit(2**63 - 1), c.cast("long"))


def whitened_components(df: DataFrame, components: int = 8, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable row and component, numbered from 1 by falling variance: id, component int, n long, deviation
    long and deviation_exact decimal(38,0), whitened, explained and identity_error doubles.

    deviation is null where it doesn't fit a long, which takes some millions of rows; deviation_exact always holds it.
    Rows with null ids and repeated rows count and are returned. Rows without a usable vector go, see usable();
    components of no variance (all of one row or of equal rows) have no rows, and an empty table gives none. Components
    of equal variance come in any order. Other columns are ignored.
    """
    spark = df.sparkSession
    vectors = usable(df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{vector_col}`").alias("vector")), scale, shift, "vector")
    model = fit(vectors)
    names = f"{id_col} {dict(df.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if model is None:
        return spark.createDataFrame([], names)
    done = written(whiten(vectors, model, components), "whitened")
    k = min(model.rank(), components)
    error = identity_error(done, k)
    share = (model.values / model.values.sum()).tolist() if k else []
    rows = done.select(F.col(f"row.{id_col}").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "w"))
    explained = F.element_at(F.array(*[F.lit(float(s)) for s in share[:k]] or [F.lit(0.0)]), F.col("at") + 1)
    return rows.select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), long_or_null(F.col("deviation")).alias("deviation"), F.col("w").alias("whitened"),
        explained.alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
