"""PCA whitening of embeddings from the exact covariance of whole-number vectors.

Entries become whole numbers x = floor(1024 c) + 100000. A first pass adds up x by dimension (partial sums a task, in
whole numbers), so S and n are exact. A row is centred as (n x - S) / n: the numerator is exact, and the quotient is rounded
once, before anything is multiplied. MLlib's `RowMatrix.computeGramianMatrix` over these rows, divided by n, is the covariance;
its eigenvectors are found on the driver and sent to the tasks, which project rows in `mapInPandas`. The whitened rows are
written once, and their own covariance, taken the same way, says how far from the identity they are.

Scale: three passes over the vectors and none of them shuffles rows: a task sends a sum a dimension, and the Gramian is added up in a tree.
The driver holds matrices of d x d for vectors of d entries, whatever the number of rows.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite entry are left out, as are those that are not as long as most
(the shorter length if two are as frequent). Repeated rows and null ids count one by one. 1024 c is cut to +-2**52, beyond which doubles
skip whole numbers. Components whose eigenvalue is zero to double precision cannot be whitened and have no rows, so a table of
one vector, of equal vectors or of none gives an empty result. `deviation` is null if it is beyond a long. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellreach.llm.common import written

SCALE, SHIFT, CUT = 1024, 100_000, float(1 << 52)
MAX_COMPONENTS = 8


@dataclass
class Whitening:
    """What a fit learns: n vectors with sums `total` by dimension, and the eigenpairs by falling eigenvalue."""

    n: int
    total: list[int]
    widest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit numbers where they must fit, Python's own elsewhere."""
        kind = np.int64 if self.n * self.widest < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.total, kind)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        most = int(np.abs(centred).max(initial=0))
        if most * most * centred.shape[1] < 1 << 63:
            return (centred.astype(np.int64) ** 2).sum(1).tolist()
        sums = (int(s) for s in (centred.astype(object) ** 2).sum(1))
        return [s if s < 1 << 63 else None for s in sums]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that count, v as array<double>."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & sound)


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(vectors * SCALE, -CUT, CUT)).astype(np.int64) + SHIFT


def _sums(batches):
    """By length and dimension: how many vectors, the sum of x and its largest size."""
    kept: dict[int, list] = {}
    for batch in batches:
        column = batch.column(0)
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy()
        row = np.repeat(sizes, sizes)
        for size in np.unique(sizes).tolist():
            x = whole(flat[row == size].reshape(-1, size))
            most = int(np.abs(x).max())
            total = x.sum(0) if most * len(x) < 1 << 62 else x.astype(object).sum(0)
            n, before, top = kept.get(size, (0, [0] * size, 0))
            kept[size] = (n + len(x), [a + int(b) for a, b in zip(before, total, strict=True)], max(top, most))
    for size, (n, total, top) in kept.items():
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.int64()]
        columns = [[size] * size, list(range(size)), [n] * size, [Decimal(t) for t in total], [top] * size]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["size", "pos", "n", "total", "top"])


def gramian(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """Sum of the outer products of an array<double> column's rows, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, numCols=width).computeGramianMatrix().toArray()


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of `usable` vectors; None if there are none."""
    sums = vectors.select("v").mapInArrow(_sums, "size int, pos int, n long, total decimal(38,0), top long")
    by_place = sums.groupBy("size", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"))
    entries = F.sort_array(F.collect_list(F.struct("pos", "total")))  # as many as a vector has
    most = by_place.groupBy("size").agg(F.max("n").alias("n"), entries.alias("entries"), F.max("top").alias("top"))
    found = most.orderBy(F.desc("n"), "size").limit(1).collect()
    if not found:
        return None
    size, n = found[0]["size"], found[0]["n"]
    model = Whitening(n, [int(e["total"]) for e in found[0]["entries"]], found[0]["top"], np.empty(0), np.empty((0, 0)), 0.0)

    def centre(batches):
        for batch in batches:
            rows = model.centred(whole(batch.column(0).flatten().to_numpy().reshape(-1, size))).astype(np.float64) / n
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=["c"])

    centred = vectors.where(F.size("v") == size).select("v").mapInArrow(centre, "c array<double>")
    covariance = gramian(centred, "c", size) / n
    values, directions = np.linalg.eigh(covariance)
    model.values, model.vectors = values[::-1], directions[:, ::-1]
    # One sign for all rows: the entry of largest size is positive.
    top = model.vectors[np.abs(model.vectors).argmax(0), np.arange(size)]
    model.vectors = model.vectors * np.where(top < 0, -1.0, 1.0)
    model.trace = float(np.trace(covariance))
    return model


def project(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """(id, deviation, w): the first components of each vector, whitened."""
    size = len(model.total)
    shared = vectors.sparkSession.sparkContext.broadcast((model, model.vectors[:, :components] / np.sqrt(model.values[:components])))

    def run(frames):
        fitted, axes = shared.value
        for frame in frames:
            if len(frame):
                centred = fitted.centred(whole(np.stack(frame["v"].to_list())))
                w = (centred.astype(np.float64) / fitted.n) @ axes
                deviation = pd.array(fitted.deviations(centred), "Int64")
                yield pd.DataFrame({"id": frame["id"].astype("Int64"), "deviation": deviation, "w": list(w)})

    return vectors.where(F.size("v") == size).mapInPandas(run, "id long, deviation long, w array<double>")


def identity_error(rows: DataFrame, column: str, n: int, width: int) -> float:
    """The largest entry by size of a column's covariance (divisor n) minus the identity."""
    means = rows.agg(*[F.avg(F.get(column, F.lit(k))).alias(f"m{k}") for k in range(width)]).first()
    away = F.zip_with(column, F.array(*[F.lit(float(m)) for m in means]), lambda a, b: a - b)
    covariance = gramian(rows.select(away.alias("away")), "away", width) / n
    return float(np.abs(covariance - np.eye(width)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = MAX_COMPONENTS) -> DataFrame:
    """A row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    kinds = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = usable(df, id_col, vector_col)
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], kinds)
    least = model.trace * len(model.total) * np.finfo(float).eps
    width = int(min(components, (model.values > least).sum()))
    if not width:
        return spark.createDataFrame([], kinds)
    rows = written(project(vectors, model, width), "whitened")
    error = identity_error(rows, "w", model.n, width)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:width]])
    return rows.select("id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        F.col("id").alias(id_col),
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
