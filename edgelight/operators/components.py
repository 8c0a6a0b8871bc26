"""Principal components of any number of spectra on a common grid.

Components come from second moments over the grid's points, not over pairs of spectra: every task adds up the outer products of its
standardised rows in one matrix of points by points, and these few matrices are added by element. What the driver sees is
one such matrix, whatever the number of spectra.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The driver takes the eigenvectors of a matrix of this size at most (128 MB)
MOST_POINTS = 4096


def point_means(df: DataFrame) -> DataFrame:
    """(idx, mean, n) over curves (y array), in order of points."""
    return df.select(F.posexplode("y").alias("idx", "v")).groupBy("idx").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def second_moments(df: DataFrame, means: list[float]) -> DataFrame:
    """(i, j, m), i <= j: the mean over spectra (y array) of z_i z_j, z being a spectrum less the mean spectrum, standardised over its own points.

    A spectrum that equals the mean spectrum up to a constant has z zero. A spectrum of another length, or one that holds null or
    non-finite values, is an error.
    """
    mean = np.asarray(means, float)
    size = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column(0)
            y = column.flatten().to_numpy(zero_copy_only=False)
            if column.null_count or len(y) != len(batch) * size or (np.diff(column.offsets.to_numpy()) != size).any() or not np.isfinite(y).all():
                raise ValueError(f"spectra of {size} finite points are expected")
            z = y.reshape(-1, size) - mean
            z -= z.mean(axis=1, keepdims=True)
            spread = z.std(axis=1, keepdims=True)
            z = np.divide(z, spread, out=np.zeros_like(z), where=spread > 0)
            total += z.T @ z
            n += len(z)
        if n:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j]), pa.array(np.full(len(i), n), pa.int64())], ["i", "j", "s", "n"])

    parts = df.select(F.col("y").cast("array<double>").alias("y")).mapInArrow(run, "i int, j int, s double, n long")
    return parts.groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("m"))


def model_of(mean: np.ndarray, moments: np.ndarray, count: int) -> dict:
    """A model from the mean spectrum and the second moments of `count` spectra: as many components as can differ from zero.

    Scaled as those of a training over pairs of spectra: the eigenvalues of both are the same, and a component there is the point-side eigenvector
    times the root of its eigenvalue over the count.
    """
    size = len(mean)
    values, vectors = np.linalg.eigh(moments)
    keep = min(count, size)
    values, vectors = np.maximum(values[::-1][:keep], 0.0), vectors[:, ::-1][:, :keep]
    comps = -np.sqrt(values / count)[:, None] * vectors.T
    tail = np.append(np.cumsum(values[::-1])[::-1], 0.0)
    r = np.arange(min(keep, count - 1))
    left = count - r - 1
    ind = np.sqrt(np.maximum(size * tail[r], 0) / left) / left.astype(float) ** 2
    ind = np.concatenate([ind[:1], ind])  # the first value stands twice
    return {"mean": mean, "components": comps, "eigenvalues": values, "variances": values / values.sum() if values.sum() > 0 else values, "ind": ind, "nsig": int(np.argmin(ind)) if len(ind) else 0}


def train(df: DataFrame) -> dict:
    """The model of all spectra in df (y array), two passes over them; no spectra or over MOST_POINTS points are an error."""
    rows = point_means(df).orderBy("idx").limit(MOST_POINTS + 1).collect()
    if not rows or len(rows) > MOST_POINTS:
        raise ValueError(f"spectra of 1 to {MOST_POINTS} points are expected")
    mean = np.array([r["mean"] for r in rows])
    moments = np.zeros((len(mean), len(mean)))
    for i, j, m in second_moments(df, mean.tolist()).collect():
        moments[i, j] = moments[j, i] = m
    return model_of(mean, moments, rows[0].n)
