"""A folder of scan files as a stream: the batch operators, unchanged, on new files. All steps are row by row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelight.operators import spectra
from edgelight.sources import datasources


def scans(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return datasources.scan_files(spark, folder, pattern, stream=True)


def reduced(spark: SparkSession, folder: str, mode: str = "raw", pattern: str = "*", **columns) -> DataFrame:
    """Stream of normalised, background-subtracted, transformed spectra; a bad file is a row with its error."""
    return spectra.reduce_all(spectra.build_mu(scans(spark, folder, pattern), mode, **columns).where(F.size("mu") > 0).drop("status", "error"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Scans per event-time window and status, with a watermark for late ones (columns ts, status)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count(F.lit(1)).alias("n"))
