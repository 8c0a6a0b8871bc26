"""Tables of curves in long form (gid, idx, x, y) and wide form (gid, x array, y array)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_curve(*order) -> Window:
    return Window.partitionBy("gid").orderBy(*(order or ("idx",)))


def long_curves(df: DataFrame, gid: str, x, y, order: str) -> DataFrame:
    """Rows of a table as curves; idx counts from 0 in the given order."""
    rows = df.select(F.col(gid).alias("gid"), F.col(order).alias("o"), x.alias("x"), y.alias("y"))
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("gid").orderBy("o")) - 1).select("gid", "idx", "x", "y")


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One curve per user: seconds since 2024-01-01 and value."""
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) / 1e6D")
    return long_curves(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", seconds, F.col("value"), "ts")


def vector_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 64-point curve per embedding on a common grid; no shuffle."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.posexplode("embedding").alias("idx", "v"))
    return rows.select("gid", "idx", (F.col("idx") * F.lit(0.05)).alias("x"), F.col("v").cast("double").alias("y"))


def wide(df: DataFrame, *columns: str) -> DataFrame:
    """Long to wide, in idx order."""
    columns = columns or ("x", "y")
    rows = df.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("idx", *columns))).alias("p"))
    return rows.select("gid", *(F.col(f"p.{c}").alias(c) for c in columns))


def long(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Wide to long; no shuffle."""
    rows = df.select("gid", F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("idx", "p"))
    return rows.select("gid", "idx", "p.x", "p.y")
