import numpy as np
import pytest
from pyspark.sql import functions as F

from edgelight.kernels import splines as sp
from edgelight.operators.spread import spread


def busy(df):
    """How many partitions hold rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_file_is_dealt_over_tasks_and_keeps_its_rows(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).select((F.col("id") % 40).alias("v"), F.when(F.col("id") > 5, F.lit("x")).alias("s")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    out = spread(df, 4)
    assert busy(df) == 1 and busy(out) == 4
    assert out.exceptAll(df).count() == 0 and out.count() == 100


def test_enough_files_and_empty_tables_are_left_alone(spark, tmp_path):
    many, none = str(tmp_path / "many"), str(tmp_path / "none")
    spark.range(100, numPartitions=6).write.parquet(many)
    spark.range(0).write.parquet(none)
    df, empty = spark.read.parquet(many), spark.read.parquet(none)
    assert spread(df, busy(df)) is df and spread(empty, 4) is empty


@pytest.mark.parametrize("degree", range(5))
@pytest.mark.parametrize("n", (2, 3, 6, 60))
def test_polynomials_pass_through_or_leave_orthogonal_residues(degree, n):
    x = np.sort(np.random.default_rng(n).uniform(-1, 3, n))
    y = np.cos(2 * x)
    c = sp.polyfit(x, y, degree)
    assert len(c) == degree + 1
    rest = y - np.polynomial.polynomial.polyval(x, c)
    for d in range(degree + 1):
        assert abs(rest @ x**d) < 1e-8
    if n <= degree + 1:
        assert np.abs(rest).max() < 1e-8


def test_polynomial_of_equal_or_single_points_is_the_mean():
    assert sp.polyfit([2.0, 2.0], [1.0, 3.0], 2).tolist() == [2.0] and sp.polyfit([2.0], [5.0], 1).tolist() == [5.0]
