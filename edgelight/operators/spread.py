"""Tasks for tables of few files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """df over at least `tasks` partitions (default: the tasks that the session runs at once).

    A row group is one task of a scan, so a small table is one task whatever its rows cost. df is a table as read from files:
    a job that reads no column counts the partitions that hold rows. Where they suffice, as in any large table, df is
    returned as it is, without a shuffle; only a table of fewer row groups than tasks is dealt anew. Rows, repeated ones
    included, stay; an empty table stays as it is.
    """
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    own = df.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).head()[0]
    return df if own == 0 or own >= tasks else df.repartition(tasks)
