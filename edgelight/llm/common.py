"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local = threading.local()


def _scratch() -> list[str]:
    """Paths of this thread, so that runs in other threads keep theirs."""
    if not hasattr(_local, "paths"):
        _local.paths = []
    return _local.paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set, else one of this process (local mode, tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = own_folder()
    return folder.rstrip("/")


@cache
def own_folder() -> str:
    """One local folder of this process."""
    return "file://" + tempfile.mkdtemp(prefix="edgelight-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, remembered until release_scratch()."""
    path = f"{shared_dir(spark)}/edgelight-scratch/{label}-{uuid.uuid4().hex}"
    _scratch().append(path)
    return path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    return len(_scratch())


def release_scratch(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Delete what materialize() has written between two marks; call it when the results that read it are stored elsewhere."""
    sc = spark.sparkContext
    paths = _scratch()
    for name in paths[since:upto]:
        if name:
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    paths[since:upto] = [""] * len(paths[since:upto])


def set_aside(docs: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column but `keep` under a neutral name, so that no operator's column clashes with it; and the way back.

    The way back restores names and the order of docs' columns; what an operator has added follows, with underscores where a
    column of docs has its name.
    """
    names = docs.columns
    aside = {c: c if c in keep else f"own_{i}" for i, c in enumerate(names)}
    taken = {c.lower() for c in names}

    def back(out: DataFrame) -> DataFrame:
        added = []
        for c in out.columns:
            if c not in aside.values():
                name = c
                while name.lower() in taken:
                    name += "_"
                taken.add(name.lower())
                added.append(F.col(c).alias(name))
        return out.select(*(F.col(v).alias(c) for c, v in aside.items()), *added)

    return docs.toDF(*aside.values()), back


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within limit; beyond it the planner's shuffle join serves."""
    return df.hint("broadcast") if rows <= limit else df
