"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its caller stores the result before the next stage
starts, and the next stage in the same thread then deletes what the one before kept in the shared folder for itself.

Defined results of all stages: columns of docs keep their names, places and values, whatever operators call theirs; a null
id stays a document of its own (near_copies keeps it, lines orders it last); null texts are rejected by language; rows
that share an id are separate documents, but near_copies takes them as one; an empty table gives an empty table.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelight.llm import common
from edgelight.llm.decontaminate import decontaminate
from edgelight.llm.langid import identify
from edgelight.llm.line_dedup import dedup_lines
from edgelight.llm.mixing import drawn, mix
from edgelight.llm.near_dedup import near_duplicates

DROPPED_IDS = 2_000_000
_own = threading.local()


def staged(f: Callable) -> Callable:
    """A stage that first deletes what the stage before it in this thread has kept for itself."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        since = common.scratch_mark()
        out = f(spark, docs, sf_dir)
        _own.marks = since, common.scratch_mark()
        return out

    run_stage.__name__ = f.__name__
    run_stage.__doc__ = f.__doc__
    return run_stage


def release(spark: SparkSession) -> None:
    """Delete what this thread's last stage has kept for itself; its result must be stored by then."""
    marks = getattr(_own, "marks", None)
    if marks:
        common.release_scratch(spark, *marks)
        _own.marks = None


@staged
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too far from every language's centroids, go; columns stay."""
    plain, back = common.set_aside(docs, "doc_id", "text", "lang")
    return back(identify(plain).where(~F.col("rejected"))).select(docs.columns)


@staged
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut from texts (n_chars follows); a document that becomes empty is a repeat and goes."""
    plain, back = common.set_aside(docs, "doc_id", "text", "n_chars")
    cut = dedup_lines(plain).where("n_removed = 0 or text <> ''")
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return back(cut.withColumn("n_chars", chars)).select(docs.columns)


@staged
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, that with the smallest doc_id."""
    gone = common.materialize(near_duplicates(docs, k=5, num=80, den=100).where(~F.col("kept")).select("doc_id"), "near-copies")
    return docs.join(common.small_side(gone, gone.count(), DROPPED_IDS), "doc_id", "left_anti").select(docs.columns)


@staged
def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    plain, back = common.set_aside(docs, "doc_id", "text")
    found = decontaminate(plain, common.table(spark, sf_dir, "benchmark"), keep_spans=False)
    return back(found.where("decon.n_hit = 0")).select(docs.columns)


@staged
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per draw of the mix, with its shard and order; documents that are not drawn go.

    After the columns of docs come size, source_size, target, taken, copy, words, shard and order_key, with underscores where
    docs has a column of that name.
    """
    plain, back = common.set_aside(docs, "doc_id", "text", "source")
    return back(drawn(mix(plain, keep=True)))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmarks", benchmarks), ("mixture", mixture)]

#: Centroids and signatures are beyond SQL; tests hold every stage and run() against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each stored in the shared folder before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
