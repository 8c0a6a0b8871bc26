"""Token counts with a digest cache.

A text's key is the SHA-256 of its normalised content (null becomes empty, text as UTF-8) together with the SHA-256 of
the tokenizer file. Keys are joined to the stored counts; of the keys that miss, one text each is encoded, and the new
counts are appended to the cache as Parquet. So copies cost one encoding and a second run encodes nothing.

Counts are those of the `tokenizers` library for the given .json file, for all texts. A batch's texts are cut into units
over which no token reaches (encoders.py says why that is exact), and each distinct unit is encoded once.

Defined results: null and empty text count 0; special strings inside texts are special tokens, as is the library's
default; repeated rows share one encoding; extra columns are kept out of the way.
"""

from __future__ import annotations

import hashlib
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelight.llm import encoders
from edgelight.llm import wordhash as wh
from edgelight.llm.common import materialize, scratch_path

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
#: Texts are cut and encoded in pieces of about so many bytes
PIECE_BYTES = 8 << 20


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def counts_of(path: str, texts: list[str]) -> np.ndarray:
    """The number of tokens of each text."""
    numbers, encode = encoders.Numbers(), encoders.byte_bpe(path, plain=False)
    # a first unit has no space in front of it
    own = [[first, *(" " + u for u in rest)] for first, *rest in (encoders.units(t) or [""] for t in texts)]
    places = np.fromiter(map(numbers.__getitem__, chain.from_iterable(own)), np.int64)
    n = np.append(encoders.encoded(encode, list(numbers))[1][places], 0)
    size = np.fromiter(map(len, own), np.int64, len(own))
    return np.add.reduceat(n, np.cumsum(size) - size)


def cached_counts(docs: DataFrame, path: str, text_col: str = "text", cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(content keys of docs joined with what is needed, counts): docs with `content` and `n_bytes`, and (content, n_tokens).

    cache: a folder of Parquet files that grows by the misses of each call; by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    version = tokenizer_digest(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("content", F.unhex(F.sha2(text, 256))).withColumn("n_bytes", F.octet_length(text).cast("long"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    misses = keyed.select("content", text.alias("text"))
    if exists:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
        misses = misses.join(stored, "content", "left_anti")
    # one text for each missing key; copies within a task are dropped before the shuffle
    misses = misses.groupBy("content").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            for first, texts in wh.groups(batch.column(1), PIECE_BYTES):
                n = counts_of(path, [t.decode() for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])

    misses.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    # two callers may append the same key; a key has one count. Written out, so that the join can split a hot key
    return keyed, materialize(counts.groupBy("content").agg(F.min("n_tokens").alias("n_tokens")), "token-counts")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache: str | None = None) -> DataFrame:
    """One row per document: id_col, n_bytes, n_tokens."""
    keyed, counts = cached_counts(docs.select(id_col, text_col), path, text_col, cache)
    return keyed.select(id_col, "content", "n_bytes").join(counts, "content").select(id_col, "n_bytes", "n_tokens")
