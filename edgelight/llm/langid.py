"""Language identification by nearest centroid.

A text becomes counts of its character 1- to 3-grams (lower case, letters only, runs of other characters as one space),
hashed to DIMS buckets, weighted by log(1 + count) times inverse document frequency and normalised. Document frequencies
are counted over all training rows. Each language's vectors are clustered into `per_lang` centroids by spherical k-means on
a sample: distinct training texts whose digest falls under a threshold set by each language's count of distinct texts with
a letter, which keeps about twice SAMPLE, of which the SAMPLE smallest digests count; so the bound holds whatever the
input's size, and copies take no place from other texts. A text gets the language of the centroid with the largest cosine; it is rejected if
its cosine is under that centroid's floor, `slack` times the sample rows' low quantile there (less for short texts).

Defined results: null text and text without a letter are `und` with score 0 and are rejected; without any training row
all are `und`; repeated rows count as often as they occur, but once in the sample; ties go to the first language by name; more than MAX_LANGS languages are an error, since all
centroids go to every worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from edgelight.llm.common import materialize

DIMS = 4096
SAMPLE = 400
PER_LANG = 4
SLACK = 0.5
QUANTILE = 0.005
MAX_LANGS = 2000
PIECE = 1 << 18
#: A text of fewer n-grams lies farther from any centroid: its floor shrinks with the square root of their number
FULL = 600

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; None without a letter."""
    if not text:
        return None
    total, is_letter, seen = np.zeros(DIMS, np.int64), letters(), False
    text, tail, before = text.lower(), np.zeros(0, np.uint32), np.zeros(1, bool)
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = is_letter[c]
        # a run of other characters after a letter is one space
        keep = own | np.concatenate((before, own[:-1]))
        before, seen = own[-1:], seen or bool(own.any())
        n = len(tail)
        c = np.concatenate((tail, np.where(own, c, np.uint32(32))[keep].astype(np.uint32)))
        tail = c[-2:]
        h1 = c * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        h3 = (h2[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1) if len(c) > 2 else h2[:0]
        for h in (h1[n:], h2[max(n - 1, 0) :], h3[max(n - 2, 0) :]):
            total += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=DIMS)
    return total if seen else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / max(float(np.linalg.norm(v)), 1e-12)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Documents and, by bucket, documents that have it; partial sums per task."""

    def run(batches):
        n, df = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                g = grams(t.as_py())
                if g is not None:
                    n += 1
                    df += g > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate(([n], df)))], ["bucket", "n"])

    rows = train.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows
    total = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        total[r.bucket + 1] = r.n
    return int(total[0]), total[1:]


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids and each row's centroid."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


class Model:
    def __init__(self, langs: list[str], centroids: np.ndarray, floors: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.floors, self.idf = langs, centroids, floors, idf


def fit(train: DataFrame, sample: int = SAMPLE, per_lang: int = PER_LANG, slack: float = SLACK) -> Model | None:
    """A model from (text, lang) rows."""
    train = train.where("text is not null and lang is not null").select("text", "lang")
    n, df = frequencies(train)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # unassigned here may be a letter to Python's newer tables
    train = train.where(F.regexp_like("text", F.lit(r"[\p{L}\p{Cn}]"))).withColumn("digest", F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53))
    sizes = materialize(train.groupBy("lang").agg(F.approx_count_distinct("digest", 0.02).alias("n")), "languages")
    if (n_langs := sizes.count()) > MAX_LANGS:
        raise ValueError(f"{n_langs} languages; a model holds {MAX_LANGS} at most")
    picked = train.join(F.broadcast(sizes), "lang")  # MAX_LANGS rows at most
    # copies share a digest, so a hot text is one sample row
    picked = picked.where(F.col("digest") < 2.0 * sample / F.col("n")).groupBy("lang", "digest").agg(F.first("text").alias("text"))

    def vectors(batches):
        for batch in batches:
            rows = [(lang.as_py(), d.as_py(), g) for lang, d, t in zip(*batch.columns) if (g := grams(t.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([weighted(r[2], idf).astype(np.float32).tobytes() for r in rows], pa.binary())], ["lang", "digest", "v"])

    def cluster(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("digest").head(sample)
        x = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(len(pdf), DIMS)
        c, own = kmeans(x, per_lang)
        near = (x * c[own]).sum(axis=1)
        floor = [slack * float(np.quantile(near[own == j], QUANTILE)) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": [key[0]] * len(c), "j": range(len(c)), "c": [v.astype(np.float32).tobytes() for v in c], "floor": floor})

    rows = picked.mapInArrow(vectors, "lang string, digest double, v binary").groupBy("lang").applyInPandas(cluster, "lang string, j int, c binary, floor double").collect()  # per_lang rows a language
    rows.sort(key=lambda r: (r.lang, r.j))
    if not rows:
        return None
    return Model([r.lang for r in rows], np.stack([np.frombuffer(r.c, np.float32) for r in rows]), np.array([r.floor for r in rows]), idf)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (a column of docs with such a name gives way)."""
    added = StructType([*DataType.fromDDL("lang_pred string, score double, rejected boolean").fields])
    plain = docs.drop(*added.names)
    names = plain.columns
    schema = StructType([*plain.schema.fields, *(StructField(f.name, f.dataType) for f in added.fields)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids: languages x per_lang x DIMS

    def run(batches):
        m = shared.value
        at = names.index(text_col)
        for batch in batches:
            n = len(batch)
            pred, score, bad = ["und"] * n, np.zeros(n), np.ones(n, bool)
            for i in range(0, n, 128):
                rows, vs, size = [], [], {}
                for j in range(i, min(n, i + 128)):
                    g = grams(batch.column(at)[j].as_py())
                    if g is not None and m is not None:
                        rows.append(j)
                        size[j] = int(g.sum())
                        vs.append(weighted(g, m.idf))
                if rows:
                    near = np.stack(vs) @ m.centroids.T
                    best = np.argmax(near, axis=1)
                    for j, b, s in zip(rows, best, near.max(axis=1)):
                        pred[j], score[j], bad[j] = m.langs[b], min(max(float(s), 0.0), 1.0), s < m.floors[b] * min(1.0, (size[j] / FULL) ** 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score), pa.array(bad)], [*names, *added.names])

    return plain.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """predict() with a model fitted on the rows that are not held out."""
    train = docs.where(~held_out(id_col)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(docs, fit(train), text_col)
