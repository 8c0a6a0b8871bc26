"""Nearest neighbours by largest inner product, with a vantage-point tree per shard.

Inner product is not a metric, so vectors get one more coordinate sqrt(M^2 - |x|^2), M the largest norm, and queries get
0 there: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the nearest by distance are those with the largest product. Each
shard (at most about `shard_rows` rows) is a tree whose nodes hold a vantage point and the range of distances of either
child; a child is skipped for a query if the triangle inequality puts all of it beyond `factor` times the query's
present radius. Factor 1 is exact search; a smaller factor skips more. Leaves are compared in one matrix product.

Queries are written to the shared folder as files of bounded size; the task of a shard reads them one by one, so neither
the driver nor a worker holds them all. Every shard returns its best k per query and the bests are merged. The trees are built once and kept in the shared folder. Scores are products of the original
vectors in double precision. Trees and radii are made of vectors divided by a power of two, so that no square overflows; where a product's
sum overflows on the way, it is taken from the divided vectors. Defined results: vectors that are null, zero, or hold null
or non-finite components take no part, and all others do; vectors meet only others of their length; rows with a query's own id are not its candidates; equal scores go by
smaller id; products beyond the largest double are infinite and equal; fewer candidates than k give fewer rows; repeated
rows are repeated candidates, but one query: of rows that share an id, the one with the least vector asks.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelight.llm.common import materialize, scratch_path

SHARD_ROWS = 16384
#: Vectors of a shard take about so many bytes at most
SHARD_BYTES = 64 << 20
QUERY_BLOCK = 4096
LEAF = 256
LARGEST = np.finfo(np.float64).max
FACTOR = 1.0


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def log_norm() -> Column:
    """Binary logarithm of the norm of v, without squares of anything above one."""
    top = F.array_max(F.transform("v", F.abs))
    return F.log2(top) + F.log2(F.aggregate(F.transform("v", lambda x: x / top), F.lit(0.0), lambda s, x: s + x * x)) / 2


def build(ids: np.ndarray, vectors: np.ndarray, log_limit: float, leaf: int) -> dict:
    """The tree over one shard: rows in leaf order, nodes as nested tuples. log_limit: binary logarithm of the largest norm."""
    power = int(np.ceil(log_limit))
    limit, small = 2.0 ** (log_limit - power) * (1 + 1e-9), np.ldexp(vectors, -power)
    more = np.sqrt(np.maximum(limit * limit - (small * small).sum(axis=1), 0))
    points = np.hstack([small, more[:, None]])
    order = np.argsort(ids, kind="stable")
    out = []

    def node(rows):
        if len(rows) <= leaf:
            out.append(rows)
            return (len(out) - 1,)
        # a far point of a far point spreads distances
        at = points[rows[0]]
        vantage = rows[int(np.argmax(((points[rows] - at) ** 2).sum(axis=1)))]
        d = np.sqrt(((points[rows] - points[vantage]) ** 2).sum(axis=1))
        by, half = np.argsort(d, kind="stable"), len(rows) // 2
        near, far = by[:half], by[half:]
        bounds = d[near].min(), d[near].max(), d[far].min(), d[far].max()
        return (points[vantage], bounds, node(rows[near]), node(rows[far]))

    root = node(order)
    return {"ids": ids, "vectors": vectors, "leaves": out, "root": root, "limit": limit, "power": power}


class Search:
    """Best k of one shard for a block of queries."""

    def __init__(self, tree: dict, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.t, self.qid, self.q, self.k, self.factor = tree, ids, queries, k, factor
        self.power = np.frexp(np.abs(queries).max(axis=1))[1]
        small = np.ldexp(queries, -self.power[:, None])
        self.points = np.hstack([small, np.zeros((len(queries), 1))])
        self.base = (small * small).sum(axis=1) + tree["limit"] ** 2
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.at = np.zeros((len(queries), k), np.int64)
        self.compared = 0

    def radius(self, rows: np.ndarray) -> np.ndarray:
        worst = self.score[rows, -1]
        small = np.ldexp(np.where(np.isinf(worst), 0, worst), -(self.power[rows] + self.t["power"]))
        return np.where(worst <= -LARGEST, np.inf, np.sqrt(np.maximum(self.base[rows] - 2 * small, 0)))

    def finite(self, s: np.ndarray, q: np.ndarray, v: np.ndarray, pairs: bool = False) -> np.ndarray:
        """Products s of queries (indexes) q and vectors v; where their sums overflowed, from divided vectors."""
        if not np.isfinite(s).all():
            left, right = self.points[q, :-1], np.ldexp(self.t["vectors"][v], -self.t["power"])
            power = self.power[q] + self.t["power"]
            small = (left * right).sum(axis=1) if pairs else left @ right.T
            s = np.where(np.isfinite(s), s, np.ldexp(small, power if pairs else power[:, None]))
        return s

    def leaf(self, at: int, rows: np.ndarray) -> None:
        own = self.t["leaves"][at]
        ids = self.t["ids"][own]
        for i in range(0, len(rows), 1024):
            r = rows[i : i + 1024]
            s = self.finite(self.q[r] @ self.t["vectors"][own].T, r, own).clip(-LARGEST, LARGEST)
            self.compared += s.size
            s[self.qid[r][:, None] == ids[None, :]] = -np.inf
            better = np.flatnonzero((s >= self.score[r, -1][:, None]).any(axis=1))
            if not len(better):
                continue
            r, s = r[better], s[better]
            scores = np.hstack([self.score[r], s])
            both = np.hstack([self.found[r], np.broadcast_to(ids, s.shape)])
            rows_at = np.hstack([self.at[r], np.broadcast_to(own, s.shape)])
            both = np.where(np.isinf(scores), np.iinfo(np.int64).max, both)
            best = np.lexsort((both, -scores), axis=1)[:, : self.k]
            self.score[r] = np.take_along_axis(scores, best, 1)
            self.found[r] = np.take_along_axis(both, best, 1)
            self.at[r] = np.take_along_axis(rows_at, best, 1)

    def visit(self, node, rows: np.ndarray) -> None:
        if len(node) == 1:
            self.leaf(node[0], rows)
            return
        point, (a, b, c, d), near, far = node
        dist = np.sqrt(np.maximum(((self.points[rows] - point) ** 2).sum(axis=1), 0))
        first_near = dist - b <= c - dist
        for child, lo, hi, these in ((near, a, b, first_near), (far, c, d, ~first_near), (far, c, d, first_near), (near, a, b, ~first_near)):
            r, x = rows[these], dist[these]
            if len(r):
                gap = np.maximum(np.maximum(lo - x, x - hi), 0)
                r = r[gap <= self.factor * self.radius(r) * (1 + 1e-9) + 1e-9]
                if len(r):
                    self.visit(child, r)

    @np.errstate(over="ignore", invalid="ignore", under="ignore")
    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.visit(self.t["root"], np.arange(len(self.q)))
        row, col = np.nonzero(~np.isinf(self.score))
        left, right = self.q[row], self.t["vectors"][self.at[row, col]]
        exact = np.zeros(len(row))
        for j in range(left.shape[1]):  # summed in the order of the components, as SQL does
            exact += left[:, j] * right[:, j]
        return self.qid[row], self.found[row, col], self.finite(exact, row, self.at[row, col], pairs=True)


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """(dim, shard, tree) for usable rows (id, v), in the shared folder."""
    facts = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(log_norm()).alias("limit"))
    facts = materialize(facts, "vector-facts")
    most = F.greatest(F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (F.col("dim") * 8 + 8))), F.lit(1))
    shards = facts.agg(F.sum(F.ceil(F.col("n") / most))).head()[0] or 1
    # one row per vector length; joined, so a few lengths or many take the same way
    rows = rows.withColumn("dim", F.size("v")).join(facts, "dim")
    n = F.ceil(F.col("n") / most).cast("int")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), n).cast("int"))
    # as many tasks and files as shards, so trees are built and searched side by side
    rows = rows.repartition(int(shards), "dim", "shard")

    def run(pdf):
        import pandas as pd

        vectors = np.array(pdf["v"].tolist(), np.float64)
        tree = build(pdf["id"].to_numpy(), vectors, float(pdf["limit"].iat[0]), leaf)
        return pd.DataFrame({"dim": [int(pdf["dim"].iat[0])], "shard": [int(pdf["shard"].iat[0])], "tree": [pickle.dumps(tree, protocol=5)]})

    return materialize(rows.groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, tree binary"), "vptree")


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> str:
    """Usable queries (id, v) as files of at most about `block` rows in the shared folder; the folder's path."""
    n = max(1, -(-queries.count() // block))
    path = scratch_path(queries.sparkSession, "queries")
    packed = queries.select("id", F.size("v").alias("dim"), "v")
    packed.repartition(n).write.option("maxRecordsPerFile", block).parquet(path)
    return path


def search(trees: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of usable queries (id, v) against an index."""
    folder = query_blocks(queries, block)

    def blocks():
        store, base = pafs.FileSystem.from_uri(folder)
        for f in store.get_file_info(pafs.FileSelector(base)):
            if f.base_name.endswith(".parquet") and f.size:
                with store.open_input_file(f.path) as source:
                    yield pq.read_table(source)

    def run(batches):
        for batch in batches:
            for dim, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                tree = pickle.loads(packed.as_py())
                for got in blocks():
                    own = got.filter(pa.compute.equal(got.column("dim"), dim))
                    if len(own):
                        vectors = own.column("v").combine_chunks().flatten().to_numpy().reshape(len(own), dim)
                        q, v, s = Search(tree, own.column("id").to_numpy(), vectors, k, factor).run()
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    found = trees.select("dim", "tree").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, factor: float = FACTOR) -> DataFrame:
    """The k nearest of every row whose id is divisible by `every`."""
    fine = usable(rows, id_col, vector_col)
    return search(index(fine), fine.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), k, factor)
