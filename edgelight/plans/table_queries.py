"""Queries of the table side: element look-ups, parameter tables, correlations, masks, symmetry, selections; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgelight import curves, session
from edgelight.functions import elements
from edgelight.functions import pointwise as p
from edgelight.operators import aggregates as ag
from edgelight.operators import grids, lattice
from edgelight.operators import ordered as od
from edgelight.plans.native_queries import BOX, CELL, EVENTS, GRAD, SITES_SQL, VECTORS, W, out, r6, supplier_sites

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


ELEMENTS = "e AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{s}', {m!r}::DOUBLE)" for i, (s, m) in enumerate(zip(elements.SYMBOLS, elements.MASSES))) + ") t(z, symbol, mass))"


@query(f"WITH {ELEMENTS} SELECT p_partkey, symbol, round(mass, 6) + 0.0 mass FROM part JOIN e ON p_size = z")
def element_lookup(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").alias("z"))
    return out(df.join(F.broadcast(elements.table(spark)), "z"), ["p_partkey", "symbol"], "mass")


@query("SELECT o_orderkey, array_to_string([o_orderstatus, o_orderpriority], ' – ') label FROM orders")
def geometry_label(spark, sf):
    geom = F.array(F.struct(F.col("o_orderstatus").alias("label")), F.struct(F.col("o_orderpriority").alias("label")))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", session.geometry_label(geom).alias("label"))


@query("WITH b AS (SELECT c_custkey k, avg(o_totalprice) f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey::VARCHAR \"name\", CASE WHEN c_custkey % 2 = 0 THEN 'vary' ELSE 'fixed' END kind, round(CASE WHEN c_custkey % 2 = 0 THEN coalesce(f, c_acctbal) ELSE c_acctbal END, 6) + 0.0 \"value\" FROM customer LEFT JOIN b ON k = c_custkey")
def adopt_guesses(spark, sf):
    c, o = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    params = c.select(F.col("c_custkey").cast("string").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "vary").otherwise("fixed").alias("kind"), F.col("c_acctbal").alias("value"))
    best = o.groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.avg("o_totalprice").alias("value")).withColumn("kind", F.lit("best"))
    return out(session.adopt(params, best), ["name", "kind"], "value")


@query("SELECT vec_id gid, len(list_filter(embedding, lambda x: x BETWEEN -0.1 AND 0.1)) n FROM embeddings")
def mask_count(spark, sf):
    """Samples that a mask keeps, by array functions on the wide form; the mask's ends are taken in the samples' type, as SQL takes them."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    kind = rows.schema["embedding"].dataType.elementType
    kept = F.filter("embedding", lambda x: x.between(F.lit(-0.1).cast(kind), F.lit(0.1).cast(kind)))
    return rows.select(F.col("vec_id").alias("gid"), F.size(kept).cast("long").alias("n"))


@query(f"WITH {VECTORS}, m AS (SELECT label, idx, avg(y) y FROM c JOIN embeddings e ON e.vec_id = c.gid GROUP BY 1, 2), k AS (SELECT a.label i, b.label j, corr(a.y, b.y) r FROM m a JOIN m b ON a.idx = b.idx AND a.label < b.label GROUP BY 1, 2) SELECT i, j, round(r, 6) + 0.0 r, row_number() OVER (ORDER BY abs(r) DESC, i, j) AS place FROM k")
def correlations(spark, sf):
    """Pairs of a small set of series by the size of their correlation: a report's ranking."""
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.posexplode("embedding").alias("idx", "v")).groupBy("label", "idx").agg(F.avg(F.col("v").cast("double")).alias("y"))
    a, b = rows.select(F.col("label").alias("i"), "idx", F.col("y").alias("a")), rows.select(F.col("label").alias("j"), "idx", F.col("y").alias("b"))
    k = a.join(b, "idx").where("i < j").groupBy("i", "j").agg(F.corr("a", "b").alias("r"))
    return out(k.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "i", "j")).cast("long")), ["i", "j", "place"], "r")


@query("SELECT p_partkey, round((p_size + 2)::DOUBLE * 3.61, 6) + 0.0 x, round((p_size / 2.0::DOUBLE) * 3.61, 6) + 0.0 y, round(0.25::DOUBLE * 3.61, 6) + 0.0 z FROM part")
def lattice_cart(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") + 2.0).alias("fx"), (F.col("p_size") / 2.0).alias("fy"), F.lit(0.25).alias("fz"))
    return out(lattice.cartesian(df, CELL), ["p_partkey"], "x", "y", "z")


@query(f"WITH {SITES_SQL} SELECT site_id, count(*) n, round(min(r), 6) + 0.0 nearest FROM b WHERE r <= 12.00000001 AND r > 1e-8 GROUP BY site_id")
def site_counts(spark, sf):
    df = lattice.cluster(supplier_sites(spark, sf), BOX, 7, 12.0).where("r > 1e-8").groupBy("site_id").agg(F.count("*").alias("n"), F.min("r").alias("nearest"))
    return out(df, ["site_id", "n"], "nearest")


@query("SELECT o_orderkey, 'kept' state FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) UNION ALL SELECT o_orderkey, 'dropped' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def reconcile(spark, sf):
    """What a new selection keeps and drops: semi and anti join."""
    o, c = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer"))
    wanted = c.where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    o = o.select("o_orderkey", "o_custkey")
    kept, gone = o.join(wanted, "o_custkey", "left_semi"), o.join(wanted, "o_custkey", "left_anti")
    return kept.select("o_orderkey", F.lit("kept").alias("state")).unionByName(gone.select("o_orderkey", F.lit("dropped").alias("state")))


@query(f"WITH {EVENTS} SELECT gid, count(*) n, round(min(x), 6) + 0.0 lo, round(max(x), 6) + 0.0 hi FROM c GROUP BY gid HAVING count(*) > 2")
def skip_empty(spark, sf):
    df = curves.wide(curves.event_curves(spark, sf)).where(F.size("y") > 2)
    return out(df.select("gid", F.size("x").cast("long").alias("n"), F.array_min("x").alias("lo"), F.array_max("x").alias("hi")), ["gid", "n"], "lo", "hi")


@query(f"WITH {VECTORS}, s AS (SELECT gid, idx, x, ({GRAD.format('y')}) g FROM c {W}) SELECT gid, min_by(idx, (-g, idx)) idx, round(max(g), 6) + 0.0 g FROM s GROUP BY gid")
def steepest_point(spark, sf):
    """The coarse pass of edge finding: the first largest derivative."""
    df = curves.vector_curves(spark, sf).withColumn("g", od.gradient("y")).select("gid", "idx", "x", F.col("g").alias("y"))
    best = df.groupBy("gid").agg(ag.first_max().alias("p"))
    return best.select("gid", F.col("p.idx").cast("long").alias("idx"), r6(F.col("p.y")).alias("g"))


@query(f"WITH {VECTORS}, s AS (SELECT gid, idx, y * CASE WHEN idx < 32 THEN 1 ELSE -1 END y FROM c) SELECT gid, idx, round(-1.7 * y, 6) + 0.0 b, round(abs(y), 6) + 0.0 m FROM s")
def background_k(spark, sf):
    y = F.col("y") * F.when(F.col("idx") < 32, 1).otherwise(-1)
    df = curves.vector_curves(spark, sf).withColumn("y", y).withColumns({"b": F.lit(-1.7) * F.col("y"), "m": p.polar(F.col("y"), F.lit(0.0))[0]})
    return out(df, ["gid", "idx"], "b", "m")


@query(f"WITH {EVENTS}, v AS (SELECT gid, avg(y) y, count(*) n FROM c WHERE x BETWEEN 300000 AND 900000 GROUP BY gid) SELECT gid, round(y, 6) + 0.0 pre, n FROM v")
def pre_edge_mean(spark, sf):
    df = curves.event_curves(spark, sf).where("x between 300000 and 900000").groupBy("gid").agg(F.avg("y").alias("pre"), F.count("*").alias("n"))
    return out(df, ["gid", "n"], "pre")


@query(f"WITH {VECTORS} SELECT gid, round(max(y) - min(y), 6) + 0.0 height, round(sum(y), 6) + 0.0 total FROM c WHERE idx BETWEEN 8 AND 55 GROUP BY gid")
def region_summary(spark, sf):
    df = curves.vector_curves(spark, sf).where(F.col("idx").between(8, 55)).groupBy("gid").agg((F.max("y") - F.min("y")).alias("height"), F.sum("y").alias("total"))
    return out(df, ["gid"], "height", "total")


@query(f"WITH {EVENTS}, {'r AS (SELECT max(a) lo, min(b) hi FROM (SELECT gid, min(x) a, max(x) b FROM c GROUP BY gid))'} SELECT gid, count(*) n FROM c, r WHERE x BETWEEN lo AND hi GROUP BY gid")
def points_in_overlap(spark, sf):
    df = curves.event_curves(spark, sf)
    inside = df.join(F.broadcast(grids.overlap(df)), F.col("x").between(F.col("lo"), F.col("hi")))  # one row
    return inside.groupBy("gid").agg(F.count("*").alias("n"))
