"""Every curve query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pytest

from edgelight.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and abs(x - y) <= 2e-5 * max(1.0, abs(x))), (name, a, b)


def test_kernel_queries_run(spark):
    for name in ("pre_edge", "reduce_all", "xftr", "mback", "lincombo_fit", "path_fit"):
        out = catalog.queries()[name](spark, SF).collect()
        assert out and all(r.status == "ok" for r in out), name


def test_build_mu_rounds_as_its_sql(spark, tmp_path):
    """Sums over 32 and 64 end in a half behind the sixth decimal, or a bit beside it."""
    lines = [(4 * o + 2, o, 0, i, q, 100.0 + i, d / 100, t / 100) for o, q in ((0, 32.0), (1, 64.0), (2, 160.0)) for i, (d, t) in enumerate((d, t) for d in range(11) for t in range(9))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    res = c.execute(catalog.oracle_sql()["build_mu"])
    names = [d[0] for d in res.description]
    df = catalog.queries()["build_mu"](spark, str(tmp_path)).select(*names)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(res.fetchall(), key=str)


def exactly(spark, name, folder, table):
    """Spark's rows and the SQL's over one table written to a folder, without rounding."""
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    res = c.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in res.description]
    return sorted(map(tuple, catalog.queries()[name](spark, str(folder)).select(*names).collect()), key=str), sorted(res.fetchall(), key=str)


def test_time_lines_round_as_its_sql(spark, tmp_path):
    """Hours half-way between two fourth decimals, whose doubles lie on either side."""
    rows = spark.range(3000).selectExpr("id % 1000 user_id", "timestamp_micros(1704067200000000 + 180000 + 360000 * (id * 7919 % 600000)) ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    # users with a count not divisible by 3, so that the last hour shows as well
    spark.range(500).selectExpr("id user_id", "timestamp_micros(1704067200000000 + 180000 + 360000 * (600000 + id * 31)) ts").write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got, want = exactly(spark, "time_lines", tmp_path, "events")
    assert len(got) == 1000 and got == want


def test_mask_count_takes_the_mask_in_the_samples_type(spark, tmp_path):
    """0.1 as a float lies beyond 0.1 as a double, and is within the mask for the SQL."""
    rows = [(0, [0.1, -0.1, 0.0, 0.2]), (1, [0.10000001, 0.1000001, -0.1000001]), (2, [float("nan"), float("inf"), None]), (3, []), (4, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = exactly(spark, "mask_count", tmp_path, "embeddings")
    assert got == want
    assert got[0] == (0, 3)


def test_wide_lines_print_as_their_sql(spark, tmp_path):
    """Samples whose seventh decimal is their last one, a 5; ends of the doubles' range; a sample that is missing."""
    rows = [(v, [(v * 64 + i - 130) / 128 for i in range(64)], 0) for v in range(5)]
    rows.append((7, [0.0, -0.0, 1e-9, -1e-9, 1e30, float("nan"), float("inf"), float("-inf"), None, 123456.78] + [0.5] * 54, 0))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = exactly(spark, "wide_lines", tmp_path, "embeddings")
    assert len(got) == 65 and got == want


def test_wide_lines_pairs_print_as_their_sql(spark, tmp_path):
    """Curves of unlike lengths in several blocks, with gaps of more than a block."""
    rows = spark.range(2600).selectExpr("id user_id", "explode(sequence(1, if(id in (3, 2590), 4, if(id % 1300 = 17, 3, 1 + cast(id % 2 as int))))) i")
    rows.selectExpr("user_id", "timestamp_micros(1704067200000000 + i * 1000003 + user_id) ts", "(user_id * 8 + i) / 128 - 3 value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = exactly(spark, "wide_lines_pairs", tmp_path, "events")
    assert len(got) == 5 and got == want
