"""All-or-none file sink, batch and stream; item source with pushed filters; standards joined to background removal."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgelight.kernels import reduction as rd
from edgelight.operators import spectra
from edgelight.plans.kernel_queries import spectra as made_spectra
from edgelight.sources import items, sinks, writers

ROWS = "name string, content string"


def files(folder):
    return {os.path.relpath(os.path.join(at, n), folder): open(os.path.join(at, n)).read() for at, _, names in os.walk(folder) for n in names}


def save(df, folder, mode="append"):
    df.write.format("xasfiles").mode(mode).save(str(folder))


def test_files_of_a_job_are_there_together(spark, tmp_path):
    sinks.register(spark)
    df = spark.createDataFrame([(f"d/s{i}.xmu", f"{i} é\n") for i in range(20)], ROWS).repartition(5)
    save(df, tmp_path)
    assert files(tmp_path) == {f"s{i}.xmu": f"{i} é\n" for i in range(20)}
    more = spark.createDataFrame([("s20.xmu", "new"), ("s3.xmu", "other")], ROWS).repartition(2)
    with pytest.raises(Exception, match="s3.xmu"):
        save(more, tmp_path)
    assert files(tmp_path) == {f"s{i}.xmu": f"{i} é\n" for i in range(20)}
    save(more, tmp_path, "overwrite")
    assert files(tmp_path)["s3.xmu"] == "other" and len(files(tmp_path)) == 21
    save(df.limit(0), tmp_path / "none")


@pytest.mark.parametrize("bad", [("x9", None), (None, "c"), ("s1", "twice"), (".hidden", "c")])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, bad):
    sinks.register(spark)
    df = spark.createDataFrame([*((f"s{i}", str(i)) for i in range(12)), bad], ROWS).repartition(4)
    with pytest.raises(Exception):
        save(df, tmp_path)
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".staging-")] == []


def test_stream_writes_each_batch_once(spark, tmp_path):
    sinks.register(spark)
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n in range(2):
        spark.createDataFrame([(f"b{n}-{i}", f"{n}{i}") for i in range(3)], ROWS).coalesce(1).write.mode("append").parquet(str(source))
        q = spark.readStream.schema(ROWS).parquet(str(source)).writeStream.format("xasfiles").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(target))
        q.awaitTermination(120)
    assert files(target) == {f"b{n}-{i}": f"{n}{i}" for n in range(2) for i in range(3)}


@pytest.fixture
def folder(tmp_path):
    e = np.linspace(8800, 9700, 300)
    mu = 0.5 + np.arctan(e - 8979) / np.pi + 1e-4 * (e - 8979)
    (tmp_path / "sub").mkdir()
    (tmp_path / ".dark").mkdir()
    for name in ("cu.xmu", "sub/zn.XMU", ".dark/x.xmu", ".y.xmu"):
        (tmp_path / name).write_text(writers.xmu(e, mu))
    k = 0.05 * np.arange(40)
    (tmp_path / "cuk.chi").write_text(writers.two_column(["# h"], k, np.sin(k)))
    (tmp_path / "cur.dat").write_text(writers.complex_columns(["# h"], k, np.cos(k), np.sin(k)))
    (tmp_path / "sub/bad.xmu").write_text("no numbers\n")
    (tmp_path / "scan.001").write_text("1 2 3\n2 3 4\n")
    return tmp_path, e, mu, k


def read(spark, folder, **options):
    items.register(spark)
    return spark.read.format("xasitem").options(**options).load(str(folder))


def test_items(spark, folder):
    at, e, mu, k = folder
    rows = {r.name: r for r in read(spark, at, item="f'").collect()}
    assert set(rows) == {"cu.xmu", "zn.XMU", "bad.xmu"} and rows["bad.xmu"].status == "failed"
    assert np.allclose(rows["zn.XMU"].y, np.gradient(mu) / np.gradient(e), atol=1e-6)
    second = read(spark, at, item="f''").where("name = 'cu.xmu'").head()
    assert len(second.y) == 300
    norm = read(spark, at, item="norm").where("name = 'cu.xmu'").head()
    assert abs(np.mean(np.array(norm.y)[-40:]) - 1) < 0.1
    chi = read(spark, at, item="k.chi", kweight="2").head()
    assert np.allclose(chi.y, k**2 * np.sin(k), atol=1e-6)
    assert np.allclose(read(spark, at, item="r.dat").head().y, np.ones(40), atol=1e-6)
    assert [r.name for r in read(spark, at, item="raw").where("status = 'ok'").collect()] == ["scan.001"]
    assert {r.name for r in read(spark, at, item="raw", produced="true").where("status = 'ok'").collect()} == {"scan.001", "cu.xmu", "zn.XMU", "cuk.chi", "cur.dat"}
    with pytest.raises(Exception, match="item"):
        read(spark, at, item="other").count()


def test_filters_reach_the_listing(spark, folder):
    at, *_ = folder
    # a file that is not wanted is never opened: unreadable names show nothing
    df = read(spark, at).where(F.col("name").isin("cu.xmu", "none") & F.col("path").startswith(str(at)) & F.col("name").endswith(".xmu"))
    assert [r.name for r in df.collect()] == ["cu.xmu"]
    reader = items.ItemReader({"path": str(at)})
    left = list(reader.pushFilters([items.EqualTo(("name",), "cu.xmu"), items.EqualTo(("status",), "ok"), items.StringStartsWith(("path",), str(at))]))
    assert [f.attribute for f in left] == [("status",)] and reader.wanted(f"{at}/cu.xmu") and not reader.wanted(f"{at}/sub/zn.XMU")
    assert sorted(os.path.relpath(p.path, at) for p in reader.partitions()) == [".", "sub"]
    plan = read(spark, at).where("name = 'cu.xmu'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" in plan or "= cu.xmu" not in plan.split("BatchScan")[0], plan


def test_standards_constrain_background_removal(spark):
    df = made_spectra(spark, "/root/testdata/sf0.001").limit(3).cache()
    k = 0.05 * np.arange(281)
    std = spark.createDataFrame([(k.tolist(), (0.1 * np.sin(4.6 * k) * np.exp(-0.02 * k * k)).tolist())], "k array<double>, chi array<double>")
    got = {r.gid: r for r in spectra.autobk_standard(df, std).collect()}
    s = std.head()
    for r in df.collect():
        want = rd.autobk(np.array(r.energy), np.array(r.mu), replace(rd.AutobkParams(), k_std=tuple(s.k), chi_std=tuple(s.chi)))
        plain = rd.autobk(np.array(r.energy), np.array(r.mu))
        assert np.allclose(got[r.gid].chi, want["chi"]) and not np.allclose(want["chi"], plain["chi"])
    first = df.orderBy("gid").head().gid
    own = spectra.autobk_standard(df, std.withColumn("gid", F.lit(first).cast("long"))).collect()
    assert {r.gid: r.status for r in own} == {g: "ok" if g == first else "skipped" for g in got}
    with pytest.raises(Exception, match="one standard"):
        spectra.autobk_standard(df, std.union(std)).collect()
