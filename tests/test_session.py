import numpy as np
import pytest
from pyspark.sql import functions as F

from edgelight import session as ss
from edgelight.functions import elements, expressions as ex
from edgelight.plans.kernel_queries import demo_path
from edgelight.sources import text as tx
from edgelight.streaming import scans


@pytest.fixture
def work(spark):
    rows = [(i, f"s{i}", [1.0, 2.0, 3.0, 4.0], [0.1, float("nan") if i == 1 else 0.2, 0.3, 0.4], [9.0]) for i in range(3)]
    return ss.Session(spark.createDataFrame(rows, "gid long, label string, energy array<double>, mu array<double>, norm array<double>"))


def test_edits_clear_what_they_make_stale(work):
    got = {r.gid: r for r in work.drop_bad().df.collect()}
    assert got[1].energy == [1.0, 3.0, 4.0] and got[1].norm is None and got[0].norm == [9.0]
    assert work.deglitch(3.1).df.where("gid = 0").head().energy == [1.0, 2.0, 4.0]
    assert work.undo() and work.undo() and not work.undo()
    assert work.trim(3.5, 1.5).df.where("gid = 2").head().energy == [2.0, 3.0]


def test_selection_and_reconcile(spark, work):
    assert [r.gid for r in work.select(1, value=False).targets().collect()] == [0, 2]
    work.select(0, 2, value=False).current = 1
    assert [r.gid for r in work.targets().collect()] == [1]
    wanted = spark.createDataFrame([("s1",), ("new",)], "label string")
    work.reconcile(wanted, lambda new: new.select(F.lit(7).cast("long").alias("gid"), "label"))
    assert {r.label for r in work.df.collect()} == {"s1", "new"}
    assert work.remove(7).df.count() == 1 and work.add(spark.createDataFrame([(8, "z")], "gid long, label string")).df.count() == 2


def test_json_round_trip(spark, work, tmp_path):
    work.drop_bad().to_json(str(tmp_path / "s"))
    back = ss.Session.from_json(spark, str(tmp_path / "s"), work.df.schema.add("later", "string"))
    assert back.df.count() == 3 and back.df.where("later is null").count() == 3


def test_views(work):
    df = work.df.selectExpr("*", "array(1D, 2D) k", "array(1D, 1D) chi", "array(1D,2D,4D,8D) bkg", *(f"array(0D) {c}" for c in ("flat", "r", "chir_mag", "q", "chiq_re", "dmude", "d2mude")))
    assert ss.view(df, "chi", 2).head().y == [1.0, 4.0]
    assert ss.view(df, "dbkg").head().y == [1.0, 2.0, 4.0]
    for name in ss.views():
        assert ss.view(df, name).count() == 3


def test_adopt_and_fit_input(spark):
    params = spark.createDataFrame([("a", "vary", 1.0), ("b", "fixed", 2.0)], "name string, kind string, value double")
    best = spark.createDataFrame([("best", "a", 5.0), ("best", "b", 6.0)], "kind string, name string, value double")
    assert {r.name: r.value for r in ss.adopt(params, best).collect()} == {"a": 5.0, "b": 2.0}
    parsed = tx.fit_input("guess amp 0.9\nset d = amp*2\npath 1 p.dat\ns02 1 amp\ndelr 1 d*reff\n")
    p, files, specs = ss.apply_fit_input(parsed, {"p.dat": demo_path(2.5, 12)})
    assert p.resolve() == {"amp": 0.9, "d": 1.8} and specs == [{"s02": "amp", "deltar": "d*reff"}] and files[0]["degen"] == 12
    assert isinstance(ss.literal_or_expression("1.5"), float) and isinstance(ss.literal_or_expression("a+1"), ex.Expr)


def test_elements(spark):
    assert elements.atomic_number("cu") == 29 and elements.symbol_of(8) == "O" and elements.symbol_of(999) is None
    assert elements.table(spark).count() == 118 and elements.mass_of(29) == pytest.approx(63.546)


def test_streaming_reduction(spark, tmp_path):
    (tmp_path / "in").mkdir()
    e = 8829.0 + 2.0 * np.arange(300)
    mu = 0.5 + 0.5 + np.arctan(e - 8979.0) / np.pi
    (tmp_path / "in" / "a.xmu").write_text("# energy mu\n" + "".join(f"{x} {y}\n" for x, y in zip(e, mu)))
    q = scans.reduced(spark, str(tmp_path / "in")).select("label", "status", "e0").writeStream.format("memory").queryName("reduced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    row = spark.sql("select * from reduced").head()
    assert row.status == "ok" and abs(row.e0 - 8979) < 4
