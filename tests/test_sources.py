import math

import pytest
from pyspark.sql import functions as F

from edgelight.functions.pointwise import fortran_e as fortran_column
from edgelight.operators import lattice, spectra
from edgelight.sources import datasources, writers
from edgelight.sources import text as tx


def test_column_file_rules():
    c = tx.column_file("# Column.1: energy eV\n# Column.2: i0 || x\n 1 2\n3,4,5\n6\n.7E+01 8\n\nfooter 1\n9 9\n")
    assert c["labels"] == ["energy", "i0"]
    assert c["columns"] == [[1.0, 3.0, 7.0], [2.0, 4.0, 8.0]]
    with pytest.raises(ValueError, match="NoData"):
        tx.column_file("# nothing\n1d 2\n1_0 3\n")
    assert tx.column_file("1 1\n# a b\n2 3\n4 5\n", skip=1)["labels"] == ["a", "b"]


def test_lenient_decode():
    assert tx.decoded("값".encode("cp949")) == "값" and tx.decoded("값".encode()) == "값"


def test_roles_and_defaults():
    assert tx.roles_of(["Energy", "I0", "Itrans", "other"])["it"] == 2
    assert tx.import_defaults(["energy", "xmu"]) == {"mode": "raw", "energy": 0, "mu": 1}
    assert tx.import_defaults(["a", "b", "c"])["mode"] == "transmission"


def test_fortran_form(spark):
    values = [0.0, 1.0, -1.5, 12345.678, 1e-9, math.inf, math.nan, 0.1]
    want = ["0.0000000E+00", "0.1000000E+01", "-.1500000E+01", "0.1234568E+05", "0.1000000E-08", "0.0000000E+00", "0.0000000E+00", "0.1000000E+00"]
    assert [writers.fortran_e(v) for v in values] == want
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(fortran_column(F.col("v"))).collect()] == want


def test_sources_and_writers_round_trip(spark, tmp_path):
    datasources.register(spark)
    (tmp_path / "a.xmu").write_text(writers.xmu([1.0, 2.0], [0.5, 0.25], "a"))
    (tmp_path / "b.001").write_text("# energy i0 it\n1 8 2\n2 9 3\n")
    (tmp_path / "bad.xmu").write_text("nothing here")
    rows = spark.read.format("xascol").load(str(tmp_path))
    got = {r.path.split("/")[-1]: r for r in rows.collect()}
    assert got["a.xmu"].columns == [[1.0, 2.0], [0.5, 0.25]] and got["bad.xmu"].status == "failed"
    mu = {r.label: r for r in spectra.build_mu(rows, "transmission").collect()}
    assert mu["b_001"].mu[0] == pytest.approx(math.log(4)) and mu["a"].error == "BadColumn(2)"
    out = tmp_path / "out"
    writers.write_files(spark.createDataFrame([("r.dat", writers.blocks([("one", [1.0, 2.0], [3.0, 4.0])], "k", "chi"))], "name string, content string"), str(out))
    block = spark.read.format("xasresult").load(str(out)).collect()[0]
    assert (block.label, block.x, block.y, block.x_label) == ("one", [1.0, 2.0], [3.0, 4.0], "k")


def test_streaming_reader(spark, tmp_path):
    datasources.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dat").write_text("1 2\n3 4\n")
    q = spark.readStream.format("xascol").load(str(tmp_path / "in")).select("path", "status").writeStream.format("memory").queryName("scans").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.status for r in spark.sql("select * from scans").collect()] == ["ok"]


def test_structure_input_round_trip():
    text = writers.structure_input("Cu", "K", [(0, 29, "Cu"), (1, 29, "Cu")], [(0.0, 0.0, 0.0, 0, "Cu", 0.0), (1.8, 1.8, 0.0, 1, "Cu", 2.545)])
    d = tx.structure_input(text)
    assert d["edge"] == "K" and len(d["atoms"]) == 2 and d["potentials"][1]["z"] == 29
    with pytest.raises(ValueError, match="Parse"):
        tx.structure_input("ATOMS\n 0 zero 0 1\n")


def test_fit_input():
    d = tx.fit_input("guess amp 1.0\nset e0x 0\npath 1 p1.dat\ns02 1 amp*2\n%set f = amp+1\nrmin = 1.2 rmax=3\nNofit\n")
    assert d["vars"][0]["vary"] and d["paths"][1]["s02"] == "amp*2" and d["functions"] == {"f": "amp+1"} and d["settings"]["rmax"] == "3" and d["nofit"]


def test_lattice(spark):
    from edgelight.plans.native_queries import CELL, fcc

    atoms = lattice.cluster(fcc(spark), CELL, 0, 4.0)
    first = lattice.shells(atoms).orderBy("shell").collect()[0]
    assert first.n == 12 and first.r == pytest.approx(3.61 / math.sqrt(2))
    assert lattice.volume(2, 3, 4, 90, 90, 90) == pytest.approx(24)
    assert {r.ipot for r in lattice.potentials(atoms).collect()} == {0, 1}
    ops = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], s) for s in ([0.0, 0.0, 0.0], [0.0, 0.5, 0.5], [0.5, 0.0, 0.5], [0.5, 0.5, 0.0], [1.0, 0.5, 0.5])], "rotation array<double>, shift array<double>")
    one = spark.createDataFrame([("Cu", 0.0, 0.0, 0.0)], "element string, fx double, fy double, fz double")
    assert lattice.expand(one, ops).count() == 4


def test_roles_come_from_the_fixed_names_in_file_order():
    assert tx.roles_of(["col1", "col2"])["energy"] == 0
    assert tx.roles_of(["trans", "it"])["it"] == 0
    assert tx.roles_of(["myfluo", "x_trans"])["iflu"] == 0 and tx.roles_of(["myfluo", "x_trans"])["it"] == 1


def test_stream_reads_late_files_and_bad_files_are_rows(spark, tmp_path):
    datasources.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run(frame, name):
        q = frame.select("path", "status").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-log")).trigger(availableNow=True).start(str(tmp_path / name))
        assert q.awaitTermination(40)
        return sorted((r.path.split("/")[-1], r.status) for r in spark.read.parquet(str(tmp_path / name)).collect())

    (folder / "m.dat").write_text("1 2\n3 4\n")
    (folder / "bad.dat").write_text("nothing")
    for name, frame in (("own", lambda: spark.readStream.format("xascol").load(str(folder))), ("files", lambda: datasources.scan_files(spark, str(folder), stream=True))):
        (folder / "a_late.dat").unlink(missing_ok=True)
        assert run(frame(), name) == [("bad.dat", "failed"), ("m.dat", "ok")]
        (folder / "a_late.dat").write_text("5 6\n7 8\n")
        assert ("a_late.dat", "ok") in run(frame(), name)
    counts = datasources.load_counts(datasources.scan_files(spark, str(folder))).head()
    assert (counts.loaded, counts.failed) == (2, 1)


def test_written_names_are_unique_and_files_are_not_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.dat", "1"), ("b/x.dat", "2")], "name string, content string")
    with pytest.raises(ValueError, match="x.dat"):
        writers.write_files(rows, str(tmp_path / "o"))
    one = spark.createDataFrame([("x.dat", "1")], "name string, content string")
    writers.write_files(one, str(tmp_path / "o"))
    with pytest.raises(Exception, match="FileExistsError"):
        writers.write_files(one, str(tmp_path / "o"))
    writers.write_files(one, f"file://{tmp_path}/o", overwrite=True)
    assert (tmp_path / "o" / "x.dat").read_text() == "1"
    assert writers.safe_name("a/b c?.dat") == "b_c_.dat" and writers.safe_name("///") == "unnamed"


def test_fit_outputs_have_a_model_only_if_there_is_one():
    one = {"k": ([0.0, 0.1], [1.0, 2.0]), "r": ([0.0], [1.0], [0.0]), "q": ([0.0], [0.5], [0.5])}
    assert [n for n, _ in writers.fit_outputs("cu", ["# h"], one)] == ["cuk.dat", "cur.dat", "cuq.dat"]
    names = dict(writers.fit_outputs("cu", ["# h"], one, one))
    assert len(names) == 6 and names["cuk.fit"] == names["cuk.dat"]


def test_wavelet_maps_and_first_grid(spark):
    k = [0.05 * i for i in range(241)]
    chi = [math.sin(2 * 2.2 * v) * math.exp(-0.01 * v * v) for v in k]
    df = spark.createDataFrame([(1, k, chi)], "gid long, k array<double>, chi array<double>")
    for whole, largest in ((spectra.cauchy_map(df), spectra.cauchy(df)), (spectra.morlet_map(df), spectra.morlet(df))):
        m, top = whole.head(), largest.head().mag
        rows = [m["map"][i : i + m["columns"]] for i in range(0, len(m["map"]), m["columns"])]
        assert [max(r) for r in rows] == pytest.approx(top)
    x1, x2 = [float(i) for i in range(10)], [0.5 + 0.7 * i for i in range(12)]
    curves = spark.createDataFrame([(1, x1, [v**2 for v in x1]), (2, x2, [v**2 for v in x2])], "gid long, x array<double>, y array<double>")
    got = {r.gid: r.y_grid for r in spectra.on_first_grid(curves).collect()}
    assert got[1] == [float(i * i) for i in range(9)] and got[2][1:] == pytest.approx([float(i * i) for i in range(1, 9)], abs=1e-6)
