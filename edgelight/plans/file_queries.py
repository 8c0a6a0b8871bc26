"""Queries over texts: Spark makes files of rows of the tables, and the parsers and writers of operators.texts work on them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from edgelight.kernels.fitting import Transform
from edgelight.operators import spectra, texts
from edgelight.plans.native_queries import VECTORS, out
from edgelight.plans.view_queries import table
from edgelight.sources import datasources, writers

QUERIES: dict = {}
SQL: dict = {}


def query(sql):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def e13(v: str) -> str:
    """SQL of a number in seven digits after the point, mantissa under one."""
    s, p = f"printf('%.6e', abs({v}))", f"(split_part(printf('%.6e', abs({v})), 'e', 2)::INT + 1)"
    return f"CASE WHEN {v} = 0 THEN '0.0000000E+00' ELSE CASE WHEN {v} < 0 THEN '-' ELSE '0' END || '.' || replace(split_part({s}, 'e', 1), '.', '') || 'E' || CASE WHEN {p} < 0 THEN '-' ELSE '+' END || printf('%02d', abs({p})) END"


def e13_value(v: str) -> str:
    return f"printf('%.6e', {v})::DOUBLE"


def vectors(spark, sf):
    """gid, k and the vector as y."""
    k = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * F.lit(0.05))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("gid"), k.alias("k"), F.transform("embedding", lambda v: v.cast("double")).alias("y"))


def points(df, *arrays):
    """A row for each point, or one with nulls for a file that failed."""
    zipped = F.posexplode_outer(F.arrays_zip(*arrays)).alias("idx", "p")
    return df.select("*", zipped).select(*(c for c in df.columns if c not in arrays), F.col("idx").cast("long").alias("idx"), *(F.col("p")[a].alias(a) for a in arrays))


COLUMN_FILES = """m AS (SELECT l_orderkey file, l_orderkey % 5 kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 idx,
  printf('%.2f', l_quantity)::DOUBLE a, printf('%.2f', l_extendedprice)::DOUBLE b, printf('%.2f', l_discount)::DOUBLE c FROM lineitem)"""


@query(f"""WITH {COLUMN_FILES}, p AS (SELECT file, kind, idx, a, b, c FROM m WHERE kind < 4 UNION ALL SELECT file, kind, count(*), 1, 2, 3 FROM m WHERE kind < 4 GROUP BY file, kind)
SELECT file, CASE kind WHEN 0 THEN 'energy,i0,itrans' WHEN 1 THEN 'e,i0,it' WHEN 2 THEN 'col1,col2,col3' ELSE 'energy,xmu,extra' END labels, CASE WHEN kind = 3 THEN 'raw' ELSE 'transmission' END mode,
  0 energy, CASE WHEN kind < 3 THEN 1 END i0, CASE WHEN kind < 3 THEN 2 END it, CASE WHEN kind = 3 THEN 1 END mu, idx, a, b, c, 'ok' status, NULL error FROM p
UNION ALL SELECT DISTINCT file, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'failed', 'NoData' FROM m WHERE kind = 4""")
def column_files(spark, sf):
    """Orders as column files of five forms: tags, a header line, none that fits, a file with mu, and one without data.

    Three separators; the second form begins with numbers that are skipped; a short row goes, a long one is cut, and a word ends the data.
    """
    kind = F.col("l_orderkey") % 5
    number = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    separator = F.when(kind == 1, ", ").when(kind == 2, "\t").otherwise("  ")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat_ws("|", number("l_quantity"), number("l_extendedprice"), number("l_discount")).alias("text"))
    files = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    head = F.when(kind == 0, "# Column.1: energy eV || keV\n# Column.2: i0\n# Column.3: itrans\n").when(kind == 1, "5 5\n6 6\n; e i0 it\n").when(kind == 2, "% two words\n").when(kind == 3, "* energy xmu extra\n").otherwise("# nothing\nno number here\n")
    body = F.when(kind < 4, F.concat(F.replace(F.array_join("l.text", "\n"), F.lit("|"), separator), F.lit("\n7.25\n1 2 3 4\nend of data\n8 8 8\n"))).otherwise("")
    files = files.select(F.col("l_orderkey").alias("file"), F.concat(head, body).alias("content"), F.when(kind == 1, 2).alias("skip"))
    rows = texts.parse(files, "columns", "content", "skip")
    value = lambda i: F.get("columns", F.lit(i))
    rows = rows.select("file", F.array_join("labels", ",").alias("labels"), "defaults.mode", "defaults.energy", "defaults.i0", "defaults.it", "defaults.mu", value(0).alias("a"), value(1).alias("b"), value(2).alias("c"), "status", "error")
    return points(rows, "a", "b", "c")


def chi_texts(spark, sf):
    """Vectors as chi(k) files with a provenance header, every seventh without data."""
    head = F.array(F.lit("# chi"), F.concat(F.lit("# source: v"), F.col("gid").cast("string")))
    good = F.col("gid") % 7 != 0
    rows = vectors(spark, sf).select("gid", head.alias("head"), F.when(good, F.col("k")).otherwise(F.array().cast("array<double>")).alias("k0"), F.when(good, F.col("y")).otherwise(F.array().cast("array<double>")).alias("y0"))
    return texts.two_column(rows, "head", "k0", "y0").select("gid", "content")


@query(f"""WITH {VECTORS} SELECT gid, idx, {e13_value("x")} k, {e13_value("y")} chi, 'ok' status, NULL error FROM c WHERE gid % 7 <> 0
UNION ALL SELECT vec_id, NULL, NULL, NULL, 'failed', 'NoData' FROM embeddings WHERE vec_id % 7 = 0""")
def chi_files(spark, sf):
    return points(texts.parse(chi_texts(spark, sf), "chi").drop("content"), "k", "chi")


@query("SELECT count(*) FILTER (WHERE vec_id % 7 <> 0) loaded, count(*) FILTER (WHERE vec_id % 7 = 0) failed FROM embeddings")
def chi_files_counts(spark, sf):
    return datasources.load_counts(texts.parse(chi_texts(spark, sf), "chi"))


#: Weighted chi(k), the magnitude of a complex file, mu of an .xmu file
@query(f"""WITH {VECTORS}, z AS (SELECT a.gid, a.idx, a.x, a.y re, b.y im FROM c a JOIN c b ON a.gid = b.gid AND b.idx = 63 - a.idx)
SELECT gid, idx, CASE gid % 3 WHEN 2 THEN round(x, 6) ELSE {e13_value("x")} END + 0.0 x,
  round(CASE gid % 3 WHEN 0 THEN {e13_value("sqrt(re * re + im * im)")} WHEN 1 THEN {e13_value("re")} * power({e13_value("x")}, 2) ELSE printf('%.10f', re)::DOUBLE END, 9) + 0.0 y FROM z""")
def overlay_files(spark, sf):
    rows, kind = vectors(spark, sf), F.col("gid") % 3
    head = F.array(F.lit("# overlay")).alias("head")
    rsp = texts.complex_columns(rows.where(kind == 0).select("gid", head, "k", "y", F.reverse("y").alias("im")), "head", "k", "y", "im").select("gid", "content", F.lit("rsp").alias("item"))
    chi = texts.two_column(rows.where(kind == 1).select("gid", head, "k", "y"), "head", "k", "y").select("gid", "content", F.lit("chi").alias("item"))
    xmu = texts.write(rows.where(kind == 2).select("gid", "k", "y"), ["k", "y"], writers.xmu).select("gid", "content", F.lit("xmu").alias("item"))
    files = rsp.union(chi).union(xmu).withColumn("weight", F.lit(2))
    rows = points(texts.parse(files, "overlay", "content", "item", "weight").select("gid", "x", "y"), "x", "y")
    return rows.select("gid", "idx", (F.round("x", 9) + 0.0).alias("x"), (F.round("y", 9) + 0.0).alias("y"))


LINE = f"""'  ' || {e13("x")} || '  ' || {e13("y")} || chr(13) || chr(10)"""


@query(f"""WITH {VECTORS} SELECT gid, '# chi(k)' || chr(13) || chr(10) || '# source: v' || gid || '.dat' || chr(13) || chr(10)
  || CASE WHEN gid % 2 = 0 THEN printf('# e0 = %.4f', 8979 + gid / 8::DOUBLE) || chr(13) || chr(10) ELSE '' END || '# rbkg = 1.000' || chr(13) || chr(10) || '#' || repeat('-', 40) || chr(13) || chr(10) || string_agg({LINE}, '' ORDER BY idx) "content" FROM c GROUP BY gid""")
def chi_text(spark, sf):
    """Every vector as the whole text of a chi(k) file; half of them know their edge energy."""
    e0 = F.when(F.col("gid") % 2 == 0, 8979 + F.col("gid") / 8)
    rows = vectors(spark, sf).select("gid", F.concat(F.lit("v"), F.col("gid").cast("string"), F.lit(".dat")).alias("source"), e0.alias("e0"), "k", "y")
    made = texts.write(rows, ["k", "y", "source", "e0"], lambda k, y, source, e0: writers.two_column(writers.provenance("chi(k)", source, e0=e0, rbkg=1.0), k, y))
    return made.select("gid", "content")


@query("""WITH g AS (SELECT vec_id gid, generate_series(0, 7) i, list_transform(embedding, lambda v: v::DOUBLE) y FROM embeddings)
SELECT gid, 'R\\k,' || array_to_string(list_transform(i, lambda a: printf('%.4f', a * 0.5::DOUBLE)), ',') || chr(10)
  || array_to_string(list_transform(i, lambda r: printf('%.4f', r * 0.25::DOUBLE) || ',' || array_to_string(list_transform(i, lambda a: printf('%.6e', abs(y[8 * r + a + 1]))), ',') || chr(10)), '') "content" FROM g""")
def wavelet_text(spark, sf):
    """Every vector as an 8 by 8 map in a CSV text."""
    k, r = [0.5 * i for i in range(8)], [0.25 * i for i in range(8)]
    rows = vectors(spark, sf).select("gid", F.transform("y", F.abs).alias("y"))
    return texts.write(rows, ["y"], lambda y: writers.wavelet_csv(k, r, np.reshape(y, (8, 8)))).select("gid", "content")


@query("""WITH t AS (SELECT user_id, min((epoch_us(ts) - 1704067200000000) / 3600000000::DOUBLE) a, max((epoch_us(ts) - 1704067200000000) / 3600000000::DOUBLE) b, count(*) n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id)
SELECT 'u' || user_id || chr(9) || printf('%.4f', a) || chr(9) || CASE WHEN n % 3 = 0 THEN '' ELSE printf('%.4f', b) END line FROM t""")
def time_lines(spark, sf):
    """First and last hour of each user as lines of the table of measured times, some without an end."""
    since = F.expr("timestampdiff(MICROSECOND, timestamp_ntz '2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    hour = since / F.lit(3600000000.0)
    rows = table(spark, sf, "events").where("user_id is not null and ts is not null").groupBy("user_id").agg(F.min(hour).alias("a"), F.max(hour).alias("b"), F.count(F.lit(1)).alias("n"))
    return rows.select(texts.time_line(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("a"), F.when(F.col("n") % 3 != 0, F.col("b"))).alias("line"))


PATH_FILE = """p AS (SELECT p_partkey file, p_size s, printf('%.4f', 2 + p_size / 100::DOUBLE)::DOUBLE reff, 'part ' || p_partkey title FROM part)"""


@query(f"""WITH {PATH_FILE} SELECT file, title, 'v6' version, 'K' shell, 'Cu' absorber, 2 nleg, s::DOUBLE degen, reff, round(-5.5, 6)::DOUBLE vmu, round(3.24 * 3.8099819442818976, 6)::DOUBLE vfermi, -18.0::DOUBLE vint,
  2 n_pot, [29, 29] iz, round(reff, 6)::DOUBLE z_last, i idx, round(i * 0.5, 6)::DOUBLE k, round(0.1 * i - reff * i, 6)::DOUBLE + 0.0 pha, round((1 + 0.01 * s) * 0.9, 6)::DOUBLE amp, 'ok' status FROM p, generate_series(0, 4) g(i)""")
def path_files(spark, sf):
    """Parts as scattering-path files: header, two potentials, two atoms, five data rows."""
    s, reff = F.col("p_size"), F.format_string("%.4f", 2 + F.col("p_size") / 100)
    title = F.concat(F.lit("part "), F.col("p_partkey").cast("string"))
    head = F.concat(F.rpad(title, 64, " "), F.lit(" v6\n Abs   Z=29 Rmt= 1.23 Rnm= 1.41 K shell\n Pot 1 Z=29 Rmt= 1.25 Rnm= 1.42\n Gam_ch=1.729E+00 H-L exch\n Mu=-5.5 kf=1.8 Vint=-18.0 Rs_int=2.0\n" + "-" * 40 + "\n"))
    path = F.concat(F.format_string("  2 %d ", s), reff, F.lit(" 2.6 -5.5 nleg, deg, reff, rnrmav(bohr), edge\n  x y z pot at#\n 0.0 0.0 0.0 0 29 Cu absorbing atom\n 0.0 0.0 "), reff, F.lit(" 1 29 Cu\n k real[p]@#\n"))
    row = lambda i: F.concat(F.format_string("%.3f %.4f %.6f ", i * 0.5, i * 0.1, 1 + s * 0.01), F.format_string("%.6f", -reff.cast("double") * i), F.lit(" 0.9 8.0 1.5\n"))
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.concat(head, path, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), row), "")).alias("content"))
    got = texts.parse(files, "path")
    rows = got.select("file", "title", "version", "shell", "absorber", "nleg", "degen", "reff", "vmu", F.round("vfermi", 6).alias("vfermi"), "vint", F.size("potentials").alias("n_pot"), F.col("geom.iz").alias("iz"), F.get("geom", F.lit(1))["z"].alias("z_last"), "k", "pha", "amp", "status")
    rows = points(rows, "k", "pha", "amp")
    return rows.withColumns({c: F.round(c, 6) + 0.0 for c in ("k", "pha", "amp")})


ATOMS = """a AS (SELECT s_suppkey // 20 file, s_suppkey, printf('%.5f', s_acctbal / 1000)::DOUBLE x, printf('%.5f', (s_suppkey % 7) * 0.5::DOUBLE)::DOUBLE y, printf('%.5f', s_nationkey * 0.25::DOUBLE)::DOUBLE z, (s_suppkey % 2)::INT ipot FROM supplier)"""


@query(f"""WITH {ATOMS} SELECT file, ['suppliers ' || file] title, ['K', 'L1', 'L2', 'L3'][file % 4 + 1] edge, ['0 29 Cu', '1 8 O'] pots, row_number() OVER (PARTITION BY file ORDER BY s_suppkey) - 1 idx, x, y, z, ipot, CASE ipot WHEN 0 THEN 'Cu' ELSE 'O' END tag, round(sqrt(x * x + y * y + z * z), 6) + 0.0 distance, 'ok' status FROM a""")
def structure_files(spark, sf):
    """Suppliers, 20 a file, as structure inputs, written and read."""
    key = F.col("s_suppkey")
    x, y, z = F.col("s_acctbal") / 1000, key % 7 * F.lit(0.5), F.col("s_nationkey") * F.lit(0.25)
    atom = F.struct(key.alias("at"), x.alias("x"), y.alias("y"), z.alias("z"), (key % 2).cast("int").alias("ipot"), F.when(key % 2 == 0, "Cu").otherwise("O").alias("tag"), F.sqrt(x * x + y * y + z * z).alias("d"))
    groups = table(spark, sf, "supplier").groupBy(F.floor(key / 20).cast("long").alias("file")).agg(F.array_sort(F.collect_list(atom)).alias("own"))
    groups = groups.select("file", "own", F.concat(F.lit("suppliers "), F.col("file").cast("string")).alias("name"), F.get(F.array(*map(F.lit, ("K", "L1", "L2", "L3"))), (F.col("file") % 4).cast("int")).alias("hole"))
    files = texts.write(groups, ["own", "name", "hole"], lambda own, name, hole: writers.structure_input(name, hole, [(0, 29, "Cu"), (1, 8, "O")], [(a["x"], a["y"], a["z"], a["ipot"], a["tag"], a["d"]) for a in own])).select("file", "content")
    got = texts.parse(files, "structure")
    pots = F.transform("potentials", lambda p: F.concat_ws(" ", p["ipot"].cast("string"), p["z"].cast("string"), p["tag"]))
    rows = got.select("file", "title", "edge", pots.alias("pots"), F.posexplode("atoms").alias("idx", "a"), "status")
    return rows.select("file", "title", "edge", "pots", F.col("idx").cast("long").alias("idx"), "a.x", "a.y", "a.z", "a.ipot", "a.tag", (F.round("a.distance", 6) + 0.0).alias("distance"), "status")


@query("""SELECT p_partkey file, ['amp vary ' || printf('%.3f', p_size / 50::DOUBLE), 'del fixed amp*2'] vars, p_partkey || '.dat' path1, 'del' e01, CASE WHEN p_size % 2 = 0 THEN 'sig' || p_size END sigma22, 'a+b' fn, printf('%d', p_size % 4) kmin, '12' kmax, p_size % 3 = 0 nofit FROM part""")
def fit_inputs(spark, sf):
    """Parts as fit inputs: variables, paths, a function, settings, and for a third of them no fit."""
    s, key = F.col("p_size"), F.col("p_partkey").cast("string")
    text = F.concat(F.format_string("%%set fn = a+b\nguess amp = %.3f %% start\nset del = amp*2\n", s / 50), F.lit("path 1 = "), key, F.lit(".dat\ne0 1 = del\n! a remark\n"))
    text = F.concat(text, F.when(s % 2 == 0, F.format_string("path 2 = x.dat\nsigma2 2 = sig%d\n", s)).otherwise(""), F.format_string("kmin = %d kmax = 12\n", s % 4), F.when(s % 3 == 0, "Nofit\n").otherwise(""))
    got = texts.parse(table(spark, sf, "part").select(F.col("p_partkey").alias("file"), text.alias("content")), "fit")
    of = lambda n, key: F.get(F.filter("paths", lambda p: p["path"] == n), F.lit(0))["entries"][key]
    names = F.transform("vars", lambda v: F.concat_ws(" ", v["name"], F.when(v["vary"], "vary").otherwise("fixed"), v["text"]))
    return got.select("file", names.alias("vars"), of(1, "path").alias("path1"), of(1, "e0").alias("e01"), of(2, "sigma2").alias("sigma22"), F.col("functions")["fn"].alias("fn"), F.col("settings")["kmin"].alias("kmin"), F.col("settings")["kmax"].alias("kmax"), "nofit")


@query(f"""WITH {VECTORS} SELECT gid, idx // 32 block, 'curve ' || gid || CASE WHEN idx < 32 THEN 'a' ELSE 'b' END "label", 'k' x_label, 'chi' y_label, idx % 32 idx, round(x, 6) + 0.0 x, round(printf('%.10f', y)::DOUBLE, 9) + 0.0 y FROM c""")
def result_files(spark, sf):
    """Every vector as a file of two curves, written and read."""
    half = lambda c, i: F.slice(c, 32 * i + 1, 32)
    rows = vectors(spark, sf).select("gid", F.array(half("k", 0), half("k", 1)).alias("xs"), F.array(half("y", 0), half("y", 1)).alias("ys"))
    files = texts.write(rows, ["xs", "ys", "gid"], lambda xs, ys, gid: writers.blocks([(f"curve {gid}{n}", x, y) for n, x, y in zip("ab", xs, ys)], "k", "chi")).select("gid", "content")
    got = texts.parse(files, "blocks").select("gid", F.posexplode("blocks").alias("block", "b")).select("gid", F.col("block").cast("long").alias("block"), "b.label", "b.x_label", "b.y_label", "b.x", "b.y")
    rows = points(got, "x", "y")
    return rows.withColumns({c: F.round(c, 9) + 0.0 for c in ("x", "y")})


NOISE = Transform(kmin=0.5, kmax=3.0, dk=0.5, window="hanning", nfft=256)


def _noise_sql() -> str:
    t, grid = NOISE, 0.05 * np.arange(64)
    weights = [float(v) for v in t.kwin()[:64] * grid**2]
    a, b = int(0.01 + 15 / t.rstep), int(min(t.nfft / 2, 1.01 + 30 / t.rstep))
    mean, spread = float(t.kwin().sum()) * t.kstep / (t.kmax - t.kmin), math.pi * 5 / (t.kstep * (t.kmax**5 - t.kmin**5))
    turn = f"(2 * pi() * idx * m / {t.nfft})"
    return f"""WITH {VECTORS}, w AS (SELECT unnest({weights}) w, unnest(generate_series(0, 63)) idx), m AS (SELECT unnest(range({a}, {b})) m),
h AS (SELECT gid, m, sum(y * w * cos{turn}) re, sum(y * w * sin{turn}) im FROM c JOIN w USING (idx), m GROUP BY gid, m),
e AS (SELECT gid, sqrt(avg(re * re + im * im) / 2) * {t.kstep / math.sqrt(math.pi) / mean!r}::DOUBLE eps FROM h GROUP BY gid)
SELECT gid, round(eps * {math.sqrt(2 * spread)!r}::DOUBLE, 6) + 0.0 eps_k, round(eps, 6) + 0.0 eps_r, 'ok' status FROM e"""


@query(_noise_sql())
def noise_high_r(spark, sf):
    """Noise of every vector as chi(k), from its transform between 15 and 30 Angstrom."""
    rows = spectra.noise(vectors(spark, sf).withColumnRenamed("y", "chi"), NOISE)
    return out(rows, ["gid", "status"], "eps_k", "eps_r")
