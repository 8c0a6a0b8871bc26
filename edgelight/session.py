"""A working set of spectra: order, selection, edits with undo, storage, views. The rows stay in a DataFrame; the session holds plans, not data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelight.functions import expressions as ex
from edgelight.functions import pointwise as p
from edgelight.kernels import paths as pt

#: What an edit of energy or mu makes stale, chi(q) included
DERIVED = ("e0", "edge_step", "pre1", "pre2", "norm1", "norm2", "pre_edge", "post_edge", "norm", "flat", "dmude", "d2mude", "bkg", "delta_bkg", "k", "chi", "delta_chi", "r", "chir_mag", "chir_re", "chir_im", "q", "chiq_mag", "chiq_re", "chiq_im")
UNDO = 32


class Session:
    """Rows gid, ord, label, selected, energy, mu and derived columns."""

    def __init__(self, df: DataFrame):
        for name, value in (("ord", F.col("gid").cast("int")), ("selected", F.lit(True))):
            if name not in df.columns:
                df = df.withColumn(name, value)
        self.df, self.current, self._past = df, None, []

    def edit(self, new: DataFrame) -> "Session":
        self._past = [*self._past[-UNDO + 1 :], self.df]
        self.df = new
        return self

    def undo(self) -> bool:
        if not self._past:
            return False
        self.df = self._past.pop()
        return True

    def add(self, more: DataFrame) -> "Session":
        return self.edit(self.df.unionByName(more, allowMissingColumns=True))

    def remove(self, *gids: int) -> "Session":
        return self.edit(self.df.where(~F.col("gid").isin(*gids)))

    def select(self, *gids: int, value: bool = True) -> "Session":
        return self.edit(self.df.withColumn("selected", F.when(F.col("gid").isin(*gids), F.lit(value)).otherwise(F.col("selected"))))

    def targets(self) -> DataFrame:
        """The selected spectra in order, else the current one."""
        chosen = self.df.where("selected")
        if chosen.head(1) or self.current is None:
            return chosen.orderBy("ord")
        return self.df.where(F.col("gid") == self.current)

    def reconcile(self, wanted: DataFrame, load) -> "Session":
        """Keep rows whose label is still wanted, load what is new (load takes the new labels), drop the rest."""
        kept = self.df.join(wanted.select("label"), "label", "left_semi")
        new = wanted.select("label").join(self.df.select("label"), "label", "left_anti")
        return self.edit(kept.unionByName(load(new), allowMissingColumns=True))

    def cleared(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in DERIVED if c in df.columns})

    def mask(self, keep) -> "Session":
        """Keep the samples for which keep(x, y, index) holds, in every co-indexed array; derived columns go only where a sample went."""
        z = F.arrays_zip("energy", "mu")
        kept = F.filter(z, lambda s, i: keep(s["energy"], s["mu"], i))
        df = self.df.withColumn("_kept", kept).withColumn("_same", F.size("_kept") == F.size("energy"))
        stale = {c: F.when(F.col("_same"), F.col(c)) for c in DERIVED if c in df.columns}
        df = df.withColumns({"energy": F.transform("_kept", lambda s: s["energy"]), "mu": F.transform("_kept", lambda s: s["mu"]), **stale})
        return self.edit(df.drop("_kept", "_same"))

    def trim(self, lo: float, hi: float) -> "Session":
        return self.mask(lambda x, y, i: x.between(min(lo, hi), max(lo, hi)))

    def drop_bad(self) -> "Session":
        return self.mask(lambda x, y, i: x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))

    def deglitch(self, energy: float) -> "Session":
        gaps = F.transform("energy", lambda e: F.abs(e - energy))
        self.df, past = self.df.withColumn("_at", F.array_position(gaps, F.array_min(gaps)) - 1), self.df
        self.mask(lambda x, y, i: i != F.col("_at"))
        self._past[-1] = past
        self.df = self.df.drop("_at")
        return self

    def to_json(self, folder: str) -> None:
        self.df.write.mode("overwrite").json(folder)

    @staticmethod
    def from_json(spark: SparkSession, folder: str, schema) -> "Session":
        """schema: columns that an older file lacks are null."""
        return Session(spark.read.schema(schema).json(folder))


#: Graph views: x and y of each, from the wide columns
def views(kweight: int = 2) -> dict:
    weighted = lambda k, y: F.zip_with(k, y, lambda a, b: p.k_weight(a, b, kweight))
    slope = lambda y, x: F.zip_with(F.zip_with(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), F.slice(y, 1, F.greatest(F.size(y) - 1, F.lit(0))), lambda a, b: a - b), F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a - b), p.ratio)
    c = F.col
    return {
        "mu": (c("energy"), c("mu")), "norm": (c("energy"), F.coalesce(c("flat"), c("norm"))), "bkg": (c("energy"), c("bkg")), "chi": (c("k"), weighted(c("k"), c("chi"))),
        "chir": (c("r"), c("chir_mag")), "chiq": (c("q"), c("chiq_re")), "dmu": (c("energy"), c("dmude")), "d2mu": (c("energy"), c("d2mude")),
        "dbkg": (F.slice(c("energy"), 2, F.greatest(F.size("energy") - 1, F.lit(0))), slope(c("bkg"), c("energy"))), "dchi": (F.slice(c("k"), 2, F.greatest(F.size("k") - 1, F.lit(0))), slope(c("chi"), c("k"))),
    }


def view(df: DataFrame, name: str, kweight: int = 2) -> DataFrame:
    x, y = views(kweight)[name]
    return df.select("gid", "label", x.alias("x"), y.alias("y"))


def fit_series(df: DataFrame, space: str, part: str) -> DataFrame:
    """One series of a fit's outputs: space k, r or q by part mag, re, im or pha."""
    if space == "k":
        return df.select("gid", F.col("k").alias("x"), F.col("chi").alias("y"))
    return df.select("gid", F.col(space).alias("x"), F.col(f"chi{space}_{part}").alias("y"))


def geometry_label(geom):
    """Leg labels of a path, joined."""
    return F.array_join(F.transform(geom, lambda a: a["label"]), " – ")


def literal_or_expression(text: str):
    """A number if the text is one, else a parsed expression."""
    try:
        return float(text)
    except ValueError:
        return ex.parse(text)


def adopt(params: DataFrame, best: DataFrame) -> DataFrame:
    """Best-fit values as the next guesses of varied parameters of the same name."""
    found = best.where("kind = 'best'").select("name", F.col("value").alias("found"))
    rows = params.join(found, "name", "left")
    return rows.withColumn("value", F.when(F.col("kind") == "vary", F.coalesce("found", "value")).otherwise(F.col("value"))).drop("found")


def apply_fit_input(parsed: dict, paths: dict[str, dict], base: ex.Parameters | None = None) -> tuple[ex.Parameters, list[dict], list[dict]]:
    """Parameters, path files and specs from a parsed fit input; paths maps file names to parsed path files."""
    params, files, specs = base or ex.Parameters(), [], []
    names = {"e0": "e0", "delr": "deltar", "s02": "s02", "sigma2": "sigma2", "third": "third", "fourth": "fourth", "ei": "ei"}
    for name, text in parsed["functions"].items():
        params.constrain(name, text)
    for v in parsed["vars"]:
        value = literal_or_expression(v["text"])
        if isinstance(value, float):
            (params.var if v["vary"] else params.fix)(v["name"], value)
        else:
            params.constrain(v["name"], v["text"])
    for _, entry in sorted(parsed["paths"].items()):
        files.append(paths[entry["path"]])
        specs.append({names[k]: t for k, t in entry.items() if k in names})
    unknown = [k for s in specs for k in s if k not in pt.NAMES]
    if unknown:
        raise ValueError(f"no path parameter {unknown}")
    return params, files, specs
