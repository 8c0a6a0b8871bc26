"""Crystal lattices: Cartesian coordinates, clusters around an absorber, shells, symmetry."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vectors(a, b, c, alpha, beta, gamma) -> list[tuple[float, float, float]]:
    """Rows are lattice vectors; angles in degrees."""
    ca, cb, cg = (math.cos(math.radians(t)) for t in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    cx = (ca - cb * cg) / sg
    return [(a, 0.0, 0.0), (b * cg, b * sg, 0.0), (c * cb, c * cx, c * math.sqrt(max(1 - cb * cb - cx * cx, 0.0)))]


def volume(*cell) -> float:
    (ax, _, _), (_, by, _), (_, _, cz) = vectors(*cell)
    return ax * by * cz


def cartesian(df: DataFrame, cell: tuple) -> DataFrame:
    """fx, fy, fz to x, y, z."""
    v = vectors(*cell)
    return df.withColumns({n: F.col("fx") * v[0][i] + F.col("fy") * v[1][i] + F.col("fz") * v[2][i] for i, n in enumerate("xyz")})


def cluster(sites: DataFrame, cell: tuple, absorber: int, radius: float) -> DataFrame:
    """Atoms within radius of a site: (site_id, element, x, y, z, r), the absorber first. Replicas are generated from each site's own row."""
    if radius <= 0:
        raise ValueError("cluster radius must be positive")
    v = vectors(*cell)
    vol = volume(*cell)
    areas = [abs(vol) / math.dist((0, 0, 0), _cross(v[(i + 1) % 3], v[(i + 2) % 3])) for i in range(3)]
    reach = [int(math.ceil(radius / h)) + 1 for h in areas]
    home = sites.where(F.col("site_id") == absorber).select(*(F.col(f"f{n}").alias(f"h{n}") for n in "xyz"))
    rows = sites.join(F.broadcast(home))  # one row
    for n, m in zip("xyz", reach):
        rows = rows.withColumn(f"t{n}", F.explode(F.sequence(F.lit(-m), F.lit(m))))
    rows = rows.select("site_id", "element", *((F.col(f"f{n}") + F.col(f"t{n}") - F.col(f"h{n}")).alias(f"f{n}") for n in "xyz"))
    rows = cartesian(rows, cell).withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    return rows.where(F.col("r") <= radius + 1e-8).select("site_id", "element", "x", "y", "z", "r")


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def potentials(atoms: DataFrame) -> DataFrame:
    """ipot: 0 for the absorber, then elements by their nearest atom."""
    near = atoms.where("r > 1e-8").groupBy("element").agg(F.min("r").alias("near"))
    ranked = near.withColumn("ipot", F.row_number().over(Window.orderBy(F.round("near", 6), "element")))
    return atoms.join(F.broadcast(ranked.drop("near")), "element", "left").withColumn("ipot", F.when(F.col("r") <= 1e-8, 0).otherwise(F.col("ipot")))


def shells(atoms: DataFrame, gap: float = 0.05, most: int = 10) -> DataFrame:
    """Coordination shells by distance to each shell's first radius: a running fold over the sorted radii of one cluster."""
    radii = atoms.where("r > 1e-8").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    start = F.array().cast("array<struct<head:double,n:bigint>>")

    def step(acc, r):
        last = F.get(acc, F.size(acc) - 1)
        more = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["head"].alias("head"), (last["n"] + 1).alias("n"))))
        new = F.concat(acc, F.array(F.struct(r.alias("head"), F.lit(1).cast("bigint").alias("n"))))
        return F.when((F.size(acc) > 0) & (r - last["head"] <= gap), more).otherwise(new)

    rows = radii.select(F.posexplode(F.aggregate("rs", start, step)).alias("shell", "s"))
    return rows.where(F.col("shell") < most).select((F.col("shell") + 1).alias("shell"), F.col("s.head").alias("r"), F.col("s.n").alias("n"))


def expand(sites: DataFrame, operations: DataFrame) -> DataFrame:
    """Symmetry operations (op, rotation 9, shift 3) on sites, wrapped to the cell, without repeats at 4 decimals."""
    def image(i):
        f = F.col("shift")[i]
        for j, n in enumerate("xyz"):
            f = f + F.col("rotation")[3 * i + j] * F.col(f"f{n}")
        g = f - F.floor(f)
        return F.when(F.round(g, 4) >= 1, F.lit(0.0)).otherwise(g)

    rows = sites.join(F.broadcast(operations))  # a space group has at most 192 operations
    rows = rows.select("element", image(0).alias("fx"), image(1).alias("fy"), image(2).alias("fz"))
    keys = [F.round(f"f{n}", 4).alias(f"k{n}") for n in "xyz"]
    return rows.groupBy("element", *keys).agg(*(F.min(f"f{n}").alias(f"f{n}") for n in "xyz")).select("element", "fx", "fy", "fz")


def expand_within(sites: DataFrame, operations: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Images (element, fx, fy, fz) of sites (site_id, element, fx, fy, fz) under operations (op, rotation 9, shift 3) without repeats within a tolerance.

    Images are taken by site_id, then op; one whose element and coordinates, up to whole cells, are those of an image taken before
    is left out, wherever it lies. Images fall in cells of the tolerance's size and meet only those of the 27 cells around, so there is no
    rounding border. Sites without an element are left out. Whether an image stays can hang on another one; for
    that, the pairs of near but unequal images of an element, of which crystals have few, are settled in order, in one group.
    """
    def image(i):
        f = F.col("shift")[i]
        for j, n in enumerate("xyz"):
            f = f + F.col("rotation")[3 * i + j] * F.col(f"f{n}")
        return f - F.floor(f)

    rows = sites.join(F.broadcast(operations))  # a space group has at most 192 operations
    rows = rows.select("element", F.struct("site_id", "op").alias("turn"), image(0).alias("fx"), image(1).alias("fy"), image(2).alias("fz"))
    # the same image many times is one row from here on
    rows = rows.groupBy("element", "fx", "fy", "fz").agg(F.min("turn").alias("turn"))
    cells = max(1, int(1 / tolerance + 1e-9))
    at = [F.least(F.floor(F.col(f"f{n}") * cells), F.lit(cells - 1)) for n in "xyz"]
    rows = rows.select("*", *(c.alias(f"c{n}") for c, n in zip(at, "xyz")))
    around = rows
    for n in "xyz":
        around = around.withColumn(f"c{n}", F.explode(F.array_distinct(F.array(*(F.pmod(F.col(f"c{n}") + d, F.lit(cells)) for d in (-1, 0, 1))))))
    a, b = around.alias("a"), rows.alias("b")
    near = [F.abs(d - F.round(d)) < tolerance for d in (F.col(f"a.f{n}") - F.col(f"b.f{n}") for n in "xyz")]
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("element", "cx", "cy", "cz")]
    met = F.col("b.turn") < F.col("a.turn")
    for c in [*same, *near]:
        met = met & c
    turn = ["site_id", "op"]
    pairs = a.join(b, met).select(F.col("a.element").alias("element"), *(F.col(f"{side}.turn.{c}").alias(f"{side}_{c}") for side in "ab" for c in turn))

    def settle(pdf):
        """An image goes if an earlier one near it stays; earlier ones are settled first."""
        own = pdf.sort_values(["a_site_id", "a_op"])
        gone, near = [], {}
        for now, before in zip(zip(own["a_site_id"], own["a_op"]), zip(own["b_site_id"], own["b_op"])):
            near.setdefault(now, []).append(before)
        lost = set()
        for now, before in near.items():
            if any(t not in lost for t in before):
                lost.add(now)
                gone.append((pdf["element"].iat[0], *now))
        return pd.DataFrame(gone, columns=["element", *turn])

    kinds = {c: rows.schema["turn"].dataType[c].dataType.simpleString() for c in turn}
    gone = pairs.groupBy("element").applyInPandas(settle, ", ".join(f"{c} {k}" for c, k in {"element": rows.schema["element"].dataType.simpleString(), **kinds}.items()))
    gone = gone.select("element", F.struct(*turn).alias("turn"))
    return rows.where("element is not null").join(gone, ["element", "turn"], "left_anti").select("element", "fx", "fy", "fz")
