"""Thermal displacements of scattering paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgelight.functions.dense import let
from edgelight.kernels.paths import DEBYE_SCALE, DEBYE_WAVE, debye_nodes


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def sigma2_debye(t: Column, theta: Column, rnorman: Column, geom: Column) -> Column:
    """Correlated Debye displacement of a closed path over its atoms, an array of structs with x, y, z and mass.

    Fixed quadrature nodes as arrays in the plan; pairs of legs by array functions. No atoms give 0, atoms at the same place next to each other null.
    """
    w, weight = (F.array(*map(F.lit, v.tolist())) for v in debye_nodes())
    t, theta = F.greatest(t, F.lit(1e-5)), F.greatest(theta, F.lit(1e-5))

    def norm(d: list[Column]) -> Column:
        return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    def gap(a: Column, b: Column) -> list[Column]:
        return [a[c] - b[c] for c in "xyz"]

    def correlation(thermal: Column, a: Column, b: Column) -> Column:
        def at(r: Column) -> Column:
            waves = F.zip_with(w, thermal, lambda v, h: h * F.when(r > 0, F.sin(v * r) / F.when(r > 0, v * r)).otherwise(F.lit(1.0)))
            return F.lit(DEBYE_SCALE) / theta * _total(waves) / F.sqrt(a["mass"] * b["mass"])

        return let(F.lit(DEBYE_WAVE) * norm(gap(a, b)) / rnorman, at)

    def legs(g: Column, c: Column) -> Column:
        n = F.size(g)
        nxt = lambda i: (i + 1) % n
        own = lambda i, j: F.get(F.get(c, i), j)

        def pair(i: Column, j: Column) -> Column:
            a, b = gap(F.get(g, i), F.get(g, nxt(i))), gap(F.get(g, j), F.get(g, nxt(j)))
            dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
            both = F.try_divide(dot * (own(i, j) + own(nxt(i), nxt(j)) - own(i, nxt(j)) - own(nxt(i), j)), norm(a) * norm(b))
            return both * F.when(i == j, 0.5).otherwise(1.0)

        every = F.sequence(F.lit(0), n - 1)
        rows = F.transform(every, lambda i: _total(F.transform(F.filter(every, lambda j: j >= i), lambda j: pair(i, j))))
        return _total(rows) / 2

    thermal = F.zip_with(w, weight, lambda v, q: q * v / F.tanh(v * theta / (2 * t)))
    matrix = lambda g: let(thermal, lambda h: F.transform(g, lambda a: F.transform(g, lambda b: correlation(h, a, b))))
    return F.when(F.size(geom) == 0, F.lit(0.0)).otherwise(let(geom, lambda g: let(matrix(g), lambda c: legs(g, c))))
