"""Small dense linear systems as Column expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def solve(rows: Column, n: int) -> Column:
    """x of A x = b by elimination with partial pivoting; rows: array of n arrays, row i of A with b[i] last.

    A singular system, one with a pivot under 1e-12 of the largest entry of A, gives nulls.
    """
    size = F.array_max(F.transform(rows, lambda row: F.array_max(F.transform(F.slice(row, 1, n), F.abs))))

    def step(m: Column, k: int, least: Column) -> Column:
        at = F.lit(k)
        # the largest entry of the column from row k on; ties to the first row
        sizes = F.transform(F.slice(m, k + 1, n - k), lambda row, i: F.struct(F.abs(F.get(row, at)).alias("size"), (-i - k).alias("row")))
        best = -F.array_max(sizes)["row"]

        def swapped(p: Column) -> Column:
            return F.transform(m, lambda row, i: F.when(i == at, F.get(m, p)).when(i == p, F.get(m, at)).otherwise(row))

        def cleared(s: Column) -> Column:
            pivot = F.get(s, at)
            top = F.get(pivot, at)
            scaled = F.transform(pivot, lambda v: F.try_divide(v, F.when(F.abs(top) > least, top)))
            return let(scaled, lambda own: F.transform(s, lambda row, i: F.when(i == at, own).otherwise(F.zip_with(row, own, lambda a, b: a - F.get(row, at) * b))))

        return let(best, lambda p: let(swapped(p), cleared))

    def eliminated(least: Column) -> Column:
        def stage(k: int) -> Callable[[Column], Column]:
            return lambda m: step(m, k, least)

        m = rows
        for k in range(n):
            # each step is a value of its own, so that expressions do not double
            m = let(m, stage(k))
        return m

    return let(let(size * 1e-12, eliminated), lambda m: F.transform(m, lambda row: F.get(row, F.lit(n))))
