"""Interaction audit of a list of filters: what each removes in every order they can run in.

Each document becomes a mask, one bit for each filter it fails, and documents are counted by (part, mask): at most 2**n
cells a part, however many documents there are. A task then takes the cells of one part and visits all orders of the
filters by swaps of neighbours (each order differs from the one before by a single swap). A swap at places i and i + 1 leaves every other
step as it is, so only these two are counted anew, from the cells. What a filter removes is added up
along the walk: its Shapley value times n!.

A filter is a Column that is true where a document fails. `duplicate` names one more, which cannot be told from a row
alone: the text is that of a row with a smaller id. The smallest id of each text is joined back on (id, text digest), keys
that stay spread even if one text holds a third of all rows.

Defined results: null text is empty; a null part is the empty string; a condition that is null counts as passed; a null id is smaller or larger
than nothing, so such a row is no duplicate and makes none; rows that share an id are documents of their own and no
duplicates of each other; several labels of an id count as good or toxic if any of them is; an empty table has no parts,
so no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelight.llm.common import materialize

#: Orders are n!, so more filters than this are refused
MOST_FILTERS = 8


def word_list(text: Column) -> Column:
    """Maximal runs of characters other than space and tab to carriage return."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def standard_filters(text: Column, words: Column) -> dict[str, Column]:
    """Conditions A to D; E, the duplicates, is added by audit()."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long") * 100 > F.length(text).cast("long") * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def swaps(n: int) -> Iterator[int]:
    """The places i whose swaps with i + 1 lead from 0, 1, ..., n - 1 through all n! orders."""
    order, left = list(range(n)), [True] * n
    for _ in range(factorial(n) - 1):
        # the largest item that looks at a smaller neighbour moves; all larger ones turn round
        item, at = max((x, i) for i, x in enumerate(order) if 0 <= (j := i - 1 if left[x] else i + 1) < n and order[j] < x)
        first = at - 1 if left[item] else at
        order[first], order[first + 1] = order[first + 1], order[first]
        for x in range(item + 1, n):
            left[x] = not left[x]
        yield first


class Walk:
    """The steps of one order over the cells of one part; swap() moves to a neighbouring order."""

    MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

    def __init__(self, names: str, mask: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray):
        self.names, self.mask, self.n, self.good, self.toxic = names, mask, n, good, toxic
        self.order = list(range(len(names)))
        self.steps = [self.step(i) for i in range(len(names))]

    def step(self, at: int) -> tuple[int, ...]:
        own = 1 << self.order[at]
        before = sum(1 << f for f in self.order[:at])
        fails, reached = self.mask & own != 0, self.mask & before == 0
        gone = fails & reached
        return tuple(int(x) for x in (self.n[reached & ~fails].sum(), self.n[gone].sum(), self.n[fails & ~reached].sum(), self.n[self.mask == own].sum(), self.good[gone].sum(), self.toxic[gone].sum()))

    def swap(self, at: int) -> None:
        self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]
        self.steps[at : at + 2] = self.step(at), self.step(at + 1)

    def rows(self) -> list[tuple]:
        """(order, step, measures..., shapley) of all orders."""
        out, total = [], [0] * len(self.order)
        removed = self.MEASURES.index("removed")

        def visit():
            name = "".join(self.names[f] for f in self.order)
            for at, f in enumerate(self.order):
                total[f] += self.steps[at][removed]
                out.append((name, at + 1, *self.steps[at], f))

        visit()
        for at in swaps(len(self.order)):
            self.swap(at)
            visit()
        return [(*r[:-1], total[r[-1]]) for r in out]


def cells(docs: DataFrame, labels: DataFrame, failing: dict[str, Column], duplicate: str | None, part: Column, id_col: str, text_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents counted by the filters they fail; `failing` are conditions on columns text and words."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(part.cast("string"), F.lit("")).alias("part"))
    own = own.withColumn("words", word_list(F.col("text")))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failing.values())), F.lit(0)).cast("int")
    # without texts from here on; written, so that texts are read once and later shuffles can split what is hot
    facts = materialize(own.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-facts")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = facts.where("id is not null").join(marks, "id", "left")
    bit = F.lit(0)
    if duplicate:
        firsts = facts.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        named = named.join(firsts, ["id", "digest"], "left")
        bit = F.when(F.col("first").isNull(), 1 << len(failing)).otherwise(0)
    named = named.select("part", (F.col("mask") + bit).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = facts.where("id is null").select("part", "mask", F.lit(False), F.lit(False))
    return named.union(nameless).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, failing: dict[str, Column] | None = None, duplicate: str | None = "E", part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    failing: one-letter names and conditions on the columns text (never null) and words; conditions A to D by default.
    """
    failing = standard_filters(F.col("text"), F.col("words")) if failing is None else failing
    names = "".join([*failing, duplicate or ""])
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names) or any(len(c) != 1 for c in failing):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter, all different")
    counted = cells(docs, labels, failing, duplicate, F.col(part_col), id_col, text_col)
    columns = ["part", "filter_order", "step", *Walk.MEASURES, "shapley"]
    schema = ", ".join(f"{c} {'string' if i < 2 else 'int' if i == 2 else 'long'}" for i, c in enumerate(columns))

    def walk(pdf):
        import pandas as pd

        found = Walk(names, *(pdf[c].to_numpy() for c in ("mask", "n", "good", "toxic"))).rows()
        return pd.DataFrame([(pdf["part"].iat[0], *r) for r in found], columns=columns)

    # a group is at most 2**n rows
    return counted.groupBy("part").applyInPandas(walk, schema)
