"""Data source `xasitem`: curves of one graph item from the files of a folder tree, with filters pushed to the listing.

Option item is one of ITEMS, or raw: the first two columns of scan files. Only files with the item's suffix are opened, dot files
never, and for raw none with a suffix that results are written under (PRODUCED), unless `produced` is true. Option kweight weights
curves over k. Each folder of the tree is a partition, listed by the task that reads it, so the driver sees folders, not files. Filters on name and path
(equal, in, starts with, ends with) are applied before a file is opened (register() turns Spark's setting for it on); the folders are
mounted on every machine.

Rows: path, name, item, x array, y array, status, error. A file that cannot be read is a row with its error.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

from edgelight.kernels import reduction as rd
from edgelight.sources import text as tx

SCHEMA = "path string, name string, item string, x array<double>, y array<double>, status string, error string"
#: Suffix of each item's files, column of the value, whether over k, how many derivatives
ITEMS = {
    "f": (".xmu", 1, False, 0), "norm": (".xmu", 1, False, 0), "f'": (".xmu", 1, False, 1), "f''": (".xmu", 1, False, 2),
    "k.chi": ("k.chi", 1, True, 0), "r.chi": ("r.chi", 3, False, 0),
    "k.dat": ("k.dat", 1, True, 0), "r.dat": ("r.dat", 3, False, 0), "q.dat": ("q.dat", 3, False, 0),
    "k.fit": ("k.fit", 1, True, 0), "r.fit": ("r.fit", 3, False, 0), "q.fit": ("q.fit", 3, False, 0),
    "e.bkg": ("e.bkg", 1, False, 0), "k.bkg": ("k.bkg", 1, False, 0),
    "raw": ("", 1, False, 0),
}
#: Suffixes of written results
PRODUCED = (".xmu", ".chi", ".dat", ".fit", ".bkg")


def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differences over the neighbours of each point, one-sided at the ends; zero where x stands still."""
    if len(x) < 2:
        return np.zeros(len(x))
    dx = np.gradient(x)
    return np.divide(np.gradient(y), dx, out=np.zeros(len(x)), where=dx != 0)


def item_of(content: str, item: str, kweight: int) -> tuple[list[float], list[float]]:
    """x and y of one item of a file."""
    _, at, weighted, order = ITEMS[item]
    columns = tx.column_file(content)["columns"]
    if len(columns) <= at:
        raise ValueError(f"needs at least {at + 1} columns")
    x, y = np.asarray(columns[0], float), np.asarray(columns[at], float)
    if item == "norm":
        out = rd.pre_edge(x, y, rd.PreEdgeParams())
        x, y = out["energy"], out["norm"]
    for _ in range(order):
        y = slope(x, y)
    return x.tolist(), (y * x**kweight if weighted else y).tolist()


class Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ItemReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.item, self.kweight = options.get("item", "f").lower(), int(options.get("kweight", 0))
        self.produced = options.get("produced", "false").lower() == "true"
        if self.item not in ITEMS:
            raise ValueError(f"item is one of {', '.join(ITEMS)}")
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            if type(f) in kinds and f.attribute in (("name",), ("path",)):
                self.tests.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f

    def wanted(self, path: str) -> bool:
        name = os.path.basename(path)
        low = name.lower()
        if low.startswith(".") or not low.endswith(ITEMS[self.item][0]) or (self.item == "raw" and not self.produced and low.endswith(PRODUCED)):
            return False
        has = {"is": lambda a, b: a == b, "in": lambda a, b: a in b, "starts": lambda a, b: b is not None and a.startswith(b), "ends": lambda a, b: b is not None and a.endswith(b)}
        return all(has[kind](name if of == "name" else path, value) for of, kind, value in self.tests)

    def partitions(self):
        return [Folder(at) for at, inner, _ in os.walk(self.root) if not inner.sort() and not any(p.startswith(".") for p in os.path.relpath(at, self.root).split("/") if p != ".")]

    def read(self, partition):
        with os.scandir(partition.path) as found:
            paths = sorted(e.path for e in found if e.is_file() and self.wanted(e.path))
        for path in paths:
            head = (path, os.path.basename(path), self.item)
            try:
                with open(path, "rb") as f:
                    x, y = item_of(tx.decoded(f.read()), self.item, self.kweight)
                yield (*head, x, y, "ok", None)
            except Exception as e:  # an error is a result here
                yield (*head, None, None, "failed", f"{type(e).__name__}: {e}")


class ItemSource(DataSource):
    @classmethod
    def name(cls):
        return "xasitem"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ItemReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ItemSource)
