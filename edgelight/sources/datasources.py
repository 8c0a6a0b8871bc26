"""Python data sources for instrument files: xascol, pathdat, structinp, xasresult. register(spark) makes them known.

A partition is a group of files of similar total size; files are listed once, on the driver, and filtered by suffix before
anything is opened. A file that cannot be read is a row with status 'failed' and its error, not an exception. With
readStream, new files of the folder are batches. These sources see folders that every machine mounts; scan_files() reads
column files through Spark's own file reader, from any store and as a stream, too.
"""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from edgelight.sources import text as tx

PATH_SCHEMA = "path string, title string, version string, shell string, absorber string, nleg int, degen double, reff double, rnorman double, edge double, gam_ch double, exch string, vmu double, vfermi double, vint double, rs_int double, potentials array<struct<ipot:int,iz:int,rmt:double,rnm:double>>, geom array<struct<label:string,iz:int,ipot:int,mass:double,x:double,y:double,z:double>>, k array<double>, real_phc array<double>, mag_feff array<double>, pha_feff array<double>, red_fact array<double>, lam array<double>, rep array<double>, pha array<double>, amp array<double>, status string, error string"


def listed(options: dict) -> list[str]:
    root, pattern = options["path"].removeprefix("file://"), options.get("pathglobfilter", "*")
    if os.path.isfile(root):
        return [root]
    names = sorted(n for n in os.listdir(root) if not n.startswith(".") and fnmatch.fnmatch(n.lower(), pattern.lower()))
    return [os.path.join(root, n) for n in names if os.path.isfile(os.path.join(root, n))]


class FilesPartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FilesReader(DataSourceReader):
    def __init__(self, options: dict, parse, width: int):
        self.options, self.parse, self.width = options, parse, width

    def partitions(self):
        """Groups of files, by size, for about `partitionbytes` each."""
        return [FilesPartition(g) for g in grouped(listed(self.options), self.options)] or [FilesPartition([])]

    def read(self, partition):
        for path in partition.paths:
            yield from rows_of(path, self.parse, self.options, self.width)


def grouped(paths: list[str], options: dict) -> list[list[str]]:
    limit, groups, size = int(options.get("partitionbytes", 16 << 20)), [], 0
    for path in paths:
        n = (os.path.getsize(path) if os.path.exists(path) else 0) + 4096
        if not groups or size + n > limit:
            groups.append([])
            size = 0
        groups[-1].append(path)
        size += n
    return groups


def rows_of(path: str, parse, options: dict, width: int):
    """Rows of one file; a file that cannot be opened or parsed is a row with its error."""
    try:
        with open(path, "rb") as f:
            content = f.read()
    except OSError as e:
        return [failed(path, e, width)]
    return parsed(path, content, parse, options, width)


def parsed(path: str, content: bytes, parse, options: dict, width: int) -> list[tuple]:
    try:
        return [(path, *row, "ok", None) for row in parse(tx.decoded(content), options)]
    except Exception as e:
        return [failed(path, e, width)]


def failed(path: str, error: Exception, width: int) -> tuple:
    return (path, *[None] * (width - 3), "failed", str(error))


class FilesStream(DataSourceStreamReader):
    """New files of a folder. The offset holds all names seen, so a file that comes late under a smaller name is read, too;
    for folders of very many files use scan_files(), whose log Spark keeps."""

    def __init__(self, options: dict, parse, width: int):
        self.options, self.parse, self.width = options, parse, width

    def initialOffset(self):
        return {"seen": []}

    def latestOffset(self):
        return {"seen": listed(self.options)}

    def partitions(self, start, end):
        new = sorted(set(end["seen"]) - set(start["seen"]))
        return [FilesPartition(g) for g in grouped(new, self.options)] or [FilesPartition([])]

    def read(self, partition):
        for path in partition.paths:
            yield from rows_of(path, self.parse, self.options, self.width)

    def commit(self, end):
        pass


def _columns(content, options):
    c = tx.column_file(content, int(options["headerskip"]) if "headerskip" in options else None)
    yield c["header"], c["labels"], c["columns"]


def _path(content, options):
    names = [f.split()[0] for f in PATH_SCHEMA.split(", ")][1:-2]
    d = tx.path_file(content)
    d["potentials"] = [tuple(p.values()) for p in d["potentials"]]
    d["geom"] = [tuple(g.values()) for g in d["geom"]]
    yield tuple(d[n] for n in names)


def _structure(content, options):
    d = tx.structure_input(content)
    yield d["title"], d["edge"], [tuple(p.values()) for p in d["potentials"]], [tuple(a.values()) for a in d["atoms"]]


def _result(content, options):
    for i, b in enumerate(tx.result_blocks(content)):
        yield i, b["label"], b["x_label"], b["y_label"], b["x"], b["y"]


def _source(kind: str, columns: str, parser):
    class Source(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return columns

        def reader(self, schema):
            return FilesReader(dict(self.options), parser, len(schema.fields))

        def streamReader(self, schema):
            return FilesStream(dict(self.options), parser, len(schema.fields))

    Source.__name__ = f"{kind.title()}Source"
    return Source


SOURCES = (
    _source("xascol", "path string, header array<string>, labels array<string>, columns array<array<double>>, status string, error string", _columns),
    _source("pathdat", PATH_SCHEMA, _path),
    _source("structinp", "path string, title array<string>, edge string, potentials array<struct<ipot:int,z:int,tag:string>>, atoms array<struct<x:double,y:double,z:double,ipot:int,tag:string,distance:double>>, status string, error string", _structure),
    _source("xasresult", "path string, block int, label string, x_label string, y_label string, x array<double>, y array<double>, status string, error string", _result),
)


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)


COLUMNS_SCHEMA = "path string, header array<string>, labels array<string>, columns array<array<double>>, status string, error string"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def scan_files(spark: SparkSession, folder: str, pattern: str = "*", stream: bool = False, **options: str) -> DataFrame:
    """Column files of a folder in any store that Spark reads, a row per file; as a stream, Spark's log keeps what was read."""
    import pandas as pd

    files = (spark.readStream if stream else spark.read).format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).load(folder)
    names = [c.split()[0] for c in COLUMNS_SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for path, content in zip(pdf["path"], pdf["content"]) for r in parsed(path, bytes(content), _columns, options, len(names))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, COLUMNS_SCHEMA)


def load_counts(scanned: DataFrame) -> DataFrame:
    """(loaded, failed): how many files of a scan could be read."""
    from pyspark.sql import functions as F

    ok = F.col("status") == "ok"
    return scanned.agg(F.count(F.when(ok, 1)).alias("loaded"), F.count(F.when(~ok, 1)).alias("failed"))
