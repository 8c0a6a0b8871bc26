"""Instrument files as a column of texts: parsers and writers over tables, a file a row, in Arrow batches without a shuffle.

Files come from Spark's text or binary reader, or are made by a query. A text that cannot be parsed is a row with status
'failed', its error and null results; null text is 'skipped'. Columns of the table keep their names and values; results
that clash with one of them are an error before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from edgelight.sources import text as tx
from edgelight.sources import writers


def mapped(df: DataFrame, inputs: list[str], kernel: Callable[..., dict], results: str) -> DataFrame:
    """df with the kernel's results (DDL), status and error; the kernel takes the inputs' values, the first of which may not be null."""
    added = StructType([*DataType.fromDDL(results).fields, *DataType.fromDDL("status string, error string").fields])
    clash = sorted({f.name.lower() for f in added} & {c.lower() for c in df.columns})
    if clash:
        raise ValueError(f"columns of the table that results are called, too: {', '.join(clash)}")
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in added]
    names = df.columns

    def run(batches):
        for batch in batches:
            rows = []
            for values in zip(*(batch.column(names.index(c)).to_pylist() for c in inputs)):
                if values[0] is None:
                    rows.append({"status": "skipped"})
                    continue
                try:
                    rows.append({**kernel(*values), "status": "ok"})
                except Exception as e:  # an error is a result here
                    rows.append({"status": "failed", "error": str(e) or type(e).__name__})
            made = [pa.array([r.get(n) for r in rows], kind) for n, kind in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *(n for n, _ in kinds)])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def _columns(content: str, skip: int | None = None) -> dict:
    found = tx.column_file(content, skip)
    return found | {"defaults": tx.import_defaults(found["labels"])}


def _chi(content: str) -> dict:
    columns = tx.column_file(content)["columns"]
    if len(columns) < 2:
        raise ValueError("BadColumn(1)")
    return {"k": columns[0], "chi": columns[1]}


def _fit(content: str) -> dict:
    found = tx.fit_input(content)
    paths = [{"path": n, "entries": list(own.items())} for n, own in sorted(found["paths"].items())]
    return found | {"paths": paths, "functions": list(found["functions"].items()), "settings": list(found["settings"].items())}


_GEOM = "struct<label:string,iz:int,ipot:int,mass:double,x:double,y:double,z:double>"
#: Kinds of files: parser and its results
KINDS: dict[str, tuple[Callable, str]] = {
    "columns": (_columns, "header array<string>, labels array<string>, columns array<array<double>>, defaults struct<mode:string,energy:int,i0:int,it:int,mu:int>"),
    "chi": (_chi, "k array<double>, chi array<double>"),
    "overlay": (tx.overlay, "x array<double>, y array<double>"),
    "path": (tx.path_file, f"title string, version string, shell string, absorber string, nleg int, degen double, reff double, vmu double, vfermi double, vint double, potentials array<struct<ipot:int,iz:int,rmt:double,rnm:double>>, geom array<{_GEOM}>, k array<double>, pha array<double>, amp array<double>"),
    "structure": (tx.structure_input, "title array<string>, edge string, potentials array<struct<ipot:int,z:int,tag:string>>, atoms array<struct<x:double,y:double,z:double,ipot:int,tag:string,distance:double>>"),
    "blocks": (lambda content: {"blocks": tx.result_blocks(content)}, "blocks array<struct<label:string,x_label:string,y_label:string,x:array<double>,y:array<double>>>"),
    "fit": (_fit, "vars array<struct<name:string,vary:boolean,text:string>>, paths array<struct<path:int,entries:map<string,string>>>, functions map<string,string>, settings map<string,string>, nofit boolean"),
}


def parse(df: DataFrame, kind: str, content: str = "content", *options: str) -> DataFrame:
    """df with what the texts of a column hold. options are columns: the lines to skip ('columns'), item and weight ('overlay')."""
    parser, results = KINDS[kind]
    return mapped(df, [content, *options], parser, results)


def write(df: DataFrame, inputs: list[str], writer: Callable[..., str]) -> DataFrame:
    """df with `content`, the text that a writer of sources.writers makes of the inputs' values."""
    return mapped(df, inputs, lambda *values: {"content": writer(*values)}, "content string")


def two_column(df: DataFrame, header: str, x: str, y: str) -> DataFrame:
    return write(df, [x, y, header], lambda a, b, h: writers.two_column(h or [], a, b))


def complex_columns(df: DataFrame, header: str, x: str, re: str, im: str) -> DataFrame:
    return write(df, [x, re, im, header], lambda a, r, i, h: writers.complex_columns(h or [], a, r, i))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals as SQL and C print it: its exact binary value, halves to even. format_string() rounds the shortest digits that name it."""

    @F.arrow_udf("string")
    def text(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"{x:.{digits}f}" for x in v.to_pylist()], pa.string())

    return text(c.cast("double"))


def time_line(name: Column, start: Column, finish: Column) -> Column:
    """A line of a table of measured times: name, start and finish in hours; what is not known is blank."""
    hours = lambda c: F.coalesce(fixed(c, 4), F.lit(""))
    return F.concat(name, F.lit("\t"), hours(start), F.lit("\t"), hours(finish))
