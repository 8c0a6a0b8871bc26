"""Sets of fit parameters as a table (set_id, pos, name, kind, value, min, max, expr): the order of constraints, their values."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelight.operators.fits import parameters

#: Names in an expression, without those that are called
NAMES = r"\b([A-Za-z_]\w*)\b(?!\s*\()"
RULES = "array<struct<name:string,uses:array<string>>>"


def _peeled(rows: Column, free) -> Column:
    """Rounds of names: each round takes what free(row, left) allows among the rows that are left; array of (name, round), and what stays."""

    def step(state: Column, i: Column) -> Column:
        left = state["left"]
        now = F.filter(left, lambda r: free(r, left))
        stay = F.filter(left, lambda r: ~F.array_contains(F.transform(now, lambda x: x["name"]), r["name"]))
        return F.struct(stay.alias("left"), F.concat(state["done"], F.transform(now, lambda r: F.struct(r["name"].alias("name"), i.alias("round")))).alias("done"))

    start = F.struct(rows.alias("left"), F.array().cast("array<struct<name:string,round:int>>").alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))), start, step)


def order(params: DataFrame) -> DataFrame:
    """(set_id, name, level, status) of the constraints: level 1 uses no other constraint, each other one is a level above what it uses.

    status: ok; cycle, in a cycle or between two; after, uses what is in a cycle. The latter two have no level. Of a name that stands
    twice in a set the last one holds. Sets are small; each is one row while it is ordered.
    """
    rows = params.groupBy("set_id", "name").agg(F.max_by(F.struct("kind", "expr"), "pos").alias("p")).where("p.kind = 'expr'")
    uses = F.array_distinct(F.regexp_extract_all(F.coalesce("p.expr", F.lit("")), F.lit(NAMES), 1))
    sets = rows.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("name", uses.alias("uses")))).alias("rules"))
    names = F.transform("rules", lambda r: r["name"])
    sets = sets.withColumn("names", names)
    known = F.transform("rules", lambda r: F.struct(r["name"].alias("name"), F.array_intersect(r["uses"], F.col("names")).alias("uses")))
    sets = sets.select("set_id", known.cast(RULES).alias("rules"))

    def unused_left(r: Column, left: Column) -> Column:
        return F.size(F.array_intersect(r["uses"], F.transform(left, lambda x: x["name"]))) == 0

    def not_used(r: Column, left: Column) -> Column:
        return ~F.array_contains(F.flatten(F.transform(left, lambda x: x["uses"])), r["name"])

    sets = sets.withColumn("up", _peeled(F.col("rules"), unused_left))
    sets = sets.withColumn("down", _peeled(F.col("up.left"), not_used))
    found = F.concat(
        F.transform("up.done", lambda d: F.struct(d["name"].alias("name"), d["round"].alias("level"), F.lit("ok").alias("status"))),
        F.transform("down.left", lambda d: F.struct(d["name"].alias("name"), F.lit(None).cast("int").alias("level"), F.lit("cycle").alias("status"))),
        F.transform(F.filter("down.done", lambda d: d["name"].isNotNull()), lambda d: F.struct(d["name"].alias("name"), F.lit(None).cast("int").alias("level"), F.lit("after").alias("status"))),
    )
    return sets.select("set_id", F.explode(found).alias("f")).select("set_id", "f.*")


def resolve(params: DataFrame) -> DataFrame:
    """(set_id, name, value, status, error): every value of a set, constraints worked out; a set with a cycle or a bad expression is one row with its error.

    A set is one row while it is worked out, and sets go through Python by Arrow batches, so their number costs no call each.
    """
    doubles = [c for c in ("value", "min", "max") if c in params.columns]
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    rule = F.struct(F.col("pos").isNull().alias("unplaced"), "pos", "name", "kind", *map(number, doubles), "expr")
    sets = params.groupBy("set_id").agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    names = ["name", "kind", *doubles, "expr"]
    sets = sets.select("set_id", *(F.col(f"rules.{c}").alias(c) for c in names))

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, fields in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                try:
                    found = parameters([dict(zip(names, r)) for r in zip(*fields)]).resolve()
                    own = [(n, float(v), "ok", None) for n, v in found.items()]
                except Exception as e:  # an error is a result here
                    own = [(None, None, "failed", f"{type(e).__name__}: {e}")]
                at += [i] * len(own)
                rows += own
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *made], ["set_id", "name", "value", "status", "error"])

    kind = params.schema["set_id"].dataType.simpleString()
    return sets.mapInArrow(run, f"set_id {kind}, name string, value double, status string, error string")
