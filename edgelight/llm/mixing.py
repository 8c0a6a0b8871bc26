"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame functions only.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share `share` times all words; a target
stops at `limit` times its source's size and what is over goes to the others by weight (water filling, solved from
running sums over sources sorted by size over weight).

Drawing: a source's documents fall into about sqrt(size) blocks by a digest of doc_id. A source's draws are slots: each
whole pass over its blocks in permuted order, then blocks of a last pass up to the quota; the last block is taken in part, document by document in
permuted order, and the last document in part, so the words taken equal the rounded target. The tree's root holds the
slots of every source; each node gives half its slots to its left child, so that the counts of the sources there are a
draw from the multivariate hypergeometric distribution (the half of the slots with the smallest keyed digests), and its
leaves are the output shards. A leaf's exact quotas cut each source's slots into disjoint ranges. Inside a shard rows go
by a digest (`order_key`).

The half with the smallest digests is found from counts of 4096 digest bins; only the rows of one bin for each node are
ranked. All group keys are (source, block) or finer, so a source with a third of all documents is many small groups. Tables
with a row per source are broadcast only up to BROADCAST_ROWS counted rows. Defined results: null text has size 0 and
is taken 0 times; a null source is a source of its own; repeated rows are separate documents; all draws repeat exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelight.llm.common import materialize, small_side

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARDS = 8
BROADCAST_ROWS = 10_000
BINS = 4096


def digest60(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts joined by colons, null as empty."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with sid, weight, target and quota. One row per source: the windows run over sources, not documents."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("sid", F.row_number().over(order)).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.lit(limit) * F.col("source_size")).withColumn("total", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    rows = rows.withColumn("below", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("left", F.col("total") - F.coalesce("below", F.lit(0.0))).withColumn("weights", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("full", F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("left") / F.col("weights"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))
    return rows.withColumn("target", target.cast("double")).select("sid", "source", "source_size", "target", F.least(F.floor(F.col("target") + 0.5), F.floor("cap")).cast("long").alias("quota"))


def split(quotas: DataFrame, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """quotas (sid, n) among shards (a power of two): (sid, node, n), node counted from 0."""
    nodes = materialize(quotas.select(F.lit(0).alias("node"), "sid", F.col("n").cast("long").alias("n")), "tree")
    for level in range(shards.bit_length() - 1):
        # slots 1..n of each (node, source), made in runs so that no array grows with n
        runs = nodes.where("n > 0").select("node", "sid", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(4096).cast("long"))).alias("first"))
        slots = runs.select("node", "sid", F.explode(F.sequence("first", F.least(F.col("first") + 4095, F.col("n")))).alias("slot"))
        slots = slots.withColumn("key", digest60(F.lit(f"{seed}/{level}"), F.col("node"), F.col("sid"), F.col("slot")))
        slots = slots.withColumn("bin", F.shiftright("key", 48).cast("int"))
        half = nodes.groupBy("node").agg(F.ceil(F.sum("n") / 2).cast("long").alias("half"))
        bins = slots.groupBy("node", "bin").agg(F.count(F.lit(1)).alias("c"))
        bins = bins.withColumn("upto", F.sum("c").over(Window.partitionBy("node").orderBy("bin"))).join(half, "node")
        cut = bins.where("upto - c < half and upto >= half").select("node", F.col("bin").alias("cut"), (F.col("half") - F.col("upto") + F.col("c")).alias("need"))
        placed = slots.join(F.broadcast(cut), "node")  # one row per node
        whole = placed.where("bin < cut").select("node", "sid")
        rank = F.row_number().over(Window.partitionBy("node").orderBy("key", "sid", "slot"))
        part = placed.where("bin = cut").withColumn("r", rank).where("r <= need").select("node", "sid")
        left = whole.unionByName(part).groupBy("node", "sid").agg(F.count(F.lit(1)).alias("l"))
        both = nodes.join(left, ["node", "sid"], "left").withColumn("l", F.coalesce("l", F.lit(0).cast("long")))
        pair = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("l")).alias("n")))
        nodes = materialize(both.select("sid", F.explode(pair).alias("x")).select("x.node", "sid", "x.n"), "tree")
    return nodes


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, limit: float = 2.0, weights: tuple = WEIGHTS, shards: int = SHARDS, seed: str = "mix", keep: bool = False) -> DataFrame:
    """One row per document: id_col, size, source_size, target, taken and draws (copy, words, shard, order_key); with keep, docs' own columns too."""
    names = ["size", "source_size", "target", "taken", "draws"]
    own = [id_col] if not keep else [c for c in docs.columns if c not in names]  # a column of docs with a result's name gives way
    work = docs.select(*([F.col(c).alias(f"own_{i}") for i, c in enumerate(own)]), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), sized(docs, text_col).alias("size"))
    # sizes once: later steps read a few bytes per document, unless the texts are to be kept
    small = materialize(work.select("id", "source", "size"), "sizes")
    if not keep:
        work = small.withColumn("own_0", F.col("id"))
    sources = targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), share, limit, weights)
    sources = sources.withColumn("n_blocks", F.greatest(F.ceil(F.sqrt("source_size")), F.lit(1)).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size"))
    sources = materialize(sources, "sources")
    n_sources = sources.count()

    def with_source(rows: DataFrame) -> DataFrame:
        side = small_side(sources.withColumnRenamed("source", "its_source"), n_sources, BROADCAST_ROWS)
        rows = rows.join(side, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
        return rows.withColumn("block", F.pmod(digest60(F.lit(f"{seed}/block"), F.col("id")), F.col("n_blocks")))

    blocks = with_source(small).groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    key = digest60(F.lit(f"{seed}/order"), F.col("sid"), F.col("block"))
    permuted = Window.partitionBy("sid").orderBy("key", "block")
    blocks = blocks.withColumn("key", key).withColumn("rank", F.row_number().over(permuted) - 1).withColumn("before", F.sum("words").over(permuted) - F.col("words"))
    blocks = blocks.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sid")))
    blocks = blocks.withColumn("part", F.greatest(F.least(F.col("rest") - F.col("before"), F.col("words")), F.lit(0).cast("long")))
    copies = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    blocks = materialize(blocks.select("sid", "block", "whole", "part", "rank", "n", copies.cast("long").alias("copies")), "blocks")
    quotas = blocks.groupBy("sid").agg(F.sum("copies").alias("n"))
    leaves = split(quotas, shards, seed)
    ranges = leaves.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("node", F.col("n").alias("c")))).alias("q"))  # one entry per shard
    starts = F.transform(F.col("q"), lambda x, i: F.aggregate(F.slice(F.col("q"), 1, i), F.lit(0).cast("long"), lambda s, y: s + y["c"]))
    ranges = ranges.select("sid", starts.alias("starts"))
    placed = blocks.join(small_side(ranges, n_sources, BROADCAST_ROWS), "sid")
    slot_shard = F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("whole")), lambda e: e < F.col("copies")),
        lambda e: F.struct(e.alias("copy"), (F.size(F.filter("starts", lambda x: x <= e * F.col("n") + F.col("rank"))) - 1).alias("shard")),
    )
    placed = placed.select("sid", "block", "part", slot_shard.alias("slots"))

    rows = with_source(work).join(placed, ["sid", "block"])
    local = Window.partitionBy("sid", "block").orderBy(digest60(F.lit(f"{seed}/doc"), F.col("id")), "id", "size")
    rows = rows.withColumn("seen", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    extra = F.greatest(F.least(F.col("part") - F.col("seen"), F.col("size")), F.lit(0).cast("long"))
    draws = F.transform(
        "slots",
        lambda x: F.struct(
            x["copy"].alias("copy"),
            F.when(x["copy"] < F.col("whole"), F.col("size")).otherwise(F.col("extra")).alias("words"),
            x["shard"].alias("shard"),
            F.xxhash64(F.lit(seed), x["copy"], F.col("id")).alias("order_key"),
        ),
    )
    rows = rows.withColumn("extra", extra).withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return rows.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(own)), "size", "source_size", "target", taken.alias("taken"), "draws")


def drawn(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per draw of mix(..., keep=True), in shards and locally shuffled; a document drawn in part has its first words."""
    rows = mixed.select("*", F.explode("draws").alias("draw")).drop("draws")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), 1), 1, F.col("draw.words").cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(F.col("draw.words") < F.col("size"), cut).otherwise(F.col(text_col)))
    rows = rows.select(*[c for c in mixed.columns if c != "draws"], "draw.copy", "draw.words", "draw.shard", "draw.order_key")
    return rows.sortWithinPartitions("shard", "order_key")
