"""Near duplicates by SimHash: fingerprints of 64 bits, linked at a few differing bits by exact tiled comparison.

A fingerprint's bit is 1 if it is set in over half of the XXH64 (seed 42) hashes of a document's shingles, repeats included.
Equal fingerprints are one class, so only distinct ones are compared. Their tiles are told by population counts: those of the four 16-bit
quarters of a fingerprint. Two fingerprints differ in at least as many bits as their counts differ by, quarter for quarter, so two tiles whose counts
differ by more than the radius in all hold no link and are skipped; every other pair of tiles is compared whole, with
exclusive-or and bit counts over numpy blocks. There are at most 17**4 tiles by counts; one that holds more than TILE
fingerprints is dealt into parts, each of which meets all parts of its neighbours. Every pair of tiles is looked at once, in the task of
the one with the higher number, to which the others are sent. A task joins what it finds linked and puts out fewer links
than it has fingerprints, never all pairs of a group. Components come from iterated joins on tables in the shared folder.

The work of comparison grows with the square of the number of distinct fingerprints (about a twentieth of all pairs are
left after skipping, where bits are even); what is sent grows with their number until tiles are dealt into parts.

Defined results: null or empty text and text without words have fingerprint zero, linked like any other; fewer than k words
form one shingle; rows that share an id are nodes of their own, and component_id is the least id that any row of a
component has; a null id is never that least one: a component without other ids has a null component_id; an empty table
gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelight.llm import wordhash as wh
from edgelight.llm.common import materialize
from edgelight.llm.near_dedup import components

SEED = 42
RADIUS = 3
QUARTERS = 4
SIDE = 64 // QUARTERS + 1
TILE = 1 << 15
#: Words are hashed in pieces of about so many bytes
PIECE = 1 << 18
#: Pairs compared at once
BLOCK = 1 << 21

#: A-Z in lower case, the other white space as spaces
PLAIN = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def hashes(text: bytes, k: int):
    """Arrays of the unsigned hashes of all shingles of a text, piece by piece."""
    text, at, kept, seen = text.translate(PLAIN), 0, [], 0
    digest = xxhash.xxh64_intdigest
    while at < len(text):
        stop = text.find(b" ", at + PIECE)
        stop = len(text) if stop < 0 else stop
        words = kept + text[at:stop].split()
        at = stop
        if len(words) >= k:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            first, last = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)
            seen += len(first)
        kept = words[-(k - 1) :] if k > 1 else []
    if kept and not seen:
        yield np.array([digest(b" ".join(kept), SEED)], np.uint64)


def bit_rows(h: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each hash."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes(text or b"", k):
        ones += bit_rows(h).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """One row per document: id, fp (the bits as a signed long)."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, k) for _, texts in wh.groups(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def tile_of(fp: Column) -> Column:
    """The counts of the quarters as one number, most significant quarter last."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))) * SIDE**i for i in range(QUARTERS)]
    return sum(counts[1:], counts[0]).cast("int")


def offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of counts that links can have."""
    span = range(-radius, radius + 1)
    return [d for d in product(span, repeat=QUARTERS) if sum(map(abs, d)) <= radius]


def neighbours(tile: int, near: list[tuple[int, ...]]) -> list[int]:
    """Tiles with a higher number that can hold links of this one's fingerprints."""
    counts = [tile // SIDE**i % SIDE for i in range(QUARTERS)]
    found = []
    for d in near:
        own = [a + b for a, b in zip(counts, d)]
        if all(0 <= c < SIDE for c in own):
            found.append(sum(c * SIDE**i for i, c in enumerate(own)))
    return [t for t in found if t > tile]


class Tile:
    """One tile's fingerprints and what links them, directly or by way of fingerprints of other tiles."""

    def __init__(self, own: np.ndarray, radius: int):
        self.own, self.radius = own, radius
        self.root = np.arange(len(own))
        self.a, self.b = [], []

    def links(self, others: np.ndarray, inside: bool = False):
        """Pairs of indexes (own, other), in bounded blocks of whole rows of others."""
        rows = max(1, BLOCK // max(1, len(self.own)))
        for i in range(0, len(others), rows):
            differ = np.bitwise_count(others[i : i + rows, None] ^ self.own[None, :])
            y, x = np.nonzero(differ <= self.radius)
            y += i
            if inside:
                y, x = y[x < y], x[x < y]
            yield x, y

    def meet(self, others: np.ndarray) -> None:
        for x, y in self.links(others):
            if len(x):
                start = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
                self.a.append(others[y[start]])
                self.b.append(self.own[x[start]])
                self.join(x, np.repeat(x[start], np.diff(np.append(start, len(x)))))

    def meet_itself(self) -> None:
        for x, y in self.links(self.own, inside=True):
            self.join(x, y)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.root[x], self.root[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that join the same components as all links found; fewer than fingerprints seen."""
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return np.concatenate([*self.a, self.own[moved]]), np.concatenate([*self.b, self.own[self.root[moved]]])


def similar(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that join those at `radius` or fewer differing bits into components."""
    if not 0 <= radius <= 8:
        raise ValueError("a radius of 0 to 8 bits")
    tiled = distinct.select("fp", tile_of(F.col("fp")).alias("tile"))
    # at most 17**4 rows, whatever the table's size
    counted = materialize(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("parts")), "fingerprint-tiles")
    parts = dict(counted.collect())
    tiled = tiled.join(F.broadcast(counted), "tile").withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    near = offsets(radius)

    def runs(batches, keys):
        """(key, column of values) of rows that come sorted by key, one batch's rows at a time."""
        for batch in batches:
            if len(batch):
                k = np.column_stack([batch.column(c).to_numpy() for c in range(keys)])
                cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    yield tuple(k[a].tolist()), batch.column(keys).slice(a, b - a)

    def send(batches):
        """Each tile's part to its own place and to all parts of its higher neighbours; in pieces, if batches cut it."""
        for (tile, part), fps in runs(batches, 2):
            places = [(tile, p, int(p != part)) for p in range(part, parts[tile])]
            places += [(t, p, 1) for t in neighbours(tile, near) for p in range(parts.get(t, 0))]
            packed = fps.to_numpy().tobytes()
            for i in range(0, len(places), 256):
                t, p, other = zip(*places[i : i + 256])
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(p, pa.int32()), pa.array(other, pa.int32()), pa.array([packed] * len(t), pa.binary())], ["tile", "part", "other", "fps"])

    def compare(batches):
        tile, now, own, others, size = None, None, [], [], 0

        def flush():
            nonlocal tile, own, others, size
            if tile is None:
                tile = Tile(np.concatenate([np.zeros(0, np.uint64), *own]), radius)
                tile.meet_itself()
                own = []
            if others:
                tile.meet(np.concatenate(others))
                others, size = [], 0

        def done():
            nonlocal tile
            flush()
            (a, b), tile = tile.edges(), None
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for (t, p, other), packed in runs(batches, 3):
            if now is not None and now != (t, p):
                yield done()
            now = (t, p)
            for one in packed:
                fps = np.frombuffer(one.as_buffer(), np.uint64)
                if not other:
                    own.append(fps)
                else:
                    others.append(fps)
                    size += len(fps)
                    if size > tile_rows:
                        flush()
        if now is not None:
            yield done()

    key = ["tile", "part"]
    # a number of its own: these rows are few bytes and much work, which coalescing by bytes would put in few tasks
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = tiled.select(*key, "fp").repartition(*key).sortWithinPartitions(*key).mapInArrow(send, "tile int, part int, other int, fps binary")
    return sent.repartition(n, *key).sortWithinPartitions(*key, "other").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = RADIUS, tile_rows: int = TILE) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows = materialize(fingerprints(docs, id_col, text_col, k), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")), "fingerprint-classes")
    links = materialize(similar(classes.select("fp"), radius, tile_rows), "fingerprint-links")
    if links.head(1):
        labels = components(links).withColumnRenamed("id", "fp")
        linked = materialize(classes.join(labels, "fp"), "fingerprint-labels")
        lowest = linked.groupBy("label").agg(F.min("low").alias("component_id"))
        named = classes.join(linked.select("fp", "label"), "fp", "left").join(lowest, "label", "left")
        # written, so that the join below can split the rows of a hot fingerprint
        classes = materialize(named.select("fp", F.when(F.col("label").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("low")), "fingerprint-components")
    out = rows.join(classes, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"))
