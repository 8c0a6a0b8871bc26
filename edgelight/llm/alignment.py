"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked id pairs.

A token of A and one of B are linked where their byte ranges overlap; offsets where both end cut a text into groups. An id pair's
count is the number of its links in the whole corpus, and a link is best if no other A id has a higher count with its B id.

Texts are taken in blocks and cut into units over which no token of either reaches (encoders.py), so a block encodes and aligns each
of its units once. A block leaves three kinds of rows in the shared folder: its documents (figures, and their units with repeats), its
links by stripe (the B id modulo STRIPES), and its pair counts by stripe, added up beforehand. Then:

* counts: the pair counts meet by stripe, and np.add.at adds them into a dense matrix of the stripe's B ids by all A ids,
  whose row maxima are the best; a matrix is STRIPE_IDS by the size of A's vocabulary, whatever the corpus.
* scores: links go to (stripe, part), where the stripe's counts, sent to each of its parts, come first; a stripe has as many parts as its links' bytes need,
  so ids that are everywhere spread over tasks. Units get their number of best links and sum of counts.
* totals: the scores of a block's units meet its documents, which add up what their units have.

Defined results: null and empty texts, and those whose tokens' bytes are not a space and the text, have no tokens: zeros and an
empty string; rows that share an id are documents of their own; ids may be null; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelight.llm import encoders
from edgelight.llm import wordhash as wh
from edgelight.llm.common import materialize

STRIPE_IDS = 128
#: Text bytes of a block; a longer text is a block of its own
BLOCK_BYTES = 8 << 20
#: Packed links of a part of a stripe
PART_BYTES = 32 << 20

PACKED = "kind string, block long, stripe int, place int, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, body binary"
DOC, LINKS, COUNTS, SCORES = "doc", "links", "counts", "scores"


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of equal length as one compressed value; each column keeps the fewest bytes that hold it."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for a in arrays:
        a = a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) <= np.iinfo(t).max))
        out += [bytes([a.itemsize]), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, at, found = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        size = raw[at]
        found.append(np.frombuffer(raw, f"<u{size}", n, at + 1).astype(np.int64))
        at += 1 + n * size
    return found


class Pair:
    """Two tokenizers by their files: A a byte-level BPE (.json), B a piece model (.model)."""

    def __init__(self, path_a: str, path_b: str):
        self.encode_a, self.encode_b = encoders.byte_bpe(path_a), encoders.piece_bpe(path_b)
        self.bytes_a, self.bytes_b = encoders.byte_bpe_bytes(path_a), encoders.piece_bpe_bytes(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        names = [[str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]]
        self.names = [[x + end for x in names[0]] for end in (",", "|", ";")]


class Aligned:
    """Units of a block, aligned in one pass: token numbers, groups, links and group texts by unit."""

    def __init__(self, pair: Pair, found: list[str]):
        self.units = found
        (a, self.n_a), (b, self.n_b) = encoders.encoded(pair.encode_a, found, " "), encoders.encoded(pair.encode_b, found)
        raw = [b" " + u.encode() for u in found]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.fits = np.ones(len(found), bool)
        for ids, n, sizes, of in ((a, self.n_a, pair.size_a, pair.bytes_a), (b, self.n_b, pair.size_b, pair.bytes_b)):
            at = np.cumsum(n) - n
            own = np.where(n > 0, np.add.reduceat(np.append(sizes[ids], 0), at) if len(n) else n, 0)
            joined = list(map(of.__getitem__, ids.tolist()))
            if (own != size).any() or b"".join(joined) != b"".join(raw):
                self.fits &= [b"".join(joined[x : x + y]) == r for x, y, r in zip(at.tolist(), n.tolist(), raw)]
        # what does not fit takes no part in the common stream of bytes
        self.a, self.unit_a = a[np.repeat(self.fits, self.n_a)], np.repeat(np.arange(len(found)), self.n_a * self.fits)
        self.b, unit_b = b[np.repeat(self.fits, self.n_b)], np.repeat(np.arange(len(found)), self.n_b * self.fits)
        self.n_a, self.n_b = self.n_a * self.fits, self.n_b * self.fits
        end_a, end_b = np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b])
        start_a, start_b = end_a - pair.size_a[self.a], end_b - pair.size_b[self.b]
        # B tokens that overlap each A token are neighbours: from the first that ends after its start to the last that starts before its end
        low = np.searchsorted(end_b, start_a, "right")
        n = np.searchsorted(start_b, end_a, "left") - low
        self.link_a = np.repeat(np.arange(len(self.a)), n)
        self.link_b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        self.n_links = np.bincount(self.unit_a, n, len(found)).astype(np.int64)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last = np.flatnonzero(np.diff(group_a, append=-1))
        self.n_groups = np.bincount(self.unit_a[last], minlength=len(found))
        # ids in the order of the text of groups, each with the sign that follows it
        group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.lexsort((side, group))
        ids, group, side = np.concatenate([self.a, self.b])[order], group[order], side[order]
        run = group * 2 + side
        ends = np.append(run[1:] != run[:-1], True) if len(run) else np.zeros(0, bool)
        signs = np.where(ends, side + 1, 0)
        names = pair.names
        pieces = [names[s][i] for s, i in zip(signs.tolist(), ids.tolist())]
        cuts = np.append(0, np.cumsum(self.n_a + self.n_b)).tolist()
        self.text = ["".join(pieces[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:])]


def block_rows(pair: Pair, number: int, ids: list, texts: list[str | None], stripes: int):
    """Rows of PACKED for one block of documents."""

    numbers = encoders.Numbers()
    own = [np.fromiter(map(numbers.__getitem__, encoders.units(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    known = Aligned(pair, list(numbers))
    if not known.fits.all():
        # a text with a unit that does not fit is looked at whole
        whole = [i for i, u in enumerate(own) if len(u) and not known.fits[u].all()]
        for i in whole:
            own[i] = np.array([numbers[texts[i]]])
        known = Aligned(pair, list(numbers))
        own = [u if known.fits[u].all() else u[:0] for u in own]
    used = np.bincount(np.concatenate([np.zeros(0, np.int64), *own]), minlength=len(numbers))
    rows = {c.split()[0]: [] for c in PACKED.split(", ")}

    def add(**values):
        for c, column in rows.items():
            column.append(values.get(c))

    for place, (i, u) in enumerate(zip(ids, own)):
        digest = hashlib.sha256(";".join([known.text[x] for x in u.tolist()]).encode()).hexdigest() if len(u) else ""
        kinds, times = np.unique(u, return_counts=True)
        sums = (int(x[u].sum()) for x in (known.n_a, known.n_b, known.n_groups, known.n_links))
        add(kind=DOC, block=number, place=place, id=i, groups_sha256=digest, body=pack(np.diff(kinds, prepend=0), times), **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums)))
    unit, a, b = known.unit_a[known.link_a], known.a[known.link_a], known.b[known.link_b]
    live = used[unit] > 0
    unit, a, b = unit[live], a[live], b[live]
    wide = len(pair.bytes_a)
    stripe, row = b % stripes, b // stripes
    order = np.argsort(stripe, kind="stable")
    cuts = np.searchsorted(stripe[order], np.arange(stripes + 1)).tolist()
    for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
        if y > x:
            at = order[x:y]
            add(kind=LINKS, block=number, stripe=s, body=pack(np.diff(unit[at], prepend=0), row[at], a[at]))
            cell, which = np.unique(row[at] * wide + a[at], return_inverse=True)
            add(kind=COUNTS, block=number, stripe=s, body=pack(np.diff(cell, prepend=0), np.bincount(which, used[unit[at]]).astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in SCHEMA], schema=SCHEMA)


SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in PACKED.split(", ")])


def runs(batches, keys: tuple[str, ...], *values: str):
    """(key, values) of each row of batches that come sorted by key."""
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *values))):
            yield row[: len(keys)], row[len(keys) :]


def counts(packed: DataFrame, rows: int, wide: int) -> DataFrame:
    """(stripe, body): the id pairs of each stripe with their counts over the corpus."""

    def run(batches):
        matrix, now = np.zeros(rows * wide, np.int64), None

        def done():
            at = np.flatnonzero(matrix)
            out = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack(np.diff(at, prepend=0), matrix[at])], pa.binary())], ["stripe", "body"])
            matrix[at] = 0
            return out

        for (stripe,), (body,) in runs(batches, ("stripe",), "body"):
            if now is not None and stripe != now:
                yield done()
            now = stripe
            cell, n = unpack(body)
            np.add.at(matrix, np.cumsum(cell), n)
        if now is not None:
            yield done()

    own = packed.where(F.col("kind") == COUNTS).select("stripe", "body")
    return materialize(own.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(run, "stripe int, body binary"), "pair-counts")


def scores(packed: DataFrame, counted: DataFrame, rows: int, wide: int, part_bytes: int) -> DataFrame:
    """(block, body): units of a block with their best links and sums of counts in one stripe."""
    links = packed.where(F.col("kind") == LINKS).select("block", "stripe", "body")
    parts = links.groupBy("stripe").agg(F.greatest(F.ceil(F.sum(F.octet_length("body").cast("long")) / part_bytes), F.lit(1)).cast("int").alias("parts"))
    parts = F.broadcast(materialize(parts, "stripe-parts"))  # a row per stripe
    none = F.lit(None).cast("long")
    links = links.join(parts, "stripe").select("stripe", F.pmod(F.xxhash64("block"), "parts").cast("int").alias("part"), F.lit(1).alias("later"), "block", "body")
    first = counted.join(parts, "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("later"), none.alias("block"), "body")

    def run(batches):
        matrix, cells = np.zeros(rows * wide, np.int64), np.zeros(0, np.int64)
        best = np.zeros(rows, np.int64)
        for _, (later, block, body) in runs(batches, ("stripe", "part"), "later", "block", "body"):
            got = unpack(body)
            if not later:
                matrix[cells] = 0
                cells = np.cumsum(got[0])
                matrix[cells] = got[1]
                best = matrix.reshape(rows, wide).max(axis=1)
                continue
            unit, row, a = np.cumsum(got[0]), got[1], got[2]
            n = matrix[row * wide + a]
            kinds, which = np.unique(unit, return_inverse=True)
            sums, hits = np.zeros(len(kinds), np.int64), np.bincount(which, n == best[row], len(kinds)).astype(np.int64)
            np.add.at(sums, which, n)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack(np.diff(kinds, prepend=0), hits, sums)], pa.binary())], ["block", "body"])

    key = ["stripe", "part"]
    both = first.unionByName(links).repartition(*key).sortWithinPartitions(*key, "later")
    return both.mapInArrow(run, "block long, body binary")


def totals(packed: DataFrame, scored: DataFrame, id_col: str) -> DataFrame:
    """One row per document: its figures, and n_best and count_sum from its units' scores."""
    own = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    docs = packed.where(F.col("kind") == DOC).select("block", F.lit(1).alias("later"), *own, "body")
    units = scored.select("block", F.lit(0).alias("later"), *(F.lit(None).cast("string" if c == "groups_sha256" else "long").alias(c) for c in own), "body")
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in [*own, "n_best", "count_sum"]])

    def grown(sums, n):
        return np.concatenate([sums, np.zeros((2, n - sums.shape[1]), np.int64)], axis=1) if n > sums.shape[1] else sums

    def run(batches):
        sums, now = np.zeros((2, 0), np.int64), None
        for batch in batches:
            keep, best, total = [], [], []
            for i, (block, later, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "later", "body")))):
                if block != now:
                    sums, now = np.zeros((2, 0), np.int64), block
                got = unpack(body)
                unit = np.cumsum(got[0])
                if not later:
                    sums = grown(sums, int(unit[-1]) + 1)
                    sums[0, unit] += got[1]
                    sums[1, unit] += got[2]
                else:
                    keep.append(i)
                    best.append(int(sums[0, unit] @ got[1]))
                    total.append(int(sums[1, unit] @ got[1]))
            left = batch.select(own).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(best, pa.int64()), pa.array(total, pa.int64())], schema=schema)

    both = units.unionByName(docs).repartition("block").sortWithinPartitions("block", "later")
    found = both.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in schema.names))
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, stripe_ids: int = STRIPE_IDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    wide, n_b = len(encoders.byte_bpe_bytes(path_a)), len(encoders.piece_bpe_bytes(path_b))
    stripes = -(-n_b // stripe_ids)

    def run(batches):
        pair, number = Pair(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in wh.groups(batch.column(1), block_bytes):
                yield block_rows(pair, number, ids[first : first + len(texts)], [t.decode() if t else None for t in texts], stripes)
                number += 1

    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PACKED)
    packed = materialize(packed, "aligned")
    counted = counts(packed, stripe_ids, wide)
    return totals(packed, materialize(scores(packed, counted, stripe_ids, wide, part_bytes), "unit-scores"), id_col)
