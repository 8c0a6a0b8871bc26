"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of `window` consecutive words (an item with fewer words, but at least one,
is one window). A window is a set of word shingles; its shingles are ordered by how often they occur in all documents,
rarest first. Exact containment (overlap 1.0) leaves a necessary prefix of one shingle, so the index holds only each
window's rarest one. A document position with that shingle is a candidate; the shingle's offset and the window's
length bound where the window must lie inside the document, and the words there are compared byte for byte.

The benchmark is read in blocks of at most `block_windows` windows, each broadcast in packed form; a worker unpacks one
block at a time, and HELD bytes of text meet it before the next; documents are never shuffled. Defined results: null text has no words; a null
item_id marks words but is not listed; rows that repeat an item_id are one item; repeated documents are judged row by row.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from edgelight.llm import wordhash as wh

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 1 << 17
#: Bytes of text that meet a block at once where there are several
HELD = 4 << 20
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, hit_words array<struct<first:long,last:long>>"


class Index:
    """The windows of one benchmark block."""

    def __init__(self, window: int, q: int):
        self.window, self.q = window, q
        self.ids: dict[tuple[bytes, ...], int] = {}
        self.items: list[set] = []
        self.hashes: list[np.ndarray] = []

    def add(self, item_id, text: str) -> None:
        raw = text.encode()
        starts, ends, h = wh.words(raw, wh.ALNUM)
        lower = bytes(wh.LOWER[np.frombuffer(raw, np.uint8)])
        tokens = [lower[s:e] for s, e in zip(starts, ends)]
        size = min(self.window, len(tokens))
        for i in range(len(tokens) - size + 1 if size else 0):
            key = tuple(tokens[i : i + size])
            at = self.ids.setdefault(key, len(self.ids))
            if at == len(self.items):
                self.items.append(set())
                self.hashes.append(h[i : i + size].copy())
            if item_id is not None:
                self.items[at].add(str(item_id))

    def tokens(self) -> dict[int, np.ndarray]:
        """Sorted distinct shingles, by shingle size."""
        found = defaultdict(list)
        for h in self.hashes:
            q = min(self.q, len(h))
            found[q].append(wh.shingles(h, q))
        return {q: np.unique(np.concatenate(x)) for q, x in found.items()}

    def order(self, tokens: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle as its prefix: self.prefix[q] = (sorted shingles, first, windows, offsets)."""
        found = defaultdict(list)
        for w, h in enumerate(self.hashes):
            q = min(self.q, len(h))
            own = wh.shingles(h, q)
            freq = counts[q][np.searchsorted(tokens[q], own)]
            at = int(np.argmin(freq))
            found[q].append((int(own[at]), w, at))
        self.prefix = {}
        for q, rows in found.items():
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            uniq, first = np.unique(key, return_index=True)
            self.prefix[q] = (uniq, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.keys = list(self.ids)


def bitmap(sorted_hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(sorted_hashes >> np.uint64(44)).astype(np.int64)] = True
    return bits


def located(sh: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in sh whose shingle is one of keys, and which."""
    maybe = np.flatnonzero(bits[(sh >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(keys, sh[maybe])
    at[at == len(keys)] = 0
    same = keys[at] == sh[maybe]
    return maybe[same], at[same]


def count_shingles(docs: DataFrame, text_col: str, tokens: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each benchmark shingle occurs in all documents; one pass, partial counts per task."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def count(batches):
        tables = {q: (keys, bitmap(keys)) for q, keys in shared.value.items()}
        totals = {q: np.zeros(len(keys), np.int64) for q, keys in shared.value.items()}
        for batch in batches:
            for _, texts in wh.groups(batch.column(0)):
                _, _, _, h, first = wh.words_of(texts, wh.ALNUM)
                for q, (keys, bits) in tables.items():
                    _, at = located(wh.shingles(h, q), bits, keys)
                    totals[q] += np.bincount(at, minlength=len(keys))
        for q, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int32)), pa.array(at), pa.array(total[at])], ["q", "at", "n"])

    rows = docs.select(text_col).mapInArrow(count, "q int, at long, n long").groupBy("q", "at").agg(F.sum("n").alias("n"))
    counts = {q: np.zeros(len(keys), np.int64) for q, keys in tokens.items()}
    for r in rows.collect():  # at most one row for each shingle of the block
        counts[r.q][r.at] = r.n
    return counts


def blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int, q: int, block_windows: int) -> list:
    """Broadcast indexes; the benchmark streams through the driver one block at a time."""
    spark, found, index = docs.sparkSession, [], Index(window, q)

    def close() -> None:
        if index.hashes:
            tokens = index.tokens()
            index.order(tokens, count_shingles(docs, text_col, tokens))
            found.append(spark.sparkContext.broadcast(pickle.dumps(index, protocol=5)))

    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        index.add(row.item_id, row.text)
        if len(index.hashes) >= block_windows:
            close()
            index = Index(window, q)
    close()
    return found


def matches(index: Index, joined: bytes, starts, ends, h, first, doc_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, lengths and windows of all verified occurrences."""
    out_start, out_len, out_win = [], [], []
    for q, (keys, offsets, wins, shifts) in index.prefix.items():
        pos, at = located(wh.shingles(h, q), index.bits[q], keys)
        if not len(pos):
            continue
        reps = offsets[at + 1] - offsets[at]
        rows = np.repeat(offsets[at] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(int(reps.sum()))
        win, start = wins[rows], np.repeat(pos, reps) - shifts[rows]
        size = index.sizes[win]
        doc = np.repeat(doc_of[pos], reps)
        inside = (start >= first[doc]) & (start + size <= first[doc + 1])  # positional and length bounds
        win, start, size = win[inside], start[inside], size[inside]
        for n in np.unique(size):
            these = size == n
            w, s = win[these], start[these]
            same = (h[s[:, None] + np.arange(n)] == index.matrix[n][index.row[w]]).all(axis=1)
            for i, j in zip(s[same].tolist(), w[same].tolist()):
                if all(joined[starts[i + k] : ends[i + k]].lower() == word for k, word in enumerate(index.keys[j])):
                    out_start.append(i)
                    out_len.append(n)
                    out_win.append(j)
    return np.array(out_start, np.int64), np.array(out_len, np.int64), np.array(out_win, np.int64)


def prepare(index: Index) -> Index:
    if not hasattr(index, "matrix"):
        index.bits = {q: bitmap(p[0]) for q, p in index.prefix.items()}
        index.sizes = np.array([len(h) for h in index.hashes])
        index.row = np.zeros(len(index.hashes), np.int64)
        index.matrix = {}
        for n in np.unique(index.sizes):
            own = np.flatnonzero(index.sizes == n)
            index.row[own] = np.arange(len(own))
            index.matrix[n] = np.stack([index.hashes[i] for i in own])
    return index


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, keep_spans: bool = True) -> DataFrame:
    """docs with a struct column `decon`: n_words, n_hit, n_items, items_sha256, items and runs of hit words (first, last)."""
    indexes = blocks(docs, benchmark, text_col, window, shingle, block_windows)
    plain = [f.name for f in docs.schema.fields]
    name = "decon"
    while name in plain:
        name += "_"
    schema = StructType([*docs.schema.fields, StructField(name, DataType.fromDDL(SCHEMA))])

    def judge(batches):
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("items", pa.list_(pa.string())), ("hit_words", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
        at = plain.index(text_col)
        only = prepare(pickle.loads(indexes[0].value)) if len(indexes) == 1 else None
        for batch in batches:
            out = []
            # several blocks: more texts at once, so that each is unpacked less often
            for texts in (texts for _, texts in wh.groups(batch.column(at), wh.SEGMENT if only or not indexes else HELD)):
                joined, starts, ends, h, first = wh.words_of(texts, wh.ALNUM)
                doc_of = np.repeat(np.arange(len(texts)), np.diff(first))
                edge, listed = np.zeros(len(h) + 1, np.int64), defaultdict(set)
                for shared in indexes:
                    index = only or prepare(pickle.loads(shared.value))
                    s, n, w = matches(index, joined, starts, ends, h, first, doc_of)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n, -1)
                    for i, j in zip(s.tolist(), w.tolist()):
                        listed[int(doc_of[i])] |= index.items[j]
                hit = np.cumsum(edge[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(hit)))
                for d in range(len(first) - 1):
                    a, b = int(first[d]), int(first[d + 1])
                    n_hit, ids, spans = int(total[b] - total[a]), sorted(listed.get(d, ())), []
                    if n_hit and keep_spans:
                        flips = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0]))))
                        spans = [{"first": int(x), "last": int(y) - 1} for x, y in zip(flips[::2], flips[1::2])]
                    out.append({"n_words": b - a, "n_hit": n_hit, "n_items": len(ids), "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(), "items": ids, "hit_words": spans})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*plain, name])

    return docs.mapInArrow(judge, schema)
