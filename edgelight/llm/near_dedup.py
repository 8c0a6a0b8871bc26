"""Near duplicates by MinHash with sequential Bayesian verification.

A document's set is its distinct k-word shingles. Documents with the same set form a class (compared by 128-bit digest),
and only one document of a class goes on, so copies cost one row each. Banded signatures propose candidates; a candidate
pair's signatures are compared in batches, and after each batch the pair is dropped if the posterior probability that its
similarity reaches the threshold (uniform prior) is under the miss probability. Survivors are verified on full sets.

No bucket emits its pairs. First every member is paired with its bucket's smallest id, and links are verified. Buckets
that still hold several components are then settled whole, one bucket to a task's memory at a time: batches (of one byte
per hash, which can only overstate matches) prune the pairs between components, survivors are verified on full sets there
and then, most similar first, and only a link that joins two components of the bucket is put out: fewer links than
members. A pair is looked at in the first band in which it agrees. In a bucket of more than BLOCK members, or BLOCK_BYTES
of sets, the largest component needs no pairs inside itself, so its blocks meet the blocks of all other members only: copies
of members are in proportion to the bucket as long as those others fit in a block. Components come from iterated joins on
tables in the shared folder; links and labels never reach the driver.

Defined results: null or empty text and text without words have an empty set, linked with nothing; fewer than k words
form one shingle; rows that share an id are one node, linked with what any of their texts is linked with; a null id is linked with nothing and its component is null.
"""

from __future__ import annotations

import hashlib
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelight.llm import wordhash as wh
from edgelight.llm.common import materialize, small_side

#: Hashes of the bands, kept whole, and further ones for comparison only, kept as one byte
PERMS = 128
EXTRA = 256
ALL = PERMS + EXTRA
STEP = 16
BLOCK = 2048
BLOCK_BYTES = 64 << 20
MISS = 1e-9
BAND_MISS = 1e-6
BROADCAST_IDS = 2_000_000


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), r.integers(0, 1 << 64, n, np.uint64)


def rows_per_band(threshold: float, perms: int = PERMS, miss: float = BAND_MISS) -> int:
    """The most rows in a band such that a pair at the threshold is missed by all bands with at most this probability."""
    return max([r for r in range(1, 17) if (1 - threshold**r) ** (perms // r) <= miss], default=1)


@cache
def least_matches(threshold: float, perms: int = ALL, step: int = STEP, miss: float = MISS) -> list[int]:
    """For each batch, the fewest matches with P(similarity >= threshold | matches) >= miss under a uniform prior."""
    found = []
    for n in range(step, perms + 1, step):
        tail, m = 0.0, 0
        while True:  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        found.append(m)
    return found


def sets_of(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    _, _, _, h, first = wh.words_of(texts, wh.NON_SPACE)
    long = wh.shingles(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        out.append(np.unique(long[a : b - k + 1]) if n >= k else wh.shingles(h[a:b], n) if n else h[:0])
    return out


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        low = np.minimum(low, (values[i : i + 1024, None] * a + b).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def stored(sig: np.ndarray) -> bytes:
    return sig[:PERMS].tobytes() + sig[PERMS:].astype(np.uint8).tobytes()


def loaded(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(whole hashes of the bands, one byte of every hash), a row per document."""
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 4 * PERMS + EXTRA)
    whole = np.ascontiguousarray(raw[:, : 4 * PERMS]).view(np.uint32)
    return whole, np.hstack([whole.astype(np.uint8), raw[:, 4 * PERMS :]])


def digest_of(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def part_of(digest: bytes | None) -> int | None:
    """Tells apart the texts of one id."""
    return None if digest is None else int.from_bytes(digest[:8], "little", signed=True)


def features(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches):
        a, b = permutations(ALL)
        for batch in batches:
            for first, texts in wh.groups(batch.column(1)):
                n, digest, part, sig = [], [], [], []
                for s in sets_of(texts, k):
                    n.append(len(s))
                    digest.append(digest_of(s) if len(s) else None)
                    part.append(part_of(digest[-1]))
                    sig.append(stored(signature(s, a, b)) if len(s) else None)
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(part, pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "digest", "part", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, digest binary, part long, sig binary")


def survivors(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, part_a, b, part_b) that no batch of their signatures rules out."""
    least = least_matches(threshold)

    def run(batches):
        for batch in batches:
            alive = np.arange(len(batch))
            if len(batch):
                x, y = (loaded(batch.column(c).to_pylist())[1] for c in ("sig_a", "sig_b"))
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                alive = np.flatnonzero(np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9)
                hits = np.zeros(len(alive), np.int64)
                for i, m in enumerate(least):
                    cut = slice(i * STEP, (i + 1) * STEP)
                    hits += (x[alive, cut] == y[alive, cut]).sum(axis=1)
                    keep = hits >= m
                    alive, hits = alive[keep], hits[keep]
            yield batch.select(["a", "part_a", "b", "part_b"]).take(pa.array(alive))

    def side(c):
        return reps.select(F.col("id").alias(c), F.col("part").alias(f"part_{c}"), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))

    both = pairs.join(side("a"), ["a", "part_a"]).join(side("b"), ["b", "part_b"])
    return both.select("a", "part_a", "b", "part_b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, part_a long, b long, part_b long")


class Sets:
    """The full sets (id, part, members) of asked-for documents, computed once for each and kept in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int):
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.k, self.have = k, None

    def add(self, nodes: DataFrame) -> DataFrame:
        """The sets kept so far, with those of nodes (id)."""
        ids = nodes.select("id").distinct()
        if self.have is not None:
            ids = ids.join(self.have.select("id"), "id", "left_anti")
        ids = materialize(ids, "set-ids")
        k = self.k

        def run(batches):
            for batch in batches:
                for first, texts in wh.groups(batch.column(1)):
                    found = sets_of(texts, k)
                    parts = [part_of(digest_of(s)) if len(s) else None for s in found]
                    ids = batch.column(0).slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(parts, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "part", "members"])

        own = self.docs.join(small_side(ids, ids.count(), BROADCAST_IDS), "id", "left_semi").select("id", "text")
        new = own.mapInArrow(run, "id long, part long, members binary").where("part is not null")
        new = materialize(new, "sets")
        self.have = new if self.have is None else self.have.unionByName(new)
        return self.have


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with exact flag ok: den * intersection >= num * union."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    def side(c):
        return sets.select(F.col("id").alias(c), F.col("part").alias(f"part_{c}"), F.col("members").alias(f"set_{c}"))

    return pairs.join(side("a"), ["a", "part_a"]).join(side("b"), ["b", "part_b"]).select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, ok boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over links (a, b), for ids that have links. Each pass takes the least label among neighbours, then the label's label."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label").select("id", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("moved"))
        step = materialize(step, "labels")
        labels = step.select("id", "label")
        if not step.where("moved").head(1):
            return labels


def settle(members: dict, threshold: float, num: int, den: int, r: int, band: int, one: bool) -> list[tuple[int, int]]:
    """Links (indexes) that join components among the members of a bucket or of two blocks of one: verified, and no two join the same.

    members: arrays id, label, n, block, whole, sig and set (a function from an index to the sorted set).
    """
    labels, n, whole, sig, block = (members[c] for c in ("label", "n", "whole", "sig", "block"))
    comp = np.unique(labels, return_inverse=True)[1]
    exact, links, least, first = Overlap(members["set"], len(n)), [], least_matches(threshold), 2 * STEP
    for i in range(0, len(n), 256):
        rows = np.arange(i, min(i + 256, len(n)))
        fits = (comp[rows, None] != comp) & (np.minimum(n[rows, None], n) >= threshold * np.maximum(n[rows, None], n) - 1e-9)
        fits &= (rows[:, None] < np.arange(len(n))) if one else (block[rows, None] < block)
        if not fits.any():
            continue
        hits = np.zeros(fits.shape, np.uint8)
        for c in range(first):
            hits += sig[rows, c, None] == sig[None, :, c]
        x, y = np.nonzero(fits & (hits >= least[first // STEP - 1]))
        h = hits[x, y].astype(np.int64)
        x = rows[x]
        for s in range(first // STEP, len(least)):
            cut = slice(s * STEP, (s + 1) * STEP)
            h += (sig[x, cut] == sig[y, cut]).sum(axis=1)
            keep = h >= least[s]
            x, y, h = x[keep], y[keep], h[keep]
        # a pair belongs to the first band in which it agrees
        agree = (whole[x, : r * (PERMS // r)] == whole[y, : r * (PERMS // r)]).reshape(len(x), PERMS // r, r).all(axis=2)
        mine = agree.argmax(axis=1) == band
        x, y, h = x[mine], y[mine], h[mine]
        order = np.lexsort((y, -h, x))
        x, y = x[order], y[order]
        bounds = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else [0]
        for begin, end in zip(bounds[:-1], bounds[1:]):
            own, left, take = int(x[begin]), y[begin:end], 4
            while len(left := left[comp[left] != comp[own]]):
                now, left, take = left[:take], left[take:], take * 4
                both = exact.with_(own, now)
                for other in now[den * both >= num * (n[own] + n[now] - both)].tolist():
                    if comp[other] != comp[own]:
                        links.append((own, other))
                        comp[comp == comp[other]] = comp[own]
    return links


class Overlap:
    """Exact intersection sizes among some sets, whose values are numbered on the first call."""

    def __init__(self, get, n: int):
        self.get, self.n, self.local = get, n, None

    def with_(self, one: int, others: np.ndarray) -> np.ndarray:
        if self.local is None:
            sets = [self.get(i) for i in range(self.n)]
            self.at = np.cumsum([0, *map(len, sets)])
            values, self.local = np.unique(np.concatenate(sets), return_inverse=True)
            self.mark = np.zeros(len(values), bool)
        own = self.local[self.at[one] : self.at[one + 1]]
        self.mark[own] = True
        parts = [self.local[self.at[i] : self.at[i + 1]] for i in others.tolist()]
        found = np.add.reduceat(self.mark[np.concatenate(parts)].astype(np.int64), np.cumsum([0, *map(len, parts[:-1])]))
        self.mark[own] = False
        return found


def settled(rows: DataFrame, num: int, den: int, r: int) -> DataFrame:
    """Links (a, b) of rows (key, lo, hi, band, id, part, label, n, block, sig, members), a list for each (key, lo, hi)."""
    group = ["key", "lo", "hi"]

    def finish(parts):
        t = pa.Table.from_batches(parts)
        ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        if labels.min() == labels.max():
            return ids[:0], ids[:0]
        whole, sig = loaded(t.column("sig").to_pylist())
        sets = t.column("members").combine_chunks()
        sets = sets if isinstance(sets, pa.Array) else sets.chunk(0)
        own = {"label": labels, "n": t.column("n").to_numpy(), "block": t.column("block").to_numpy(), "whole": whole, "sig": sig, "set": lambda i: np.frombuffer(sets[i].as_buffer(), np.uint64)}
        found = settle(own, num / den, num, den, r, t.column("band")[0].as_py(), t.column("lo")[0].as_py() == t.column("hi")[0].as_py())
        return ids[[x for x, _ in found]], ids[[y for _, y in found]]

    def run(batches):
        parts, now = [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in group])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if parts and tuple(keys[a]) != now:
                    out.append(finish(parts))
                    parts = []
                now = tuple(keys[a])
                parts.append(batch.slice(a, b - a))
            if out:
                yield links_batch(out)
        if parts:
            yield links_batch([finish(parts)])

    def links_batch(out):
        a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def blocked(now: DataFrame) -> DataFrame:
    """Member rows (key, band, id, part, label, n) of buckets with several components, with block, and a copy for each list (lo, hi) it takes part in."""
    counts = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    facts = counts.groupBy("key").agg(F.max(F.struct("c", "w", "label")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("labels"))

    def need(c, w):
        return F.greatest(F.ceil(c / BLOCK), F.ceil(w * 8 / BLOCK_BYTES), F.lit(1)).cast("int")

    whole = need(F.col("c"), F.col("w"))
    split = whole > 1
    facts = facts.where("labels > 1").select(
        "key",
        F.when(split, F.col("top.label")).alias("main"),
        F.when(split, need(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w"))).otherwise(F.lit(1)).alias("n_out"),
        F.when(split, need(F.col("top.c"), F.col("top.w"))).otherwise(F.lit(0)).alias("n_main"),
    )
    rows = now.join(facts, "key")
    place = F.xxhash64("id")
    block = F.when(F.col("label") == F.col("main"), F.col("n_out") + F.pmod(place, F.col("n_main"))).otherwise(F.pmod(place, F.col("n_out"))).cast("int")
    # blocks of the largest component meet only those of the others
    others = F.sequence(F.lit(0), F.when(F.col("block") < F.col("n_out"), F.col("n_out") + F.col("n_main")).otherwise(F.col("n_out")) - 1)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(others))
    return rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "band", "id", "part", "label", "n", "block")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (smallest id reachable over similarity >= num/den), kept."""
    t = num / den
    feats = materialize(features(docs, id_col, text_col, k), "features")
    full = feats.where("n > 0 and id is not null")
    classes = materialize(full.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    # a row for each text; texts of one id are told apart by part, and are one node in labels
    reps = full.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").select("id", "part", "n", "sig")
    reps = materialize(reps.dropDuplicates(["id", "part"]), "reps")
    r = rows_per_band(t)
    keys = F.transform(F.sequence(F.lit(0), F.lit(PERMS // r - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * r) + 1, F.lit(4 * r))))
    bands = reps.select("id", "part", F.posexplode(keys).alias("band", "key"))
    node = F.struct("id", "part")
    big = bands.groupBy("key").agg(F.min(node).alias("pivot"), F.max(node).alias("top")).where("pivot < top").drop("top")
    # written out, so that both sides are dealt by key and a hot bucket can be split
    members = materialize(bands.join(materialize(big, "buckets"), "key"), "members")
    # what shares no bucket needs no signature from here on
    near = materialize(reps.join(members.select("id").distinct(), "id", "left_semi"), "near")
    pairs = members.where(node > F.col("pivot")).select(F.col("pivot.id").alias("a"), F.col("pivot.part").alias("part_a"), F.col("id").alias("b"), F.col("part").alias("part_b"))
    pairs = materialize(survivors(pairs.distinct(), near, t), "candidates")
    store = Sets(docs, id_col, text_col, k)
    labels = near.select("id", F.col("id").alias("label")).distinct()
    if pairs.head(1):
        links = verified(pairs, store.add(pairs.select(F.explode(F.array("a", "b")).alias("id"))), num, den).where("ok and a <> b").select("a", "b").distinct()
        labels = relabelled(labels, components(links))
    # buckets of several components; those of one are done
    now = members.select("key", "band", "id", "part").join(labels, "id").join(near.select("id", "part", "n"), ["id", "part"])
    now = materialize(blocked(now), "lists")
    if now.head(1):
        rows = now.join(near.select("id", "part", "sig"), ["id", "part"]).join(store.add(now.select("id")), ["id", "part"])
        more = materialize(settled(rows, num, den, r), "links")
        if more.head(1):
            # components of components: only the new links, between labels
            ends = more.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
            labels = relabelled(labels, components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()))
    dup = full.select("id", "n", "digest").join(classes, "digest").select("id", "n", "rep")
    named = dup.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", "n", F.coalesce("label", "rep").alias("component"))
    out = named.union(feats.where("n = 0 or id is null").select("id", "n", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (id, label) with each label replaced by its component's in found (id, label), where it has one."""
    new = found.select(F.col("id").alias("label"), F.col("label").alias("to"))
    return materialize(labels.join(new, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "node-labels")
