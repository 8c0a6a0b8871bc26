"""Filter audit, token alignment and SimHash against brute force, with odd inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers as tokenizers
import xxhash
from pyspark.sql import functions as F

from edgelight.llm import encoders, filter_audit, oracles, simhash
from edgelight.llm.alignment import align, pack, unpack

A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
LABELS = "doc_id long, quality int, toxic int, part string"
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "É"), (904, "x" * 30_000), (905, "🙂 " * 500), (906, "a▁b c"), (907, "  two  spaces  "), (908, "<|endoftext|> <s> <0x0A>"), (908, "same id")]


# filter audit


def test_walk_visits_every_order_once_by_single_swaps():
    for n in (1, 2, 3, 4, 5, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filter_audit.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def audit_brute(rows, labels):
    marks, first = {}, {}
    for i, q, t, _ in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = good or q == 1, toxic or t == 1
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in rows:
        own = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", own)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", own)) > 3 * len(own), "D": bool(re.search("[#$%&*|]", own)), "E": i is not None and first[own] < i}
        parts[lang or ""].append(({k for k, v in fails.items() if v}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part, docs in parts.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for s, f in enumerate(order):
                gone, kept = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                earlier = sum(f in d[0] for d in docs) - len(gone)
                out[part, order, s + 1] = [len(kept), len(gone), earlier, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                total[f] += len(gone)
                left = kept
        for order, s in itertools.product(map("".join, itertools.permutations("ABCDE")), range(5)):
            out[part, order, s + 1].append(total[order[s]])
    return out


def audit_rows():
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(("alpha", "Beta", "x#", "y", "z1")) if r.random() < 0.7 else f"w{r.randrange(10**6)}" for _ in range(r.choice((3, 150, 230, 400)))), r.choice(("en", "fr", None, ""))) for i in range(40)]
    rows += [(i + 100, rows[i % 5][1], "de") for i in range(20)] + [(None, rows[0][1], "en"), (7, rows[7][1], "en"), (3, rows[8][1], "en")]
    return rows + [(i, t, "odd") for i, t in ODD]


def test_filter_audit(spark):
    rows, r = audit_rows(), random.Random(4)
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1, None)), "clash") for i in [*range(30), *range(20), None, 110, 901]]
    docs = spark.createDataFrame([(*x, 5, "m") for x in rows], "doc_id long, text string, lang string, part int, mask string")
    marks = spark.createDataFrame(labels, LABELS)
    got = filter_audit.audit(docs, marks).collect()
    want = audit_brute(rows, labels)
    assert len(got) == len(want) == len({(x[2] or "") for x in rows}) * 600
    assert {tuple(g[:3]): list(g[3:]) for g in got} == want
    con = duckdb.connect()
    for name, frame in (("documents", docs), ("labels", marks)):
        con.register(name, frame.toArrow())
    columns = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {columns} FROM ({oracles.OP11})").fetchall())


def test_filter_audit_of_nothing_and_of_other_filters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, marks).collect() == []
    some = spark.createDataFrame([(1, "a b", "x"), (2, "a", "x"), (3, None, "x")], docs.schema)
    got = filter_audit.audit(some, marks, {"s": F.size("words") < 2, "b": F.col("text").contains("b")}, duplicate=None).collect()
    assert [tuple(g)[:7] for g in got] == [("x", "sb", 1, 1, 2, 0, 2), ("x", "sb", 2, 0, 1, 0, 1), ("x", "bs", 1, 2, 1, 0, 1), ("x", "bs", 2, 0, 2, 0, 2)]
    with pytest.raises(ValueError):
        filter_audit.audit(some, marks, {"long": F.lit(True)})


# token alignment


def strings(n=400, seed=5):
    r = random.Random(seed)
    signs = ["a", "the", "'s", "é", "Ω", "123", "한", "漢", "\n", "\t", " ", "  ", "   ", ".", ",", "🙂", " ", "　", "​", "́", "▁", "'", "ll", "\x1c", "\x85", "ﬁ", "½", "<s>", "᠎", "I'll"]
    return ["".join(r.choice(signs) + r.choice(("", " ", "")) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def test_units_encode_like_whole_texts():
    a, b = encoders.byte_bpe(A), encoders.piece_bpe(B)
    for t in [*strings(), *(t for _, t in ODD if t)]:
        own = encoders.units(t)
        assert " " + t == "".join(" " + u for u in own)
        assert [i for x in a([" " + u for u in own]) for i in x] == a([" " + t])[0], repr(t)
        assert [i for x in b(own) for i in x] == b([t])[0], repr(t)


def align_brute(rows):
    a, b = encoders.byte_bpe(A), encoders.piece_bpe(B)
    bytes_a, bytes_b = encoders.byte_bpe_bytes(A), encoders.piece_bpe_bytes(B)
    docs, count = [], Counter()
    for i, t in rows:
        x, y, links, groups = [], [], [], []
        if t:
            x, y = a([" " + t])[0], b([t])[0]
            if not b"".join(bytes_a[v] for v in x) == b"".join(bytes_b[v] for v in y) == (" " + t).encode():
                x, y = [], []
        ea, eb = list(itertools.accumulate(len(bytes_a[v]) for v in x)), list(itertools.accumulate(len(bytes_b[v]) for v in y))
        for p, v in enumerate(x):
            for q, w in enumerate(y):
                if ea[p] > eb[q] - len(bytes_b[w]) and eb[q] > ea[p] - len(bytes_a[v]):
                    links.append((v, w))
        low = 0
        for e in sorted(set(ea) & set(eb)):
            side = [",".join(str(v) for v, end in zip(ids, ends) if low < end <= e) for ids, ends in ((x, ea), (y, eb))]
            groups.append("|".join(side))
            low = e
        count.update(links)
        docs.append((i, x, y, links, groups))
    top = defaultdict(int)
    for (_, w), n in count.items():
        top[w] = max(top[w], n)
    return sorted((i, len(x), len(y), len(g), len(k), sum(count[p] == top[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, x, y, k, g in docs)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 300, "stripe_ids": 16000, "part_bytes": 500}])
def test_token_alignment(spark, sizes):
    rows = [(i, t) for i, t in enumerate(strings(80, 6))] + [(i, t[:3000] if t else t) for i, t in ODD]
    docs = spark.createDataFrame([(*x, 1, b"", 2) for x in rows], "doc_id long, text string, block int, body binary, stripe int").repartition(3)
    got = align(docs, A, B, **sizes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = align_brute(rows)
    assert sum(w[1] == 0 for w in want) >= 4
    assert sorted(map(tuple, got.collect())) == want


def test_token_alignment_of_nothing_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align(docs, A, B).collect() == []
    got = align(spark.createDataFrame([(None, "one two"), (None, None)], docs.schema), A, B).collect()
    assert sorted(g.n_a for g in got) == [0, 2] and all(g.doc_id is None for g in got)


def test_packed_columns_come_back():
    for own in ([np.array([3, 1]), np.array([70_000, 2]), np.array([1 << 40, 0])], [np.zeros(0, np.int64)] * 2):
        assert [x.tolist() for x in unpack(pack(*own))] == [x.tolist() for x in own]


# SimHash


def simhash_brute(rows, k=3, radius=3):
    prints = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        if (prints[x] ^ prints[y]).bit_count() <= radius:
            part[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted(((i, f"{p:016x}", least.get(root(x))) for x, ((i, _), p) in enumerate(zip(rows, prints))), key=str)


@pytest.mark.parametrize("tile_rows", [simhash.TILE, 2])
def test_simhash(spark, docs, tile_rows):
    r = random.Random(9)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(n)) for n in (1, 2, 3, 4, 60, 200, 500, 500)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = r.choice(base[4:]).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"w{r.randrange(500)}"
        rows.append((100 + i, "\t".join(w).upper()))
    rows += [(2, base[5]), (None, base[6]), (None, "alone here now"), *ODD]
    got = simhash.near_duplicates(docs(rows), tile_rows=tile_rows).collect()
    assert sorted(map(tuple, got), key=str) == simhash_brute(rows)
    # Spark's own function is the same hash
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).head()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_links_of_random_bits(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 64, 40, np.uint64)
    all_bits = [int(b) ^ sum(1 << int(x) for x in r.choice(64, r.integers(0, 6), replace=False)) for b in base for _ in range(12)]
    own = sorted({0, 1, 7, 15, 31, (1 << 64) - 1, *all_bits})
    want = {(a, b) for a, b in itertools.combinations(own, 2) if (a ^ b).bit_count() <= 3}
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in own], "fp long")

    def classes(pairs):
        part = {x: x for x in own}

        def root(x):
            while part[x] != x:
                x = part[x]
            return x

        for a, b in pairs:
            part[root(a)] = root(b)
        found = defaultdict(set)
        for x in own:
            found[root(x)].add(x)
        return sorted(map(sorted, found.values()))

    for tile_rows in (1 << 15, 3):
        got = [(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.similar(frame, tile_rows=tile_rows).collect()]
        assert classes(got) == classes(want)


def test_simhash_of_nothing_and_of_long_texts(spark, docs):
    assert simhash.near_duplicates(docs([])).collect() == []
    words = [f"w{i * 7919 % 1000}" for i in range(120_000)]
    whole = simhash.fingerprint(" ".join(words).encode())
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)], np.uint64)
    assert whole == int(sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)))
