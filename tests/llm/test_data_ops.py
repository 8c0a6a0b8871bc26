"""Token counts, URL rules, nearest neighbours, WARC bundles, mixing and PII against plain versions, with odd inputs."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgelight.llm import common, mixing, pii, token_counts, url_rules, vptree, warc
from edgelight.llm.common import materialize, scratch_path

tokenizers = pytest.importorskip("public_tokenizers")


def test_token_counts_are_the_librarys(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = [None, "", "hello  world\n\n x", "it's <|endoftext|> é“quoted” 漢字 🙂 ١٢", "a" * 50_000, "ab" * 10, "ab" * 10, "\u200b\u0378 ǅ ⅷ"]
    texts += [" " * 1_000_000, "\n " * 300_000, "#" * 200_000, "x " * 100_000, "1" * 100_000, "é" * 50_000]
    df = docs(list(enumerate(texts)))
    cache = "file://" + str(tmp_path / "cache")
    for _ in range(2):  # the second run finds all in the cache
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, path, cache=cache).collect()}
        assert got == {i: (len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    other = spark.read.parquet(cache).selectExpr("content", "'another' tokenizer", "n_tokens + 1 n_tokens")
    other.write.mode("append").parquet(cache)  # another tokenizer's counts are not this one's
    assert token_counts.count_tokens(df, path, cache=cache).where("doc_id = 2").head().n_tokens == len(own.encode(texts[2], add_special_tokens=False).ids)
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_counts_by_units_are_those_of_whole_texts():
    """On random strings of every character up to U+024F and others, of words, numbers, signs and white space, and on whole documents."""
    from tokenizers import Tokenizer

    path, r, texts = tokenizers.path("byte_bpe_50k.json"), random.Random(0), []
    own = Tokenizer.from_file(path)
    signs = [*map(chr, range(0x250)), *map(chr, range(0x2000, 0x2070)), " ", " ", "\u3000", "\u180e", "\ufeff", "\u2581", "\u0378"]
    parts = ["the", "The", " token", "'s", "'LL", "don't", "\n", "\r\n", "\t", "   ", "  \n ", "\x85", "\xa0", "42", "3.14", "<|endoftext|>", "<|endof", " <|endoftext|> ", "é", "ß", "ǅ", "“", "–", "...", "==", "#!", "_", "\x00", "\x1c", "²", "½", "ª", " "]
    for _ in range(1500):
        texts += ["".join(r.choice(signs) + r.choice(("", " ")) for _ in range(r.randrange(60))), "".join(r.choice(parts) for _ in range(r.randrange(40)))]
    texts += ["x" + run * n + "y" for n in (998, 1001, 5000) for run in (" ", "\n", "\n ", "a", "é", "#", "7", "a ", "\xa0", "\xa0 ")]
    if os.path.isdir("/root/testdata/sf0.01"):
        import pyarrow.parquet as pq

        texts += [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    assert token_counts.counts_of(path, texts).tolist() == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


def test_url_rules(spark):
    urls = ["https://www.example.com/en/x", "http://m.example.com/en/y?q#f", "http://EXAMPLE.com/fr", "http://a.net/es/1", "http://net/fr/", "http://a.org/en", None, "nothing", "x://", "http://b.org?x://y/", "http://notexample.com/en/", "ftp://com#/en/"]
    urls += [f"http://{'casino' if i % 2 else 'news'}.site{i % 7}.org/p/{i}" for i in range(80)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'z' rule2")
    labels = spark.createDataFrame([(i, 1, int("casino" in (u or ""))) for i, u in enumerate(urls)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(pages, labels, min_support=0.05)
    out = {r.page_id: r for r in url_rules.judge(pages, rules).collect()}
    want = {0: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 1: ("m.example.com", "/en/y", "example.com/en/", "block"), 2: ("example.com", "/fr", "com/", "allow"), 3: ("a.net", "/es/1", "net/es/", "block"), 4: ("net", "/fr/", "net/fr/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("b.org", "", None, "allow"), 10: ("notexample.com", "/en/", "com/", "allow"), 11: ("com", "", None, "allow")}
    for i, w in want.items():
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == w, urls[i]
    assert all(out[i].verdict == ("block" if "casino" in urls[i] else "allow") for i in range(12, len(urls)))
    assert all(r["classes"] and r["confidence"] >= url_rules.MIN_CONFIDENCE for r in rules)
    assert url_rules.mine(pages.limit(0), labels) == [] and url_rules.mine(pages, labels.limit(0)) == []


def test_mined_rules_match_all_token_sets(spark):
    r = random.Random(7)
    urls = [f"http://{r.choice('abc')}.{r.choice('xyz')}.org/{r.choice('pq')}/{i}" for i in range(120)]
    bad = [("a." in u and "/p/" in u) or r.random() < 0.1 for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(pages, labels, min_support=0.05, min_confidence=0.5, vocabulary=30)
    every = url_rules.all_rules([(url_rules.url_tokens(u), b) for u, b in zip(urls, bad)], 0.05, 0.5)
    spelt = url_rules.written(rules)
    assert all(every[k] == pytest.approx(c) for k, c in spelt.items())
    for own, conf in every.items():  # each rule is kept or covered by a shorter one at least as confident
        assert any(k <= own and c >= conf - 1e-12 for k, c in spelt.items())


def test_url_rules_of_many_hosts_are_those_of_all_token_sets(spark):
    r = random.Random(11)
    hosts = [f"www.{w}{i}.{'com' if i % 3 else 'net'}" for i in range(24) for w in ("farm", "good")]
    urls = [f"http://{h}/{r.choice('pq')}/{j}" for h in hosts for j in range(8)]
    bad = ["farm" in u for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(pages, labels, min_support=0.005)
    assert all(x.verdict == ("block" if "farm" in x.url else "allow") for x in url_rules.judge(pages, rules).where("rule is null").collect())
    every = url_rules.all_rules([(url_rules.url_tokens(u), b) for u, b in zip(urls, bad)], 5 / len(urls), url_rules.MIN_CONFIDENCE)
    want = {own: c for own, c in every.items() if not any(k < own and every[k] >= c for k in map(frozenset, (x for i in range(1, len(own)) for x in itertools.combinations(own, i))) if k in every)}
    assert url_rules.written(rules) == want and len(rules) < len(want)


def test_url_rules_keep_columns_and_take_long_urls(spark):
    long = "http://" + ".".join(f"l{i}" for i in range(200_000)) + ".farm.biz/x"
    assert sum(map(len, url_rules.url_tokens(long))) < 30 * len(long)
    rows = [(1, "http://a.farm.biz/x", "m", "h", "v", 0.5), (1, "http://a.farm.biz/x", "m", "h", "v", 0.5), (2, long, "m", "h", "v", 0.5), (3, None, None, None, None, None), (4, "http://x.net/es/1", "m", "h", "v", 0.5)]
    rows += [(10 + i, f"http://s{i}.farm.biz/x", "m", "h", "v", 0.5) for i in range(20)] + [(40 + i, f"http://s{i}.good.biz/x", "m", "h", "v", 0.5) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, mined string, host string, Verdict string, confidence double")
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in [*range(10, 30), *range(40, 60)]], "doc_id long, quality int, toxic int")
    out = url_rules.judge(pages, url_rules.mine(pages, labels))
    assert out.columns[:6] == pages.columns and out.columns[6:] == ["host_", "path", "rule", "verdict_", "mined_rule", "confidence_"]
    got = out.collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, rows))
    assert [r.verdict_ for r in got if r.page_id in (1, 2)] == ["block"] * 3 and {r.verdict_ for r in got if r.page_id >= 40} == {"allow"}
    assert [(r.rule, r.verdict_) for r in got if r.page_id == 4] == [("net/es/", "block")] and [r.verdict_ for r in got if r.page_id == 3] == ["allow"]
    # rules that tie in confidence and support: the last by name speaks, always the same
    assert {r.mined_rule for r in got if r.page_id == 1} == {max(" ".join(sorted(n)) for n in url_rules.written(url_rules.mine(pages, labels)) if n <= url_rules.url_tokens("http://a.farm.biz/x"))}


def test_nearest_is_exact_at_factor_one_and_good_below(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(900, 8)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(900)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, 2.0]), (2001, [3.0, 1.0]), (2080, [None] * 8), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = vptree.usable(df, "vec_id", "embedding")
    trees = vptree.index(fine, shard_rows=300, leaf=20)
    queries = fine.where(F.col("id") % 20 == 0)
    exact = {}
    for q in range(0, 900, 20):
        s = v.astype(float) @ v[q].astype(float)
        exact[q] = sorted((i for i in range(900) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
    got = {}
    for r in vptree.search(trees, queries, 20, 1.0, block=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.pop(2060) == [2001]
    assert got == exact
    near = {}
    for r in vptree.search(trees, queries, 20, 0.7).collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(near[q] & set(exact[q])) / 20 for q in exact])
    assert recall >= 0.9
    assert vptree.nearest(df.limit(0)).count() == 0


def test_nearest_takes_every_finite_vector(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** int(rng.choice((-300, -200, -5, 0, 5, 151, 160, 300)))]) for i in range(240)]
    rows += [(300, [1.0, 0.0, 0.0, 0.0]), (301, [1e151, 0.0, 0.0, 0.0]), (302, [2.0, 0.0, 0.0, 0.0]), (303, [1e200, -1e200, 0.0, 0.0]), (320, [1e200, 1e200, 0.0, 0.0]), (304, [5e-324] * 4), (305, [1.7e308] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = {i: [Fraction(x) for x in v] for i, v in rows}
    limit = Fraction(np.finfo(np.float64).max)
    got = {}
    for r in vptree.search(vptree.index(vptree.usable(df, "vec_id", "embedding"), shard_rows=60, leaf=5), vptree.usable(df.where("vec_id % 20 = 0"), "vec_id", "embedding"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in [*range(0, 240, 20), 300, 320]:
        score = {i: sum(a * b for a, b in zip(own[q], v)) for i, v in own.items() if i != q}
        # products as doubles hold them: beyond the largest they are equal, under the least they are zero
        score = {i: max(-limit, min(limit, s)) if abs(s) > Fraction(1, 10**300) else Fraction(0) for i, s in score.items()}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        found = [i for _, i, _ in sorted(got[q])]
        assert len(found) == 20
        close = [abs(score[a] - score[b]) <= abs(score[b]) * Fraction(1, 10**12) for a, b in zip(found, want)]
        assert all(close), (q, found, want)
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1e151, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vptree.nearest(few).orderBy("rank").collect()] == [(20, 1, 1, 1e151), (20, 2, 2, 2.0)]


def test_nearest_of_a_repeated_id_asks_with_the_least_vector(spark):
    df = spark.createDataFrame([(20, [2.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vptree.nearest(df).orderBy("rank").collect()] == [2, 1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are absent")
def test_recall_on_embeddings_below_factor_one(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = [{(r.query_id, r.vec_id) for r in vptree.nearest(df, factor=f).collect()} for f in (1.0, 0.8)]
    assert len(found[0] & found[1]) / len(found[0]) >= 0.9


def test_scratch_without_a_configured_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    folder = common.shared_dir(spark)
    assert folder.startswith("file:///") and common.shared_dir(spark) == folder


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "<p>é</p>\r\n\r\nWARC/1.1", "x" * 300_000, "x" * 300_000, "y"]
    rows = [(i, None if i == 7 else f"http://a/{i}\r\nX: 1", h) for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    stored = materialize(warc.write_bundles(df, folder, frame_bytes=1000, bundle_bytes=100_000), "warc-index")
    index = stored.collect()
    last = {}
    for i, h in enumerate(html):
        last[h or ""] = i
    warc.write_bundles(df, folder).collect()  # a second attempt's bundles are in no index
    back = warc.read_bundles(stored, folder).collect()
    got = {r.record_id: r for r in back}
    assert len(back) == len(got) == len(html)
    for i, h in enumerate(html):
        r, body = got[i], (h or "").encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.payload_bytes == len(body)
        assert (r.record_type, r.refers_to) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert bytes(r.payload) == (body if r.record_type == "response" else b"")
    for e in index:
        head, body = warc.read_record(folder, e.bundle, e.frame, e.offset)
        assert warc.number(head["WARC-Record-ID"]) == e.record_id
    assert warc.write_bundles(df.limit(0), scratch_path(spark, "warc-none")).count() == 0


def test_warc_rows_that_share_an_id_keep_their_own_payloads(spark):
    rows = [(1, "copied"), (1, "alone"), (1, "again"), (2, "copied"), (3, "again")]
    folder = scratch_path(spark, "warc-ids")
    index = materialize(warc.write_bundles(spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string"), folder), "warc-index")
    got = sorted((r.record_id, r.record_type, r.refers_to or 0, bytes(r.payload).decode()) for r in warc.read_bundles(index, folder).collect())
    assert got == [(1, "response", 0, "alone"), (1, "revisit", 2, ""), (1, "revisit", 3, ""), (2, "response", 0, "copied"), (3, "response", 0, "again")]


def fill(sizes, share=1.5, limit=2.0):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, full, total = set(names), {}, share * sum(sizes.values())
    while True:
        level = (total - sum(full.values())) / sum(w[n] for n in left) if left else 0
        over = [n for n in left if level * w[n] >= limit * sizes[n]]
        if not over:
            return {n: full.get(n, level * w[n]) for n in names}
        for n in over:
            full[n] = limit * sizes[n]
            left.discard(n)


def test_mix_targets_quotas_and_shards(spark, docs):
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.randrange(0, 60))), r.choice(["a", "b", "c", "d", None] + ["hot"] * 5)) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "empty"), (5, "again again", "b"), (5, "again again", "b")]
    df = docs(rows)
    out = mixing.mix(df, keep=True).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken, slots = fill(sizes), {}, {}
    for x in out:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and x.taken <= 2 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        for d in x.draws:
            slots[d.shard] = slots.get(d.shard, 0) + 1
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert sorted(slots) == list(range(8))
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    drawn = mixing.drawn(mixing.mix(df, keep=True)).collect()
    assert all(len(x.text.split()) == x.words for x in drawn) and sum(x.words for x in drawn) == sum(taken.values())
    assert mixing.mix(df.limit(0)).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    got = mixing.split(spark.createDataFrame([(1, 5000), (2, 37), (3, 0)], "sid int, n long"), 4).collect()
    per = {}
    for r in got:
        per[r.sid] = per.get(r.sid, 0) + r.n
    leaf = {}
    for r in got:
        leaf[r.node] = leaf.get(r.node, 0) + r.n
    assert per == {1: 5000, 2: 37, 3: 0}
    assert max(leaf.values()) - min(leaf.values()) <= 2
    assert all(abs(r.n - per[r.sid] / 4) < 5 * math.sqrt(per[r.sid] / 4 + 1) for r in got)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_pii_base_spans_are_the_patterns(docs):
    r = random.Random(9)
    alphabet = ["a", "Z", "9", "4", "0", "1", "@", ".", "-", "+", " ", "(", ")", "_", "é", "🙂", "\n", "a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(120)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a@b.cc_x@d.ee a@b.c@d.e"), (1003, "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255"), (1004, "a" * 50_000 + "@"), (1005, "4 " * 20_000), (1006, "x@" + "a." * 20_000 + "b"), (1007, "1.1.1.1 " * 3000), (1008, "+" * 2000 + "1" * 20_000)]
    got = {x.doc_id: [tuple(s) for s in x.base] for x in pii.detect(docs(rows)).collect()}
    for i, t in rows:
        assert got[i] == brute_spans(t), (i, (t or "")[:80])


def test_pii_model_adds_without_touching_base(docs):
    r = random.Random(10)
    rows = []
    for i in range(300):
        secret = "".join(r.choice("0123456789abcdef") for _ in range(24))
        rows.append((i, f"text {r.choice(['password=', 'token = '])}{secret} and {r.choice(['v1.2', '2020-01-02', '+1 (555) 123-4567', '10.0.0.1', 'token of thanks', 'key: value12'])} end"))
    df = docs([*rows, (999, None)])
    out = {x.doc_id: x for x in pii.detect(df, model=pii.train(df)).collect()}
    assert all([tuple(s) for s in out[i].base] == brute_spans(t) for i, t in rows)
    added = [(t, s) for i, t in rows for s in out[i].added]
    assert sum(s.kind == "secret" for _, s in added) > 250
    assert all("password" in t[s.start : s.end] or "token" in t[s.start : s.end] for t, s in added if s.kind == "secret")
    assert pii.train(df.limit(0)) is None and pii.detect(df.limit(0)).count() == 0
    clean = pii.redact(df, model=pii.train(df)).where("text like '%password=%'").count()
    assert clean <= 5


def test_pii_model_comes_from_every_candidate(docs, monkeypatch):
    stored, kept = {}, pii.materialize

    def materialize(df, label, **options):
        stored[label] = kept(df, label, **options)
        return stored[label]

    monkeypatch.setattr(pii, "materialize", materialize)
    rows = [(i, f"{('phone', 'part')[i % 2]} {2_000_000 + i} end") for i in range(9000)]
    df = docs([*rows, *((9000 + i, rows[i % 3][1]) for i in range(500)), (9999, None)])
    model = pii.train(df)
    for seen in stored.values():
        sums = seen.selectExpr("sum(n)" if "n" in seen.columns else "count(1)", "sum(label * n)" if "n" in seen.columns else "sum(label)").first()
        assert tuple(sums) == (9000, 4500)  # copies count once
    out = {x.doc_id: [s.kind for s in x.added] for x in pii.detect(df, model=model).collect()}
    assert all(out[i] == ["number"] * (i % 2 == 0) for i, _ in rows)


def test_pii_every_generator_adds_spans_beyond_the_base(docs):
    r = random.Random(12)
    word = lambda n=7: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rows, planted = [], {}
    for i in range(600):
        mail = f"{word()}{r.choice(['(at)', ' (at) ', ' [at] '])}{word()}{r.choice(['(dot)', ' [dot] ', '.'])}{r.choice(['com', 'org', 'de'])}"
        phone = r.choice([f"({r.randrange(200, 999)}) {num(3)}-{num(4)}", f"{r.randrange(200, 999)}-{num(3)}-{num(4)}", f"020 {num(4)} {num(4)}"])
        secret = f"password={word(5).upper()}{num(4)}{word(5)}"
        other = r.choice([f"2{num(3)}-0{r.randrange(1, 9)}-1{num(1)}", f"v{num(1)}.{num(2)}", f"{word()} @ {word()}. {word().capitalize()}", f"{num(3)} {num(2)}", "token: something", f"{word()}@{word()}.com", "10.0.0.1"])
        planted[i] = (mail, phone, secret)
        rows.append((i, f"Please write {mail} today. The phone is {phone} and {secret} then {other} end"))
    df = docs(rows)
    out = {x.doc_id: x for x in pii.detect(df, model=pii.train(df)).collect()}
    hits, wrong = [0, 0, 0], 0
    for i, t in rows:
        assert [tuple(s) for s in out[i].base] == brute_spans(t)
        added = {(s.kind, t[s.start : s.end]) for s in out[i].added}
        want = set(zip(("contact", "number", "secret"), planted[i]))
        for g, w in enumerate(zip(("contact", "number", "secret"), planted[i])):
            hits[g] += w in added
        wrong += len(added - want)
    assert min(hits) >= 540 and wrong <= 30, (hits, wrong)
