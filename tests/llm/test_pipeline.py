import os
import random
import re
import threading

import duckdb
import numpy as np
import pytest
from test_text_ops import brute_components, brute_hits, brute_lines, text

import corpus_pipeline
from edgelight.llm import common, langid, oracles

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_stages_keep_columns_and_take_effect(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = common.materialize(stage(spark, docs, SF), f"test-{name}")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after <= before and after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("words > 0").count() > 0


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_give_the_rows_of_plain_versions(spark, docs, tmp_path):
    r = random.Random(13)
    sentences = lambda n: " ".join(text(r, 7).capitalize() + "." for _ in range(n))
    shared, item = sentences(12), text(r, 30)
    rows = [(i, sentences(r.randrange(3, 9)) + ("\n" + shared if i % 3 == 0 else "") + (f"\n{item}" if i % 7 == 0 else "")) for i in range(40)]
    rows += [(100 + i, " ".join(w + "x" if j == 5 else w for j, w in enumerate(t.split()))) for i, t in rows[:12]] + [(200, rows[3][1]), (201, rows[4][1])]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, own):
        return {x.doc_id: x.text for x in stages[name](spark, docs(own), str(tmp_path)).collect()}

    cut = dict(zip((i for i, _ in rows), brute_lines(rows)))
    after_lines = [(i, cut[i]) for i, t in rows if cut[i] != ""]
    assert stage("lines", rows) == dict(after_lines) and len(after_lines) < len(rows) and after_lines != rows
    # lines takes most of what near copies share, so the next stage gets the uncut rows here
    groups = brute_components(rows, 5, 80, 100)
    after_copies = [(i, t) for i, t in rows if groups[i][1] == i]
    assert stage("near_copies", rows) == dict(after_copies) and len(after_copies) < len(rows)
    hits = brute_hits(after_copies, [(1, item)])
    clean = [(i, t) for i, t in after_copies if not hits[i][1]]
    assert stage("benchmarks", after_copies) == dict(clean) and 0 < len(clean) < len(after_copies)


def plain_grams(t):
    """Counts of hashed n-grams, letter by letter."""
    m, seq = 0xFFFFFFFF, []
    for ch in (t or "").lower():
        if ch.isalpha():
            seq.append(ord(ch))
        elif seq and seq[-1] != 32:
            seq.append(32)
    if not seq:
        return None
    total = np.zeros(langid.DIMS)
    for i, c in enumerate(seq):
        h = c * 0x9E3779B1 & m
        found = [h]
        if i + 1 < len(seq):
            h = (h ^ (seq[i + 1] * 0x85EBCA77 & m)) * 0xC2B2AE3D & m
            found.append(h)
        if i + 2 < len(seq):
            found.append((h ^ (seq[i + 2] * 0x27D4EB2F & m)) * 0x165667B1 & m)
        for h in found:
            total[((h ^ (h >> 15)) * 0x2C1B3C6D & m) >> 20] += 1
    return total


def plain_language(t, model):
    """(language, rejected) by the largest cosine."""
    g = plain_grams(t)
    if g is None:
        return "und", True
    v = np.log1p(g) * model.idf
    near = model.centroids @ (v / np.linalg.norm(v))
    best = int(np.argmax(near))
    return model.langs[best], bool(near[best] < model.floors[best] * min(1.0, (g.sum() / langid.FULL) ** 0.5))


def test_grams_over_piece_borders(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("abé -,Ω1") for _ in range(r.randrange(1, 200))) for _ in range(50)] + ["", "1", "-a", "a-"]
    for piece in (1, 2, 7, 1 << 18):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t in texts:
            got, want = langid.grams(t), plain_grams(t)
            assert (got is None and want is None) or (got == want).all()


def mixed_rows(rows):
    """(id, words, text) of each draw, from the SQL of the mix."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    texts, out = {i: t for i, t, _ in rows}, []
    for i, size, _, _, taken in con.execute(oracles.OP7).fetchall():
        while taken > 0:
            n = min(taken, size)
            out.append((i, n, texts[i] if n == size else " ".join(re.findall(r"[^\x20\x09-\x0D]+", texts[i])[:n])))
            taken -= n
    return sorted(out)


def test_run_gives_the_rows_of_plain_stages(spark, tmp_path):
    r = random.Random(17)
    sentences = lambda n, w: " ".join(text(r, 9).replace("w", w) + "." for _ in range(n))
    item = text(r, 30)
    rows = [(i, sentences(r.randrange(4, 9), "ab" if i % 2 else "éc") + (f" {item}" if i % 9 == 0 else ""), "aa" if i % 2 else "bb", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[3][1], "aa", "s0"), (101, None, None, None), (102, "... 12", "aa", "s1"), (103, "ω" * 40, "zz", "s2")]
    # two long documents with an edit, in long lines that are no repeats
    long = " ".join(f"xb{r.randrange(9999)}b" for _ in range(300)).split()
    rows += [(110, " ".join(long), "aa", "s0"), (111, " ".join([*long[:150], "edit", *long[151:]]), "aa", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")
    model = langid.fit(docs.where(~langid.held_out()).select("text", "lang"))
    kept = [x for x in rows if not plain_language(x[1], model)[1]]
    assert {x.doc_id: (x.lang_pred, x.rejected) for x in langid.predict(docs, model).collect()} == {x[0]: plain_language(x[1], model) for x in rows}
    assert {101, 102} <= {x[0] for x in rows} - {x[0] for x in kept}
    cut = [(x[0], t, x[3]) for x, t in zip(kept, brute_lines([x[:2] for x in kept])) if t]
    groups = brute_components([x[:2] for x in cut], 5, 80, 100)
    cut = [x for x in cut if groups[x[0]][1] == x[0]]
    hits = brute_hits([x[:2] for x in cut], [(1, item)])
    cut = [x for x in cut if not hits[x[0]][1]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.words, x.text) for x in got) == mixed_rows(cut)
    assert {100, 0} <= {x[0] for x in rows} - {x[0] for x in cut}
    assert 0 <= min(x.shard for x in got) <= max(x.shard for x in got) < 8


CLASHES = ("score", "words", "shard", "copy", "order_key", "decon", "rejected", "lang_pred", "n_removed", "chars_removed", "size", "target", "taken", "draws", "key", "row", "gone", "own_5", "id", "Kept")


def test_columns_that_clash_keep_their_values(spark, docs, tmp_path):
    rows = [(i, f"Own words of the document number {i} stand here alone. " + text(random.Random(i), 30, 9999), "s") for i in range(12)] + [(None, "A text without an id of its own. More of it.", "s")]
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = docs(rows).selectExpr("*", *(f"'{c} own' as {c}" for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, df, str(tmp_path)), f"clash-{name}")
        assert out.columns[: len(df.columns)] == df.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        assert out.count() >= 10 and all(x[c] == f"{c} own" for x in out.select(*CLASHES).collect() for c in CLASHES)
    assert all(isinstance(x.words_, int) and isinstance(x.shard_, int) for x in out.collect())


def test_scratch_of_threads_is_apart(spark):
    mine = common.scratch_path(spark, "mine")
    seen = []
    t = threading.Thread(target=lambda: (common.scratch_path(spark, "other"), common.release_scratch(spark), seen.append(common.scratch_mark())))
    t.start()
    t.join()
    assert mine in common._scratch() and seen == [1]
