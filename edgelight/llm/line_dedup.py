"""Line dedup by content-defined chunks of lines. DataFrame functions only.

A text is cut into lines: at line feeds, after sentence ends before a space, and inside long
sentences where the two letters before a space both belong to CLASS, so that a line has about seven words also where
nothing else ends it. CLASS is of Latin, Greek, Cyrillic, Hebrew and Arabic letters; after a word of any other script (OTHER), and
after every character of scripts without spaces (UNSPACED), a line ends where a hash of what stands between two such places hits, one in
four: about four words or characters. Lines keep their separators, so joined lines are the text. Every line has a hash (of the line
without its separator), and a rolling hash covers it and its neighbour. A chunk starts at a line where the rolling hash of
the chunk's first two lines hits, and ends at the first place, MIN_LINES lines on or more, where another rolling hash of
its last two lines hits (MAX_LINES at most); physical lines start and end chunks, too. So a chunk is told by its own lines
alone: a passage is cut alike wherever it stands, from about half a line after its beginning to half a line before its
end. Chunks overlap. A whole text of several lines is a chunk as well. Chunks of at least `min_words` words that occur
more than once are repeats: the first occurrence (smallest id, then place) stays, and the lines of all others go. Every
line that goes has an equal one at a smaller place, so the first of equal passages is whole.

Repeats are proposed by hash and decided on bytes: of the chunks with one hash, the least and the greatest text are found,
pre-aggregated, so a chunk with a third of all occurrences costs one row per task. If the two are the same bytes, all are;
if not, the chunks of that hash are grouped by their texts. Texts are cut once and stored as lines with a row number, so
no id, null or repeated, gathers texts. Where the repeated hashes are more than BROADCAST_ROWS, documents are joined with
their repeated chunks by row number, and lines are shuffled once for it.

Defined results: null text stays null, without lines; a text may become empty; rows that share an id are ordered by a
digest of their texts, and rows that share both are the same place, cut alike; a null id comes after all others. The
separator of a chunk's last line plays no part in comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelight.llm.common import materialize, small_side

#: Every fourth letter of some alphabets, odd digits, and ranges of others: short, since the matcher tries them one by one
CLASS = "".join(chr(c) for a, b in ((0x61, 0x7B), (0xE0, 0x100)) for c in range(a + 1, b, 4)) + "13579Ā-Šα-θа-иא-זا-خ"
#: Characters of all other scripts than those of CLASS; and of scripts that put no spaces between words: Thai and Lao, Burmese, Khmer, Chinese and Japanese with signs and wide forms
OTHER = "\u0530-\u058F\u0700-\u1DFF\u2C00-\U0010FFFF"
UNSPACED = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\uFE30-\uFE4F\uFF00-\uFFEF\U00020000-\U0003FFFD"
ENDS = rf"\n|[.!?] |[{CLASS}][{CLASS}] "
#: Where a line ends or may end; the first lookbehind only keeps the search fast
SEPARATOR = rf"(?<=[\n {UNSPACED}])(?<={ENDS}|[{OTHER}] |[{UNSPACED}])"
WORD = rf"[^\x20\x09-\x0D{UNSPACED}]+|[{UNSPACED}]"
MIN_WORDS = 10
MIN_LINES, MAX_LINES = 3, 8
BROADCAST_ROWS = 1_000_000
LAST = (1 << 63) - 1
RANGES = "array<struct<pos:int,end:int>>"
CHUNKS = "array<struct<pos:int,n:int,hash:bigint>>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambda variables are bound, not copied into the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    cut = lambda separator: F.filter(F.split(text, separator, -1), lambda x: x != "")

    def joined(own: Column) -> Column:
        n = F.size(own)
        hit = lambda x: (F.ascii(x) * 7 + F.ascii(F.substring(x, 2, 1)) * 3 + F.length(x) * 5) % 4 < 1
        ends = F.array_compact(F.transform(own, lambda x, i: F.when((i == n - 1) | x.rlike(f"({ENDS})$") | hit(x), i)))
        piece = lambda e: F.transform(e, lambda at, k: let(F.when(k > 0, F.get(e, k - 1) + 1).otherwise(0), lambda first: F.array_join(F.slice(own, first + 1, at - first + 1), "")))
        return let(ends, piece)

    # UNSPACED is part of OTHER: where no such character is, the letters' rule is all there is
    return F.when(text.rlike(f"[{OTHER}]"), let(cut(SEPARATOR), joined)).otherwise(cut(rf"(?<=[\n ])(?<={ENDS})"))


def bare(line: Column) -> Column:
    """A line without its separator."""
    return F.rtrim(line, F.lit(" \n"))


def chunks(lines: Column) -> Column:
    """Array of (pos, n, hash) of the chunks of a text's lines: first line, number of lines, hash. The last one is the whole text."""

    def cut(own: Column) -> Column:
        h, feeds = F.transform(own, lambda x: F.ascii(F.md5(bare(x)))), F.transform(own, lambda x: x.endswith("\n"))
        return F.when(F.size(own) > 1, let(h, lambda h: let(feeds, lambda f: placed(own, h, f)))).otherwise(F.array().cast(CHUNKS))

    def placed(own: Column, h: Column, feed: Column) -> Column:
        n = F.size(own)
        every = F.sequence(F.lit(0), n - 1)
        starts = F.filter(F.sequence(F.lit(0), n - 2), lambda i: ((F.get(h, i) * 7 + F.get(h, i + 1) * 3) % 10 < 9) | (i == 0) | F.get(feed, i - 1))
        # by the last line of a chunk: whether it may end there
        ends = F.transform(every, lambda i: ((F.get(h, i - 1) * 3 + F.get(h, i) * 7) % 11 < 10) | (i == n - 1) | F.get(feed, i))
        pieces = lambda e: F.transform(F.filter(starts, lambda i: i + MIN_LINES <= n), lambda i: piece(own, e, i, n))
        return F.concat(let(ends, pieces), F.array(named(own, F.lit(0), n)))

    def piece(own: Column, e: Column, i: Column, n: Column) -> Column:
        size = F.when(F.get(e, i + MIN_LINES - 1), F.lit(MIN_LINES))
        for k in range(MIN_LINES + 1, MAX_LINES):
            size = size.when(F.get(e, i + k - 1), F.lit(k))
        return let(size.otherwise(F.least(F.lit(MAX_LINES), n - i)), lambda k: named(own, i, k))

    def named(own: Column, i: Column, k: Column) -> Column:
        body = F.xxhash64(F.slice(own, i + 1, k - 1), bare(F.get(own, i + k - 1)))
        return F.struct(i.cast("int").alias("pos"), k.cast("int").alias("n"), body.alias("hash"))

    return cut(lines)


def n_words(text: Column) -> Column:
    """Words, each character of a script without spaces as one."""
    return F.regexp_count(text, F.lit(WORD))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text_col cut. Two columns follow, n_removed (lines) and chars_removed; their names get underscores while docs has such a column."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("key")
    text = F.col(text_col)
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("digest")
    rest = docs.drop(text_col)
    # once: the row number is stored with what it names
    cut = docs.select(F.struct(*rest.columns).alias("doc") if rest.columns else F.lit(None).alias("doc"), key, digest, lines(text).alias("lines"))
    cut = cut.withColumn("chunks", F.coalesce(chunks(F.col("lines")), F.array())).withColumn("row", F.monotonically_increasing_id())
    cut = materialize(cut, "cut", compression="zstd")
    every = cut.select("row", "key", "digest", F.explode("chunks").alias("c")).select("row", "key", "digest", "c.*")
    twice = materialize(every.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
    place = F.struct("key", "digest", "pos")

    def bodies(hashes: DataFrame) -> DataFrame:
        """(key, digest, row, pos, n, hash, body) of the chunks with these hashes."""
        if (n := hashes.count()) <= BROADCAST_ROWS:
            rows = cut.select("row", "key", "digest", "lines", F.explode("chunks").alias("c")).withColumn("hash", F.col("c.hash")).join(F.broadcast(hashes), "hash", "left_semi")
        else:
            hits = every.join(hashes, "hash", "left_semi").groupBy("row").agg(F.collect_list(F.struct("pos", "n", "hash")).alias("hits"))  # bounded by the document
            rows = cut.select("row", "key", "digest", "lines").join(materialize(hits, "hits"), "row").select("row", "key", "digest", "lines", F.explode("hits").alias("c"))
        return rows.select("row", "key", "digest", "c.*", body_of(F.col("lines"), F.col("c")).alias("body"))

    found = bodies(twice).groupBy("hash").agg(F.min("body").alias("body"), F.max("body").alias("most"), F.min(place).alias("first"), F.max(place).alias("final"))
    found = materialize(found.where((n_words(F.col("body")) >= min_words) & (F.col("first") < F.col("final")) | (F.col("body") != F.col("most"))), "repeats")
    alike = materialize(found.where("body = most").select("hash", "first"), "alike")
    marks = every.join(small_side(alike, alike.count(), BROADCAST_ROWS), "hash").where(place > F.col("first")).select("row", "pos", "n")
    other = found.where("body <> most").select("hash")
    if other.head(1):
        mixed = materialize(bodies(other).where(n_words(F.col("body")) >= min_words), "mixed")
        first = mixed.groupBy("body").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first < final").select("body", "first")
        marks = marks.unionByName(mixed.join(materialize(first, "first"), "body").where(place > F.col("first")).select("row", "pos", "n"))
    gone = marks.groupBy("row").agg(F.collect_list(F.struct("pos", (F.col("pos") + F.col("n")).alias("end"))).alias("gone"))  # bounded by the document
    gone = materialize(gone.select("row", merged(F.col("gone")).alias("gone")), "gone")
    n_gone = gone.agg(F.sum(F.size("gone"))).head()[0] or 0
    own = cut.drop("chunks").join(F.broadcast(gone) if n_gone <= BROADCAST_ROWS else gone.hint("merge"), "row", "left")
    whole = F.array_join("lines", "")
    own = own.withColumn("result", F.when(F.col("gone").isNotNull(), without(F.col("lines"), F.col("gone"))))
    left = F.coalesce(F.col("result.text"), whole)
    names, added = [], {"n_removed": F.coalesce("result.n", F.lit(0)).cast("long"), "chars_removed": F.coalesce(F.length(whole) - F.length("result.text"), F.lit(0)).cast("long")}
    for name in added:
        while name in docs.columns:
            name += "_"
        names.append(name)
    same = [left.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return own.select(*same, *(v.alias(c) for v, c in zip(added.values(), names)))


def body_of(own: Column, c: Column) -> Column:
    """A chunk's bytes, the last line bare."""
    return F.concat(F.array_join(F.slice(own, c["pos"] + 1, c["n"] - 1), ""), bare(F.get(own, c["pos"] + c["n"] - 1)))


def merged(ranges: Column) -> Column:
    """Ranges (pos, end) as few disjoint ones."""

    def step(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.array(F.struct(last["pos"].alias("pos"), F.greatest(last["end"], r["end"]).alias("end")))
        return F.when((F.size(done) > 0) & (r["pos"] <= last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(RANGES), step)


def without(own: Column, gone: Column) -> Column:
    """(n, text): how many lines are in the disjoint ranges gone, and the text of the others."""
    at = F.flatten(F.transform(gone, lambda g: F.sequence(g["pos"], g["end"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), at)
    return let(stay, lambda s: F.struct((F.size(own) - F.size(s)).alias("n"), F.array_join(F.transform(s, lambda i: F.get(own, i)), "").alias("text")))
