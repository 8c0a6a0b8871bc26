"""Personal data by base patterns and boosted candidates. DataFrame and Spark ML functions only.

Base: the leftmost non-overlapping matches of each kind that pass the kind's check (email; ip with parts up to 255; card
with 12 to 19 digits and a right check digit; phone with 9 to 15 digits). The patterns are written for a backtracking
matcher so that they take linear time and constant stack on any text, with the same matches.

Added: high-recall generators propose overlapping candidates (numbers with separators, addresses written with "at",
credentials). Features of format (lengths, digit, upper case and separator counts, distinct characters, checks) and of
context (words before, neighbouring characters) go to gradient boosted trees. All distinct candidates of the table outside
base spans (others cannot be added) are counted by features and label, and from these counts come the bins of the numbers,
the trees and the thresholds: nothing is sampled. Labels are those of validators that reach beyond the base patterns:
addresses valid once "(at)" and "(dot)" are undone, national phone numbers by format or by words before, credentials by the
entropy of their value. Each generator weighs the same in the trees. Its threshold is the lowest score that keeps PRECISION
over all its candidates, each scored by trees of the half it is not in; a generator that never reaches it adds nothing. The
trees that judge are those of all candidates. Candidates over their threshold that overlap no base span (and no earlier, better candidate) are
added. The trees become a Column expression, so scoring stays inside one projection, without a shuffle.

Positions are code points, end exclusive. They come from the lengths between matches: a prefix sum in two levels, so a
text with many matches costs no square. Defined results: null and empty text have no spans; repeated rows are judged
alike; unless each half has candidates of both labels nothing is added.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelight.llm.common import materialize
from edgelight.llm.line_dedup import let

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
NAME = "A-Za-z0-9-"
#: A run that a match would enter in its middle has been tried from its start (or the last match ended there)
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{NAME}]++\.[{NAME}](?:[{NAME}.](?<=[{NAME}]|[{NAME}]\.(?=[{NAME}])))*+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9 -](?<=[0-9]|[0-9][ -](?=[0-9])))++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

AT, DOT = r"(?i:\(at\)|\[at\])", r"(?i:\(dot\)|\[dot\])"
#: Ends of host names that a written-out address must have to count as right
ENDS = "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|example|test|invalid|local"
PHONE_WORDS = r"(?i)(?:phone|tel|telephone|call|mobile|cell|fax|dial|ring|whatsapp|sms)(?: (?:number|no|us|me|at|on))*[^A-Za-z0-9]{0,4}$"
#: National phone numbers that need no word before: 3-3-4, or from 0 in groups
NATIONAL = r"^(?:\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{1,5}\)?(?:[ .-]{1,2}[0-9]{2,8}){1,5})$"
DATE = r"^(?:(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ](?:19|20)[0-9]{2})"
#: Bits a character that the value of a credential must have; the word password says so much that it needs less
ENTROPY, PASSWORD_ENTROPY = 3.0, 2.5

#: Generators of candidates: name, whether a text can have one, pattern
GENERATORS = (
    ("contact", r"(?i)@|[(\[]at[)\]]", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++ ?(?:@|{AT}) ?[{NAME}]++ ?(?:\.|{DOT}) ?[A-Za-z]{{2,24}}(?:(?:\.| ?{DOT} ?)[{NAME}]*[A-Za-z])*+"),
    ("number", r"[0-9]", r"[+(]?[0-9](?:[0-9 ().-](?<=[0-9]|[0-9)][ ().-]{1,2}(?=[ ().-]?[0-9(])))++"),
    ("secret", r"(?i)password|passwd|token|secret|api.?key|AKIA", r"(?:(?i:password|passwd|token|secret|api.?key) ?[=:] ?[\"']?[A-Za-z0-9/+_.-]{6,128}|AKIA[0-9A-Z]{12,20})"),
)
SPAN = "array<struct<start:int,end:int,body:string>>"
PRECISION = 0.98
TREES, DEPTH = 12, 4
#: Parts of equal size of each generator's candidates, between which the trees split the numbers among FEATURES
BINS = 32
FEATURES = ("generator", "length", "digits", "upper", "lower", "separators", "dots", "distinct", "groups", "plus", "luhn", "octets", "assigned", "hex_tail", "word_before", "letter_before", "letter_after", "line_start", "written_out", "known_end", "phone_format", "phone_word", "mixed")
NUMBERS = FEATURES[1:9]


def found(text: Column, pattern: str) -> Column:
    """All matches of pattern: array of (start, end, body)."""
    bodies = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def placed(b: Column, gap: Column) -> Column:
        steps = F.transform(b, lambda x, i: F.get(gap, i) + F.length(x))
        zero = F.lit(0)

        def starts(s: Column) -> Column:
            groups = F.transform(F.sequence(zero, F.greatest(F.ceil(F.size(s) / 256).cast("int") - 1, zero)), lambda g: F.aggregate(F.slice(s, g * 256 + 1, 256), zero, lambda t, x: t + x))

            def start(g: Column, i: Column) -> Column:
                k = F.floor(i / 256).cast("int")
                return F.aggregate(F.slice(g, 1, k), zero, lambda t, x: t + x) + F.aggregate(F.slice(s, k * 256 + 1, i - k * 256), zero, lambda t, x: t + x)

            return let(groups, lambda g: F.transform(b, lambda x, i: let(start(g, i) + F.get(gap, i), lambda a: F.struct(a.alias("start"), (a + F.length(x)).alias("end"), x.alias("body")))))

        return let(steps, starts)

    return let(bodies, lambda b: F.when(F.size(b) == 0, F.array().cast(SPAN)).otherwise(let(between, lambda gap: placed(b, gap))))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def octets_fit(x: Column) -> Column:
    return F.regexp_like(x, F.lit(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))


def card_fits(x: Column) -> Column:
    return F.length(digits(x)).between(12, 19) & F.call_function("luhn_check", digits(x))


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, kind, end), by start and kind."""
    parts = []
    for i, (pattern, could, check) in enumerate(
        (
            (EMAIL, text.contains("@"), lambda x: F.lit(True)),
            (IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), octets_fit),
            (CARD, F.regexp_like(text, F.lit("[0-9][ -]?[0-9]")), card_fits),
            (PHONE, text.contains("+"), lambda x: F.length(digits(x)).between(9, 15)),
        )
    ):
        spans = F.filter(found(text, pattern), lambda s: check(s["body"]))
        own = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), F.lit(KINDS[i]).alias("kind"), s["end"].alias("end")))
        parts.append(F.when(could, own).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")))
    return F.array_sort(F.concat(*parts))


def candidates(text: Column) -> Column:
    """Array of (start, end, body, generator, before, after): what stands before (up to 24 characters) and after (1)."""
    parts = []
    for i, (_, could, pattern) in enumerate(GENERATORS):
        around = lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["body"].alias("body"),
            F.lit(i).alias("generator"),
            F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("before"),
            F.substring(text, s["end"] + 1, F.lit(1)).alias("after"),
        )
        kind = "array<struct<start:int,end:int,body:string,generator:int,before:string,after:string>>"
        parts.append(F.when(F.regexp_like(text, F.lit(could)), F.transform(found(text, pattern), around)).otherwise(F.array().cast(kind)))
    return F.concat(*parts)


def features(c: Column) -> list[Column]:
    """FEATURES of a candidate."""
    x, before = c["body"], c["before"]

    def count(pattern: str) -> Column:
        return F.regexp_count(x, F.lit(pattern))

    flags = [
        F.call_function("luhn_check", digits(x)) & (F.length(digits(x)) >= 12),
        octets_fit(x),
        F.regexp_like(x, F.lit("[=:]")),
        F.regexp_like(x, F.lit("[0-9a-f]{12,}\"?$")),
        F.regexp_like(before, F.lit(r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|card|ssn|iban|account|password|token|key|secret)[^A-Za-z]{0,4}$")),
        F.regexp_like(before, F.lit("[A-Za-z]$")),
        F.regexp_like(c["after"], F.lit("[A-Za-z]")),
        (F.length(before) == 0) | before.endswith("\n"),
        F.regexp_like(x, F.lit(f"{AT}|{DOT}")),
        F.regexp_like(x, F.lit(rf"[^ ](?:{ENDS})$")),
        F.regexp_like(x, F.lit(NATIONAL)),
        F.regexp_like(before, F.lit(PHONE_WORDS)),
        F.regexp_like(x, F.lit(r"[=:] ?[\"']?(?=[^A-Za-z]*[A-Za-z])[^0-9]*[0-9]")),
    ]
    numbers = [c["generator"], F.length(x), F.length(digits(x)), count("[A-Z]"), count("[a-z]"), count("[ ()-]"), count(r"\."), F.size(F.array_distinct(F.split(x, ""))), count("[0-9]+"), x.startswith("+").cast("int")]
    return [n.cast("double") for n in [*numbers, *(f.cast("int") for f in flags)]]


def entropy(x: Column) -> Column:
    """Bits a character of x by its own character frequencies."""

    def bits(total: Column, ch: Column) -> Column:
        return let((F.length(x) - F.length(F.replace(x, ch, F.lit("")))) / F.length(x), lambda p: total - p * F.log2(p))

    return F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0.0), bits)


def strict(c: Column) -> Column:
    """The label of a candidate in the training sample: whether a strict validator takes all of it. Base patterns play no part in it."""
    x, before = c["body"], c["before"]

    def is_address(plain: Column) -> Column:
        return F.regexp_like(plain, F.lit(rf"^[{LOCAL}]*[A-Za-z0-9][{LOCAL}]*@[{NAME}]+(?:\.[{NAME}]+)*\.(?:{ENDS})$"))

    contact = is_address(F.regexp_replace(F.regexp_replace(x, f" ?{AT} ?| ?@ ?", "@"), f" ?{DOT} ?", "."))
    n = F.length(digits(x))
    phone = (F.regexp_like(x, F.lit(NATIONAL)) & n.between(9, 15)) | (F.regexp_like(before, F.lit(PHONE_WORDS)) & n.between(7, 15))
    number = phone & ~F.regexp_like(x, F.lit(DATE))

    def is_value(v: Column) -> Column:
        mixed = F.regexp_like(v, F.lit("[A-Za-z]")) & F.regexp_like(v, F.lit("[0-9]"))
        least = F.when(F.regexp_like(x, F.lit("(?i)^passw")), F.lit(PASSWORD_ENTROPY)).otherwise(F.lit(ENTROPY))
        return F.regexp_like(v, F.lit("^[0-9a-f]{16,}$")) | (mixed & (entropy(v) >= least))

    secret = F.regexp_like(x, F.lit("^AKIA[0-9A-Z]{16}$")) | (F.regexp_like(x, F.lit("[=:]")) & let(F.regexp_extract(x, "[=:] ?[\"']?(.*)$", 1), is_value))
    return F.when(c["generator"] == 0, contact).when(c["generator"] == 1, number).otherwise(secret)


def blocks_of(spans: Column) -> Column:
    """spans in runs of 256 with their bounds (lo, hi, items), so that a look-up passes over most of them."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / 256).cast("int")), lambda g: F.slice(spans, g * 256 + 1, 256))
    bounds = lambda own: F.struct(F.array_min(F.transform(own, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(own, lambda s: s["end"])).alias("hi"), own.alias("items"))
    return F.when(F.size(spans) > 0, F.transform(runs, bounds))


def touched(blocks: Column, c: Column, also=lambda s: F.lit(True)) -> Column:
    """Whether an item of blocks_of() overlaps c and fits."""
    inside = lambda run: F.exists(run["items"], lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]) & also(s))
    return F.coalesce(F.exists(blocks, lambda run: (run["lo"] < c["end"]) & (c["start"] < run["hi"]) & inside(run)), F.lit(False))


def outside(spans: Column, base: Column) -> Column:
    """Of spans, those that touch no base span."""
    return F.when(F.size(base) == 0, spans).otherwise(let(blocks_of(base), lambda own: F.filter(spans, lambda c: ~touched(own, c))))


def tree_column(text: str, values: list[Column], cuts: dict[int, list[float]]) -> Column:
    """A Column from the printed form of one regression tree over values, of which some were put into bins at cuts."""
    rows = [(len(line) - len(line.lstrip()), line.strip()) for line in text.splitlines() if re.match(r"\s*(If|Else|Predict)", line)]
    at = 0

    def node() -> Column:
        nonlocal at
        line = rows[at][1]
        at += 1
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        k, cut = int(feature), float(cut)
        low = node()
        at += 1  # the matching Else
        # bins up to the k-th hold the values up to the k-th cut
        return F.when(values[k] <= (cuts[k][int(cut)] if k in cuts else cut), low).otherwise(node())

    return node()


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """FEATURES, label and half of every distinct candidate outside base spans; `n` of them share a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(F.explode(let(candidates(text), lambda c: F.when(F.size(c) > 0, outside(c, base_spans(text))))).alias("c"))
    # distinct ones, so that a hot candidate has no more weight than others
    own = ("generator", "body", "before", "after")
    alone = every.select(*(F.col(f"c.{k}").alias(k) for k in own)).distinct().select(F.struct(*own).alias("c"), F.pmod(F.xxhash64(*own), F.lit(2)).alias("half"))
    rows = alone.select("half", strict(F.col("c")).cast("double").alias("label"), *(f.alias(k) for f, k in zip(features(F.col("c")), FEATURES)))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, text_col: str = "text", precision: float = PRECISION):
    """(score of a candidate as a function to a Column, thresholds by generator), or None."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Bucketizer, VectorAssembler

    seen = materialize(labelled(docs, text_col), "candidates")
    steps = [i / BINS for i in range(1, BINS)]
    sizes = seen.groupBy("generator").agg(F.sum("n").alias("n"), *(F.percentile(k, steps, F.col("n")).alias(k) for k in NUMBERS)).collect()  # a row each generator
    if not sizes:
        return None
    cuts = {FEATURES.index(k): sorted({float(int(v)) for r in sizes for v in r[k]}) for k in NUMBERS}
    bins = Bucketizer(splitsArray=[[-math.inf, *(c + 0.5 for c in cuts[FEATURES.index(k)]), math.inf] for k in NUMBERS], inputCols=list(NUMBERS), outputCols=[f"{k}_bin" for k in NUMBERS])
    inputs = [f"{k}_bin" if k in NUMBERS else k for k in FEATURES]
    # each generator weighs the same, however many candidates it has; an order of their own makes sums the same in every run
    weight = F.lit(0.0)
    for r in sizes:
        weight = F.when(F.col("generator") == r.generator, F.col("n") / F.lit(float(r.n))).otherwise(weight)
    keys = ["half", "label", *inputs]
    # sums, since the trees would not keep the order of what Bucketizer calls nominal
    binned = bins.transform(seen).withColumns({f"{k}_bin": F.col(f"{k}_bin") + F.lit(0.0) for k in NUMBERS})
    rows = binned.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("weight", weight)
    rows = materialize(VectorAssembler(inputCols=inputs, outputCol="v").transform(rows), "candidate-bins").repartition(2, *keys).sortWithinPartitions(*keys)
    if {(r.half, r.label) for r in rows.select("half", "label").distinct().collect()} != {(h, y) for h in (0, 1) for y in (0.0, 1.0)}:
        return None

    def fitted(part: DataFrame):
        # so many bins that the splits come from all rows
        model = GBTClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=1 << 15).fit(part)
        trees = [(w, t.toDebugString) for w, t in zip(model.treeWeights, model.trees)]

        def score(values: list[Column]) -> Column:
            total = F.lit(0.0)
            for w, t in trees:
                total = total + F.lit(float(w)) * tree_column(t, values, cuts)
            return total

        return score

    # calibration: every candidate by the trees of the other half; at each score step, the share of right ones among all at or over it
    values = [F.col(k) for k in FEATURES]
    other = F.when(F.col("half") == 0, fitted(rows.where("half = 1"))(values)).otherwise(fitted(rows.where("half = 0"))(values))
    marks = seen.select("generator", "n", (F.col("label") * F.col("n")).alias("right"), F.floor(other * 20).alias("step")).groupBy("generator", "step").agg(F.sum("right").alias("right"), F.sum("n").alias("all")).collect()
    least = {}
    for g in {r.generator for r in marks}:
        right = total = 0
        for r in sorted((r for r in marks if r.generator == g), key=lambda r: -r.step):
            right, total = right + r.right, total + r["all"]
            if right >= precision * total:
                least[int(g)] = r.step / 20
            elif right < 0.5 * total:
                break
    return fitted(rows), least


def detect(docs: DataFrame, text_col: str = "text", model=None) -> DataFrame:
    """docs with `base` and `added`: arrays of (start, rank, kind, end). Columns of docs with these names give way."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    rows = docs.drop("base", "added").withColumn("base", base_spans(text))
    if not model or not model[1]:
        return rows.withColumn("added", F.array().cast(kind))
    score, cuts = model
    names = [g[0] for g in GENERATORS]

    def judged(c: Column) -> Column:
        s = let(F.array(*features(c)), lambda v: score([F.element_at(v, i + 1) for i in range(len(FEATURES))]))
        cut = F.lit(None).cast("double")
        for g, at in cuts.items():
            cut = F.when(c["generator"] == g, F.lit(float(at))).otherwise(cut)
        return F.struct(c["start"].alias("start"), (c["generator"] + len(KINDS)).alias("rank"), F.element_at(F.array(*map(F.lit, names)), c["generator"] + 1).alias("kind"), c["end"].alias("end"), s.alias("score"), cut.alias("cut"))

    def free(base: Column, over: Column) -> Column:
        """Of candidates over their threshold, those that touch no base span and no better (then earlier, longer) candidate."""
        clear = outside(over, base)
        better = lambda a, c: (a["score"] > c["score"]) | ((a["score"] == c["score"]) & ((a["start"] < c["start"]) | ((a["start"] == c["start"]) & (a["rank"] < c["rank"]))))
        return let(clear, lambda own: let(blocks_of(own), lambda runs: F.filter(own, lambda c: ~touched(runs, c, lambda a: better(a, c)))))

    over = F.array_sort(F.filter(F.transform(candidates(text), judged), lambda c: c["score"] >= c["cut"]))
    added = let(over, lambda o: free(F.col("base"), o))
    return rows.withColumn("added", F.transform(added, lambda c: F.struct(c["start"], c["rank"], c["kind"], c["end"])).cast(kind))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", model=None, mark: str = "[{}]") -> DataFrame:
    """docs with every span of text_col replaced by its kind; overlapping base spans are replaced as one, named after the first."""
    rows = detect(docs, text_col, model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.concat("base", "added"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        name = F.when(s["start"] >= state["at"], F.concat(F.lit(mark.split("{}")[0]), s["kind"], F.lit(mark.split("{}")[1]))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.concat(state["out"], gap, name).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda st: F.concat(st["out"], F.substring(text, st["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done)).drop("base", "added")
