"""URL filters: fixed host and path rules first, mined association rules for the rest.

Mining: a labelled page's URL becomes a set of tokens (scheme, host suffixes and labels, path segments, extension, query
keys, fragment) plus a token for a bad label; Spark's FP-growth finds frequent token sets and the rules whose consequent
is the bad token. Rules are kept from a least support and confidence, and a rule is dropped if a shorter one that it
contains is at least as confident. Every token with enough bad pages is mined (no rule can hold another), so support alone
bounds the work: at most (tokens of a URL) / min_support tokens. Tokens on exactly the same rows go in as one, told by
two hashes over the distinct token sets, and stay one class in the rules: a rule needs one token of each of its classes, which is what all its
spellings together say, so it is never written out by them. A token of all rows
changes no confidence, so it makes a rule of its own at most. The result is that of all token sets.

Matching: each rule is listed under its rarest class in an inverted index; a URL looks up its tokens' classes, and the listed
rules are checked for their other classes. The index is bounded by support, its size is counted, and it goes to the workers as a closure; over
MOST_TOKENS names in rules are an error (raise min_support), never rules left out.
Defined results: a null URL, or one without "://", has empty host and path and no tokens of either; labels are joined by
the page's id, and several labels of one page count as bad if one is; pages that share an id or a URL are judged one by one, and count one by one in mining; without labels
nothing is mined and all is allowed. Of several rules that fit, the most confident speaks, then that of most support, then the last in the order of its
names. A host gives suffixes of HOST_LABELS labels at most, so the tokens of a URL take no more than a fixed multiple of its length. All columns of pages keep their names and values;
added columns get underscores where pages has their name. Empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
import string
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgelight.llm.common import materialize, set_aside

BAD = "#bad"
MIN_SUPPORT = 0.002
MIN_PAGES = 5
MIN_CONFIDENCE = 0.6
HOST_LABELS = 16
MOST_TOKENS = 1_000_000
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host (or a subdomain) and path prefix fit; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later, longer ones win
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        name = F.when(fits, F.lit(own + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def url_tokens(url: str | None) -> set[str]:
    if url is None or "://" not in url:
        return set()
    scheme, rest = url.split("://", 1)
    main, _, fragment = rest.partition("#")
    main, _, query = main.partition("?")
    host, _, path = main.partition("/")
    labels = [x for x in host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).split(".") if x]
    found = {f"scheme={scheme.lower()}"} | {f"label={x}" for x in labels} | {"suffix=" + ".".join(labels[i:]) for i in range(max(0, len(labels) - HOST_LABELS), len(labels))}
    parts = [x for x in path.split("/") if x]
    found |= {f"part={'0' if x.isdigit() else x}" for x in parts} | {f"depth={min(len(parts), 5)}"}
    if parts and (m := re.search(r"\.(\w+)$", parts[-1])):
        found.add(f"ext={m[1].lower()}")
    found |= {"key=" + x.split("=", 1)[0] for x in query.split("&") if x}
    if fragment:
        found.add("fragment")
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_udf(url: pd.Series) -> pd.Series:
    return url.map(lambda u: sorted(url_tokens(u)))


def mine(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, vocabulary: int | None = None, min_pages: int = MIN_PAGES) -> list[dict]:
    """Pruned rules: classes (frozensets of tokens that stand for each other), support, confidence, key (the rarest class). `vocabulary` is an error bound: more tokens to mine than that are refused, never left out."""
    from pyspark.ml.fpm import FPGrowth

    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).where("url is not null").join(known, "id").select(tokens_udf("url").alias("tokens"), "bad")
    rows = materialize(rows, "url-tokens")
    n_bad = F.sum(F.col("bad").cast("long")).alias("b")
    distinct = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), n_bad)
    marked = distinct.select(F.explode("tokens").alias("token"), "n", "b", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(1), "tokens").alias("h2"))
    per_token = marked.groupBy("token").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), n_bad).head()
    n, b = totals.n, totals.b or 0
    if not n or not b:
        return []
    least = max(math.ceil(min_support * n - 1e-9), min(n, min_pages), 1)
    usable = per_token.where(F.col("b") >= least).collect()  # bounded by support
    if vocabulary is not None and len(usable) > vocabulary:
        raise ValueError(f"{len(usable)} tokens to mine; {vocabulary} are allowed")
    freq = {r.token: r.n for r in usable}
    same: dict[tuple, list[str]] = {}
    for r in sorted(usable, key=lambda r: r.token):
        same.setdefault((r.n, r.h1, r.h2), []).append(r.token)
    classes = {own[0]: own for own in same.values()}
    mined = frozenset(t for t in classes if freq[t] < n)
    found = [(frozenset([t]), r.b, n) for r in usable if (t := r.token) in classes and r.n == n]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def basket(tokens: pd.Series, bad: pd.Series) -> pd.Series:
        return pd.Series([[t for t in own if t in mined] + ([BAD] if is_bad else []) for own, is_bad in zip(tokens, bad)], dtype=object)

    if mined:
        # half a row less, so that rounding cannot raise the least count
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(rows.select(basket("tokens", "bad").alias("items")))
        sets = materialize(model.freqItemsets.select(F.array_sort(F.array_remove("items", BAD)).alias("own"), F.array_contains("items", BAD).alias("bad"), "freq"), "token-sets")
        right = sets.where("bad and size(own) > 0").select("own", F.col("freq").alias("b"))
        both = right.join(sets.where("not bad").select("own", F.col("freq").alias("n")), "own")
        found += [(frozenset(r.own), r.b, r.n) for r in both.where(F.col("b") >= F.col("n") * (min_confidence - 1e-12)).collect()]
    rules: list[dict] = []
    index: dict[str, list] = {}  # kept class rules by their first token
    for own, right_n, all_n in sorted(found, key=lambda r: (len(r[0]), -r[1] / r[2], sorted(r[0]))):
        confidence = right_n / all_n
        if confidence < min_confidence or any(k < own and c >= confidence for t in own for k, c in index.get(t, ())):
            continue
        index.setdefault(min(own), []).append((own, confidence))
        rules.append({"classes": frozenset(frozenset(classes[t]) for t in own), "confidence": confidence, "support": right_n / n, "key": frozenset(classes[min(own, key=lambda t: (freq[t], t))])})
    return rules


def written(rules: list[dict]) -> dict[frozenset, float]:
    """Rules by every one of their spellings, with confidences; for tests and small sets of rules."""
    return {frozenset(names): r["confidence"] for r in rules for names in product(*r["classes"])}


def inverted(rules: list[dict]) -> tuple[dict[str, int], dict[int, list]]:
    """(number of each token's class, rules (classes, confidence, support) by the number of their rarest class)."""
    size = sum(len(c) for r in rules for c in r["classes"])
    if size > MOST_TOKENS:
        raise ValueError(f"rules hold {size} names; {MOST_TOKENS} are allowed: raise min_support")
    numbers = {c: i for i, c in enumerate(sorted({c for r in rules for c in r["classes"]}, key=sorted))}
    index: dict[int, list] = {}
    for r in rules:
        index.setdefault(numbers[r["key"]], []).append((frozenset(numbers[c] for c in r["classes"]), r["confidence"], r["support"]))
    return {t: i for c, i in numbers.items() for t in c}, index


def judge(pages: DataFrame, rules: list[dict], url_col: str = "url") -> DataFrame:
    """pages, then host, path, rule, verdict, mined_rule and confidence."""
    class_of, index = inverted(rules)

    @F.pandas_udf("tokens string, confidence double")
    def matched(url: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for u in url:
            own: dict[int, str] = {}  # of tokens that stand for each other the last by name speaks
            for t in url_tokens(u):
                if (i := class_of.get(t)) is not None:
                    own[i] = max(t, own.get(i, t))
            hits = [(c, s, sorted(own[i] for i in rule)) for i in own for rule, c, s in index.get(i, ()) if rule <= own.keys()]
            best = max(hits, default=None)
            names.append(" ".join(best[2]) if best else None)
            scores.append(best[0] if best else None)
        return pd.DataFrame({"tokens": names, "confidence": pd.Series(scores, dtype="float64")})

    plain, back = set_aside(pages, url_col)
    url = F.col(url_col)
    rule, verdict = best_rule(F.col("host_"), F.col("path_"))
    out = plain.withColumn("host_", host_of(url)).withColumn("path_", path_of(url)).withColumn("mined_", matched(url))
    method = F.when(F.col("mined_.tokens").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    added = {"host": F.col("host_"), "path": F.col("path_"), "rule": rule, "verdict": F.coalesce(verdict, method), "mined_rule": F.col("mined_.tokens"), "confidence": F.col("mined_.confidence")}
    return back(out.select(*plain.columns, *(v.alias(c) for c, v in added.items())))


def all_rules(baskets: list[tuple[set, bool]], min_support: float, min_confidence: float) -> dict[frozenset, float]:
    """Brute force over all token sets, for tests."""
    n, found = len(baskets), {}
    for size in range(1, max((len(t) for t, _ in baskets), default=0) + 1):
        for own in {frozenset(c) for t, _ in baskets for c in combinations(sorted(t), size)}:
            have = [bad for t, bad in baskets if own <= t]
            if have and sum(have) >= min_support * n and sum(have) / len(have) >= min_confidence:
                found[own] = sum(have) / len(have)
    return found
