"""Registered queries of the corpus operators, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelight.llm import oracles
from edgelight.llm import pii, simhash, url_rules, warc
from edgelight.llm.alignment import align
from edgelight.llm.common import materialize, scratch_path, table
from edgelight.llm.decontaminate import decontaminate
from edgelight.llm.filter_audit import audit
from edgelight.llm.langid import held_out, identify
from edgelight.llm.line_dedup import dedup_lines
from edgelight.llm.mixing import mix
from edgelight.llm.near_dedup import near_duplicates
from edgelight.llm.token_counts import count_tokens
from edgelight.llm.vptree import nearest
from edgelight.operators.spread import spread

TOKEN_LIMIT = 512


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_removed", "chars_removed", "text")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules.mine(pages, table(spark, sf_dir, "labels"))
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = materialize(warc.write_bundles(pages, folder), "warc-index")
    back = warc.read_bundles(index, folder, payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    # a folder in edgelight.token.cache keeps counts between runs
    cache = spark.conf.get("edgelight.token.cache", None)
    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), cache=cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_spans=False)
    return found.select("doc_id", "decon.n_words", "decon.n_hit", "decon.n_items", "decon.items_sha256", (F.col("decon.n_hit") > 0).alias("contaminated"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")), k=3, num=85, den=100)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = pii.detect(docs, model=pii.train(docs))
    counts = [n_of(k) for k in pii.KINDS]
    spans = F.array_sort(F.concat("base", "added"))
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def n_of(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def queries() -> dict:
    own = (op1_language_id, op2_line_dedup, op3_url_rules, op4_nearest, op5_warc, op6_token_counts, op7_mix, op8_decontaminate, op9_near_duplicates, op10_pii)
    own += (op11_filter_audit, op12_token_alignment, op13_simhash)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
