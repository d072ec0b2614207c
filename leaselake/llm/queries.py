"""The registered queries of these operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaselake.llm import (
    bpe, conversations, fingerprint, hard_negatives, langid, mixing, pii, quality, sharding, simhash, substrings, toxicity, url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(documents(spark, sf_dir))


@query
def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


_SQL["op2_quality_cascade"] = quality.SQL


@query
def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(
        documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_toxicity_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op6_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


@query
def op7_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans"
    )


#: Domains of the sources, as a pattern each; other sources are a domain of their own.
DOMAINS = {"web": "^src[0-9]$", "reference": "^src1[0-4]$", "forum": "^src1[5-9]$"}
#: Target weights of nodes: domain, language, source.
MIXTURE = [
    ("web", None, None, 4), ("reference", None, None, 4), ("forum", None, None, 2),
    ("web", "en", None, 5), ("web", "de", None, 2), ("reference", "en", None, 3), ("reference", "es", None, 3),
    ("web", "en", "src0", 3), ("reference", "en", "src10", 6), ("forum", "fr", "src15", 4),
]
MIX_PERCENT = 80
MIX_EPOCHS = 3


def domain_of(source: str = "source"):
    out = F.lit("other")
    for name, pattern in reversed(DOMAINS.items()):
        out = F.when(F.col(source).rlike(pattern), name).otherwise(out)
    return out


def mixture(spark: SparkSession) -> DataFrame:
    """The weights as a table of literal rows, so that no Python runs on the executors for it."""
    rows = ", ".join("({}, {}, {}, {})".format(*("null" if v is None else repr(v) for v in row)) for row in MIXTURE)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(domain, lang, source, weight)")


@query
def op8_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", "lang", "source", mixing.token_count(F.col("text")).alias("words")
    )
    mixed = mixing.select(docs, mixture(spark), MIX_PERCENT, MIX_EPOCHS, domain_of(), tokens=F.col("words"))
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken")


_SQL["op8_hierarchical_mix"] = mixing.oracle(
    "CASE " + " ".join(f"WHEN regexp_matches(source, '{p}') THEN '{n}'" for n, p in DOMAINS.items()) + " ELSE 'other' END",
    MIXTURE, MIX_PERCENT, MIX_EPOCHS,
)


@query
def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.assign_shards(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query
def op10_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


@query
def op11_lempel_ziv_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_SQL["op11_lempel_ziv_dedup"] = substrings.SQL


@query
def op12_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op13_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % 50 == 0)


_SQL["op13_kronecker_negatives"] = hard_negatives.SQL


_QUERIES["pipeline"] = corpus_pipeline.run
