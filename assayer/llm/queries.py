"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import hamming_search, licenses, mixing, oracles, packing, quality_model, quality_rules, secrets, simhash, toxicity, url_filter
from assayer.llm.common import labels_of, ready, table


#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed canonical URLs are those that some page carries with a tracking parameter; they are blocked."""
    pages = table(ready(spark), sf_dir, "pages")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    tracked = pages.where(F.col("url").contains("utm_source="))
    listed = tracked.select(url_filter.canonical(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("key"), F.lit("block").alias("verdict"))
    return url_filter.judge(pages, rules, listed.distinct())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out: no label can belong to it."""
    docs = table(ready(spark), sf_dir, "documents")
    rows = toxicity.scores(docs, toxicity.fit(docs, labels_of(spark, sf_dir, "toxic")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted", "sentences")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(ready(spark), sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(ready(spark), sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = ready(spark)
    return secrets.findings(table(spark, sf_dir, "documents"), secrets.train(secrets.example_findings(spark)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digest(packing.pack(table(ready(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ready(spark), sf_dir, "embeddings")
    return hamming_search.top_k(rows, rows.where("vec_id % 100 = 0"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(ready(spark), sf_dir, "documents"), similarity=None))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(ready(spark), sf_dir, "documents")))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = ready(spark)
    return quality_model.quality(table(spark, sf_dir, "documents"), labels_of(spark, sf_dir, "quality"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_toxicity, op3_quality_rules, op4_mixing, op5_secrets, op6_packing, op7_hamming_top_k, op8_simhash_dedup,
        op9_licenses, op10_quality_model,
    )
}
SQL = oracles.SQL
